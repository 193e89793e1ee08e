"""Queries of decisions and loosely typed values, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import whole_word
from lodestone.operators import decisions, values
from lodestone.plans.registry import query, table

WORDS = r"([\p{L}\p{N}]+)"
SQL_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
NEXT = f"w AS (SELECT conv_id, turn, list_distinct({SQL_W}) AS t FROM conversations), p AS (SELECT a.conv_id, a.turn, a.t AS x, b.t AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _words(c="text"):
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORDS)))


def _next(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", _words().alias("x"))
    return rows.join(rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"])


@query("SELECT event_id, event_type FROM events WHERE CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END >= 2")
def quality_filter(spark, d):
    return decisions.of_quality(table(spark, d, "events"), "event_type", "click", ("view", "click", "purchase")).select("event_id", "event_type")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def type_filter(spark, d):
    return table(spark, d, "documents").where(F.col("lang") == "de").select("doc_id", "lang")


@query("""SELECT 'kind' AS by, o_orderpriority AS value, count(*) AS n, round(avg(o_totalprice), 4) AS confidence, sum(o_custkey)::BIGINT AS size, round(avg(o_custkey), 4) AS mean_size FROM orders GROUP BY 2
          UNION ALL SELECT 'quality', o_orderstatus, count(*), round(avg(o_totalprice), 4), sum(o_custkey)::BIGINT, round(avg(o_custkey), 4) FROM orders GROUP BY 2
          UNION ALL SELECT 'all', NULL, count(*), round(avg(o_totalprice), 4), sum(o_custkey)::BIGINT, round(avg(o_custkey), 4) FROM orders""")
def content_statistics(spark, d):
    out = decisions.content_statistics(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", "o_custkey")
    return out.withColumn("confidence", F.round("confidence", 4)).withColumn("mean_size", F.round("mean_size", 4))


@query("""SELECT c_custkey, (c_custkey % 256)::VARCHAR || '.' || (c_custkey % 32)::VARCHAR || '.1.1' AS host,
          c_custkey % 256 IN (10, 127) OR (c_custkey % 256 = 172 AND c_custkey % 32 BETWEEN 16 AND 31) AS private FROM customer""")
def private_hosts(spark, d):
    key = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", F.concat((key % 256).cast("string"), F.lit("."), (key % 32).cast("string"), F.lit(".1.1")).alias("host"))
    return rows.withColumn("private", decisions.private_host("host"))


@query(f"""WITH w AS (SELECT conv_id, turn, list_distinct({SQL_W}) AS t FROM conversations), q AS (SELECT conv_id, t FROM w WHERE turn = 0)
           SELECT q.conv_id, round(CASE WHEN len(q.t) = 0 THEN 0.5 ELSE coalesce(max(len(list_intersect(q.t, s.t)) / len(q.t)), 0) END, 6) AS relevance
           FROM q LEFT JOIN w s ON s.conv_id = q.conv_id AND s.turn BETWEEN 1 AND 5 GROUP BY q.conv_id, q.t""")
def source_relevance(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", _words().alias("t"))
    # the first turns of one conversation
    sources = rows.where("turn between 1 and 5").groupBy("conv_id").agg(F.collect_list("t").alias("s"))
    asked = rows.where("turn = 0").join(sources, "conv_id", "left")
    score = decisions.relevance(F.col("t"), F.coalesce("s", F.array().cast("array<array<string>>")))
    return asked.select("conv_id", F.round(score, 6).alias("relevance"))


@query(r"SELECT doc_id, (regexp_matches(lower(text), '\bder\b') OR regexp_matches(lower(text), '\bles\b')) AND NOT regexp_matches(lower(text), '\bthe\b') AS off_topic FROM documents")
def off_topic(spark, d):
    return table(spark, d, "documents").select("doc_id", decisions.off_topic("text", [whole_word("der"), whole_word("les")], [whole_word("the")]).alias("off_topic"))


@query("""WITH r AS (SELECT user_id, value / 500 AS s, row_number() OVER (PARTITION BY user_id ORDER BY value / 500 DESC, event_id) AS r FROM events)
          SELECT user_id, round(0.5 * max(CASE WHEN r = 1 THEN s END) + 0.3 * avg(s) + 0.2 * (max(CASE WHEN r = 1 THEN s END) - coalesce(max(CASE WHEN r = 2 THEN s END), 0)), 6) AS confidence FROM r WHERE r <= 3 GROUP BY 1""")
def ranked_confidence(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("value") / 500).alias("s"))
    return decisions.rank_confidence(rows, ["user_id"], "s", "event_id").withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {NEXT}, s AS (SELECT conv_id, turn, x, y, len(list_intersect(x, y)) AS c, len(x) + len(y) - len(list_intersect(x, y)) AS u,
             list_has_any(list_intersect(x, ['the', 'les', 'der']), list_intersect(y, ['the', 'les', 'der'])) OR (len(list_intersect(x, ['the', 'les', 'der'])) = 0 AND len(list_intersect(y, ['the', 'les', 'der'])) = 0) AS i FROM p),
           v AS (SELECT *, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.5 ELSE 0.4 * c / u + 0.4 * c / len(x) + 0.2 * i::INTEGER END AS score FROM s)
           SELECT conv_id, turn, round(score, 6) AS score, len(x) = 0 OR len(y) = 0 OR score >= 0.3 OR (c / u >= 0.2 AND i) AS match FROM v""")
def question_matches(spark, d):
    found = _next(spark, d).withColumn("m", decisions.question_match(F.col("x"), F.col("y"), ["the", "les", "der"]))
    return found.select("conv_id", "turn", F.round("m.score", 6).alias("score"), "m.match")


@query(f"""WITH {NEXT}, m AS (SELECT conv_id, turn, list_filter(x, lambda w: length(w) >= 6) AS k, list_filter(x, lambda w: length(w) < 6) AS g, y FROM p),
           s AS (SELECT conv_id, turn, CASE WHEN len(k) > 0 THEN len(list_intersect(k, y)) / len(k) ELSE 1 END AS a, CASE WHEN len(g) > 0 THEN len(list_intersect(g, y)) / len(g) ELSE 1 END AS b FROM m)
           SELECT conv_id, turn, round(0.7 * a + 0.3 * b, 6) AS coverage, 0.7 * a + 0.3 * b >= 0.3 AND a > 0 AS passed FROM s""")
def coverage_checks(spark, d):
    long, short = F.filter("x", lambda w: F.length(w) >= 6), F.filter("x", lambda w: F.length(w) < 6)
    found = _next(spark, d).withColumn("c", decisions.coverage_check(long, short, F.col("y")))
    return found.select("conv_id", "turn", F.round("c.coverage", 6).alias("coverage"), "c.passed")


@query("SELECT event_id, coalesce(value / 500, 0.5) >= CASE event_type WHEN 'click' THEN 0.1 WHEN 'purchase' THEN 0.4 ELSE 0.28 END AS passed FROM events")
def relevance_gate(spark, d):
    rows = table(spark, d, "events").withColumn("s", F.col("value") / 500)
    return decisions.similarity_gate(rows, "s", "event_type", {"click": 0.1, "purchase": 0.4}).select("event_id", "passed")


@query(r"""WITH n AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: x::DOUBLE) AS n FROM conversations),
           s AS (SELECT a.conv_id, a.turn, CASE WHEN len(a.n) = 0 THEN 1 ELSE len(list_filter(a.n, lambda e: len(list_filter(b.n, lambda v: abs(v - e) <= 0.01 * greatest(abs(e), 1e-9))) > 0)) / len(a.n) END AS accuracy
             FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
           SELECT conv_id, turn, round(accuracy, 6) AS accuracy, CASE WHEN accuracy >= 0.95 THEN 'exact' WHEN accuracy >= 0.7 THEN 'high' WHEN accuracy >= 0.4 THEN 'partial' ELSE 'low' END AS level FROM s""")
def numeric_accuracy(spark, d):
    n = F.transform(F.regexp_extract_all("text", F.lit("([0-9]+)")), lambda x: x.cast("double"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", n.alias("n"))
    both = rows.join(rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("n").alias("m")), ["conv_id", "turn"])
    return both.select("conv_id", "turn", decisions.numeric_accuracy(F.col("m"), F.col("n")).alias("a")).select("conv_id", "turn", F.round("a.accuracy", 6).alias("accuracy"), "a.level")


@query("SELECT doc_id, greatest(0, 1 - 0.2 * ((length(text) < 200)::INTEGER + (NOT contains(text, chr(10)))::INTEGER + (NOT regexp_matches(text, '[0-9]'))::INTEGER))::DOUBLE AS accuracy FROM documents")
def structural_accuracy(spark, d):
    t = F.col("text")
    score = decisions.structural_accuracy(F.length(t) < 200, ~t.contains("\n"), ~t.rlike("[0-9]"))
    return table(spark, d, "documents").select("doc_id", F.round(score, 6).alias("accuracy"))


@query("""WITH p AS (SELECT conv_id, turn, text, 3 + regexp_matches(text, '[0-9]')::INTEGER + regexp_matches(text, '[.!?:;,]')::INTEGER + (contains(lower(text), 'the')::INTEGER + contains(lower(text), 'and')::INTEGER + contains(lower(text), 'tion')::INTEGER > 2)::INTEGER + (turn > 2)::INTEGER AS n FROM conversations)
          SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'poor' WHEN n >= 7 THEN 'excellent' WHEN n >= 6 THEN 'very good' WHEN n >= 5 THEN 'good' WHEN n >= 4 THEN 'fair' ELSE 'poor' END AS quality FROM p""")
def answer_quality(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", decisions.answer_quality("text", F.col("turn"), ["the", "and", "tion"]).alias("quality"))


@query("SELECT least(count(*) / 10, 1.0) AS relevance, 0.8 AS completeness, (least(count(*) / 10, 1.0) + 0.8) / 2 AS confidence FROM nation WHERE n_regionkey = 1")
def result_quality(spark, d):
    rows = table(spark, d, "nation").where("n_regionkey = 1")
    return decisions.result_quality(rows, len(rows.columns) + 1)


@query("SELECT event_id, round(value / 500 + least((event_type = 'click')::INTEGER * 0.1 + (user_id % 2 = 0)::INTEGER * 0.05 + contains(props, '1')::INTEGER * 0.05, 0.3), 6) AS score FROM events")
def context_boosts(spark, d):
    score = decisions.context_boost(F.col("value") / 500, F.col("event_type") == "click", F.col("user_id") % 2 == 0, F.col("props").contains("1"))
    return table(spark, d, "events").select("event_id", F.round(score, 6).alias("score"))


@query("""WITH k AS (SELECT doc_id, (len(string_split(lower(text), 'tion')) - 1)::DOUBLE AS s, contains(lower(text), 'the') AND contains(lower(text), 'and') AS hit, n_chars FROM documents)
          SELECT doc_id, round(0.4 * least(n_chars / 10000, 1) + 0.1 * s + hit::INTEGER, 6) AS score FROM k""")
def enhanced_search(spark, d):
    t = F.lower("text")
    score = decisions.enhanced_score(F.least(F.col("n_chars") / 10000, F.lit(1.0)), F.size(F.split(t, "tion")) - 1, t.contains("the") & t.contains("and"))
    return table(spark, d, "documents").select("doc_id", F.round(score, 6).alias("score"))


@query("""WITH k AS (SELECT doc_id, len(string_split(lower(text), 'tion')) - 1 AS score FROM documents) SELECT doc_id, score::INTEGER AS score, least(score / 10, 1.0) AS similarity FROM k WHERE k.score > 0 ORDER BY k.score DESC, doc_id LIMIT 30""")
def keyword_only_search(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (F.size(F.split(F.lower("text"), "tion")) - 1).alias("score"))
    return decisions.keyword_only(rows, "score", "doc_id", 30)


@query(r"""WITH h AS (SELECT o_orderkey, 'show the ' || CASE o_orderkey % 3 WHEN 0 THEN 'previous' WHEN 1 THEN 'next' ELSE 'same' END || ' clause' || CASE WHEN o_orderkey % 2 = 0 THEN ' of ' || (1000 + o_orderkey % 9000)::VARCHAR ELSE '' END AS q, o_custkey FROM orders)
           SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'previous' WHEN 1 THEN 'next' END AS direction, CASE WHEN o_orderkey % 2 = 0 THEN (1000 + o_orderkey % 9000)::VARCHAR WHEN o_custkey >= 100 THEN o_custkey::VARCHAR END AS value,
           CASE WHEN o_orderkey % 2 = 0 THEN 0.9 ELSE 0.8 END AS confidence FROM h WHERE o_orderkey % 3 < 2 AND (o_orderkey % 2 = 0 OR o_custkey BETWEEN 100 AND 99999999)""")
def step_intents(spark, d):
    key = F.col("o_orderkey")
    way = F.when(key % 3 == 0, "previous").when(key % 3 == 1, "next").otherwise("same")
    asked = F.concat(F.lit("show the "), way, F.lit(" clause"), F.when(key % 2 == 0, F.concat(F.lit(" of "), (1000 + key % 9000).cast("string"))).otherwise(""))
    rows = table(spark, d, "orders").select("o_orderkey", asked.alias("q"), F.array(F.concat(F.lit("clause "), F.col("o_custkey").cast("string")), F.lit("none")).alias("h"))
    return rows.withColumn("s", decisions.step_intent("q", F.col("h"), "previous|before", "next|after")).where("s is not null").select("o_orderkey", "s.direction", "s.value", "s.confidence")


@query("SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts)) <= 300000")
def idle_entities(spark, d):
    return decisions.idle_dropped(table(spark, d, "events"), "ts", F.lit("2024-01-20").cast("timestamp"), 300_000).select("event_id")


@query("SELECT event_type AS gate, user_id % 4 AS reason, count(*) AS n FROM events WHERE value < 50 GROUP BY 1, 2")
def rejection_reasons(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("gate"), F.when(F.col("value") < 50, "rejected").otherwise("passed").alias("decision"), (F.col("user_id") % 4).alias("reason"))
    return decisions.gate_counts(log, "gate", "decision", "reason", "rejected")


@query("""WITH q AS (SELECT [0.1 * ((i % 5) - 2) FOR i IN range(64)]::DOUBLE[] AS q), r AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r FROM embeddings),
          s AS (SELECT vec_id, label, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)) + 1e-8), 9) AS s FROM r, q WHERE r <= 100), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS k FROM s)
          SELECT label, vec_id, round(s, 6) AS similarity FROM k WHERE k <= 3""")
def similar_turns(spark, d):
    out = decisions.similar_turns(table(spark, d, "embeddings"), "label", "vec_id", "embedding", [0.1 * ((i % 5) - 2) for i in range(64)])
    return out.select("label", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN value WHEN user_id % 3 = 1 THEN 0.0 ELSE user_id::DOUBLE END AS number FROM events")
def first_numbers(spark, d):
    k = F.col("user_id") % 3
    fields = F.create_map(F.lit("amount"), F.when(k == 0, F.col("value").cast("string")).otherwise("n/a"), F.lit("total"), F.when(k == 1, "0").otherwise("-"), F.lit("id"), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", values.first_number(fields, ["amount", "total", "id"]).alias("number"))


@query("SELECT round(sum(CASE user_id % 3 WHEN 0 THEN value / 100 WHEN 1 THEN value * 42000 ELSE value END), 2) AS total, sum((user_id % 3 <> 0 OR value BETWEEN 0 AND 100)::INTEGER)::BIGINT AS valid FROM events")
def normalised_sum(spark, d):
    unit = F.when(F.col("user_id") % 3 == 0, "%").when(F.col("user_id") % 3 == 1, "USD").otherwise("")
    rows = table(spark, d, "events").select("value", unit.alias("unit"))
    return rows.agg(F.round(F.sum(values.amount("value", "unit", {"USD": 42000.0})), 2).alias("total"), F.sum(values.valid_amount("value", "unit", ["USD"]).cast("int")).alias("valid"))


@query("SELECT round(sum(l_extendedprice), 2) AS total, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 2) AS returned, round(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END), 2) AS open FROM lineitem")
def conditional_totals(spark, d):
    out = values.conditional_totals(table(spark, d, "lineitem"), "l_extendedprice", {"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O"})
    return out.select(*(F.round(c, 2).alias(c) for c in out.columns))


@query("SELECT min_by(event_id, (value, event_id)) AS event_id, min(value) AS value FROM events")
def smallest_value(spark, d):
    return table(spark, d, "events").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("event_id"), F.min("value").alias("value"))


@query("SELECT DISTINCT n_name, year(o_orderdate)::INTEGER AS year FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def years_by_organisation(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    found = o.select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year")).join(c.select("c_custkey", "c_nationkey"), "c_custkey")
    pairs = found.select("c_nationkey", "year").distinct()
    return pairs.join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select("n_name", "year").distinct()


@query(r"""WITH v AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN doc_id::VARCHAR || '.50' WHEN 2 THEN 'True' WHEN 3 THEN source WHEN 4 THEN '' ELSE '-' || doc_id::VARCHAR END AS v FROM documents)
           SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'integer' WHEN 1 THEN 'float' WHEN 2 THEN 'boolean' WHEN 3 THEN 'string' WHEN 5 THEN 'integer' END AS type FROM v""")
def data_types(spark, d):
    k, i = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    v = F.when(k == 0, i).when(k == 1, F.concat(i, F.lit(".50"))).when(k == 2, "True").when(k == 3, F.col("source")).when(k == 4, "").otherwise(F.concat(F.lit("-"), i))
    return table(spark, d, "documents").select("doc_id", values.data_type(v).alias("type"))


@query("SELECT event_type, substring(to_json(list_sort(list_distinct(list(user_id)))), 1, 40) AS users FROM events GROUP BY 1")
def scalar_json(spark, d):
    # at most a few hundred users for each type
    rows = table(spark, d, "events").groupBy("event_type").agg(F.array_sort(F.collect_set("user_id")).alias("users"))
    return rows.select("event_type", values.scalar("users", 40).alias("users"))


@query(f"""WITH {NEXT}, g AS (SELECT unnest([['the', 'der', 'les'], ['and', 'und', 'et']]) AS g), e AS (SELECT conv_id, turn, x, y, list_distinct(list_concat(x, flatten(coalesce(list(g) FILTER (WHERE list_has_any(g, x)), [])))) AS wide FROM p, g GROUP BY conv_id, turn, x, y)
           SELECT conv_id, turn, len(wide)::INTEGER AS n_words, round(len(list_intersect(x, y)) + 0.5 * (len(list_intersect(wide, y)) - len(list_intersect(x, y))) + CASE WHEN len(x) + len(y) > 0 THEN 2 * len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) ELSE 0 END
             + 1.5 * len(list_intersect(list_intersect(x, y), ['tion', 'that'])), 6) AS score FROM e""")
def synonym_scores(spark, d):
    groups = {"the": ["der", "les"], "and": ["und", "et"]}
    score = values.synonym_score(F.col("x"), F.col("y"), groups, ["tion", "that"])
    return _next(spark, d).select("conv_id", "turn", F.size(values.with_synonyms(F.col("x"), groups)).alias("n_words"), F.round(score, 6).alias("score"))


@query(r"""SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 6 THEN NULL ELSE c_custkey % 7 END::INTEGER AS row FROM customer""")
def ordinal_rows(spark, d):
    k = F.col("c_custkey") % 7
    asked = F.when(k == 1, "the first row").when(k == 2, "row 2 please").when(k == 3, "Third").when(k == 4, "show 4").when(k == 5, "fifth one").when(k == 6, "row 61").otherwise("all rows")
    return table(spark, d, "customer").select("c_custkey", values.ordinal(asked).alias("row"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
          SELECT doc_id, line::INTEGER AS line, len(string_split(t, ' '))::INTEGER AS n_cells, trim(string_split(t, ' ')[1]) AS first FROM l WHERE contains(lower(t), 'elle')""")
def matching_rows(spark, d):
    out = values.matching_rows(table(spark, d, "documents"), "doc_id", "text", "elle", " ")
    return out.select("doc_id", "line", F.size("cells").alias("n_cells"), F.col("cells")[0].alias("first"))


@query("SELECT doc_id, string_split(text, chr(10))[3] AS row FROM documents")
def third_row(spark, d):
    return table(spark, d, "documents").select("doc_id", values.nth_row("text", 3).alias("row"))


@query("""WITH k AS (SELECT unnest(string_split(p_name, ' ')) AS keyword FROM part UNION ALL SELECT unnest(string_split(lower(n_name), ' ')) FROM nation UNION ALL SELECT p_type FROM part)
          SELECT keyword, count(*) AS freq FROM k GROUP BY 1 ORDER BY freq DESC, keyword LIMIT 50""")
def combined_keywords(spark, d):
    part, nation = table(spark, d, "part"), table(spark, d, "nation")
    return values.combined_keywords(part.select(F.explode(F.split("p_name", " "))), nation.select(F.explode(F.split(F.lower("n_name"), " "))), part.select("p_type"))


@query("SELECT doc_id, array_to_string(list_filter(list_concat(list_concat([source], regexp_extract_all(text, '[0-9]+')[1:5]), [lang]), lambda x: x IS NOT NULL AND x <> ''), ' ') AS keywords FROM documents")
def search_keywords(spark, d):
    found = values.search_keywords("source", F.regexp_extract_all("text", F.lit("([0-9]+)")), "lang")
    return table(spark, d, "documents").select("doc_id", F.array_join(found, " ").alias("keywords"))


@query(r"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
           r AS (SELECT doc_id, s, 1 AS i, s[1] AS open, 0 AS piece FROM s WHERE len(s) > 0
                 UNION ALL SELECT doc_id, s, i + 1, CASE WHEN length(open) + length(s[i + 1]) + 2 <= 500 THEN open || '. ' || s[i + 1] ELSE s[i + 1] END,
                   CASE WHEN length(open) + length(s[i + 1]) + 2 <= 500 THEN piece ELSE piece + 1 END FROM r WHERE i < len(s))
           SELECT doc_id, piece::INTEGER AS piece, max_by(open, i) AS text FROM r GROUP BY doc_id, piece""")
def packed_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(values.packed_sentences("text")).alias("piece", "text"))


@query("""SELECT 'text' AS type, item_id::VARCHAR AS name, substring(text, 1, 500) AS content, NULL::BIGINT AS rows FROM benchmark
          UNION ALL SELECT 'table', 'result', '[' || (SELECT string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 3) || ']', count(*) FROM nation""")
def detailed_sources(spark, d):
    return values.detailed_sources(table(spark, d, "benchmark"), "text", "item_id", table(spark, d, "nation").select("n_nationkey", "n_name"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY lang, array_to_string(string_split(text, chr(10))[1:3], chr(10))")
def distinct_tables(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", F.split("text", "\n").alias("body"))
    return values.distinct_tables(rows, "doc_id", "lang", "body").select("doc_id", "copies")


@query("SELECT p_partkey, p_brand FROM part WHERE contains(lower(p_brand), '#1')")
def fuzzy_column_lookup(spark, d):
    return values.lookup(table(spark, d, "part"), "Brand", "#1").select("p_partkey", "p_brand")
