"""Queries of the parts of answers, with SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import whole_word
from lodestone.operators import answers
from lodestone.plans.registry import query, table

#: the terms and patterns of the queries below
TERMS = ["nation", "sonderung", "liberte", "quality"]
PATTERNS = [("year", r"\b(?:19|20)[0-9]{2}\b"), ("code", r"[a-z]{2,}[0-9]{3,}"), ("address", r"[a-z0-9._]+@[a-z0-9.]+")]
CUES = {"code": ["id", "code"], "address": ["mail", "contact"]}


@query(r"""WITH f AS (SELECT c_custkey, '{"key": ' || c_custkey || ', "name": "' || c_name || '"}' AS j, c_custkey % 5 AS k FROM customer)
           SELECT c_custkey, CASE WHEN k < 4 THEN c_custkey END AS key FROM f""")
def json_in_text(spark, d):
    key = F.col("c_custkey")
    j = F.concat(F.lit('{"key": '), key.cast("string"), F.lit(', "name": "'), F.col("c_name"), F.lit('"}'))
    text = F.when(key % 5 == 0, j).when(key % 5 == 1, F.concat(F.lit("Here:\n```json\n"), j, F.lit("\n``` done"))).when(key % 5 == 2, F.concat(F.lit("```\n"), j, F.lit("```")))
    text = text.when(key % 5 == 3, F.concat(F.lit("The plan is "), j, F.lit(" as asked."))).otherwise(F.concat(F.lit("{no plan "), j))
    return table(spark, d, "customer").select("c_custkey", F.get_json_object(answers.json_object(text), "$.key").cast("long").alias("key"))


@query(r"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN '| key | price |' || chr(10) || '| ' || o_orderkey || ' | 1 |' END AS "table",
           CASE o_orderkey % 3 WHEN 0 THEN 'Before it.' || chr(10) || chr(10) || 'After it.' END AS prose FROM orders""")
def answer_tables(spark, d):
    key = F.col("o_orderkey")
    t = F.concat(F.lit("| key | price |\n| "), key.cast("string"), F.lit(" | 1 |"))
    text = F.when(key % 3 == 0, F.concat(F.lit("Before it.\n"), t, F.lit("\nAfter it. "))).when(key % 3 == 1, t).otherwise("nothing here")
    return table(spark, d, "orders").select("o_orderkey", answers.split_table(text).alias("t")).select("o_orderkey", "t.table", "t.prose")


@query(r"""WITH c AS (SELECT conv_id, turn, lower(text) AS a, lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS b FROM conversations),
           m AS (SELECT conv_id, turn, list_sort(list_distinct(list_filter(regexp_extract_all(a, '\w+ [0-9]+'), lambda x: NOT list_contains(regexp_extract_all(b, '\w+ [0-9]+'), x)))) AS m FROM c WHERE b IS NOT NULL)
           SELECT conv_id, turn, array_to_string(m, ',') AS missing, CASE WHEN len(m) > 0 THEN 0.5 ELSE 1.0 END AS score FROM m""")
def citation_mapping(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    pairs = rows.join(rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")), ["conv_id", "turn"])
    pairs = pairs.withColumn("m", answers.unmapped_citations("text", "next", [r"\w+ [0-9]+"]))
    return pairs.select("conv_id", "turn", F.array_join("m", ",").alias("missing"), answers.citation_score("m").alias("score"))


@query("""WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS w, string_split(p_type, ' ') AS t FROM part)
          SELECT p_partkey, 1.0 / 2 AS precision, 1.0 / 2 AS recall, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.5 END AS mrr FROM s""")
def context_metrics(spark, d):
    true = F.array(F.lit("true"), F.lit("words"), F.col("p_partkey").cast("string"))
    other = F.array(F.lit("other"), F.lit("text"))
    found = F.when(F.col("p_partkey") % 2 == 0, F.array(true, other)).otherwise(F.array(other, true))
    metrics = answers.context_metrics(found, F.array(true, F.array(F.lit("never"), F.lit("found"))))
    return table(spark, d, "part").select("p_partkey", metrics.alias("m")).select("p_partkey", "m.precision", "m.recall", "m.mrr")


@query("SELECT count(*) AS cases, round(avg(value), 6) AS value, round(avg(user_id), 6) AS user_id FROM events")
def batch_average(spark, d):
    return answers.batch_average(table(spark, d, "events"), ["value", "user_id"]).select("cases", F.round("value", 6).alias("value"), F.round("user_id", 6).alias("user_id"))


@query()
def keyword_similarity(spark, d):
    return answers.keyword_similarity(table(spark, d, "documents"), "doc_id", "text", TERMS)


@query()
def typed_patterns(spark, d):
    return answers.typed_patterns(table(spark, d, "documents"), "doc_id", "text", PATTERNS, CUES)


@query(r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[0-9]+')) AS n, len(regexp_extract_all(lower(text), '\bthe\b')) AS t FROM documents)
           SELECT doc_id, greatest(n, t)::INTEGER AS n, CASE WHEN t >= n THEN 'words' ELSE 'numbers' END AS type, least(greatest(n, t) / 3, 1.0) AS confidence FROM c WHERE greatest(n, t) > 0""")
def pattern_classes(spark, d):
    best = answers.pattern_class("text", {"numbers": "[0-9]+", "words": whole_word("the")})
    return table(spark, d, "documents").select("doc_id", best.alias("b")).where("b is not null").select("doc_id", "b.n", "b.type", "b.confidence")


@query("""SELECT event_id, round(least(1.0, value / 100 + CASE WHEN contains(lower(props), event_type) THEN 0.1 ELSE 0 END
            + CASE WHEN contains(event_type, 'i') AND contains(lower(props), '1') THEN 0.05 ELSE 0 END), 6) AS score FROM events""")
def content_bonus(spark, d):
    score = answers.content_bonus(F.col("value") / 100, F.col("event_type"), F.col("props"), [("i", "1")])
    return table(spark, d, "events").select("event_id", F.round(score, 6).alias("score"))


@query("""WITH r AS (SELECT o_orderpriority AS item, year(o_orderdate) AS y, o_totalprice AS v FROM orders)
          SELECT CASE WHEN GROUPING(item) = 0 THEN 'item' WHEN GROUPING(y) = 0 THEN 'year' ELSE 'all' END AS "by", coalesce(item, y::VARCHAR) AS value, round(sum(v), 2) AS total, count(*) AS n
          FROM r GROUP BY GROUPING SETS ((item), (y), ())""")
def answer_totals(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", F.year("o_orderdate").alias("year"), "o_totalprice")
    return answers.answer_totals(rows, "o_orderpriority", "year", "o_totalprice").withColumn("total", F.round("total", 2))


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT sum(n)::BIGINT AS n, first(source ORDER BY n DESC, source) AS title FROM c""")
def list_summary(spark, d):
    return answers.list_summary(table(spark, d, "documents"), "source")


@query("""SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS covered, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1995, 1996, 1997) GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) >= 2 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1""")
def best_covered(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    return answers.best_covered(rows, "o_custkey", "year", [1995, 1996, 1997])


@query("""SELECT p_partkey, p_brand AS label, 'p_size' AS series, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, p_brand, 'p_retailprice', p_retailprice::DOUBLE FROM part""")
def chart_series(spark, d):
    return answers.chart_series(table(spark, d, "part"), "p_partkey", "p_brand", ["p_size", "p_retailprice"])


@query("""SELECT n_regionkey, 0::BIGINT AS row, 'Page ' || n_regionkey || chr(10) || 'Headers:' || chr(10) || '  Column 0: n_name' || chr(10) AS text FROM nation GROUP BY n_regionkey
          UNION ALL SELECT n_regionkey, n_nationkey, 'Page ' || n_regionkey || ', Row ' || n_nationkey || chr(10) || '  n_name: ' || n_name || chr(10) FROM nation""")
def table_chunks(spark, d):
    return answers.table_chunks(table(spark, d, "nation"), "n_regionkey", "n_nationkey", ["n_name"])


@query("""WITH c AS (SELECT lpad((100000 + l_partkey % 900000)::VARCHAR, 6, '0') AS c, l_quantity AS v FROM lineitem), w AS (SELECT unnest([0, 1, 2]) AS level, unnest([2, 4, 6]) AS w)
          SELECT level::INTEGER AS level, rpad(substring(c, 1, w), 6, '0') AS code, round(sum(v), 2) AS total, count(*) AS n FROM c, w GROUP BY 1, 2""")
def code_level_sums(spark, d):
    rows = table(spark, d, "lineitem").select((100000 + F.col("l_partkey") % 900000).cast("string").alias("code"), "l_quantity")
    return answers.code_levels(rows, "code", "l_quantity", [2, 4, 6]).withColumn("total", F.round("total", 2))


@query("""SELECT a.conv_id, a.turn, sha256(trim(a.text) || chr(10) || trim(b.text)) AS digest FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
          WHERE length(trim(a.text)) > 0 AND length(trim(b.text)) > 0""")
def qa_documents(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    pairs = rows.join(rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")), ["conv_id", "turn"])
    return answers.qa_documents(pairs, "text", "answer").select("conv_id", "turn", F.sha2("text", 256).alias("digest"))
