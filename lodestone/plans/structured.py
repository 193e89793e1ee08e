"""Queries of the structured family, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import profile, structured
from lodestone.plans.registry import query, table


def _orders_by_nation(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)


ORDERS_BY_NATION = "orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"


@query("SELECT round(coalesce(sum(o_totalprice), 0), 2) AS total FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1997")
def sum_filtered(spark, d):
    o = table(spark, d, "orders")
    return structured.total(o, "o_totalprice", (F.col("o_orderstatus") == "F") & (F.year("o_orderdate") == 1997)).select(F.round("total", 2).alias("total"))


@query(f"SELECT n_name, n_regionkey, round(sum(o_totalprice), 2) AS total FROM {ORDERS_BY_NATION} GROUP BY ALL")
def sum_by_entity(spark, d):
    return structured.total_by(_orders_by_nation(spark, d), ["n_name", "n_regionkey"], {"total": "o_totalprice"}).withColumn("total", F.round("total", 2))


@query(f"SELECT n_name, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS total FROM {ORDERS_BY_NATION} GROUP BY ALL ORDER BY year, total DESC")
def sum_by_entity_year(spark, d):
    rows = _orders_by_nation(spark, d).withColumn("year", F.year("o_orderdate").cast("long"))
    return structured.total_by(rows, ["n_name", "year"], {"total": "o_totalprice"}).withColumn("total", F.round("total", 2)).orderBy("year", F.desc("total"))


@query(f"SELECT n_name, round(sum(o_totalprice), 2) AS total FROM {ORDERS_BY_NATION} GROUP BY n_name ORDER BY sum(o_totalprice) DESC, n_name LIMIT 10")
def top_n_entities(spark, d):
    return structured.top_n(_orders_by_nation(spark, d), ["n_name"], "o_totalprice", 10).withColumn("total", F.round("total", 2))


@query(f"SELECT n_name, round(sum(o_totalprice), 2) AS total FROM {ORDERS_BY_NATION} GROUP BY n_name ORDER BY sum(o_totalprice), n_name LIMIT 5")
def bottom_n_entities(spark, d):
    return structured.top_n(_orders_by_nation(spark, d), ["n_name"], "o_totalprice", 5, largest=False).withColumn("total", F.round("total", 2))


@query("""SELECT l_returnflag, l_linestatus, year(l_shipdate) AS year, round(sum(l_quantity), 2) AS quantity,
          round(sum(l_extendedprice), 2) AS gross, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem GROUP BY ALL""")
def breakdown_multi_measure(spark, d):
    rows = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate").cast("long"))
    out = structured.total_by(rows, ["l_returnflag", "l_linestatus", "year"], {"quantity": "l_quantity", "gross": "l_extendedprice", "net": F.col("l_extendedprice") * (1 - F.col("l_discount"))})
    return out.select("l_returnflag", "l_linestatus", "year", *(F.round(c, 2).alias(c) for c in ("quantity", "gross", "net")))


@query(f"""WITH a AS (SELECT n_name, sum(o_totalprice) AS income FROM {ORDERS_BY_NATION} GROUP BY n_name),
           b AS (SELECT n_name, sum(l_extendedprice) AS cost FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY n_name)
           SELECT n_name, round(coalesce(income, 0), 2) AS income, round(coalesce(cost, 0), 2) AS cost, round(coalesce(income, 0) - coalesce(cost, 0), 2) AS balance
           FROM a FULL OUTER JOIN b USING (n_name)""")
def cross_table_balance(spark, d):
    li, s, n = (table(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    income = structured.total_by(_orders_by_nation(spark, d), ["n_name"], {"income": "o_totalprice"})
    # the measure is summed by supplier first, so the join carries one row each
    by_supplier = structured.total_by(li, ["l_suppkey"], {"cost": "l_extendedprice"}, F.col("l_returnflag") == "R")
    cost = by_supplier.join(s, by_supplier.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).groupBy("n_name").agg(F.sum("cost").alias("cost"))
    return structured.full_balance(income, cost, "n_name", "income", "cost").select("n_name", *(F.round(c, 2).alias(c) for c in ("income", "cost", "balance")))


def _cases():
    return [(name, F.col("o_orderpriority").startswith(k)) for name, k in (("urgent", "1"), ("high", "2"), ("low", "5"))]


@query("""WITH t AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_orderpriority LIKE '2%' THEN 'high' WHEN o_orderpriority LIKE '5%' THEN 'low' END AS entity, sum(o_totalprice) AS total FROM orders GROUP BY 1)
          SELECT entity, round(total, 2) AS total, round(total - (SELECT total FROM t WHERE entity = 'urgent'), 2) AS difference FROM t WHERE entity IS NOT NULL""")
def entity_diff_first(spark, d):
    out = structured.compare_buckets(table(spark, d, "orders"), _cases(), "o_totalprice")
    return out.select("entity", F.round("total", 2).alias("total"), F.round("difference", 2).alias("difference"))


@query("""SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_orderpriority LIKE '2%' THEN 'high' WHEN o_orderpriority LIKE '5%' THEN 'low' ELSE 'other' END AS entity,
          round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def entity_case_compare(spark, d):
    return table(spark, d, "orders").groupBy(structured.bucket(_cases(), "other").alias("entity")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


def _yearly(spark, d):
    return structured.total_by(table(spark, d, "orders").withColumn("year", F.year("o_orderdate").cast("long")), ["year"], {"total": "o_totalprice"})


YEARLY = "WITH y AS (SELECT year(o_orderdate) AS year, sum(o_totalprice) AS total FROM orders GROUP BY 1), l AS (SELECT *, lag(total) OVER (ORDER BY year) AS previous FROM y)"


@query(f"{YEARLY} SELECT year, round(total, 2) AS total, round(previous, 2) AS previous, round(total - previous, 2) AS change, CASE WHEN previous > 0 THEN round((total - previous) / previous * 100, 2) ELSE 0 END AS pct FROM l")
def yoy_growth(spark, d):
    out = structured.growth(_yearly(spark, d), "year", "total")
    return out.select("year", F.round("total", 2).alias("total"), F.round("previous", 2).alias("previous"), F.round("change", 2).alias("change"), "pct")


@query(f"{YEARLY} SELECT year, round(total, 2) AS total FROM y")
def trend_by_year(spark, d):
    return _yearly(spark, d).select("year", F.round("total", 2).alias("total"))


@query(f"{YEARLY} SELECT round(avg(CASE WHEN previous > 0 THEN (total - previous) / previous * 100 END), 4) AS avg_growth, round((max_by(total, year) - min_by(total, year)) / min_by(total, year) * 100, 4) AS total_growth FROM l")
def avg_total_growth(spark, d):
    return structured.growth_summary(_yearly(spark, d), "year", "total").select(F.round("avg_growth", 4).alias("avg_growth"), F.round("total_growth", 4).alias("total_growth"))


@query("""WITH y AS (SELECT o_orderpriority, sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1996) AS b, sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1997) AS n FROM orders GROUP BY 1)
          SELECT o_orderpriority, round(b, 2) AS base, round(n, 2) AS next, round(n - b, 2) AS difference, round((n - b) / b * 100, 4) AS rate FROM y""")
def compare_years(spark, d):
    rows = structured.total_by(table(spark, d, "orders").withColumn("year", F.year("o_orderdate")), ["o_orderpriority", "year"], {"total": "o_totalprice"})
    out = structured.compare_periods(rows, "year", "total", 1996, 1997, ["o_orderpriority"])
    return out.select("o_orderpriority", *(F.round(c, 2).alias(c) for c in ("base", "next", "difference")), F.round("rate", 4).alias("rate"))


@query("""WITH a AS (SELECT sum(o_totalprice) AS income FROM orders), b AS (SELECT sum(l_extendedprice) AS cost FROM lineitem)
          SELECT round(income, 2) AS income, round(cost, 2) AS cost, round(income - cost, 2) AS balance, CASE WHEN income > cost THEN 'surplus' WHEN income < cost THEN 'deficit' ELSE 'balanced' END AS status FROM a, b""")
def balance_single(spark, d):
    out = structured.single_balance(structured.total(table(spark, d, "orders"), "o_totalprice", name="income"), structured.total(table(spark, d, "lineitem"), "l_extendedprice", name="cost"), "income", "cost")
    return out.select(*(F.round(c, 2).alias(c) for c in ("income", "cost", "balance")), "status")


@query("""SELECT c_custkey, c_name, n_name, 'nation' AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_3'""")
def hierarchy_probe_filter(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    levels = [("region", F.col("r_name") == "NATION_3"), ("nation", F.col("n_name") == "NATION_3"), ("customer", F.col("c_name") == "NATION_3")]
    return structured.first_level(rows, levels).select("c_custkey", "c_name", "n_name", "level")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 500")
def detail_rows(spark, d):
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rows.select(*keys, "l_extendedprice", "l_quantity").orderBy(F.desc("l_extendedprice"), *keys, "l_quantity").limit(500)


@query("""WITH f AS (SELECT o_custkey, year(o_orderdate) AS y, min_by(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END, o_orderkey) AS v FROM orders GROUP BY 1, 2)
          SELECT o_custkey, round(sum(v), 2) AS total, count(*) AS periods FROM f GROUP BY 1 HAVING count(*) >= 2""")
def verified_signed_sum(spark, d):
    rows = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    out = structured.signed_sum(rows, "o_custkey", "y", "o_totalprice", F.col("o_orderstatus") == "F", "o_orderkey")
    return out.withColumn("total", F.round("total", 2))


@query("""WITH w(n_name) AS (VALUES ('NATION_1'), ('NATION_7'), ('NOWHERE')), s AS (SELECT n_name, sum(s_acctbal) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
          SELECT w.n_name, round(total, 2) AS total, total IS NULL AS missing FROM w LEFT JOIN s USING (n_name)""")
def organisation_sums(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    rows = s.join(n, s.s_nationkey == n.n_nationkey)
    names = spark.createDataFrame([("NATION_1",), ("NATION_7",), ("NOWHERE",)], "n_name string")
    return structured.organisation_totals(rows, names, "n_name", ["n_name"], "s_acctbal").withColumn("total", F.round("total", 2))


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE lower(c_mktsegment) LIKE '%build%' AND lower(c_name) LIKE '%customer%' AND lower(c_name) NOT LIKE '%00007%'""")
def search_filter(spark, d):
    c = table(spark, d, "customer")
    return c.where(structured.search_filter("c_name", ["customer"], ["c_mktsegment", "c_name"], ["build"], ["00007"])).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%red widget%' OR lower(p_type) LIKE '%red widget%'")
def phrase_filter(spark, d):
    return table(spark, d, "part").where(structured.phrase_filter(["p_name", "p_type"], "Red-Widget")).select("p_partkey", "p_name")


@query("""WITH RECURSIVE t(node, parent, v) AS (
            SELECT 'c' || c_custkey, 'n' || c_nationkey, c_acctbal FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0 FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, 0 FROM region),
          w(node, v) AS (SELECT node, v FROM t UNION ALL SELECT t.parent, w.v FROM w JOIN t ON t.node = w.node WHERE t.parent IS NOT NULL)
          SELECT node, round(sum(v), 2) AS v FROM w GROUP BY node""")
def tree_rollup(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    named = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nodes = c.select(named("c", "c_custkey").alias("node"), named("n", "c_nationkey").alias("parent"), F.col("c_acctbal").alias("v"))
    nodes = nodes.unionByName(n.select(named("n", "n_nationkey").alias("node"), named("r", "n_regionkey").alias("parent"), F.lit(0.0).alias("v")))
    nodes = nodes.unionByName(r.select(named("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("v")))
    return structured.tree_rollup(nodes, "node", "parent", "v").withColumn("v", F.round("v", 2))


@query("SELECT DISTINCT p_size, lag(p_size) OVER (ORDER BY p_size) AS previous, lead(p_size) OVER (ORDER BY p_size) AS next FROM (SELECT DISTINCT p_size FROM part)")
def seq_prev_next_code(spark, d):
    return structured.neighbours(table(spark, d, "part"), "p_size")


@query("""SELECT 'o_totalprice' AS "column", 'numeric' AS kind, count(o_totalprice) AS n, count(*) - count(o_totalprice) AS nulls, count(DISTINCT o_totalprice) AS distinct_values,
          min(o_totalprice) AS min, max(o_totalprice) AS max, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 4) AS mean FROM orders
          UNION ALL SELECT 'o_orderpriority', 'text', count(o_orderpriority), count(*) - count(o_orderpriority), count(DISTINCT o_orderpriority), NULL, NULL, NULL, NULL FROM orders""")
def column_profile(spark, d):
    out = profile.column_profile(table(spark, d, "orders"), ["o_totalprice", "o_orderpriority"])
    return out.withColumn("sum", F.round("sum", 2)).withColumn("mean", F.round("mean", 4))


@query("SELECT CASE WHEN avg(length(text)) > 100 THEN 'long_text' WHEN avg(length(text)) > 30 THEN 'medium_text' ELSE 'short_text' END AS kind, 0.0 AS numbers, round(avg(length(text)), 4) AS mean_length FROM documents")
def schema_infer_stats(spark, d):
    out = profile.data_kind(table(spark, d, "documents"), "text")
    return out.select("kind", F.round("numbers", 4).alias("numbers"), F.round("mean_length", 4).alias("mean_length"))


@query("""WITH f AS (SELECT count(DISTINCT o_orderpriority) AS parents, min(o_totalprice) FILTER (WHERE o_totalprice > 0) AS low, max(o_totalprice) FILTER (WHERE o_totalprice > 0) AS high FROM orders)
          SELECT parents, low, high, parents > 1 AS offer_parents, high > 2 * low AS offer_range, greatest(1.0, power(10.0, floor(log10(high - low)) - 2)) AS step FROM f""")
def facet_ranges(spark, d):
    return profile.facets(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").withColumn("step", profile.slider_step("low", "high"))


@query("SELECT o_orderstatus, count(*) AS n, 0 AS is_total FROM orders GROUP BY 1 UNION ALL SELECT NULL, count(*), 1 FROM orders")
def counts_with_total(spark, d):
    return profile.counts_with_total(table(spark, d, "orders"), "o_orderstatus")


@query("SELECT DISTINCT year(o_orderdate) AS year FROM orders")
def available_years(spark, d):
    return profile.distinct_years(table(spark, d, "orders"), "o_orderdate").select(F.col("year").cast("long").alias("year"))


@query("WITH y AS (SELECT DISTINCT year(o_orderdate) AS year FROM orders) SELECT (SELECT year FROM y ORDER BY abs(year - 2010), year LIMIT 1) AS year, (SELECT min(year) FROM y) AS first_year, (SELECT max(year) FROM y) AS last_year")
def closest_year(spark, d):
    return profile.closest_year(profile.distinct_years(table(spark, d, "orders"), "o_orderdate"), 2010).select(*(F.col(c).cast("long").alias(c) for c in ("year", "first_year", "last_year")))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 100) AS rejected, round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0 END), 6) AS rate FROM events GROUP BY 1")
def rejection_rate(spark, d):
    return profile.rejection_rates(table(spark, d, "events"), ["event_type"], F.col("value") > 100).withColumn("rate", F.round("rate", 6))


@query("""SELECT lang, source, round(avg(quality), 6) AS mean_score, count(*) AS n, GROUPING(lang, source)::INTEGER AS level FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())""")
def grouping_sets_eval(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return profile.evaluation_sets(rows, "quality", "lang", "source").select("lang", "source", F.round("mean_score", 6).alias("mean_score"), "n", "level")


@query("SELECT event_type, count(*) FILTER (WHERE user_id % 2 = 0) AS even, count(*) FILTER (WHERE user_id % 2 = 1) AS odd FROM events GROUP BY 1")
def pivot_counts(spark, d):
    rows = table(spark, d, "events").withColumn("side", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    return rows.groupBy("event_type").pivot("side", ["even", "odd"]).count().na.fill(0)


@query("SELECT c_mktsegment, 'customer' AS source, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1 HAVING sum(c_acctbal) <> 0 UNION ALL SELECT 'all', 'supplier', round(sum(s_acctbal), 2) FROM supplier HAVING sum(s_acctbal) <> 0")
def dual_table_search(spark, d):
    a = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("total")).withColumn("source", F.lit("customer"))
    b = table(spark, d, "supplier").agg(F.sum("s_acctbal").alias("total")).select(F.lit("all").alias("c_mktsegment"), F.lit("supplier").alias("source"), "total")
    return a.unionByName(b).where("total <> 0").withColumn("total", F.round("total", 2))
