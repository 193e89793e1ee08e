"""Queries over hierarchies, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import hierarchy
from lodestone.plans.registry import query, table


@query("""WITH own AS (SELECT lpad(CAST(item_id % 100000 * 100 + line_no % 4 AS VARCHAR), 8, '0') AS code, sum(quantity) AS own_total, count(*) AS own_n FROM sale_lines
                       WHERE item_id IS NOT NULL AND line_no IS NOT NULL GROUP BY 1),
               p AS (SELECT *, CASE WHEN right(code, 6) = '000000' THEN left(code, 2) WHEN right(code, 4) = '0000' THEN left(code, 4) WHEN right(code, 2) = '00' THEN left(code, 6) ELSE code END AS prefix FROM own),
               a AS (SELECT *, length(prefix) // 2 - 1 AS level FROM p),
               up AS (SELECT c.code, max(u.level) FILTER (WHERE u.level < c.level) AS parent_level,
                             arg_max(u.code, u.level) FILTER (WHERE u.level < c.level) AS parent
                      FROM a c JOIN a u ON u.prefix IN (left(c.prefix, 2), left(c.prefix, 4), left(c.prefix, 6), c.prefix) GROUP BY 1),
               below AS (SELECT u.code, sum(c.own_total) AS total, sum(c.own_n) AS n FROM a c JOIN a u ON u.prefix IN (left(c.prefix, 2), left(c.prefix, 4), left(c.prefix, 6), c.prefix) GROUP BY 1)
          SELECT a.code, a.level, up.parent, a.level - coalesce(up.parent_level, -1) - 1 AS skipped, a.own_total, a.own_n, below.total, below.n,
                 (SELECT count(*) FROM up k WHERE k.parent = a.code) AS children
          FROM a JOIN up USING (code) JOIN below USING (code)""")
def item_code_tree(spark, d):
    rows = table(spark, d, "sale_lines").where("item_id is not null and line_no is not null")
    # the table's own codes: an item's number and the kind of its line, of which many higher levels do not occur
    code = F.lpad((F.col("item_id") % 100000 * 100 + F.col("line_no") % 4).cast("string"), 8, "0")
    return hierarchy.code_tree(rows.select(code.alias("code"), "quantity"), "code", "quantity", [2, 4, 6, 8])


def _places(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    held = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return held.select(F.lit(None).cast("string").alias("world"), "r_name", "n_name", "c_mktsegment", "c_acctbal")


@query("""SELECT 'n_name' AS level, n_name AS name, round(sum(c_acctbal), 2) AS total, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def drilled_level(spark, d):
    # five regions are more than three: one level down
    return hierarchy.level_results(_places(spark, d), ["world", "r_name", "n_name", "c_mktsegment"], "r_name", "c_acctbal", most=3).withColumn("total", F.round("total", 2))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\b(region|the)\\b') THEN 'top' WHEN regexp_matches(lower(text), '\\b(of|and)\\b') THEN 'middle' ELSE 'low' END AS level
          FROM conversations""")
def question_levels(spark, d):
    levels = {"top": ["region", "the"], "middle": ["of", "and"]}
    return table(spark, d, "conversations").select("conv_id", "turn", hierarchy.detect_level("text", levels, "low", "[0-9A-Za-z_]").alias("level"))
