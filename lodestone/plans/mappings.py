"""Queries over the contents of columns, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import mapping
from lodestone.plans.registry import query, table

_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(value, '{p}') THEN '{k}'" for k, p in mapping.CLASSES.items()) + " WHEN length(value) > 100 THEN 'long' ELSE 'phrase' END"


def _cells(name: str, columns: dict[str, str]) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS col, trim({text}) AS value FROM {name}" for c, text in columns.items())
    return f"SELECT col, value, md5(value) AS h, {_CLASS} AS kind FROM ({parts}) WHERE value <> ''"


#: decimals are written with two digits on both sides
CUSTOMER = {"c_custkey": "c_custkey::VARCHAR", "c_name": "c_name", "c_nationkey": "c_nationkey::VARCHAR", "c_acctbal": "printf('%.2f', c_acctbal)", "c_mktsegment": "c_mktsegment"}
CLIENTS = {"client_id": "client_id::VARCHAR", "name": "name", "email": "email", "nation_id": "nation_id::VARCHAR", "segment": "segment", "balance": "printf('%.2f', balance)"}
#: a copy of customer under other names, with its rows of odd keys only
COPY = {"number": "c_custkey::VARCHAR", "title": "c_name", "country": "c_nationkey::VARCHAR", "funds": "printf('%.2f', c_acctbal)", "branch": "c_mktsegment"}


def _two(c: str):
    return F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c).cast("double")))


def _customer(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", _two("c_acctbal").alias("c_acctbal"), "c_mktsegment")


@query(f"""WITH v AS ({_cells("clients", CLIENTS)})
           SELECT col AS "column", count(*) AS n, round(avg(length(value)), 6) AS mean_length,
                  CASE WHEN count(TRY_CAST(value AS DOUBLE)) > 0.8 * count(*) THEN 'numeric' WHEN avg(length(value)) > 100 THEN 'answer' WHEN bool_or(regexp_matches(value, '[?؟]|چیست|چگونه|چرا|کجا|کدام')) THEN 'question'
                       WHEN count(*) FILTER (WHERE regexp_matches(value, '^(1[34][0-9][0-9]|[89][0-9]|0[0-4])$')) >= 0.5 * count(*) THEN 'year'
                       WHEN avg(length(value)) <= 30 AND count(*) FILTER (WHERE regexp_matches(value, '^[0-9]{{2,10}}$|^[A-Za-z0-9_-]+$')) >= 0.7 * count(*) THEN 'code' ELSE 'unknown' END AS role
           FROM v GROUP BY col""")
def column_roles(spark, d):
    rows = table(spark, d, "clients").select("client_id", "name", "email", "nation_id", "segment", _two("balance").alias("balance"))
    return mapping.content_roles(mapping.column_slots(rows)).select("column", "n", F.round("mean_length", 6).alias("mean_length"), "role")


@query(f"""WITH a AS ({_cells("customer", CUSTOMER)}), b AS ({_cells("(SELECT * FROM customer WHERE c_custkey % 2 = 1)", COPY)}),
           sa AS (SELECT col, left(h, 2) AS slot, min(substr(h, 3, 14)) AS mark FROM a GROUP BY ALL), sb AS (SELECT col, left(h, 2) AS slot, min(substr(h, 3, 14)) AS mark FROM b GROUP BY ALL),
           ka AS (SELECT col, kind, count(*) / sum(count(*)) OVER (PARTITION BY col) AS share FROM a GROUP BY col, kind), kb AS (SELECT col, kind, count(*) / sum(count(*)) OVER (PARTITION BY col) AS share FROM b GROUP BY col, kind),
           ca AS (SELECT col, count(*) AS slots FROM sa GROUP BY 1), cb AS (SELECT col, count(*) AS slots FROM sb GROUP BY 1),
           met AS (SELECT sa.col AS x, sb.col AS y, count(*) AS both_, count(*) FILTER (WHERE sa.mark = sb.mark) AS same FROM sa JOIN sb USING (slot) GROUP BY ALL),
           sh AS (SELECT ka.col AS x, kb.col AS y, sum(least(ka.share, kb.share)) AS shapes FROM ka JOIN kb USING (kind) GROUP BY ALL),
           s AS (SELECT ca.col AS left_column, cb.col AS right_column, coalesce(same, 0) / (ca.slots + cb.slots - coalesce(both_, 0)) AS overlap, coalesce(shapes, 0) AS shapes
                 FROM ca CROSS JOIN cb LEFT JOIN met ON met.x = ca.col AND met.y = cb.col LEFT JOIN sh ON sh.x = ca.col AND sh.y = cb.col)
           SELECT left_column, right_column, round(overlap, 6) AS overlap, round(shapes, 6) AS shapes, round(0.7 * overlap + 0.3 * shapes, 6) AS score FROM s WHERE 0.7 * overlap + 0.3 * shapes >= 0.3 - 1e-12""")
def column_mapping(spark, d):
    customer = _customer(spark, d)
    copy = customer.where("c_custkey % 2 = 1").toDF(*COPY)
    matches = mapping.column_matches(mapping.column_slots(customer), mapping.column_slots(copy), 0.3 - 1e-12)
    return matches.select("left_column", "right_column", *(F.round(c, 6).alias(c) for c in ("overlap", "shapes", "score")))
