"""From a question to rows: names found in it, a filter, and the operator that its category asks for; all lazy but the names."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import structured as s
from lodestone.plans.analysis import QueryPlan, analyse
from lodestone.plans.registry import query, table


@dataclass
class TableSchema:
    """What the columns of a table mean: who, how much, when, what is set against it, and the levels by their spoken name."""

    entity: str
    value: str
    year: str | None = None
    cost: str | None = None
    levels: Mapping[str, str] = field(default_factory=dict)


def names_in(text: str, names: DataFrame, name: str) -> list[str]:
    """Known names that the text contains, in its order; a name inside a longer one that is there goes.

    The comparison runs on the executors; only names that the text holds come to the driver.
    """
    said = lambda x: re.sub(r"[-_\u200c\s]+", " ", x.lower()).strip()
    plain = f" {said(text)} "
    found = names.select(name).distinct().where((F.length(F.trim(name)) > 0) & F.lit(plain).contains(s.plain(name))).collect()
    keys = {r[0]: said(r[0]) for r in found}
    kept = [n for n, k in keys.items() if not any(k != other and k in other for other in keys.values())]
    return sorted(kept, key=lambda n: (plain.index(keys[n]), n))


def plan_filter(schema: TableSchema, entities: Sequence[str] = (), years: Sequence[int] = (), component: tuple[str, str] | None = None) -> Column:
    """Any of the entities, any of the years, and the component's phrase in its column; what is not given holds always."""
    out = F.lit(True)
    if entities:
        out = out & F.col(schema.entity).isin(*entities)
    if years and schema.year:
        out = out & F.col(schema.year).isin(*years)
    if component:
        out = out & s.phrase_filter([component[0]], component[1])
    return out


def rows_of(plan: QueryPlan, df: DataFrame, schema: TableSchema, entities: Sequence[str] = ()) -> DataFrame:
    """The rows that a plan asks for. A question that is none for a table raises ValueError; so does a balance without costs."""
    kind = plan.comparison or plan.category
    where = plan_filter(schema, entities, plan.years)
    if kind in ("balance", "cross_table"):
        if schema.cost is None:
            raise ValueError("the table has no costs to balance")
        return s.single_balance(s.total(df, schema.value, where, "income"), s.total(df, schema.cost, where, "cost"), "income", "cost")
    if kind == "entity":
        years = plan_filter(schema, (), plan.years)
        return s.compare_buckets(df.where(years), [(e, F.col(schema.entity) == e) for e in entities], schema.value)
    if kind in ("year_over_year", "trend") and schema.year:
        series = s.total_by(df, [schema.year], {"total": schema.value}, where)
        return s.compare_periods(series, schema.year, "total", *plan.years) if kind == "year_over_year" else s.growth(series, schema.year, "total")
    if kind == "breakdown":
        dims = [schema.levels[d] for d in plan.dimensions if d in schema.levels]
        return s.total_by(df, dims or [schema.entity], {"total": schema.value}, where)
    if kind == "top_n":
        return s.top_n(df.where(where), [schema.entity], schema.value, plan.limit, plan.largest)
    if kind in ("simple_sum", "comparison"):
        return s.total(df, schema.value, where)
    raise ValueError(f"no question for a table: {plan.text}")


def answer_rows(text: str, df: DataFrame, schema: TableSchema, names: DataFrame | None = None) -> DataFrame:
    """A question's rows: analyse, find the table's names in it (from `names`, else the table), run the plan."""
    entities = names_in(text, df if names is None else names, schema.entity)
    return rows_of(analyse(text, len(entities)), df, schema, entities)


@dataclass
class Step:
    """One step of a plan: a tool by name, its arguments, and the steps whose results it needs."""

    number: int
    tool: str
    arguments: Mapping[str, object] = field(default_factory=dict)
    needs: Sequence[int] = ()


def run_steps(steps: Sequence[Step], tools: Mapping[str, Callable[..., DataFrame]]) -> dict[int, DataFrame]:
    """The frame of every step, each after those it needs, whose frames it gets as step_<number>_result; nothing is computed yet.

    A need that no step meets, a circle, a number twice or an unknown tool raises ValueError before any step runs.
    """
    by_number = {x.number: x for x in steps}
    if len(by_number) < len(steps):
        raise ValueError("a step's number is there twice")
    if unknown := sorted({x.tool for x in steps} - set(tools)):
        raise ValueError(f"unknown tools: {unknown}")
    try:
        order = [*TopologicalSorter({x.number: x.needs for x in steps}).static_order()]
    except CycleError as e:
        raise ValueError("steps need each other") from e
    if missing := sorted(set(order) - set(by_number)):
        raise ValueError(f"missing steps: {missing}")
    out: dict[int, DataFrame] = {}
    for number in order:
        step = by_number[number]
        out[number] = tools[step.tool](**step.arguments, **{f"step_{k}_result": out[k] for k in step.needs})
    return out


def _orders(spark, d):
    """Orders by nation, with years of the solar calendar; half of a price is its cost."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    rows = o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("price"), (F.col("o_totalprice") / 2).alias("spent"), (F.year("o_orderdate") - 621).alias("year"), F.col("o_orderpriority").alias("priority"))
    rows = rows.join(c.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey").join(n.select("n_nationkey", "n_name"), "n_nationkey")
    return rows, TableSchema("n_name", "price", "year", "spent", {"section": "priority", "year": "year"}), n


SQL_ORDERS = "o AS (SELECT n_name, o_totalprice AS price, year(o_orderdate)::INTEGER - 621 AS year, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def _asked(spark, d, text, *rounded):
    df, schema, names = _orders(spark, d)
    return answer_rows(text, df, schema, names).withColumns({c: F.round(c, 2) for c in rounded})


@query(f"WITH {SQL_ORDERS} SELECT round(coalesce(sum(price), 0), 2) AS total FROM o WHERE n_name = 'NATION_3' AND year = 1375")
def question_sum(spark, d):
    return _asked(spark, d, "total budget of nation 3 in 1375", "total")


@query(f"WITH {SQL_ORDERS} SELECT n_name, round(sum(price), 2) AS total FROM o GROUP BY 1 ORDER BY sum(price) DESC, 1 LIMIT 3")
def question_top(spark, d):
    return _asked(spark, d, "top 3 countries by cost", "total")


@query(f"WITH {SQL_ORDERS} SELECT priority, round(sum(price), 2) AS total FROM o WHERE year = 1375 GROUP BY 1")
def question_breakdown(spark, d):
    return _asked(spark, d, "cost breakdown by section in 1375", "total")


@query(f"""WITH {SQL_ORDERS}, t AS (SELECT n_name AS entity, sum(price) AS total FROM o WHERE n_name IN ('NATION_7', 'NATION_3') GROUP BY 1)
           SELECT entity, round(total, 2) AS total, round(total - (SELECT total FROM t WHERE entity = 'NATION_7'), 2) AS difference FROM t""")
def question_entities(spark, d):
    return _asked(spark, d, "compare the cost of nation 7 and nation 3", "total", "difference")


@query(f"""WITH {SQL_ORDERS}, t AS (SELECT round(sum(price) FILTER (WHERE year = 1374), 2) AS base, round(sum(price) FILTER (WHERE year = 1375), 2) AS next FROM o)
           SELECT base, next, round(next - base, 2) AS difference, round((next - base) / base * 100, 2) AS rate FROM t""")
def question_years(spark, d):
    return _asked(spark, d, "change of cost from 1374 to 1375", "base", "next", "difference", "rate").drop("rate_text")


@query(f"""WITH {SQL_ORDERS}, t AS (SELECT year, sum(price) AS total FROM o WHERE year BETWEEN 1374 AND 1378 GROUP BY 1), w AS (SELECT *, lag(total) OVER (ORDER BY year) AS p FROM t)
           SELECT year, round(total, 2) AS total, round(p, 2) AS previous, round(total - p, 2) AS change, coalesce(round((total - p) / p * 100, 2), 0) AS pct FROM w""")
def question_trend(spark, d):
    return _asked(spark, d, "growth of cost 1374 to 1378", "total", "previous", "change")


@query(f"WITH {SQL_ORDERS} SELECT round(sum(price), 2) AS income, round(sum(price) / 2, 2) AS cost, round(sum(price) / 2, 2) AS balance, 'surplus' AS status FROM o WHERE year = 1375")
def question_balance(spark, d):
    return _asked(spark, d, "balance of 1375", "income", "cost", "balance")


@query("SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer) GROUP BY 1")
def agent_steps(spark, d):
    customers = table(spark, d, "customer")
    tools = {
        "first": lambda column: customers.agg(F.min(column).alias(column)),
        "rows": lambda step_1_result: customers.join(F.broadcast(step_1_result), "c_mktsegment"),  # one row
        "totals": lambda by, step_2_result: step_2_result.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")),
    }
    steps = [Step(3, "totals", {"by": "c_nationkey"}, [2]), Step(2, "rows", needs=[1]), Step(1, "first", {"column": "c_mktsegment"})]
    return run_steps(steps, tools)[3]
