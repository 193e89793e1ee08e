"""Analytical templates over fact tables: filtered sums, breakdowns, top-N, comparisons, growth, balances, hierarchies.

Each takes and returns DataFrames and is lazy, so filters and column choice reach the scan. Amounts may be text: `amount`
reads them with try_cast, and unreadable cells count as missing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import stash


def amount(col: str | Column) -> Column:
    """A number from a cell of text, without thousands separators; null if it isn't one."""
    c = F.col(col) if isinstance(col, str) else col
    return F.translate(c.cast("string"), ",٬", "").try_cast("double")


def total(df: DataFrame, measure: str | Column, where: Column | None = None, name: str = "total") -> DataFrame:
    """Filter, then one sum; no rows give 0."""
    m = F.col(measure) if isinstance(measure, str) else measure
    return (df if where is None else df.where(where)).agg(F.coalesce(F.sum(m), F.lit(0)).alias(name))


def total_by(df: DataFrame, dims: Sequence[str], measures: Mapping[str, Column | str], where: Column | None = None) -> DataFrame:
    """Sums of several measures by up to any number of dimensions; partial sums are made before the shuffle."""
    sums = [F.sum(F.col(m) if isinstance(m, str) else m).alias(n) for n, m in measures.items()]
    return (df if where is None else df.where(where)).groupBy(*dims).agg(*sums)


def top_n(df: DataFrame, dims: Sequence[str], measure: str | Column, n: int = 10, largest: bool = True, name: str = "total") -> DataFrame:
    """The n groups of the largest or smallest totals; ties go to the smaller key."""
    sums = total_by(df, dims, {name: measure})
    return sums.orderBy(F.col(name).desc() if largest else F.col(name).asc(), *dims).limit(n)


def full_balance(left: DataFrame, right: DataFrame, key: str, income: str, cost: str) -> DataFrame:
    """Two pre-aggregated sides by a full outer join on the key, missing sides as 0, with the balance."""
    joined = left.join(right, key, "full_outer")
    return joined.select(key, F.coalesce(income, F.lit(0)).alias(income), F.coalesce(cost, F.lit(0)).alias(cost)).withColumn("balance", F.col(income) - F.col(cost))


def single_balance(left: DataFrame, right: DataFrame, income: str, cost: str) -> DataFrame:
    """Two one-row sums side by side, the balance and the label of its sign."""
    # one row on either side, so the join is a product of one row by construction
    a, b = left.withColumn("__one", F.lit(1)), right.withColumn("__one", F.lit(1))
    both = a.join(b, "__one").drop("__one").withColumn("balance", F.col(income) - F.col(cost))
    return both.withColumn("status", F.when(F.col("balance") > 0, "surplus").when(F.col("balance") < 0, "deficit").otherwise("balanced"))


def bucket(cases: Sequence[tuple[str, Column]], other: str | None = None) -> Column:
    """The name of the first case that holds."""
    out = reduce(lambda c, x: c.when(x[1], x[0]), cases[1:], F.when(cases[0][1], cases[0][0]))
    return out.otherwise(other) if other is not None else out


def compare_buckets(df: DataFrame, cases: Sequence[tuple[str, Column]], measure: str | Column) -> DataFrame:
    """Totals by the first matching case, with the difference from the first case in the given order."""
    order = F.create_map(*(F.lit(v) for i, (name, _) in enumerate(cases) for v in (name, i)))
    m = F.col(measure) if isinstance(measure, str) else measure
    sums = df.withColumn("entity", bucket(cases)).where("entity is not null").groupBy("entity").agg(F.sum(m).alias("total"))
    first = F.first_value("total").over(Window.partitionBy(F.lit(0)).orderBy(order[F.col("entity")]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return sums.select("entity", "total", (F.col("total") - first).alias("difference"))


def growth(series: DataFrame, period: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Change and percentage against the period before; 0 percent where that is missing or not above 0.

    series holds one row for each group and period already, so the window sorts few rows.
    """
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(period)
    before = F.lag(value).over(w)
    pct = F.when(before > 0, F.round((F.col(value) - before) / before * 100, 2)).otherwise(F.lit(0.0))
    return series.select(*by, period, value, before.alias("previous"), (F.col(value) - before).alias("change"), pct.alias("pct"))


def growth_summary(series: DataFrame, period: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the valid yearly growths and the growth from the first to the last period."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(period)
    before = F.lag(value).over(w)
    rows = series.select(*by, period, value, F.when(before > 0, (F.col(value) - before) / before * 100).alias("g"))
    first, last = F.min_by(value, period), F.max_by(value, period)
    return rows.groupBy(*by).agg(F.avg("g").alias("avg_growth"), F.when(first > 0, (last - first) / first * 100).otherwise(0.0).alias("total_growth"))


def compare_periods(series: DataFrame, period: str, value: str, a: object, b: object, by: Sequence[str] = ()) -> DataFrame:
    """Two periods side by side: difference and growth rate (0 if the base is not above 0), also as text."""
    one = F.sum(F.when(F.col(period) == a, F.col(value)).otherwise(0))
    two = F.sum(F.when(F.col(period) == b, F.col(value)).otherwise(0))
    rows = series.where(F.col(period).isin(a, b)).groupBy(*by).agg(one.alias("base"), two.alias("next"))
    rate = F.when(F.col("base") > 0, (F.col("next") - F.col("base")) / F.col("base") * 100).otherwise(0.0)
    return rows.select(*by, "base", "next", (F.col("next") - F.col("base")).alias("difference"), rate.alias("rate")).withColumn("rate_text", F.format_string("%.1f%%", F.col("rate")))


def plain(col: str | Column) -> Column:
    """A name for comparison: lower case, hyphens and runs of space as one space."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"[-_‌]", " ")), r"\s+", " "))


def phrase_filter(columns: Sequence[str], phrase: str) -> Column:
    """Whether any of the columns contains the phrase, hyphens and spaces aside."""
    return reduce(or_, (plain(c).contains(" ".join(phrase.lower().replace("-", " ").split())) for c in columns))


def words_filter(column: str, words: Sequence[str]) -> Column:
    """Whether the column contains all of the words."""
    return reduce(lambda a, b: a & b, (plain(column).contains(w.lower()) for w in words), F.lit(True))


def search_filter(primary: str, terms: Sequence[str], entity_columns: Sequence[str] = (), keywords: Sequence[str] = (), excludes: Sequence[str] = ()) -> Column:
    """All terms in the primary column, all keywords in any entity column, and no excluded word; nothing given holds always."""
    out = words_filter(primary, terms)
    if keywords and entity_columns:
        out = out & reduce(or_, (words_filter(c, keywords) for c in entity_columns))
    for word in excludes:
        out = out & ~plain(primary).contains(word.lower())
    return out


def first_level(df: DataFrame, levels: Sequence[tuple[str, Column]]) -> DataFrame:
    """The rows of the first level whose filter matches any row, with its name; one pass counts all levels."""
    counts = df.agg(*(F.count_if(c).alias(f"n{i}") for i, (_, c) in enumerate(levels)))
    chosen = reduce(lambda c, i: c.when(F.col(f"n{i}") > 0, i), range(1, len(levels)), F.when(F.col("n0") > 0, 0))
    # the counts are one row, which is broadcast
    tagged = df.join(F.broadcast(counts.select(chosen.alias("__level"))), F.lit(True))
    holds = reduce(or_, ((F.col("__level") == i) & c for i, (_, c) in enumerate(levels)))
    names = F.create_map(*(F.lit(v) for i, (n, _) in enumerate(levels) for v in (i, n)))
    return tagged.where(holds).withColumn("level", names[F.col("__level")]).drop("__level")


def signed_sum(rows: DataFrame, entity: str, period: str, value: str, deduction: Column, rank: str, least_periods: int = 2) -> DataFrame:
    """Sum over periods of the first value of each entity and period, deductions negative, for entities of enough periods."""
    signed = F.when(deduction, -F.col(value)).otherwise(F.col(value))
    first = rows.groupBy(entity, period).agg(F.min_by(signed, rank).alias("v"))
    return first.groupBy(entity).agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("periods")).where(F.col("periods") >= least_periods)


def organisation_totals(df: DataFrame, names: DataFrame, name: str, columns: Sequence[str], value: str) -> DataFrame:
    """Each requested name with its sum over rows where any of the columns equals it, counted once; missing ones have null."""
    keys = F.explode(F.array_distinct(F.array(*columns)))
    sums = df.select(keys.alias(name), value).groupBy(name).agg(F.sum(value).alias("total"))
    return names.select(name).distinct().join(sums, name, "left").withColumn("missing", F.col("total").isNull())


def tree_rollup(nodes: DataFrame, node: str, parent: str, value: str, depth: int = 1000) -> DataFrame:
    """Every node with the sum of the values at and below it, by walking the sums up level by level until none has a parent.

    Each level is written once, so a step reads the one before it and not all of them. A tree of more than `depth` levels, which
    a circle of parents looks like, raises ValueError; nothing is left out.
    """
    links = stash(nodes.select(F.col(node).alias("__n"), F.col(parent).alias("__p")).where("__p is not null"), "links")
    levels = [stash(nodes.select(F.col(node).alias("__at"), F.col(value).alias("__v")).groupBy("__at").agg(F.sum("__v").alias("__v")), "level")]
    while not levels[-1].isEmpty():
        if len(levels) > depth:
            raise ValueError(f"more than {depth} levels, or a circle of parents")
        step = levels[-1].join(links, F.col("__at") == F.col("__n")).groupBy(F.col("__p").alias("__at")).agg(F.sum("__v").alias("__v"))
        levels.append(stash(step, "level"))
    return reduce(DataFrame.unionAll, levels).groupBy(F.col("__at").alias(node)).agg(F.sum("__v").alias(value))


def neighbours(df: DataFrame, code: str, by: Sequence[str] = ()) -> DataFrame:
    """Every distinct code with the one before and after it, within `by` where that is given.

    Codes are sorted by range and looked up within their partition; only the ends of partitions, a row each, meet in one place.
    """
    rows = df.select(*by, code).distinct().repartitionByRange(*by, code).sortWithinPartitions(*by, code)
    rows = stash(rows.withColumn("__part", F.spark_partition_id()), "codes")
    inner = Window.partitionBy("__part").orderBy(*by, code)
    beside = F.struct(*by, code)
    rows = rows.withColumn("__before", F.lag(beside).over(inner)).withColumn("__after", F.lead(beside).over(inner))
    ends = rows.groupBy("__part").agg(F.min(beside).alias("low"), F.max(beside).alias("high"))
    across = Window.orderBy("__part")
    ends = ends.select("__part", F.lag("high").over(across).alias("__low"), F.lead("low").over(across).alias("__high"))
    rows = rows.join(F.broadcast(ends), "__part")
    before, after = F.coalesce("__before", "__low"), F.coalesce("__after", "__high")
    same = lambda x: reduce(lambda a, b: a & b, (x[c].eqNullSafe(F.col(c)) for c in by), F.lit(True))
    return rows.select(*by, code, F.when(same(before), before[code]).alias("previous"), F.when(same(after), after[code]).alias("next"))
