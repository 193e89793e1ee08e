"""Profiles, facets and counts of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row per column: kind, rows, nulls, distinct values, and min, max, sum, mean of what reads as a number; one pass."""
    columns = list(columns or df.columns)
    parts = []
    for i, c in enumerate(columns):
        text = F.col(c).cast("string")
        number = text.try_cast("double")
        parts += [
            F.count(text).alias(f"n{i}"), F.count_if(text.isNull()).alias(f"z{i}"), F.count_distinct(text).alias(f"d{i}"),
            F.count(number).alias(f"k{i}"), F.min(number).alias(f"a{i}"), F.max(number).alias(f"b{i}"), F.sum(number).alias(f"s{i}"), F.avg(number).alias(f"m{i}"),
        ]
    wide = df.agg(*parts)
    numeric = lambda i: F.col(f"k{i}") > 0
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.when(numeric(i), "numeric").otherwise("text").alias("kind"), F.col(f"n{i}").alias("n"), F.col(f"z{i}").alias("nulls"),
            F.col(f"d{i}").alias("distinct_values"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"), F.col(f"s{i}").alias("sum"), F.col(f"m{i}").alias("mean"),
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def data_kind(df: DataFrame, column: str) -> DataFrame:
    """numeric_string above 80 % numbers, else by mean length long_text, medium_text, short_text; unknown if empty."""
    text = F.col(column).cast("string")
    stats = df.agg(F.avg(F.when(text.isNotNull(), text.try_cast("double").isNotNull().cast("int"))).alias("numbers"), F.avg(F.length(text)).alias("mean_length"))
    kind = F.when(F.col("numbers").isNull(), "unknown").when(F.col("numbers") > 0.8, "numeric_string").when(F.col("mean_length") > 100, "long_text").when(F.col("mean_length") > 30, "medium_text").otherwise("short_text")
    return stats.select(kind.alias("kind"), "numbers", "mean_length")


def facets(df: DataFrame, parent: str, value: str) -> DataFrame:
    """Distinct parents (offered if more than one) and the range of positive amounts (offered if it spans more than twice)."""
    positive = F.when(F.col(value) > 0, F.col(value))
    out = df.agg(F.count_distinct(parent).alias("parents"), F.min(positive).alias("low"), F.max(positive).alias("high"))
    return out.withColumn("offer_parents", F.col("parents") > 1).withColumn("offer_range", F.coalesce(F.col("high") > 2 * F.col("low"), F.lit(False)))


def slider_step(low: str, high: str):
    """The step of a range slider: a hundredth of the range's power of ten, at least 1."""
    spread = F.col(high) - F.col(low)
    return F.when(spread <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.pow(F.lit(10.0), F.floor(F.log10(spread)) - 2)))


def counts_with_total(df: DataFrame, key: str) -> DataFrame:
    """Rows by key and, with key null, of the whole table."""
    return df.rollup(key).agg(F.count(F.lit(1)).alias("n"), F.grouping(key).cast("int").alias("is_total"))


def distinct_years(df: DataFrame, ts: str) -> DataFrame:
    return df.select(F.year(ts).alias("year")).where("year is not null").distinct()


def closest_year(years: DataFrame, target: int) -> DataFrame:
    """The year nearest to the target; the earlier one on a tie."""
    return years.agg(F.min_by("year", F.struct(F.abs(F.col("year") - target), F.col("year"))).alias("year"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def rejection_rates(events: DataFrame, by: Sequence[str], rejected) -> DataFrame:
    """Share of rejected decisions, with totals."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(rejected).alias("rejected"), F.avg(rejected.cast("double")).alias("rate"))


def evaluation_sets(cases: DataFrame, score: str, a: str, b: str) -> DataFrame:
    """Mean score and counts overall, by a, and by b, in one pass over grouping sets."""
    g = cases.groupingSets([[a], [b], []], a, b)
    return g.agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))
