"""Time windows, due times and turn histories; the same transformations serve batch and streaming frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import whole_word

FOLLOW_UPS = ("what about", "and", "also", "why", "how about", "it", "that")


def tumbling(events: DataFrame, ts: str, width: str, by: Sequence[str], late: str | None = None) -> DataFrame:
    """Counts by window and key; with `late`, a watermark bounds the state of a streaming frame and drops later rows."""
    rows = events.withWatermark(ts, late) if late else events
    w = rows.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sliding(events: DataFrame, ts: str, width: str, step: str, by: Sequence[str], value: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    w = rows.groupBy(F.window(ts, width, step).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, by: Sequence[str], late: str | None = None) -> DataFrame:
    """Runs of events with less than the gap between them."""
    rows = events.withWatermark(ts, late) if late else events
    w = rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return w.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_only(events: DataFrame, ts: str, keys: Sequence[str], late: str) -> DataFrame:
    """Repeated events dropped while the watermark remembers them."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def trailing_count(events: DataFrame, ts: str, by: Sequence[str], seconds: int) -> DataFrame:
    """Each event with the number of its key's events in the last so many seconds, itself included (batch)."""
    w = Window.partitionBy(*by).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(w))


def last_turns(turns: DataFrame, by: Sequence[str], order: str, n: int = 10) -> DataFrame:
    """The last n rows of each conversation."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))
    return turns.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def with_history(turns: DataFrame, by: str, order: str, text: str, n: int = 5) -> DataFrame:
    """Each turn with the texts of up to n turns before it, oldest first."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(text).over(w))


def follow_up(text: Column, has_history: Column, most_words: int = 5) -> Column:
    """Whether a turn leans on the ones before: history, and an indicator word or few words."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    hint = F.lower(text).rlike(whole_word("|".join(FOLLOW_UPS)))
    return has_history & (hint | (F.size(words) <= most_words))


def due(last: Column, hours: Column, now: Column, enabled: Column) -> Column:
    """Whether a crawl is due: enabled, and never done or at least the interval ago."""
    return enabled & (last.isNull() | (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(last.cast("timestamp")) >= hours * 3600))


def next_run(last: Column, hours: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(last.cast("timestamp")) + hours * 3600)


def nearest_rank(rows: DataFrame, by: Sequence[str], order: str, value: str, last: int = 120, share: float = 0.9) -> DataFrame:
    """The nearest-rank percentile of each key's last values: index round(share * (n - 1)) of the sorted ones."""
    recent = last_turns(rows, by, order, last)
    values = F.array_sort(F.collect_list(value))
    grouped = recent.groupBy(*by).agg(values.alias("v"))
    return grouped.select(*by, F.element_at("v", (F.round(share * (F.size("v") - 1)) + 1).cast("int")).alias("value"), F.size("v").alias("n"))


def retained(entries: DataFrame, last_access: str, now: Column, ttl_seconds: int, most: int, key: str) -> DataFrame:
    """Cache entries that are neither expired nor beyond the most recently used `most`."""
    fresh = entries.where(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(last_access).cast("timestamp")) < ttl_seconds)
    return fresh.orderBy(F.col(last_access).desc(), key).limit(most)


def relevant_facts(facts: DataFrame, text: str, words: Sequence[str], confidence: str, ts: str, k: int = 5) -> DataFrame:
    """Facts with any query word, the surest and newest first."""
    hit = F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(F.lower(text), w))
    return facts.where(hit).orderBy(F.col(confidence).desc(), F.col(ts).desc(), text).limit(k)
