"""Hierarchies of codes with gaps, and the level of a hierarchy at which a question is answered."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import stash

#: fixed values: levels of a budget from the highest on, with the words that name them
LEVELS = {"part": ("قسمت",), "section": ("بخش",), "clause": ("بند",), "main_entity": ("دستگاه اصلی", "دستگاه اصلي"), "entity": ("دستگاه اجرایی", "دستگاه اجرايي", "دستگاه"), "item": ("جزء", "جزو")}


def detect_level(question: str | Column, levels: Mapping[str, Sequence[str]] = LEVELS, default: str | None = "entity", letters: str = r"[\p{L}\p{N}_]") -> Column:
    """The first of the ordered levels of which a word stands in the question, in either case and not
    next to letters; the default otherwise, and for null."""
    text = F.lower(F.col(question) if isinstance(question, str) else question)
    found = [F.when(text.rlike(f"(?<!{letters})(?:" + "|".join(re.escape(w.lower()) for w in words) + f")(?!{letters})"), name) for name, words in levels.items()]
    return F.coalesce(*found, F.lit(default).cast("string"))


def level_results(rows: DataFrame, levels: Sequence[str], start: str, value: str, most: int = 20) -> DataFrame:
    """level, name, total and n at the level that suits: the next lower one where the start has more than `most` names, the next
    higher one where it has none.

    The levels are columns, from the highest on; null names are none. The probe stops at `most` + 1 names.
    """
    k = list(levels).index(start)
    found = rows.where(F.col(start).isNotNull()).select(start).distinct().limit(most + 1).count()
    if found > most and k + 1 < len(levels):
        k += 1
    elif found == 0 and k > 0:
        k -= 1
    named = rows.where(F.col(levels[k]).isNotNull()).groupBy(F.col(levels[k]).cast("string").alias("name"))
    return named.agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).select(F.lit(levels[k]).alias("level"), "name", "total", "n")


def _prefix(code: Column, widths: Sequence[int]) -> Column:
    """The code's digits up to the first of the widths after which there are zeros only."""
    out = F.when(F.length(code) == widths[-1], code)
    for w in reversed(widths[:-1]):
        out = F.when((F.length(code) == widths[-1]) & F.substring(code, w + 1, widths[-1]).rlike("^0+$"), F.substring(code, 1, w)).otherwise(out)
    return out


def code_tree(rows: DataFrame, code: str, value: str, widths: Sequence[int]) -> DataFrame:
    """code, level, parent, skipped, own_total, own_n, total, n, children: each code that occurs, under its nearest ancestor that does.

    A code has as many digits as the last width. It stands at the first level of whose width the rest are zeros, and covers all
    codes with these digits. Where the next higher level does not occur, the code is attached above the gap: `skipped` counts the
    levels between (for a code without an ancestor, all above it), so no sum is lost; `total` and `n` hold all that a code covers.
    Codes of another length, and null, are left out. Null values count as rows.

    Codes that share an ancestor may be most of all. They do not meet at a join key: distinct codes are cut into sorted ranges of
    equal size, each of which starts with the ancestors of its first code, and one pass finds the last code of each level.
    """
    spark, depth = rows.sparkSession, len(widths)
    own = rows.groupBy(F.col(code).cast("string").alias("code")).agg(F.sum(value).alias("own_total"), F.count(F.lit(1)).alias("own_n"))
    own = own.withColumn("prefix", _prefix(F.col("code"), widths)).where("prefix is not null")
    level = sum((F.when(F.length("prefix") > w, 1).otherwise(0) for w in widths), F.lit(0))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = stash(own.withColumn("level", level).repartitionByRange(parts, "code").withColumn("range", F.spark_partition_id()), "codes")

    # a row for each range and level above its first code: bounded by the partitions, so it may be broadcast
    firsts = own.groupBy("range").agg(F.min("code").alias("first"))
    above = firsts.select("range", "first", F.explode(F.array(*(F.substring("first", 1, w) for w in widths))).alias("prefix"))
    carried = own.select("code", "prefix", "level").join(F.broadcast(above), "prefix").where("code < first").select("range", "code", "prefix", "level", F.lit(True).alias("carried"))
    sorted_codes = own.select("range", "code", "prefix", "level", F.lit(False).alias("carried")).unionByName(carried)
    before = Window.partitionBy("range").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.struct("prefix", "code")), ignorenulls=True).over(before).alias(f"at{k}") for k in range(depth)]
    seen = sorted_codes.select("*", *last).where("not carried")
    holds = [(k, (F.col("level") > k) & F.col("prefix").startswith(F.col(f"at{k}.prefix"))) for k in range(depth)]
    parent, parent_level = F.lit(None).cast("string"), F.lit(-1)
    for k, is_above in holds:
        parent, parent_level = F.when(is_above, F.col(f"at{k}.code")).otherwise(parent), F.when(is_above, k).otherwise(parent_level)
    placed = stash(seen.select("code", "level", "prefix", parent.alias("parent"), (F.col("level") - parent_level - 1).alias("skipped")), "placed")

    # sums of all digits that a code may stand for: added before the shuffle, so an ancestor of most codes is no hot key
    each = F.explode(F.filter(F.array(*(F.when(F.length("prefix") >= w, F.substring("prefix", 1, w)) for w in widths)), lambda p: p.isNotNull()))
    sums = own.select(each.alias("prefix"), "own_total", "own_n").groupBy("prefix").agg(F.sum("own_total").alias("total"), F.sum("own_n").alias("n"))
    children = placed.where("parent is not null").groupBy(F.col("parent").alias("code")).agg(F.count(F.lit(1)).alias("children"))
    out = placed.join(own.select("code", "own_total", "own_n"), "code").join(sums, "prefix").join(children, "code", "left")
    return out.select("code", "level", "parent", "skipped", "own_total", "own_n", "total", "n", F.coalesce("children", F.lit(0)).alias("children"))
