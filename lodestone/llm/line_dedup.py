"""Repeated runs of lines by a suffix array over line ids, built by distributed prefix doubling.

A line's id is a pair of 64-bit hashes of its text; suffixes run over the non-blank lines of a document. A text that repeats
as a whole is represented by its first document. Only suffixes that share their first lines with another are ranked: each
round joins a suffix with the one as many lines further on as its rank stands for and ranks the pairs by a range-partitioned
sort, so that ranks follow the order of the suffixes; a suffix whose pair is unique has left every longest-common-prefix
interval of that depth. Doubling ends when all ranks are unique. In each interval the first suffix stays, the others are blocks
of so many lines that repeat; blocks that overlap make up the maximal repeated runs, whose lines are deleted, and the deepest
block at a run's start names the place that it repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import hot_join, release, stash

LEAST = 2  # lines of a run
WORDS = 50  # words of a line that is a run of its own
WHITE = " \t\n\x0b\f\r"
KEY = ["doc_id", "text_hash"]


def place() -> Column:
    """Where a suffix starts; the first copy is the smallest."""
    return F.struct(*KEY, "nth")


def ranked(rows: DataFrame, keys: list[str], firsts: bool = False) -> DataFrame | None:
    """rows in groups of two and more by keys, with the group's rank in the order of keys, and its first place if firsts is
    set; None if there is no such group."""
    first = [F.min(place()).alias("first")] if firsts else []
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), *first).where("copies > 1")
    # the ids follow partition and row, so after a sort by range they are in order; the written copy keeps them fixed
    order = stash(groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")
    out = None if order.isEmpty() else stash(hot_join(rows, order, keys, "copies", written=True).drop(*keys), "suffixes")
    release(order)
    return out


def later_copies(level: DataFrame, depth: int) -> DataFrame:
    """The suffixes that are not the first of their interval, as blocks of `depth` lines, with the first's place."""
    found = level.where(place() > F.col("first"))
    return found.select(*KEY, "nth", F.lit(depth).alias("size"), F.col("first.doc_id").alias("source"), F.col("first.nth").alias("source_nth"))


def blocks(lines: DataFrame, least: int) -> list[DataFrame]:
    """doc_id, text_hash, nth, size, source, source_nth of the blocks that repeat an earlier one, a written copy for each depth."""
    level, depth = ranked(lines.select(*KEY, "nth", "long", "h1", "h2"), ["h1", "h2"]), 1
    found = []
    if level is not None:
        # only here are first places found apart: most lines are unique, and few of the others are runs of their own
        singles = level if least == 1 else level.where("long")
        first = stash(singles.groupBy("rank").agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("copies")), "firsts")
        found.append(stash(later_copies(hot_join(singles, first, ["rank"], "copies", written=True), 1), "blocks"))
        release(first)
    while level is not None:
        # the last step to `least` may overlap: two ranks then stand for fewer lines than twice the depth
        step = min(depth, least - depth) if depth < least else depth
        ahead = level.select(*KEY, (F.col("nth") - step).alias("nth"), F.col("rank").alias("next"))
        paired = stash(level.select(*KEY, "nth", F.col("rank").alias("own")).join(ahead, [*KEY, "nth"]), "pairs")
        release(level)
        level, depth = ranked(paired, ["own", "next"], firsts=True), depth + step
        release(paired)
        if level is not None and depth >= least:
            found.append(stash(later_copies(level, depth), "blocks"))
    return found


def filled(text: Column) -> Column:
    """The numbers (from 0) and words of the non-blank lines."""
    numbered = F.transform(F.split(text, "\n"), lambda x, k: F.struct(k.alias("line"), x.alias("words")))
    return F.filter(numbered, lambda x: F.trim(x["words"], F.lit(WHITE)) != "")


def repeated_runs(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash and the maximal runs of repeated lines, array<struct<start, length, source, source_start>> over the
    non-blank lines (from 0), of the documents that have any; source is the doc_id of the first copy."""
    text = docs["text"].cast("string")
    split = docs.where(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.hash(text).alias("more"), filled(text).alias("x"))
    line = F.col("x.words")
    wordy = F.coalesce(F.when(F.length(line) >= 2 * words - 1, F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) >= words), F.lit(False))
    lines = split.select(*KEY, "more", F.size("x").alias("n"), F.posexplode("x").alias("nth", "x")).select(*KEY, "more", "n", "nth", wordy.alias("long"), F.xxhash64(line).alias("h1"), F.xxhash64(F.reverse(line)).alias("h2"))
    lines = stash(lines, "lines")
    heads = lines.where(F.col("nth") == 0).where(F.col("n") >= least).select(*KEY, "more", "n").distinct()
    whole = heads.groupBy("text_hash", "more", "n").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last")
    copies = stash(heads.join(whole, ["text_hash", "more", "n"]).where("doc_id > source").select(*KEY, "n", "source"), "copies")
    own = lines.drop("more", "n").join(copies.select(*KEY), KEY, "left_anti").dropDuplicates([*KEY, "nth"])
    found = own.select(*KEY, "nth", F.lit(0).alias("size"), F.col("doc_id").alias("source"), F.col("nth").alias("source_nth")).limit(0)
    for more in blocks(own, least):
        found = found.unionByName(more)
    by_place = Window.partitionBy(*KEY).orderBy("nth", F.desc("size"))
    before = F.max(F.col("nth") + F.col("size")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("opens", F.when(before.isNull() | (F.col("nth") >= before), 1).otherwise(0)).withColumn("run", F.sum("opens").over(by_place))
    deepest = F.min_by(F.struct("source", "source_nth"), F.struct("nth", -F.col("size")))
    runs = opened.groupBy(*KEY, "run").agg(F.min("nth").alias("start"), F.max(F.col("nth") + F.col("size")).alias("end"), deepest.alias("from"))
    shown = F.struct("start", (F.col("end") - F.col("start")).alias("length"), F.col("from.source").alias("source"), F.col("from.source_nth").alias("source_start"))
    listed = runs.groupBy(*KEY).agg(F.array_sort(F.collect_list(shown)).alias("runs"))
    entire = F.struct(F.lit(0).alias("start"), F.col("n").alias("length"), F.col("source").alias("source"), F.lit(0).alias("source_start"))
    out = listed.unionByName(copies.select(*KEY, F.array(entire).alias("runs")))
    release(lines)
    return out


def with_runs(docs: DataFrame, least: int, words: int) -> DataFrame:
    """docs with the runs to delete in __lodestone_runs, null where there are none."""
    runs = stash(repeated_runs(docs, least, words), "runs").select(F.col("doc_id").alias("__lodestone_id"), F.col("text_hash").alias("__lodestone_hash"), F.col("runs").alias("__lodestone_runs"))
    # the table of runs grows with the corpus: merged at every size, never broadcast
    same = (docs["doc_id"].cast("long") == F.col("__lodestone_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__lodestone_hash"))
    return docs.join(runs.hint("merge"), same, "left").drop("__lodestone_id", "__lodestone_hash")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, also where use refers to it for each element of another list."""
    return F.element_at(F.transform(F.array(value), use), 1)


def without_runs(joined: DataFrame, columns: list[str], gone: str) -> DataFrame:
    """columns, with the lines of the runs taken out of text, and their numbers in the column `gone`."""
    places = F.flatten(F.transform("__lodestone_runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    numbers = bound(filled(F.col("text").cast("string")), lambda lines: F.transform(places, lambda k: F.element_at(lines, k + 1)["line"]))
    found = joined.withColumn("__lodestone_gone", F.when(F.col("__lodestone_runs").isNotNull(), numbers))
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__lodestone_gone"))
    kept = bound(F.split("text", "\n"), lambda lines: F.array_join(F.transform(stay(lines), lambda k: F.element_at(lines, k + 1)), "\n"))
    text = F.when(F.col("__lodestone_gone").isNull(), F.col("text")).otherwise(kept)
    return found.select(*(text.alias(c) if c == "text" else F.col(c) for c in columns), F.coalesce("__lodestone_gone", F.array().cast("array<int>")).alias(gone))


def line_dedup(docs: DataFrame, least: int = LEAST, words: int = WORDS, gone: str = "gone") -> DataFrame:
    """docs with all columns, text without the later copies of repeated runs, and the numbers of the lines deleted in `gone`.

    A run is `least` and more lines, or one line of `words` and more words. Lines end at \\n and are compared by 128 bits of
    hashes; a line of white space alone stays, and neither breaks a run nor counts in it. The first copy is the one with the
    smallest doc_id (then hash of the text, then line). Rows that repeat both id and text count once and lose the same lines.
    Null and empty texts, and rows without an id, stay as they are and are nobody's first copy. An empty table gives no rows.
    Runs may overlap themselves: of three equal lines in a row the first stays. Other columns may bear any name but `gone`'s.
    """
    if gone in docs.columns:
        raise ValueError(f"docs has a column {gone}: name another one for the lines deleted")
    return without_runs(with_runs(docs, least, words), docs.columns, gone)


def line_report(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """doc_id, n_lines (non-blank), n_removed, n_runs (maximal runs deleted), longest_run (its lines) and kept_sha256 of each document."""
    rows = docs.select("doc_id", "text", F.size(filled(F.col("text"))).alias("n_lines"))
    found = with_runs(rows, least, words).withColumn("n_runs", F.size(F.coalesce("__lodestone_runs", F.array().cast("array<struct<start:int,length:int,source:bigint,source_start:int>>"))))
    found = found.withColumn("longest_run", F.coalesce(F.array_max(F.transform("__lodestone_runs", lambda r: r["length"])), F.lit(0)))
    return without_runs(found, [*rows.columns, "n_runs", "longest_run"], "gone").select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.col("n_runs").cast("long").alias("n_runs"),
        F.col("longest_run").cast("long").alias("longest_run"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def keep_distinct_lines(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """docs with the later copies of runs deleted, n_chars set anew; rows of which nothing but blanks is left go."""
    found = line_dedup(docs, least, words, "__lodestone_deleted")
    changed = F.size("__lodestone_deleted") > 0
    kept = found.where(~changed | (F.trim("text", F.lit(WHITE)) != ""))
    return kept.select(*(F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))
