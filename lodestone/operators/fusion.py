"""Merging of result lists, maps and sub-questions; iterative retrieval; greedy near-duplicate removal in small groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.similarity import jaccard


def tagged_union(parts: dict[str, DataFrame], weights: dict[str, float], score: str = "score") -> DataFrame:
    """Rows of several routes with their name, scores times the route's weight; columns may differ."""
    out = None
    for name, df in parts.items():
        part = df.withColumn("route", F.lit(name)).withColumn(score, F.col(score) * weights.get(name, 1.0))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def weighted_merge(dense: DataFrame, sparse: DataFrame, key: str, dense_weight: float, sparse_weight: float, least: float = 0.0) -> DataFrame:
    """Dense and a tenth of sparse scores, weighted, over a full outer join; the threshold applies after the weights."""
    both = dense.join(sparse, key, "full_outer")
    score = dense_weight * F.coalesce("dense", F.lit(0.0)) + sparse_weight * F.coalesce("sparse", F.lit(0.0)) / 10
    return both.select(key, score.alias("score")).where(F.col("score") >= least)


def multi_hop_merge(hits: DataFrame, question: str, key: str, hop: str, rank: str, score: str, k: int, bonus: float = 0.1, anchor: float = 0.05, reserved: int = 2) -> DataFrame:
    """Results of several hops for each question: the best score of a key, a bonus for each further hop that has it and for
    leading one; the best `reserved` keys of every hop come first, then by score, k in all; ties by key."""
    merged = hits.groupBy(question, key).agg(F.max(score).alias("s"), F.count_distinct(hop).alias("hops"), F.min(rank).alias("lead"), F.min(F.struct(rank, hop)).alias("home"))
    merged = merged.withColumn("score", F.col("s") + bonus * (F.col("hops") - 1) + F.when(F.col("lead") == 1, anchor).otherwise(0.0)).withColumn("hop", F.col("home")[hop])
    place = F.row_number().over(Window.partitionBy(question, "hop").orderBy(F.col("score").desc(), key))
    final = F.row_number().over(Window.partitionBy(question).orderBy((F.col("place") <= reserved).desc(), F.col("score").desc(), key))
    return merged.withColumn("place", place).withColumn("rank", final).where(F.col("rank") <= k).select(question, key, "score", "rank")


def interleave(rows: DataFrame, side: str, score: str, key: str, k: int) -> DataFrame:
    """Comparison results taken from each side in turn."""
    turn = F.row_number().over(Window.partitionBy(side).orderBy(F.col(score).desc(), key))
    return rows.withColumn("__t", turn).orderBy("__t", side).limit(k).drop("__t")


def retrieve_in_rounds(search: Callable[[Sequence[str]], DataFrame], words: Sequence[str], refine: Callable[[DataFrame, Sequence[str]], Sequence[str]], rounds: int = 3) -> DataFrame:
    """Up to so many searches; each adds the documents that none before it found, and the next query is refined by them."""
    found = None
    for i in range(rounds):
        new = search(words)
        if found is not None:
            new = new.join(found.select("doc"), "doc", "left_anti")
        new = new.withColumn("round", F.lit(i))
        found = new if found is None else found.unionByName(new)
        more = refine(new, words)
        if [*more] == [*words]:
            break
        words = more
    return found


def merge_maps(a: str | Column, b: str | Column) -> Column:
    """Per key the longer of the two values, the first one on a tie; an empty or missing one never wins over a value."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.map_zip_with(x, y, lambda k, u, v: F.when(F.coalesce(F.length(v), F.lit(0)) > F.coalesce(F.length(u), F.lit(0)), v).otherwise(u))


def by_priority(rows: DataFrame, key: str, priority: str, columns: Sequence[str]) -> DataFrame:
    """The row of the smallest priority of each key, in order of priority."""
    best = rows.groupBy(key).agg(F.min_by(F.struct(*columns, priority), F.struct(priority, *columns)).alias("b"))
    return best.select(key, *(F.col(f"b.{c}").alias(c) for c in [*columns, priority])).orderBy(priority, key)


def greedy_distinct(rows: DataFrame, group: str, order: str, words: str, least: float = 0.7) -> DataFrame:
    """Of each group's few rows, those that are not like any kept one before them; the group must fit a task by nature
    (suggestions of one question), as every decision needs the ones before."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        kept: list[set] = []
        mask = []
        for w in table.column(words).to_pylist():
            s = set(w or ())
            like = any(len(s & k) > least * len(s | k) for k in kept if s | k)
            mask.append(not like)
            if not like:
                kept.append(s)
        return table.filter(pa.array(mask, pa.bool_()))

    return rows.groupBy(group).applyInArrow(run, rows.schema)


def boosted(rows: DataFrame, score: str, query: Column, words: Column, least: float = 0.6, factor: float = 2.0) -> DataFrame:
    """Scores raised by factor * jaccard where the question is like enough, sorted anew."""
    j = jaccard(query, words)
    return rows.withColumn(score, F.col(score) + F.when(j >= least, factor * j).otherwise(0.0)).orderBy(F.col(score).desc())


def numbered_context(rows: DataFrame, group: str, rank: str, text: str, limit: int = 500) -> DataFrame:
    """'[rank] text' of a group's results in order, as one text."""
    line = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), F.substring(text, 1, limit))
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def markdown_table(rows: DataFrame, group: str, order: str, columns: Sequence[str]) -> DataFrame:
    """A group's rows as a table in Markdown."""
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    return rows.groupBy(group).agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n")).alias("markdown"))
