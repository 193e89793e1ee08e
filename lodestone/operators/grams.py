"""The most frequent sequences of words, exact, without counting all of them.

Sequences are hashed into a fixed number of buckets, whose counts bound those of the sequences in them from above. The sequences of
the fullest buckets are counted; the last of the wanted ones among them is a bound that only buckets of as many can reach. If
buckets not yet counted reach it, their sequences are counted in one more pass. So what travels is a row for each bucket and task,
and the sequences of a few buckets; where no sequence stands out, all buckets are counted, as the result demands.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import release, stash

#: buckets of each length, a power of two, and how many of the fullest are counted at first
BUCKETS = 1 << 16
FIRST = 1 << 10
#: texts whose words a task handles at once
TEXTS = 1000


def coded_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Of some rows at a time the words of their lists one after the other as places in an array of distinct words, that array,
    and how many words each list has; a null list has none."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield coded(batch.column(0).slice(at, TEXTS))


def coded(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    found = lists.flatten().dictionary_encode()
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary, lengths.to_numpy(zero_copy_only=False).astype(np.int64)


def sequences(codes: np.ndarray, distinct: pa.Array, lengths: np.ndarray, sizes: list[int], buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each size the places where a sequence begins that does not leave its text, and the buckets of these sequences."""
    own = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)[codes] if len(codes) else np.empty(0, np.uint64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    mixed = own
    for n in range(1, max(sizes) + 1):
        if n > 1:
            mixed = mixed[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[n - 1 :]
            mixed = mixed ^ (mixed >> np.uint64(32))
        if n in sizes:
            at = np.flatnonzero(left[: len(mixed)] >= n)
            spread = mixed[at] * np.uint64(0xBF58476D1CE4E5B9)
            yield n, at, ((spread >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def frequent_grams(rows: DataFrame, words: Column, tops: Mapping[int, int], least: int = 2) -> DataFrame:
    """n, gram and freq of the tops[n] most frequent sequences of n words that occur `least` times and more, ties by gram."""
    sizes, buckets, listed = sorted(tops), BUCKETS, rows.select(words.alias("w"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(sizes), buckets), np.int64)
        for texts in coded_words(batches):
            for n, _, bucket in sequences(*texts, sizes, buckets):
                sums[sizes.index(n)] += np.bincount(bucket, minlength=buckets)
        k, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(bucket), pa.array(sums[k, bucket])], ["k", "bucket", "total"])

    def counted(chosen: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for codes, distinct, lengths in coded_words(batches):
                for n, at, bucket in sequences(codes, distinct, lengths, sizes, buckets):
                    at = at[chosen[sizes.index(n)][bucket]]
                    # equal sequences get equal numbers, one word after the other
                    same = codes[at]
                    for j in range(1, n):
                        same = np.unique(same, return_inverse=True)[1] * len(distinct) + codes[at + j]
                    _, first, freq = np.unique(same, return_index=True, return_counts=True)
                    parts = [distinct.take(pa.array(codes[at[first] + j])) for j in range(n)]
                    gram = pc.binary_join_element_wise(*parts, pa.scalar(" ", distinct.type))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), n), pa.int32()), gram.cast(pa.string()), pa.array(freq, pa.int64())], ["n", "gram", "freq"])

        found = listed.mapInArrow(run, "n int, gram string, freq long").groupBy("n", "gram").agg(F.sum("freq").alias("freq"))
        return best(found.where(F.col("freq") >= least))

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("freq"), "gram"))
        wanted = F.element_at(F.create_map(*(F.lit(v) for kv in tops.items() for v in kv)), F.col("n"))
        # the constant lets each task drop all but its own first rows
        return found.withColumn("rank", rank).where((F.col("rank") <= max(tops.values())) & (F.col("rank") <= wanted)).select("n", "gram", "freq")

    # a row for each bucket, of which there is a fixed number
    summed = listed.mapInArrow(totals, "k long, bucket long, total long").groupBy("k", "bucket").agg(F.sum("total").alias("total")).toArrow()
    total = np.zeros((len(sizes), buckets), np.int64)
    total[summed["k"].to_numpy(), summed["bucket"].to_numpy()] = summed["total"].to_numpy()
    # of equal totals any will do: what is left out is looked at again below
    chosen = np.zeros(total.shape, bool)
    for k, n in enumerate(sizes):
        chosen[k, np.argsort(-total[k], kind="stable")[: max(FIRST, tops[n])]] = True
    chosen &= total >= least
    found = stash(counted(chosen), "grams")
    known = {r["n"]: r["freq"] for r in found.groupBy("n").agg(F.count(F.lit(1)).alias("k"), F.min("freq").alias("freq")).collect() if r["k"] == tops[r["n"]]}
    left = ~chosen & (total >= np.array([[known.get(n, least)] for n in sizes]))
    if not left.any():
        return found
    both = stash(best(found.unionAll(counted(left))), "grams")
    release(found)
    return both
