"""Best-fit packing of documents into training sequences by a grouping genetic algorithm.

Pieces of equal length are exchangeable, so the packing is solved on the histogram of lengths, which has fewer entries
than a sequence has tokens however many documents there are. A genome is a list of groups: a bin pattern (lengths that
share a bin) and how many bins are filled by it. Crossover injects well-filled bins of one parent into the other, removes
the bins that would then hold a piece twice and packs the displaced pieces again by best fit. Islands evolve as Spark
tasks; after each epoch the driver moves every island's elite to its neighbour. Genomes stay small: each pattern of a
best-fit pass uses up at least one length.

The bins are then dealt to documents without a shuffle of texts: each task ranks its own pieces by length while it
tokenises, and the ranks are offset by the counts of the tasks before it. A piece that fills a sequence alone needs no dealing:
its sequence has a negative number made of its task and its place there.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import Encoder, packed, text_batches
from lodestone.llm.common import id_text, stash

#: Fixed: how the public byte-level vocabulary splits a text into pretokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The library's pattern runs out of stack on white space of several hundred thousand characters; texts that hold a run of this
#: length are left to the named method, which gives the same ids.
LONG_WHITE = re.compile(r"\s{10000}")
CAPACITY = 1024
END_ID = 2
TASK_PIECES = 1 << 36  # more full pieces than a task can have
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 6, 3, 4, 6

Genome = list[tuple[tuple[int, ...], int]]


class LibraryEncoder(Encoder):
    """The same ids, with what the memo lacks encoded by the tiktoken library over the vocabulary's own ranks: packing needs ids
    only, however they are found."""

    def __init__(self, path: str):
        super().__init__(path)
        ranks = {t: k for k, t in enumerate(self.token) if t and k not in self.special.values()}
        self.library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def split(self, text: str) -> list[bytes]:
        return super().split(text) if LONG_WHITE.search(text) else [packed(self.library.encode_ordinary(text))]

    def learn(self, chunks: list[str]) -> None:
        if len(self.memo) + len(chunks) > self.limit:
            self.memo.clear()
        self.memo.update((c, None if not c or c.isspace() else b"".join(self.split(" " + c))) for c in chunks)


_ENCODERS: dict[str, LibraryEncoder] = {}


def best_fit(counts: dict[int, int], capacity: int, rng: random.Random, noise: float = 0.0) -> Genome:
    """Pack counts (length -> pieces): the longest piece opens a bin, which takes an exact filler, an exact pair, or the longest that fits."""
    left = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(left)
    genome: Genome = []
    while lengths:
        top = lengths[-1]
        used, room = Counter({top: 1}), capacity - top
        while room > 0:
            fitting = [x for x in lengths if x <= room and left[x] > used[x]]
            if not fitting:
                break
            pick = fitting[-1]
            if pick != room:
                there = set(fitting)
                pairs = [x for x in fitting if room - x in there and (2 * x != room or left[x] > used[x] + 1)]
                if pairs:
                    pick = rng.choice(pairs) if noise else pairs[-1]
                elif noise and rng.random() < noise:
                    pick = rng.choice(fitting)
            used[pick] += 1
            room -= pick
        times = min(left[x] // n for x, n in used.items())
        genome.append((tuple(sorted(used.elements(), reverse=True)), times))
        for x, n in used.items():
            left[x] -= n * times
        lengths = [x for x in lengths if left[x] > 0]
    return genome


def fitness(genome: Genome, capacity: int) -> tuple[float, float]:
    """Fewer bins first, then fuller ones."""
    return -float(sum(m for _, m in genome)), sum(m * (sum(p) / capacity) ** 2 for p, m in genome)


def crossover(a: Genome, b: Genome, counts: dict[int, int], capacity: int, rng: random.Random) -> Genome:
    """Bins of b, then bins of a as far as their pieces are still free; what is displaced is packed by best fit."""
    left, child = dict(counts), []

    def inject(groups: Genome) -> None:
        for pattern, times in groups:
            used = Counter(pattern)
            fits = min(left[x] // n for x, n in used.items())
            if take := min(times, fits):
                child.append((pattern, take))
                for x, n in used.items():
                    left[x] -= n * take

    well = [g for g in b if sum(g[0]) == capacity] or sorted(b, key=lambda g: -sum(g[0]))[: max(1, len(b) // 4)]
    inject(rng.sample(well, max(1, len(well) // 2)))
    kept = [g for g in a if sum(g[0]) >= capacity - rng.randrange(3)]
    rng.shuffle(kept)
    inject(kept)
    return child + best_fit(left, capacity, rng, noise=rng.choice([0.0, 0.05, 0.3]))


def evolve(population: list[Genome], counts: dict[int, int], capacity: int, rng: random.Random, generations: int) -> list[Genome]:
    size = len(population)
    bound = -(-sum(k * v for k, v in counts.items()) // capacity)
    for _ in range(generations):
        population.sort(key=lambda g: fitness(g, capacity), reverse=True)
        if -fitness(population[0], capacity)[0] <= bound:
            break
        parents = population[: max(2, size // 2)]
        population = [*parents, *(crossover(*rng.sample(parents, 2), counts, capacity, rng) for _ in range(size - len(parents)))]
    return sorted(population, key=lambda g: fitness(g, capacity), reverse=True)


def pack_lengths(spark, counts: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS) -> Genome:
    """The best packing found of a histogram of lengths; islands run as tasks, elites move around a ring between epochs."""
    if not counts:
        return []
    bound = -(-sum(k * v for k, v in counts.items()) // capacity)
    best = best_fit(counts, capacity, random.Random(0))
    elites: list[list[Genome]] = [[best] for _ in range(islands)]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k, epoch, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rng = random.Random(k * 1000 + epoch)
                seeds = [[(tuple(p), m) for p, m in g] for g in json.loads(text)]
                full = seeds + [best_fit(counts, capacity, rng, noise=0.02 * (i + 1)) for i in range(POPULATION - len(seeds))]
                found = evolve(full, counts, capacity, rng, GENERATIONS)[:2]
                yield pa.RecordBatch.from_pydict({"island": [k], "genomes": [json.dumps(found)]})

    for epoch in range(epochs):
        if sum(m for _, m in best) <= bound:
            break
        rows = [(k, epoch, json.dumps(elites[k])) for k in range(islands)]
        frame = spark.createDataFrame(rows, "island long, epoch long, genomes string").repartition(islands, "island")
        found = {r["island"]: [[(tuple(p), m) for p, m in g] for g in json.loads(r["genomes"])] for r in frame.mapInArrow(run, "island long, genomes string").collect()}
        best = max([best, *(g for gs in found.values() for g in gs)], key=lambda g: fitness(g, capacity))
        elites = [[*found[k][:1], found[(k - 1) % islands][0]] for k in range(islands)]
    return best


def slots(genome: Genome) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, to rank, sequence of the first, offset): where the pieces of each length go."""
    rows, rank, sequence = [], Counter(), 0
    for pattern, times in genome:
        offset = 0
        for x in pattern:
            rows.append((x, rank[x], rank[x] + times, sequence, offset))
            rank[x] += times
            offset += x
        sequence += times
    return rows


def tokenise(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, n (tokens), crcs of its pieces, part and the ranks of its pieces among those of the same task."""

    def run(batches):
        enc = _ENCODERS.setdefault(vocabulary, None) or LibraryEncoder(vocabulary)
        _ENCODERS[vocabulary] = enc
        part, ranks, full = TaskContext.get().partitionId(), Counter(), 0
        end = packed([END_ID])
        for ids, texts in text_batches(batches):
            out = {k: [] for k in ("n", "crcs", "rest", "rank", "full")}
            for data in enc.encode(texts):
                data += end
                n = len(data) // 4
                rest = n % capacity
                starts = [*([0] if rest else []), *range(rest, n, capacity)]
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, [*starts[1:], n], strict=True)]
                for k, v in zip(out, (n, crcs, rest, ranks[rest], full), strict=True):
                    out[k].append(v)
                ranks[rest] += 1
                full += n // capacity
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["crcs"], pa.list_(pa.int64())), pa.array([part] * len(ids), pa.int64())]
                + [pa.array(out[k], pa.int64()) for k in ("rest", "rank", "full")],
                ["doc_id", "n", "crcs", "part", "rest", "rank", "full"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, n long, crcs array<long>, part long, rest long, rank long, full long")


def best_fit_pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds the end token alone. Only documents longer than a sequence are cut;
    their first piece takes the remainder. Rows repeated with the same id are packed each. Other columns are not read;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = stash(tokenise(docs, vocabulary, capacity), "tokens")
    per_part = stash(rows.where("rest > 0").groupBy("part", "rest").agg(F.count(F.lit(1)).alias("pieces")), "lengths")
    counts = {r["rest"]: r["pieces"] for r in per_part.groupBy("rest").agg(F.sum("pieces").alias("pieces")).collect()}  # a row for each length
    genome = pack_lengths(spark, counts, capacity)
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rank_base = per_part.select("part", "rest", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("rank_base"))
    # a row for each length and pattern of the genome: best fit makes at most one pattern a length, a crossover adds as many
    places = spark.createDataFrame(slots(genome), "rest long, low long, high long, sequence long, offset long")
    # the counts of tasks grow with the input: merged at every size, never broadcast
    ranked = rows.join(rank_base.hint("merge"), ["part", "rest"], "left").withColumn("rank", F.col("rank") + F.col("rank_base"))
    placed = ranked.join(F.broadcast(places), (ranked["rest"] == places["rest"]) & (ranked["rank"] >= places["low"]) & (ranked["rank"] < places["high"]), "left").drop(places["rest"])
    pieces = placed.select("*", F.posexplode("crcs").alias("piece", "ids_crc32"))
    first = (F.col("piece") == 0) & (F.col("rest") > 0)
    whole = F.col("piece") - F.when(F.col("rest") > 0, 1).otherwise(0)  # which of the document's full pieces
    return pieces.select(
        "doc_id",
        "piece",
        F.when(first, F.lit(0)).otherwise(F.col("rest") + whole * capacity).cast("long").alias("start"),
        F.when(first, F.col("rest")).otherwise(F.lit(capacity)).cast("long").alias("length"),
        "ids_crc32",
        F.when(first, F.col("sequence") + F.col("rank") - F.col("low")).otherwise(-1 - (F.col("part") * F.lit(TASK_PIECES) + F.col("full") + whole)).cast("long").alias("sequence_id"),
        F.when(first, F.col("offset")).otherwise(F.lit(0)).cast("long").alias("offset"),
    )
