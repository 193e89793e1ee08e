"""Similarity join of documents by the Jaccard index of their word shingles, with an R-tree over count vectors.

1. Each document becomes the set of its hashed shingles. Documents with equal sets are one representative from then on.
2. Families. Two sets that reach the threshold differ in at most `tau` elements, a number that their size bounds. Elements are
   hashed into more than tau groups; as each differing element spoils one group, all but tau of the groups with elements hold
   the same elements in both sets. A set that shares fewer of its groups with others has no partner and is dropped; sets that
   then share a group's whole content are joined into families, and no link crosses families. The number of groups depends
   on a band of sizes, and a set also takes part in the band of its largest possible partner.
3. Within a family, elements are hashed into coordinates; the group counts of a set are a point, points are kept in an R-tree
   whose boxes hold the largest count of each group. The sum of coordinate minima bounds the overlap from above, for boxes
   as for points; pairs that survive are verified on the sets. Only pairs that are not connected yet need verifying.
4. Families too large for one task are cut into blocks, and each pair of blocks is a task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import hot_join, id_text, release, stash, tidy
from lodestone.llm.components import components
from lodestone.sources.scratch import written_bytes

COORDINATES = 32, 512  # least and most coordinates of a point
LEAF = 16
BLOCK = 3_000_000  # weight of a family that one task holds from each of its two blocks
POINT = 256  # weight of a document's point, besides one for each shingle
GROWTH = 1.5  # of the size bands
ROUNDS = 2  # of dropping sets without a partner; more of them would only make families smaller
WAYS = 1 << 10  # more than the size bands of texts that memory holds times SEEDS
PARTS = 4  # a power of two: keys are shuffled in so many parts, one after the other, so that disk holds one part's shuffle
ONCE = 1 << 28  # bytes of a written sketch up to which all parts are shuffled at once, which takes the driver fewer jobs
SEEDS = 8  # ways of grouping that are tried for sets with too many empty groups
WORDS = 400_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Sets of hashed shingles; word hashes are kept in a memo of bounded size."""

    def __init__(self, size: int = 3):
        self.size, self.memo = size, {}

    def word_hashes(self, text: str) -> np.ndarray:
        """Hashes of the words between ASCII white space, with A-Z in lower case (which is what bytes.lower and split do)."""
        words = text.encode("utf-8", "replace").lower().split()
        memo = self.memo
        found = [*map(memo.get, words)]
        if None in found:
            if len(memo) > WORDS:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            found = [memo[w] for w in words]
        return np.array(found, dtype=np.uint64)

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of each text, sorted, one after the other, and where each text's begin.

        A text with fewer words than a shingle has its whole sequence as one.
        """
        words = [self.word_hashes(t or "") for t in texts]
        lengths = np.array([*map(len, words)], np.int64)
        w = np.concatenate([*words, np.zeros(self.size, np.uint64)])
        k = np.minimum(self.size, lengths)
        counts = np.where(lengths > 0, lengths - k + 1, 0)
        ends = np.cumsum(counts)
        # the place of each shingle's first word
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(np.cumsum(lengths) - lengths - (ends - counts), counts)
        size = np.repeat(k, counts)
        x = size.astype(np.uint64)
        for j in range(self.size):
            y = mix(x * U(0x9E3779B97F4A7C15) + w[at + j])
            x = np.where(j < size, y, x)
        for a, b in zip(ends - counts, ends, strict=True):
            x[a:b].sort()
        fresh = np.ones(len(x), bool)
        fresh[1:] = x[1:] != x[:-1]
        fresh[(ends - counts)[counts > 0]] = True
        return x[fresh], np.concatenate([[0], np.concatenate([[0], np.cumsum(fresh)])[ends]]).astype(np.int64)

    def shingles(self, text: str | None) -> np.ndarray:
        return self.sets([text])[0]


class Bands:
    """Size bands, and into how many groups the elements of sets of a band are hashed."""

    def __init__(self, percent: int):
        self.percent, self.first, self.groups, self.tau = percent, [1], [], []

    def of(self, n: int) -> int:
        while self.first[-1] <= n:
            low = self.first[-1]
            high = max(low + 1, int(low * GROWTH))
            tau = (100 - self.percent) * 2 * (high - 1) // (100 + self.percent)
            smallest, groups = max(1, low * self.percent // 100), tau + 1
            # some groups will be empty: as many more as leave tau + 1 with elements
            while tau and groups < smallest and groups * (1 - np.exp(-smallest / groups)) < 1.03 * (tau + 1):
                groups += max(1, groups // 50)
            self.first.append(high)
            self.groups.append(groups)
            self.tau.append(tau)
        return bisect.bisect_right(self.first, n) - 1

    def keys(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Keys of the groups of all sets; of each key the set, the way of grouping, and how many keys of it any partner shares.

        The lowest bits of a key are its way of grouping.
        """
        sizes = np.diff(starts)
        jobs = [(k, b) for k, n in enumerate(sizes.tolist()) if n for b in range(self.of(n), self.of(100 * n // self.percent) + 1)]
        out = []
        for seed in range(SEEDS):
            if not jobs:
                break
            who, band = (np.array(c) for c in zip(*jobs, strict=True))
            groups, lengths = np.array(self.groups)[band], sizes[who]
            ends = np.cumsum(lengths)
            elements = x[np.arange(ends[-1]) + np.repeat(starts[who] - (ends - lengths), lengths)]
            way = band * SEEDS + seed
            salt = mix((way.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))
            hashed = mix(elements ^ np.repeat(salt, lengths))
            base = np.cumsum(groups) - groups
            place = (hashed % np.repeat(groups, lengths).astype(np.uint64)).astype(np.int64) + np.repeat(base, lengths)
            total = int(groups.sum())
            # exact sums of both halves of a second hash tell contents apart
            spread = mix(hashed + U(0xD1B54A32D192ED03))
            high, low = (np.bincount(place, weights=(h & U(0xFFFFFFFF)).astype(np.float64), minlength=total).astype(np.uint64) for h in (spread >> U(32), spread))
            held = np.bincount(place, minlength=total) > 0
            own = np.repeat(np.arange(len(jobs)), groups)
            # at most tau of the groups with elements differ from those of a partner
            least = np.bincount(own[held], minlength=len(jobs)) - np.array(self.tau)[band]
            if seed + 1 == SEEDS:
                held |= (least < 1)[own]  # empty groups count, too, where nothing else can
            number = (np.arange(total) - np.repeat(base, groups)).astype(np.uint64)
            found = mix(mix(high * U(0x9E3779B97F4A7C15) + low) ^ mix(np.repeat(salt, groups) + number))
            found = found & ~U(WAYS - 1) | way[own].astype(np.uint64)
            out.append((found[held], who[own][held], way[own][held], np.maximum(least, 1)[own][held]))
            jobs = [j for j, n in zip(jobs, least, strict=True) if n < 1]
        empty = np.empty(0, np.int64)
        return tuple(np.concatenate(c) for c in zip((empty.astype(np.uint64), empty, empty, empty), *out, strict=True))


class RTree:
    """Bulk-loaded over points; a node keeps the largest count of each group, and the range of set sizes below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.order = self.tile(np.argsort(sizes, kind="stable"), points, leaf)
        self.points, self.sizes, self.leaf = points[self.order], sizes[self.order], leaf
        self.levels = []
        high, low = self.points, self.sizes
        while True:
            starts = np.arange(0, len(high), leaf)
            high, low = np.maximum.reduceat(high, starts, axis=0), np.minimum.reduceat(low, starts)
            self.levels.append((high, low))
            if len(high) == 1:
                break

    def tile(self, rows: np.ndarray, points: np.ndarray, leaf: int) -> np.ndarray:
        """Halve by the group of the widest spread until a leaf is left."""
        done, todo = [], [rows]
        while todo:
            r = todo.pop()
            if len(r) <= leaf:
                done.append(r)
                continue
            p = points[r]
            r = r[np.argsort(p[:, int(np.argmax(p.max(axis=0) - p.min(axis=0)))], kind="stable")]
            half = (len(r) // 2 + leaf - 1) // leaf * leaf
            half = half if half < len(r) else len(r) // 2
            todo += [r[half:], r[:half]]
        return np.concatenate(done)

    def below(self, level: int) -> int:
        """How many entries the nodes of a level point to."""
        return len(self.levels[level - 1][0]) if level else len(self.points)

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose summed minima allow the overlap that the threshold needs: overlap >= p / (100 + p) of both sizes."""
        nodes = np.array([0])
        for level in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[level]
            bound = np.minimum(high[nodes], point).sum(axis=1, dtype=np.int64)
            nodes = nodes[bound * (100 + percent) >= percent * (size + low[nodes])]
            nodes = (nodes[:, None] * self.leaf + np.arange(self.leaf)).ravel()
            nodes = nodes[nodes < self.below(level)]
        bound = np.minimum(self.points[nodes], point).sum(axis=1, dtype=np.int64)
        return self.order[nodes[bound * (100 + percent) >= percent * (size + self.sizes[nodes])]]


def family_links(ids: list[int], sides: np.ndarray, sets: list[np.ndarray], same: bool, percent: int) -> list[tuple[int, int]]:
    """Links that connect what the threshold connects; same: within one block, else only across the two sides."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    groups = min(COORDINATES[1], max(COORDINATES[0], 1 << (int(np.median(sizes)) // 4).bit_length()))
    counts = np.zeros((n, groups), np.uint16 if sizes.max() < 1 << 16 else np.int64)
    for k, s in enumerate(sets):
        counts[k] = np.bincount((mix(s) % U(groups)).astype(np.intp), minlength=groups)
    label = np.arange(n)
    members = {k: [k] for k in range(n)}
    tree, out = RTree(counts, sizes), []
    for k in range(n):
        if len(members) == 1:
            break
        near = tree.search(counts[k], int(sizes[k]), percent)
        near = near[(near < k) & (label[near] != label[k]) & (same | (sides[near] != sides[k]))]
        for j in near.tolist():
            a, b = int(label[j]), int(label[k])
            if a == b:
                continue
            shared = len(np.intersect1d(sets[j], sets[k], assume_unique=True))
            if 100 * shared >= percent * (sizes[j] + sizes[k] - shared):
                if len(members[a]) > len(members[b]):
                    a, b = b, a
                label[members[a]] = b
                members[b] += members.pop(a)
                out.append((ids[j], ids[k]))
    return out


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed numbers."""
    if not len(s):
        return 0, 0
    return int(mix(s ^ U(0x8EBC6AF09C88C6E3)).sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix(s ^ U(0x589965CC75374CC3))).astype(np.int64))


def key_parts() -> list[str]:
    return [f"keys{p}" for p in range(PARTS)]


def sketch(plain: DataFrame, size: int, percent: int) -> DataFrame:
    """row (a number of its own for every row), doc_id, text_hash, n, d1, d2 (digest of the set) and the keys of its groups.

    tags has a number for each way of grouping: the way and, in the lower half, how many keys any partner shares. The keys are
    dealt by their highest bits into the columns of key_parts(), which are read one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        shingler, bands, number = Shingler(size), Bands(percent), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x, starts = shingler.sets(part.column(1).to_pylist())
                digests = [set_digest(x[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                keys, owners, ways, least = bands.keys(x, starts)
                order = np.lexsort((ways, owners))
                keys, owners, tags = keys[order], owners[order], ((ways << 32) + least)[order]
                first = np.ones(len(keys), bool)
                first[1:] = (owners[1:] != owners[:-1]) | (tags[1:] != tags[:-1])
                part_of = (keys >> U(32)).astype(np.int64) * PARTS >> 32
                listed = []
                for of, held in ((owners[first], tags[first]), *((owners[part_of == p], keys[part_of == p].astype(np.int64)) for p in range(PARTS))):
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=part.num_rows))]).astype(np.int32)
                    listed.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(held)))
                rows = pa.array(np.arange(number, number + part.num_rows), pa.int64())
                number += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [rows, part.column(0), part.column(2), pa.array(np.diff(starts), pa.int64()), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)), *listed],
                    ["row", "doc_id", "text_hash", "n", "d1", "d2", "tags", *key_parts()],
                )

    hashed = plain.select("doc_id", "text", F.xxhash64("text"))
    return hashed.mapInArrow(run, "row long, doc_id long, text_hash long, n long, d1 long, d2 long, tags array<long>, " + ", ".join(f"{p} array<long>" for p in key_parts()))


def shared_keys(keyed: DataFrame) -> DataFrame:
    """Rows whose key occurs in two sets, with the smallest set that has it; each row travels once."""
    own = Window.partitionBy("key")
    return keyed.select("rep", "key", F.min("rep").over(own).alias("first"), F.max("rep").over(own).alias("last")).where("first < last").select("rep", "key", "first")


def families(keyed: list[DataFrame], tags: DataFrame) -> DataFrame:
    """id and component_id of the sets (rep, key) that may have a partner, by shared keys over any number of steps.

    Most keys are of one set only; what is left is few. keyed has the parts of the keys, of which one is shuffled at a time.
    """
    found = []
    for part in keyed:
        found.append(stash(shared_keys(part), "hits"))
        tidy(part.sparkSession)
    hits = reduce(DataFrame.unionAll, found)
    for _ in range(ROUNDS):
        # a set with too few shared keys has no partner; without it, others may have too few
        counted = hits.groupBy("rep", F.col("key").bitwiseAND(F.lit(WAYS - 1)).alias("way")).agg(F.count(F.lit(1)).alias("n"))
        live = counted.join(tags, ["rep", "way"]).where("n >= least").select("rep", "way")
        with_way = hits.select("rep", "key", F.col("key").bitwiseAND(F.lit(WAYS - 1)).alias("way"))
        fewer = stash(shared_keys(with_way.join(live, ["rep", "way"], "left_semi").select("rep", "key")), "hits")
        release(*found)
        hits, found = fewer, [fewer]
    # every set joins the smallest set with a key of its own
    stars = stash(hits.where("rep > first").select("rep", "first").distinct(), "stars")
    release(*found)
    out = components(stars)
    release(stars)
    return out


def jaccard_rows(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, text_hash, n_shingles, component_id and component (a number of the component) of every row of docs.

    The rules are those of jaccard_groups; a row without shingles or without an id is a component of its own.
    """
    plain = id_text(docs, id_col, text_col)
    tidy(docs.sparkSession)
    drawn = stash(sketch(plain, size, percent), "sketch")
    rows = stash(drawn.drop("tags", *key_parts()), "rows")
    known = rows.where("n > 0 and doc_id is not null")
    # sets that are equal are one representative from here on; only it brings keys
    reps = stash(known.groupBy("n", "d1", "d2").agg(F.min("row").alias("rep")), "reps")
    members = known.select("row", "n", "d1", "d2").join(reps, ["n", "d1", "d2"]).select("row", "rep")
    # copies are few next to all rows, and their written size decides how they are left out
    copies = stash(members.where("row > rep"), "copies")
    release(reps)
    alone = drawn.where("n > 0 and doc_id is not null").join(copies.select("row"), "row", "left_anti")
    parts = [F.col(p) for p in key_parts()] if written_bytes(drawn) > ONCE else [F.concat(*key_parts())]
    keyed = [alone.select(F.col("row").alias("rep"), F.explode(p).alias("key")) for p in parts]
    tags = drawn.select(F.col("row").alias("rep"), F.explode("tags").alias("tag")).select("rep", F.shiftright("tag", 32).alias("way"), F.col("tag").bitwiseAND(F.lit(0xFFFFFFFF)).alias("least"))
    family = families(keyed, tags).select(F.col("id").alias("row"), F.col("component_id").alias("family"))
    release(drawn)  # the keys are most of what is written so far
    sized = family.join(known.select("row", "doc_id", "n", "d1", "d2"), "row")
    blocks = sized.groupBy("family").agg(F.ceil(F.sum(F.col("n") + POINT) / F.lit(BLOCK)).cast("int").alias("blocks"))
    active = stash(sized.join(blocks, "family").select("row", "doc_id", "d1", "d2", "family", "blocks"), "families")
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    texts = plain.join(active.hint("merge"), "doc_id").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = texts.select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "row", "d1", "d2", "text")

    def links(table: pa.Table) -> pa.Table:
        shingler, ids, sides, sets = Shingler(size), [], [], []
        for batch in table.select(["block", "row", "d1", "d2", "text"]).to_batches(max_chunksize=500):
            block, row, d1, d2, text = (c.to_pylist() for c in batch.columns)
            x, starts = shingler.sets(text)
            for k in range(batch.num_rows):
                s = x[starts[k] : starts[k + 1]]
                if set_digest(s) == (d1[k], d2[k]):  # an id may repeat with another text
                    ids.append(row[k])
                    sides.append(block[k])
                    sets.append(s)
        found = family_links(ids, np.array(sides), sets, table.column("low")[0] == table.column("high")[0], percent) if ids else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    linked = components(paired.groupBy("family", "low", "high").applyInArrow(links, "a long, b long")).select(F.col("id").alias("rep"), F.col("component_id").alias("component"))
    # what is not in a copy's or a link's row stands for itself
    node = rows.select("row", "doc_id", "text_hash", F.col("n").alias("n_shingles")).join(copies, "row", "left").withColumn("rep", F.coalesce("rep", "row"))
    placed = node.join(linked, "rep", "left").select("row", "doc_id", "text_hash", "n_shingles", F.coalesce("component", "rep").alias("component"))
    placed = stash(placed, "placed")
    release(rows, copies, active)
    smallest = stash(placed.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("copies")), "smallest")
    return hot_join(placed, smallest, ["component"], "copies", written=True).select("row", "doc_id", "text_hash", "n_shingles", "component_id", "component")


def jaccard_groups(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of every row of docs.

    Null, empty and blank texts have no shingles and link with nothing, nor does a row without an id, whose component_id is
    null. Rows repeated with one id keep one row each and link by their own texts. Other columns are not read; an empty table
    gives no rows.
    """
    return jaccard_rows(docs, size, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def distinct_rows(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of rows linked by their shingles the one with the smallest doc_id, all columns of docs.

    Rows with null, empty or blank texts, or without an id, stay. Of rows that repeat both id and text one stays; rows of one
    id with texts that do not link all stay.
    """
    found = jaccard_rows(docs, size, percent)
    first = found.where("n_shingles > 0 and doc_id is not null").groupBy("component").agg(F.min(F.struct("doc_id", "row", "text_hash")).alias("x"))
    kept = first.groupBy(F.col("x.doc_id").alias("__id"), F.col("x.text_hash").alias("__hash")).agg(F.count(F.lit(1)).alias("__n"))
    blank = F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")) == 0
    same = (docs["doc_id"].cast("long") == F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__hash"))
    aside = docs["doc_id"].isNull() | blank
    chosen = docs.where(~aside).join(kept.hint("merge"), same, "left_semi")
    # rows that repeat id and text are one component, of which one row stays
    numbered = Window.partitionBy(chosen["doc_id"], F.xxhash64(chosen["text"].cast("string"))).orderBy(F.lit(0))
    return chosen.withColumn("__nth", F.row_number().over(numbered)).where("__nth = 1").select(*docs.columns).union(docs.where(aside))
