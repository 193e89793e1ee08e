"""Near-duplicate vectors by a forest of random-projection trees with spill.

Trees are grown on a bounded sample: a node splits at the median of a random direction, and vectors within SPILL of the
split go to both sides. Where the sample is too small to fill the leaves that the input needs, its leaves are split further at
their centre along directions that a tree has for each depth, so leaves stay small however many vectors there are. All
vectors then run down all trees; vectors of one label in one leaf are compared exactly. A
pair that shares several leaves is counted in the first of them only, so numbers of links need no table of pairs: each
leaf returns counts and a spanning forest of its links.

Equal vectors of a label are one representative with a weight, so copies are never compared with one another. A leaf that
is still large (a dense cluster) is cut into blocks, and each pair of blocks is a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import hashed_sample, stash
from lodestone.llm.components import components

TREES = 6
SAMPLE_ROWS = 20_000
LEAF_ROWS = 256
SPILL = 0.4  # of the projection's standard deviation between vectors at the threshold
LEAST = 0.98
BLOCK = 1500
SMALLEST = 8  # rows of the sample that a node needs for a split at their median


class Forest:
    """Per tree: directions, split values and children of the nodes; a negative child is a leaf of the sample.

    total is how many vectors there are to index. A leaf of the sample has a first number, and a centre for each further split.
    """

    def __init__(self, sample: np.ndarray, total: int, leaf_rows: int, spill: float, trees: int = TREES, seed: int = 0):
        rng = np.random.default_rng(seed)
        share = max(1.0, total / len(sample))  # vectors that a row of the sample stands for
        self.spill, self.trees = spill, []
        self.first, self.centres = [0], [np.empty(0)]
        number = 0
        for _ in range(trees):
            directions, splits, children = [], [], []
            deeper = rng.normal(size=(max(0, int(np.ceil(np.log2(total / leaf_rows)))), sample.shape[1]))
            deeper /= np.linalg.norm(deeper, axis=1, keepdims=True)

            def leaf(rows: np.ndarray, splittable: bool) -> int:
                nonlocal number
                centres = []
                for d in deeper if splittable else ():
                    if len(rows) * share / 2 ** len(centres) <= leaf_rows:
                        break
                    p = sample[rows] @ d
                    if (np.abs(p - p.mean()) <= spill).mean() > 0.5:  # too dense for the spill
                        break
                    centres.append(p.mean())
                self.first.append(number)
                self.centres.append(np.array(centres))
                number += 2 ** len(centres)
                return -(len(self.first) - 1)

            def grow(rows: np.ndarray) -> int:
                if len(rows) * share <= leaf_rows or len(rows) <= SMALLEST:
                    return leaf(rows, True)
                d = rng.normal(size=sample.shape[1])
                d /= np.linalg.norm(d)
                p = sample[rows] @ d
                cut = float(np.median(p))
                left, right = rows[p <= cut + spill], rows[p > cut - spill]
                if max(len(left), len(right)) > 0.95 * len(rows):  # too dense for the spill
                    return leaf(rows, False)
                at = len(splits)
                directions.append(d)
                splits.append(cut)
                children.append([0, 0])
                children[at] = [grow(left), grow(right)]
                return at

            top = grow(np.arange(len(sample)))
            self.trees.append((top, np.array(directions, np.float32).reshape(-1, sample.shape[1]), np.array(splits), np.array(children).reshape(-1, 2), deeper.astype(np.float32)))

    def leaves_of(self, x: np.ndarray) -> list[list[int]]:
        """The leaf numbers of each row, in order."""
        out: list[list[int]] = [[] for _ in range(len(x))]
        for top, directions, splits, children, deeper in self.trees:
            todo = [(top, 0, 0, np.arange(len(x)))]  # node, depth and path below a leaf of the sample, rows
            while todo:
                node, depth, path, rows = todo.pop()
                if node < 0 and depth == len(self.centres[-node]):
                    for r in rows:
                        out[r].append(self.first[-node] + path)
                    continue
                p, cut = (x[rows] @ deeper[depth], self.centres[-node][depth]) if node < 0 else (x[rows] @ directions[node], splits[node])
                for side, inside in ((0, p <= cut + self.spill), (1, p > cut - self.spill)):
                    if inside.any():
                        todo.append((node, depth + 1, 2 * path + side, rows[inside]) if node < 0 else (int(children[node][side]), 0, 0, rows[inside]))
        return [sorted(o) for o in out]


def unit(vectors: list | np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; the largest component is taken out first, so that squares stay in range."""
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def leaf_pairs(leaf: int, ids: np.ndarray, sides: np.ndarray, weights: np.ndarray, x: np.ndarray, leaves: list, same: bool, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weighted number of links of each row that this leaf is the first to hold, and links that span all of the leaf's links."""
    n = len(ids)
    counts, links = np.zeros(n, np.int64), []
    earlier = sorted({k for own in leaves for k in own if k < leaf})
    member = np.zeros((n, len(earlier)), np.float32)
    at = {k: j for j, k in enumerate(earlier)}
    for r, own in enumerate(leaves):
        member[r, [at[k] for k in own if k < leaf]] = 1
    parent = np.arange(n)
    for start in range(0, n, 512):
        rows = slice(start, min(n, start + 512))
        near = x[rows] @ x.T >= least
        near[np.arange(near.shape[0]), np.arange(rows.start, rows.stop)] = False
        if not same:
            near &= sides[rows, None] != sides[None, :]
        if not near.any():
            continue
        fresh = near & ~(member[rows] @ member.T > 0) if earlier else near
        counts[rows] += fresh.astype(np.int64) @ weights
        for r in np.flatnonzero(near.any(axis=1)):
            # join the whole neighbourhood by its smallest label; only label changes give links
            hood = np.append(np.flatnonzero(near[r]), start + r)
            labels = np.unique(parent[hood])
            if len(labels) > 1:
                firsts = [hood[np.flatnonzero(parent[hood] == p)[0]] for p in labels]
                # each label's member links with row r itself
                links += [(int(ids[f]), int(ids[start + r])) for f in firsts if f != start + r]
                parent[np.isin(parent, labels)] = labels[0]
    return counts, links


def near_vectors(vectors: DataFrame, least: float = LEAST, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, trees: int = TREES) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label).

    Only vectors of equal, non-null labels and equal length link. A null, empty or zero vector, and one with a null or
    non-finite component, links with nothing and is its own component. Rows repeated with one id count as vectors of
    their own. The forest is fitted on at most sample_rows rows, the first by a hash; all rows are indexed. Other columns
    are not read; an empty table gives no rows.
    """
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<float>" if single else "array<double>").alias("x"), vectors["label"].cast("string").alias("label"))
    sound = F.col("label").isNotNull() & F.coalesce(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    usable = rows.where(sound & (F.size("x") > 0)).where(F.exists("x", lambda v: v != 0))
    reps = stash(usable.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "vectors")
    members = usable.join(reps.withColumnRenamed("label", "l").withColumnRenamed("x", "y"), (F.col("label") == F.col("l")) & (F.col("x") == F.col("y"))).select("vec_id", "rep", "weight")
    found = None if reps.isEmpty() else _links(reps, "<f4" if single else "<f8", least, sample_rows, leaf_rows, trees)
    everyone = rows.select("vec_id")
    if found is None:
        return everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stash(found, "pairs")
    counts = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    placed = components(found.where("other is not null").select("rep", "other")).withColumnRenamed("id", "rep")
    known = members.join(counts, "rep", "left").join(placed, "rep", "left").groupBy("vec_id").agg(
        F.max(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.min(F.coalesce("component_id", "rep")).alias("component_id")
    )
    result = everyone.join(known, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return result.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links(reps: DataFrame, kind: str, least: float, sample_rows: int, leaf_rows: int, trees: int) -> DataFrame:
    """rep with a number of links, and rep with another linked rep; vectors travel as they came, in single or double precision."""
    total = reps.count()
    by_length: dict[int, list] = {}
    sampled = hashed_sample(reps.select("rep", "x"), "rep", sample_rows).collect()
    for r in sampled:
        by_length.setdefault(len(r["x"]), []).append(r["x"])
    # a length that the sample lacks is rare: its vectors are one leaf
    forests = {n: Forest(unit(x), -(-len(x) * total // len(sampled)), leaf_rows, SPILL * np.sqrt(2 - 2 * least) / np.sqrt(n), trees) for n, x in by_length.items()}

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                vectors = part.column(1).to_pylist()
                lengths = np.array([*map(len, vectors)])
                leaves: list[list[int]] = [[0] for _ in vectors]
                for n in set(lengths.tolist()) & forests.keys():
                    own = np.flatnonzero(lengths == n)
                    for k, found in zip(own.tolist(), forests[n].leaves_of(unit([vectors[k] for k in own])), strict=True):
                        leaves[k] = found
                raw = pa.array([np.array(v, kind).tobytes() for v in vectors], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), raw, part.column(2), part.column(3), pa.array(lengths, pa.int32()), pa.array(leaves, pa.list_(pa.int64()))], ["rep", "x", "label", "weight", "length", "leaves"])

    placed = reps.select("rep", "x", "label", "weight").mapInArrow(place, "rep long, x binary, label string, weight long, length int, leaves array<long>")
    spread = stash(placed, "placed").withColumn("leaf", F.explode("leaves"))
    group = ["length", "leaf", "label"]
    sizes = spread.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cut = spread.join(sizes, group).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select(*group, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "weight", "x", "leaves")

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        x = unit(np.stack([np.frombuffer(b, kind) for b in table.column("x").to_pylist()]))
        sides = table.column("block").to_numpy()
        counts, links = leaf_pairs(table.column("leaf")[0].as_py(), ids, sides, table.column("weight").to_numpy(), x, table.column("leaves").to_pylist(), table.column("low")[0] == table.column("high")[0], least)
        some = np.flatnonzero(counts)
        return pa.table({
            "rep": pa.array([*ids[some].tolist(), *(a for a, _ in links)], pa.int64()),
            "links": pa.array([*counts[some].tolist(), *([None] * len(links))], pa.int64()),
            "other": pa.array([*([None] * len(some)), *(b for _, b in links)], pa.int64()),
        })

    return cut.groupBy(*group, "low", "high").applyInArrow(compare, "rep long, links long, other long")
