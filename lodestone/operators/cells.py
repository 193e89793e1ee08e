"""An inverted file over vectors: k-means cells, searched by the nearest cells or, with bounds, exactly; and what it serves:
names matched by meaning and questions sent to collections.

Only centroids (at most `cells` of them), their radii and sizes are on the driver. Every row is in the index. A cell is cut into
blocks of rows and the queries that probe it into blocks of queries, so a hot cell becomes many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.similarity import cosine, sequence_ratio
from lodestone.operators.entities import entity_key
from lodestone.operators.names import entity_candidates
from lodestone.sources.scratch import release, stash

CELLS, ROUNDS = 4096, 5
BLOCK_ROWS, BLOCK_QUERIES = 4000, 1000


def _matrix(batch: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    v = batch.column(column)
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32), np.ascontiguousarray(x).reshape(-1))


def unit_rows(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id and x of unit length; vectors that are null, zero or hold null or non-finite entries are left out."""
    x = F.col(vector).cast("array<double>")
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), x.alias("x")).where(F.col("x").isNotNull() & F.coalesce(fine, F.lit(False)))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    return rows.withColumn("norm", norm).where("norm > 0").select("id", F.transform("x", lambda v: v / F.col("norm")).alias("x"))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its distance."""
    squares = (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    cell = squares.argmin(axis=1)
    return cell, np.linalg.norm(x - centres[cell], axis=1)


class CellIndex:
    """vectors of one length in k-means cells; build it once, search it often, release it at the end."""

    def __init__(self, vectors: DataFrame, vec_id: str, vector: str, cells: int | None = None, rounds: int = ROUNDS):
        rows = stash(unit_rows(vectors, vec_id, vector), "unit")
        n = rows.count()
        self.cells = min(CELLS, n, cells or max(1, round(n**0.5)))
        # a bounded choice of rows by hash starts the cells; all rows then move them
        seeds = rows.orderBy(F.xxhash64("id"), "id").limit(self.cells).collect()
        self.centres = np.array([r["x"] for r in seeds], float).reshape(len(seeds), len(seeds[0]["x"]) if seeds else 0)
        for _ in range(rounds if n else 0):
            self._move(rows)
        self.index = stash(self._assigned(rows), "cells") if n else rows.withColumn("cell", F.lit(0)).withColumn("away", F.lit(0.0))
        sizes = self.index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect()  # a row for each cell
        self.size, self.radius = np.zeros(len(self.centres), int), np.full(len(self.centres), -1.0)
        for r in sizes:
            self.size[r["cell"]], self.radius[r["cell"]] = r["n"], r["r"]
        release(rows)

    def _move(self, rows: DataFrame) -> None:
        """One round of k-means: sums within tasks, then by cell, then one row of each cell to the driver."""
        centres = self.centres

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(centres), np.zeros(len(centres), int)
            for b in batches:
                if b.num_rows:
                    x = _matrix(b, "x")
                    cell, _ = _nearest(x, centres)
                    np.add.at(total, cell, x)
                    count += np.bincount(cell, minlength=len(centres))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), _lists(total[some])], names=["cell", "n", "s"])

        def merged(table: pa.Table) -> pa.Table:
            total = _matrix(table, "s").sum(axis=0, keepdims=True)
            return pa.table({"cell": table.column("cell")[:1], "n": [int(np.sum(table.column("n").to_numpy()))], "s": _lists(total)})

        schema = "cell long, n long, s array<double>"
        moved = centres.copy()
        for r in rows.select("x").mapInArrow(partial, schema).groupBy("cell").applyInArrow(merged, schema).collect():
            moved[r["cell"]] = np.array(r["s"]) / r["n"]
        self.centres = moved

    def _assigned(self, rows: DataFrame) -> DataFrame:
        centres = self.centres

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell, away = _nearest(_matrix(b, "x"), centres)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int64)), pa.array(away)], names=["id", "x", "cell", "away"])

        return rows.mapInArrow(assign, "id long, x array<double>, cell long, away double")

    def search(self, queries: DataFrame, vec_id: str, vector: str, k: int = 5, probes: int = 8, exact: bool = False, itself: bool = False) -> DataFrame:
        """qid, id, score (cosine) and rank of the k nearest rows of each query; ties, to nine digits, go to the smaller id.

        Without `exact` only the `probes` nearest cells are read. With it, cells that by their distance and radius could still hold
        a nearer row are read, too, so the result is that of a full search. A query is not its own neighbour unless `itself`.
        Queries that are repeated with one id count once if their vectors are equal.
        """
        asked = stash(unit_rows(queries, vec_id, vector).distinct(), "queries")
        if not len(self.centres):
            return queries.sparkSession.createDataFrame([], "qid long, id long, score double, rank int")
        found = self._top(self._scan(self._probed(asked.withColumn("kth", F.lit(None).cast("double")), probes, None), k, itself), k)
        if exact:
            found = stash(found, "first")
            kth = found.groupBy("qid").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("m")).where(F.col("m") >= k).select(F.col("qid").alias("id"), "kth")
            rest = self._scan(self._probed(asked.join(kth, "id", "left"), probes, k), k, itself)
            found = self._top(found.drop("rank").unionByName(rest), k)
        return found

    def _probed(self, asked: DataFrame, probes: int, k: int | None) -> DataFrame:
        """qid, x and the cells to read: the nearest, or (given k) those beyond them that may hold one of the k nearest rows."""
        centres, radius = self.centres, self.radius
        probes = min(probes, len(centres))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = _matrix(b, "x")
                gap = np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T)))
                gap[:, radius < 0] = np.inf
                order = np.argsort(gap, axis=1, kind="stable")
                near = order[:, :probes]
                if k is None:
                    q, c = np.repeat(np.arange(len(x)), probes), near.ravel()
                else:
                    kth = b.column("kth").to_numpy(zero_copy_only=False)
                    best = 1 - np.maximum(0, gap - radius[None, :]) ** 2 / 2
                    may = np.isnan(kth)[:, None] | (best >= np.nan_to_num(kth)[:, None] - 1e-8)
                    np.put_along_axis(may, near, False, axis=1)
                    q, c = np.nonzero(may & (radius >= 0)[None, :])
                at = pa.array(q)
                yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("x").take(at), pa.array(c.astype(np.int64))], names=["qid", "x", "cell"])

        return asked.select("id", "x", F.col("kth").cast("double").alias("kth")).mapInArrow(choose, "qid long, x array<double>, cell long")

    def _scan(self, probed: DataFrame, k: int, itself: bool) -> DataFrame:
        """qid, id and score of the k best rows of each block that a query reads."""
        spark, probed = probed.sparkSession, stash(probed, "probed")
        asks = {r["cell"]: r["n"] for r in probed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each cell
        plan = [(c, -(-int(self.size[c]) // BLOCK_ROWS), -(-n // BLOCK_QUERIES)) for c, n in asks.items() if self.size[c]]
        blocks = F.broadcast(spark.createDataFrame(plan, "cell long, blocks int, parts int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        salt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        q = probed.join(blocks, "cell").withColumn("part", salt("qid", "parts")).withColumn("block", every("blocks")).select("cell", "block", "part", F.col("qid").alias("id"), "x", F.lit(True).alias("asks"))
        r = self.index.join(blocks, "cell").withColumn("block", salt("id", "blocks")).withColumn("part", every("parts")).select("cell", "block", "part", "id", "x", F.lit(False).alias("asks"))

        def near(table: pa.Table) -> pa.Table:
            asking = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            ids, x = table.column("id").to_numpy(), _matrix(table, "x")
            a, b = np.flatnonzero(asking), np.flatnonzero(~asking)
            b = b[np.argsort(ids[b], kind="stable")]
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            scores = np.round(x[a] @ x[b].T, 9)
            if not itself:
                scores[ids[a][:, None] == ids[b][None, :]] = -2
            for row, s in zip(a, scores, strict=True):
                # all that tie with the k-th stay until the order by id decides
                keep = np.flatnonzero((s > -2) & (s >= (np.partition(s, -k)[-k] if len(s) > k else -2)))
                keep = keep[np.argsort(-s[keep], kind="stable")][:k]
                out.append((np.full(len(keep), ids[row]), ids[b][keep], s[keep]))
            join = lambda i, kind: pa.array(np.concatenate([o[i] for o in out]) if out else np.array([]), kind)
            return pa.table({"qid": join(0, pa.int64()), "id": join(1, pa.int64()), "score": join(2, pa.float64())})

        return q.unionByName(r).groupBy("cell", "block", "part").applyInArrow(near, "qid long, id long, score double")

    @staticmethod
    def _top(found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def semantic_match(queries: DataFrame, entities: DataFrame, query: str, name: str, vector: str, n: int = 5, types: tuple[str, ...] = ()) -> DataFrame:
    """The n best entities of each query: query, name, score, semantic, ratio, overlap, rank, confirm.

    Both frames have a vector for each name (of one length; repeated names have equal ones). Candidates are the 4 n nearest by
    cosine and the 4 n best by name, among them every equal name. The score is .5 (cosine + 1) / 2 + .25 ratio + .25 overlap of
    the query's words, or .6 ratio + .4 overlap where a vector is missing; an equal name has 1. A query that names a kind of body (one of types) only meets
    entities with a common one. A best score below .85 wants confirming if the second is nearer than .1 or the overlap is below .4.
    """
    x = queries.select(F.col(query).alias("q"), F.col(vector).cast("array<double>").alias("qv")).where("q is not null").groupBy("q").agg(F.max("qv").alias("qv")).withColumn("qid", F.xxhash64("q"))
    y = entities.select(F.col(name).alias("e"), F.col(vector).cast("array<double>").alias("ev")).where("e is not null").groupBy("e").agg(F.max("ev").alias("ev")).withColumn("id", F.xxhash64("e"))
    x, y = stash(x, "asked"), stash(y, "entities")
    near = CellIndex(y, "id", "ev").search(x, "qid", "qv", 4 * n, exact=True, itself=True).join(x.select("qid", "q"), "qid").join(y.select("id", "e"), "id").select("q", "e")
    alike = entity_candidates(x, y, "q", "e", n=4 * n).select("q", "e")
    pairs = near.unionByName(alike).distinct().join(x.select("q", "qv"), "q").join(y.select("e", "ev"), "e")
    a, b = entity_key("q"), entity_key("e")
    words = lambda c: F.array_distinct(F.split(F.trim(c), r"\s+"))
    named = F.array_intersect(words(a), F.array(*(F.lit(t) for t in types)).cast("array<string>"))
    pairs = pairs.where((F.size(named) == 0) | (F.size(F.array_intersect(named, words(b))) > 0))
    pairs = pairs.withColumn("semantic", F.when(F.col("qv").isNotNull() & F.col("ev").isNotNull(), (cosine("qv", "ev") + 1) / 2)).withColumn("ratio", sequence_ratio(a, b)).withColumn("overlap", F.size(F.array_intersect(words(a), words(b))) / F.size(words(a)))
    score = F.when(a == b, 1.0).when(F.col("semantic").isNotNull(), 0.5 * F.col("semantic") + 0.25 * F.col("ratio") + 0.25 * F.col("overlap")).otherwise(0.6 * F.col("ratio") + 0.4 * F.col("overlap"))
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "e")
    ranked = pairs.withColumn("score", score).withColumn("rank", F.row_number().over(w)).withColumn("gap", F.col("score") - F.lead("score").over(w))
    unsure = (F.col("rank") == 1) & (F.col("score") < 0.85) & (F.coalesce(F.col("gap") < 0.1, F.lit(False)) | (F.col("overlap") < 0.4))
    return ranked.where(F.col("rank") <= n).select(F.col("q").alias(query), F.col("e").alias(name), "score", "semantic", "ratio", "overlap", "rank", unsure.alias("confirm"))


def collection_texts(docs: DataFrame, collection: str, order: str, text: str, question: str | None = None, answer: str | None = None) -> DataFrame:
    """collection and the text that stands for it: the questions and the answers' first 200 characters of its first 15 documents by
    `order`; without any, the first 300 characters of its first 10 texts; joined by spaces and cut at 1200 characters."""
    rank = F.row_number().over(Window.partitionBy(collection).orderBy(order))
    q, a = (F.col(c) if c else F.lit(None).cast("string") for c in (question, answer))
    rows = docs.select(collection, rank.alias("rank"), F.col(text).alias("t"), F.nullif(q, F.lit("")).alias("q"), F.nullif(F.left(a, F.lit(200)), F.lit("")).alias("a")).where(F.col("rank") <= 15)
    joined = lambda c: F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", c.alias("v")))), lambda s: s["v"])), " ")
    pairs, texts = F.array_compact(F.array("q", "a")), F.when(F.col("rank") <= 10, F.array_compact(F.array(F.left("t", F.lit(300))))).otherwise(F.array().cast("array<string>"))
    both = rows.groupBy(collection).agg(joined(pairs).alias("p"), joined(texts).alias("t"))
    return both.select(collection, F.left(F.when(F.col("p") != "", F.col("p")).otherwise(F.col("t")), F.lit(1200)).alias("profile"))


def collection_similarity(queries: DataFrame, query: str, profiles: DataFrame, collection: str, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """query, collection and the cosine of both, 0.5 where the collection has no text or no model is given.

    Every query meets every collection: collections are few, one row each, so they are broadcast.
    """
    q = queries.select(query).distinct()
    if embedder is None:
        return q.join(F.broadcast(profiles.select(collection)), F.lit(True)).withColumn("similarity", F.lit(0.5))
    q, p = q.withColumn("__q", embedder(F.col(query))), profiles.withColumn("__p", embedder(F.col("profile")))
    known = F.col("profile").isNotNull() & (F.col("profile") != "")
    return q.join(F.broadcast(p), F.lit(True)).select(query, collection, F.when(known, cosine("__q", "__p")).otherwise(0.5).alias("similarity"))
