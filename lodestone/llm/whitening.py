"""Whitening of embeddings by the singular values of the centred rows, which MLlib finds over distributed rows.

Entries become whole numbers first, so counts, sums and deviations are exact. computeSVD of the centred rows gives right
singular vectors, which are the eigenvectors of the covariance, and singular values s with eigenvalues s * s / n. What
travels to the driver has the size of one vector, of a covariance matrix, or of one row for each length of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import release, stash

COMPONENTS = 32
#: Singular values below this share of the largest are those of directions in which the rows do not differ.
SMALLEST = 1e-6
SCALE, SHIFT = 64, 1_000_000
LONG = 2**63


def whole(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """The vectors of a batch, all of one length, as rows of longs."""
    v = batch.column(column)
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and x of the vectors without null or non-finite entries; only those of the most frequent length stay."""
    c = F.col("c").cast("array<double>")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= F.lit((LONG - 2 * SHIFT) / SCALE)))
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[vector].alias("c")).where(F.col("c").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    # floor of a double is a long
    rows = stash(rows.select("vec_id", F.transform(c, lambda v: F.floor(v * SCALE) + SHIFT).alias("x")), "whole")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    size = sizes.agg(F.max_by("d", F.struct("n", "d"))).first()[0]  # of one row for each length
    out = rows.where(F.size("x") == F.lit(size)) if size is not None else rows
    out._stash_path = rows._stash_path
    return out


def column_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension: a row of partial sums from each batch, merged by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = whole(b, "x")
                sums = x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) > LONG // (2 * len(x)) else x.sum(axis=0)
                yield pa.RecordBatch.from_pydict({"n": [len(x)] * x.shape[1], "d": list(range(x.shape[1])), "s": [str(s) for s in sums]})

    parts = rows.select("x").mapInArrow(partial, "n long, d long, s string")
    sums = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("d").collect()  # a row for each dimension
    return (sums[0]["n"] if sums else 0), [int(r["s"]) for r in sums]


def deviations(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """vec_id, deviation (exact, as text) and the centred row (n * x - S) / n in doubles."""
    low, high = min(sums), max(sums)

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(sums, dtype=object)
        for b in batches:
            if not b.num_rows:
                continue
            x = whole(b, "x")
            reach = max(n * int(np.abs(x).max()), abs(low), abs(high))
            exact = n * x - total.astype(np.int64) if 2 * reach < LONG else n * x.astype(object) - total
            if int(np.abs(exact).max()) ** 2 * x.shape[1] >= LONG:
                exact = exact.astype(object)
            squares = (exact * exact).sum(axis=1)
            rows_out = np.ascontiguousarray(exact.astype(float) / n)
            ends = np.arange(0, rows_out.size + 1, x.shape[1], dtype=np.int32)
            lists = pa.ListArray.from_arrays(ends, rows_out.reshape(-1))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([str(s) for s in squares]), lists], names=["vec_id", "deviation", "y"])

    return rows.mapInArrow(centred, "vec_id long, deviation string, y array<double>")


def principal(rows: DataFrame, n: int, dims: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors as columns, of the covariance of centred rows: at most k, none of value 0."""
    features = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("y").alias("y")), "y")
    found = RowMatrix(features, n, dims).computeSVD(min(k, dims), computeU=False, rCond=SMALLEST)
    s = np.array(found.s.toArray())
    return s * s / n, np.array(found.V.toArray()).reshape(dims, len(s))


def identity_error(rows: DataFrame, project: np.ndarray, n: int) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity.

    The rows are centred before they are projected, so products need no further centring but for what rounding leaves.
    """
    k = project.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((k + 1, k))
        for b in batches:
            if b.num_rows:
                z = whole(b, "y") @ project
                gram[:k] += z.T @ z
                gram[k] += z.sum(axis=0)
        i, j = np.indices(gram.shape)
        yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "v": gram.ravel()})

    cells = rows.select("y").mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # k * (k + 1) numbers
    gram = np.zeros((k + 1, k))
    for c in cells:
        gram[c["i"], c["j"]] = c["v"] / n
    return float(np.abs(gram[:k] - np.outer(gram[k], gram[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each usable vector and component up to k: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out, and so are those of another length than the most
    frequent one (of lengths equally frequent, the largest), and entries whose whole number does not fit a long. Repeated
    rows and rows with a null id count and are returned each. Directions in which the rows do not differ have no component,
    so equal vectors, a single one or an empty table give no rows. deviation is null where it does not fit a long. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(vectors, vec_id, vector)
    n, sums = column_sums(rows)
    if not sums:
        return spark.createDataFrame([], schema)
    moved = stash(deviations(rows, n, sums), "centred")
    release(rows)
    total = int(moved.agg(F.sum(F.col("deviation").cast("decimal(38,0)"))).first()[0])
    if total == 0:
        return spark.createDataFrame([], schema)
    values, axes = principal(moved, n, len(sums), k)
    project = axes / np.sqrt(values)
    error = identity_error(moved, project, n)
    # trace of the covariance: the deviations' sum over n, for the mean, and n twice, for the factor n before squaring
    explained = [float(e) * n**3 / total for e in values]
    count = len(values)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = whole(b, "y") @ project
                squares = [int(d) for d in b.column("deviation").to_pylist()]
                whole_or_null = pa.array([d if d < LONG else None for d in squares], pa.int64())
                at = pa.array(np.repeat(np.arange(len(z)), count))
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(at), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(z))), pa.array(np.full(z.size, n)), whole_or_null.take(at), pa.array(z.ravel()),
                     pa.array(np.tile(explained, len(z))), pa.array(np.full(z.size, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return moved.mapInArrow(projected, schema)
