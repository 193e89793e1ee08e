"""Neighbour graphs over vectors and bounded expansion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import stash


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a list column, all of one length, without an object for each number."""
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1).astype(float)


def knn_graph(vectors: DataFrame, vec_id: str, vector: str, k: int = 5, least: float = 0.5, block_rows: int = 16_000, sources: DataFrame | None = None) -> DataFrame:
    """Directed edges from every vector, or from those whose ids `sources` (one column) has, to its k nearest others with cosine
    above `least`: src, dst, weight.

    Vectors fall into hash blocks, and each pair of blocks is one task that keeps only k candidates a row, so what is
    shuffled is blocks * rows vectors and blocks * k edges a row. There are as many blocks as make about block_rows rows each,
    or up to six smaller ones. Exact.
    """
    in_blocks = lambda n: max(-(-n // block_rows), min(6, -(-n // 1000)), 1)
    dst_blocks = in_blocks(vectors.count())
    src_blocks = dst_blocks if sources is None else in_blocks(sources.count())
    # vectors travel as they are stored and are widened in the tasks
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("x"))
    asked = rows if sources is None else rows.join(sources.select(F.col(sources.columns[0]).cast("long").alias("id")).distinct(), "id", "left_semi")
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = asked.withColumn("src_block", own(src_blocks)).select("src_block", every(dst_blocks).alias("dst_block"), F.lit(True).alias("is_src"), "id", "x").unionAll(
        rows.withColumn("dst_block", own(dst_blocks)).select(every(src_blocks).alias("src_block"), "dst_block", F.lit(False).alias("is_src"), "id", "x")
    ).repartition(src_blocks * dst_blocks, "src_block", "dst_block")

    def near(table: pa.Table) -> pa.Table:
        is_src = table.column("is_src").to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        x = _matrix(table.column("x"))
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        a, b = np.flatnonzero(is_src), np.flatnonzero(~is_src)
        b = b[np.argsort(ids[b])]
        across, of_b = np.ascontiguousarray(x[b].T), ids[b]
        src, dst, weight = [], [], []
        for start in range(0, len(a), 256):
            part = a[start : start + 256]
            sims = x[part] @ across
            at = np.searchsorted(of_b, ids[part])
            for r in np.flatnonzero((at < len(b)) & (of_b[np.minimum(at, len(b) - 1)] == ids[part])) if len(b) else ():
                own = at[r]
                while own < len(b) and of_b[own] == ids[part[r]]:
                    sims[r, own] = -2
                    own += 1
            # all that may tie with the k-th once rounded stay until the order by id decides
            kth = np.partition(sims, -k, axis=1)[:, -k] if len(b) > k else np.full(len(part), -2.0)
            row, col = np.nonzero(sims >= np.maximum(kth, least)[:, None] - 2e-9)
            w = np.round(sims[row, col], 9)
            row, col, w = row[w > least], col[w > least], w[w > least]
            order = np.lexsort((col, -w, row))
            row, col, w = row[order], col[order], w[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            src.append(ids[part[row[kept]]])
            dst.append(of_b[col[kept]])
            weight.append(w[kept])
        join = lambda v, kind: pa.array(np.concatenate(v) if v else [], kind)
        return pa.table({"src": join(src, pa.int64()), "dst": join(dst, pa.int64()), "weight": join(weight, pa.float64())})

    found = sent.groupBy("src_block", "dst_block").applyInArrow(near, "src long, dst long, weight double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("src", "dst", "weight")


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """id and the hop (0 for a seed) at which each node is first reached along edges, which are written once."""
    edges = stash(edges, "edges")
    reached = seeds.select(F.col(seeds.columns[0]).alias("id")).distinct().withColumn("hop", F.lit(0))
    front = reached
    for h in range(1, hops + 1):
        nxt = edges.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = nxt.join(reached.select("id"), "id", "left_anti").withColumn("hop", F.lit(h))
        reached = reached.unionAll(front)
    return reached


def expand_nearest(vectors: DataFrame, vec_id: str, vector: str, seeds: DataFrame, hops: int = 2, k: int = 5, least: float = 0.5) -> DataFrame:
    """What `expand` gives over knn_graph's edges, of which only those from nodes that a hop has reached are made."""
    reached = front = stash(seeds.select(F.col(seeds.columns[0]).cast("long").alias("id")).distinct().withColumn("hop", F.lit(0)), "reached")
    for h in range(1, hops + 1):
        nxt = knn_graph(vectors, vec_id, vector, k, least, sources=front.select("id")).select(F.col("dst").alias("id")).distinct()
        front = stash(nxt.join(reached.select("id"), "id", "left_anti").withColumn("hop", F.lit(h)), "reached")
        reached = reached.unionAll(front)
    return reached


def graph_results(reached: DataFrame, scored: DataFrame, new_score: float = 0.5) -> DataFrame:
    """Seeds keep their score; nodes that only the graph gave get a fixed one."""
    return reached.join(scored, "id", "left").select("id", "hop", F.coalesce("score", F.lit(new_score)).alias("score"), F.when(F.col("hop") == 0, "seed").otherwise("graph").alias("source"))
