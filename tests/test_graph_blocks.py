"""Edges of the neighbour graph against all pairs, over several blocks and with ties."""

import numpy as np
import pyarrow as pa

from lodestone.operators import graph


def test_edges_over_blocks_with_ties_and_zero_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2300, 4)).round(1).astype(np.float32)
    x[5], x[40:60] = 0, x[39]
    rows = [(int(3 * i), [float(v) for v in r]) for i, r in enumerate(x)]
    got = {tuple(r) for r in graph.knn_graph(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v", 5, 0.2).collect()}
    d = x.astype(float)
    norm = np.sqrt((d * d).sum(axis=1, keepdims=True))
    d = np.divide(d, norm, out=np.zeros_like(d), where=norm > 0)
    want = set()
    for i, row in enumerate(np.round(d @ d.T, 9)):
        near = [j for j in np.lexsort((np.arange(len(row)), -row)) if j != i and row[j] > 0.2][:5]
        want |= {(3 * i, 3 * int(j), float(row[j])) for j in near}
    assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in want}


def test_vectors_are_read_without_an_object_for_each_number(monkeypatch):
    column = pa.chunked_array([pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float32())), pa.array([[5.0, 6.0]], pa.list_(pa.float32()))])
    assert graph._matrix(column.slice(1)).tolist() == [[3.0, 4.0], [5.0, 6.0]]


def test_expansion_makes_only_the_edges_of_nodes_it_reaches(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(1500, 6)).astype(np.float32))]
    v = spark.createDataFrame(rows, "id long, v array<float>")
    seeds = spark.createDataFrame([(0,), (7,)], "id long")
    want = {tuple(r) for r in graph.expand(graph.knn_graph(v, "id", "v", 3, 0.2), seeds, 2).collect()}
    asked, made = [], graph.knn_graph

    def counted(*args, sources=None, **more):
        asked.append(sources.count())
        return made(*args, sources=sources, **more)

    monkeypatch.setattr(graph, "knn_graph", counted)
    assert {tuple(r) for r in graph.expand_nearest(v, "id", "v", seeds, 2, 3, 0.2).collect()} == want
    assert asked[0] == 2 and asked[1] <= 6
