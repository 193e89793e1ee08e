"""Whitening against eigenvectors by numpy and exact integers, and on odd vectors."""

import numpy as np

from lodestone.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n string, x string, deviation string"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, 1, "clash", "clash", "clash") for i, v in zip(ids or range(len(vectors)), vectors, strict=True)], SCHEMA)


def some(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) @ rng.standard_normal((d, d))).astype(np.float32)


def check(got, kept, k):
    x = np.floor(64 * np.array(kept, dtype=np.float32).astype(float)).astype(int) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    got = got.sort_values(["vec_id", "component"])
    z = got["whitened"].to_numpy().reshape(n, k)
    want = c @ q / np.sqrt(e)
    assert np.allclose(z, want * np.sign((z * want).sum(axis=0)), atol=1e-7)
    assert np.allclose(z.T @ z / n, np.eye(k), atol=1e-6) and (got["identity_error"] < 1e-6).all() and got["identity_error"].nunique() == 1
    total = np.trace(c.T @ c / n)
    assert np.allclose(got["explained"].to_numpy().reshape(n, k), e / total, rtol=1e-9)
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    assert list(got["deviation"][got["component"] == 1]) == exact and set(got["n"]) == {n}


def test_whitening_is_numpy_s(spark):
    vectors = some(400, 40)
    check(whiten(table(spark, vectors.tolist())).toPandas(), vectors, 32)


def test_few_dimensions_and_odd_vectors(spark):
    vectors = some(30, 5, 1)
    odd = [None, [1.0, None, 1.0, 1.0, 1.0], [1.0, float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0, 1.0], [1.0, 2.0], [], [3e38] * 5]
    rows = [*vectors.tolist(), *odd, vectors[0].tolist()]
    got = whiten(table(spark, rows, [*range(30 + len(odd)), 0])).toPandas()
    assert len(got) == 31 * 5 and set(got["vec_id"]) == set(range(30))
    assert (got.groupby("vec_id").size() == [10, *[5] * 29]).all()
    nameless = whiten(table(spark, [*vectors.tolist(), vectors[3].tolist()], [*range(30), None])).toPandas()
    assert nameless["vec_id"].isna().sum() == 5


def test_rows_that_do_not_differ_have_no_components(spark):
    assert whiten(table(spark, [])).count() == 0
    assert whiten(table(spark, [None, [float("nan")]])).count() == 0
    assert whiten(table(spark, [[1.0, 2.0]])).count() == 0
    assert whiten(table(spark, [[1.0, 2.0]] * 5)).count() == 0
    flat = whiten(table(spark, [[1.0, 2.0, float(k)] for k in range(5)])).toPandas()
    assert set(flat["component"]) == {1} and np.allclose(flat["explained"], 1)


def test_deviations_beyond_a_long(spark):
    far = whiten(table(spark, [[1e9, 0.0], [-1e9, 1.0], [5.0, 5.0]])).toPandas()
    assert list(far.sort_values("vec_id")["deviation"].isna().groupby(far["vec_id"]).all()) == [True, True, False] and (far["identity_error"] < 1e-4).all()
    near = whiten(table(spark, [[1e6, 0.0], [-1e6, 1.0], [5.0, 5.0]])).toPandas()
    x = [[64_000_000 + 1_000_000, 1_000_000], [-64_000_000 + 1_000_000, 1_000_064], [1_000_320, 1_000_320]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert list(near[near["component"] == 1].sort_values("vec_id")["deviation"]) == [sum((3 * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
