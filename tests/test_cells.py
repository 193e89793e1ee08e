"""The inverted file against full search, also where a third of all rows is one vector, and what is built on it."""

import numpy as np
import pytest

from lodestone.functions.models import embedder
from lodestone.operators import cells

FOLDER = "/root/testdata/sf0.01"


def brute(ids, x, asked, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in asked:
        s = np.round(u @ u[i], 9)
        order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i])[:k]
        out |= {(ids[i], rank): (j, -v) for rank, (v, j) in enumerate(order, 1)}
    return out


@pytest.fixture(scope="module")
def embeddings(spark):
    frame = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding")
    p = frame.toPandas().sort_values("vec_id")
    return frame, p["vec_id"].tolist(), np.array(p["embedding"].tolist(), float)


def told(df):
    return {(r["qid"], r["rank"]): (r["id"], pytest.approx(r["score"], abs=1e-8)) for r in df.collect()}


def test_exact_search_is_a_full_search(embeddings):
    frame, ids, x = embeddings
    index = cells.CellIndex(frame, "vec_id", "embedding")
    want = brute(ids, x, range(0, len(ids), 25), 5)
    asked = frame.where("vec_id % 25 = 0")
    assert told(index.search(asked, "vec_id", "embedding", 5, exact=True)) == want
    near = index.search(asked, "vec_id", "embedding", 5, probes=12).collect()
    hits = {(q, i) for (q, _), (i, _) in want.items()}
    assert len({(r["qid"], r["id"]) for r in near} & hits) / len(hits) >= 0.9


def test_hot_cells_odd_vectors_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 40)
    monkeypatch.setattr(cells, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[50:150] = x[50]
    rows = [(k, v.tolist(), 1.0, "clash") for k, v in enumerate(x)]
    odd = [(900, None, 1.0, ""), (901, [0.0] * 8, 1.0, ""), (902, [float("nan")] * 8, 1.0, ""), (903, [1.0, None] * 4, 1.0, "")]
    frame = spark.createDataFrame([*rows, *odd], "vec_id long, v array<float>, score double, cell string")
    index = cells.CellIndex(frame, "vec_id", "v")
    assert index.size.sum() == 300
    assert told(index.search(frame, "vec_id", "v", 4, probes=2, exact=True)) == brute(list(range(300)), x.astype(float), range(300), 4)
    nothing = cells.CellIndex(frame.where("vec_id > 899"), "vec_id", "v")
    assert nothing.search(frame, "vec_id", "v").count() == 0


def test_names_by_meaning(spark):
    vectors = {"ministry of roads": [1.0, 0.0, 0.2], "department of streets": [0.98, 0.05, 0.2], "ministry of health": [0.0, 1.0, 0.1], "bank of roads": [0.7, 0.0, 0.9], "nameless": None}
    entities = spark.createDataFrame([(k, v) for k, v in vectors.items()], "name string, v array<double>")
    asked = spark.createDataFrame([("ministry of streets", [0.99, 0.02, 0.2]), ("ministry of health", [0.1, 0.9, 0.0]), ("nameles", [0.0, 0.0, 1.0]), (None, None)], "q string, v array<double>")
    got = {(r["q"], r["rank"]): r for r in cells.semantic_match(asked, entities, "q", "name", "v", types=("ministry", "bank")).collect()}
    assert got["ministry of streets", 1]["name"] == "ministry of roads" and got["ministry of streets", 1]["confirm"] is False
    assert {r["name"] for (q, _), r in got.items() if q == "ministry of streets"} == {"ministry of roads", "ministry of health"}
    assert (got["ministry of health", 1]["name"], got["ministry of health", 1]["score"]) == ("ministry of health", 1.0)
    missing = got["nameles", 1]
    assert missing["name"] == "nameless" and missing["semantic"] is None and missing["score"] == pytest.approx(0.6 * missing["ratio"]) and missing["confirm"]


def test_collections_by_their_first_documents(spark):
    rows = [("faq", k, "unused", f"how do I {w}", f"you {w} so" + "x" * 300) for k, w in enumerate(["pay", "cancel", "return"])]
    rows += [("news", k, f"rain and wind in city {k} " + "y" * 400, None, None) for k in range(20)] + [("empty", 1, None, None, None)]
    docs = spark.createDataFrame(rows, "c string, k int, t string, q string, a string")
    profiles = cells.collection_texts(docs, "c", "k", "t", "q", "a")
    texts = {r["c"]: r["profile"] for r in profiles.collect()}
    faq = " ".join(p for _, _, _, q, a in rows[:3] for p in (q, a[:200]))
    assert texts["faq"] == faq[:1200] and texts["news"] == " ".join(r[2][:300] for r in rows[3:13])[:1200] and texts["empty"] == ""
    asked = spark.createDataFrame([("how do I pay",), ("wind in city",)], "question string")
    got = {(r["question"], r["c"]): r["similarity"] for r in cells.collection_similarity(asked, "question", profiles, "c", embedder()).collect()}
    assert got["how do I pay", "faq"] > got["how do I pay", "news"] and got["wind in city", "news"] > got["wind in city", "faq"] and got["wind in city", "empty"] == 0.5
    assert {r["similarity"] for r in cells.collection_similarity(asked, "question", profiles, "c").collect()} == {0.5}
