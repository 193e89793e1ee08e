"""Components: what is joined to its smallest id already takes no step, whatever else does."""

import random

from lodestone.llm import components as module


def run(spark, monkeypatch, edges):
    written, real = [], module.stash
    monkeypatch.setattr(module, "stash", lambda df, label: written.append(label) or real(df, label))
    found = module.components(spark.createDataFrame(edges, "a long, b long")).collect()
    monkeypatch.setattr(module, "stash", real)
    assert len(found) == len({r["id"] for r in found})
    return {r["id"]: r["component_id"] for r in found}, len(written)


def test_stars_take_no_step(spark, monkeypatch):
    edges = [(9, 1), (1, 8), (7, 1), (7, 1), (5, 3), (3, 4), (6, 6)]
    assert run(spark, monkeypatch, edges) == ({9: 1, 8: 1, 7: 1, 1: 1, 5: 3, 4: 3, 3: 3}, 1)
    assert run(spark, monkeypatch, []) == ({}, 1)


def test_what_is_no_star_is_joined(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1, 12)] + [(20, 21), (22, 21)] + [(30, 32), (31, 32), (31, 33)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)]
    smallest = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in smallest:
        for a, b in edges:
            if a != b:
                smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    found, written = run(spark, monkeypatch, edges)
    assert found == smallest and written > 1
