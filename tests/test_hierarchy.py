"""Trees of codes with gaps against a comparison of all pairs, and levels of questions."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import hierarchy


def prefix(code, widths):
    return next(code[:w] for w in widths if not code[w:].strip("0"))


def force(rows, widths):
    own = {}
    for code, value in rows:
        if code is not None and len(code) == widths[-1]:
            t, n = own.get(code, (None, 0))
            own[code] = (t if value is None else (t or 0) + value, n + 1)
    at = {c: prefix(c, widths) for c in own}
    level = {c: widths.index(len(at[c])) for c in own}
    parent = {c: max((u for u in own if level[u] < level[c] and at[c].startswith(at[u])), key=level.get, default=None) for c in own}
    out = set()
    for c in own:
        held = [own[u] for u in own if at[u].startswith(at[c])]
        sums = [t for t, _ in held if t is not None]
        gap = level[c] - (level[parent[c]] if parent[c] else -1) - 1
        out.add((c, level[c], parent[c], gap, *own[c], sum(sums) if sums else None, sum(n for _, n in held), sum(p == c for p in parent.values())))
    return out


@pytest.mark.parametrize("hot", [0.0, 0.6])
@pytest.mark.parametrize("parts", ["1", "3", "13"])
def test_tree(spark, parts, hot):
    rng = random.Random(int(parts) + int(hot * 10))
    widths = [2, 4, 6]
    rows = [(None, 1), ("", 2), ("12345", 3), ("1234567", 4), ("000000", 5), ("110000", None), ("110101", 6), ("110101", None), ("99 9x0", 7)]
    for _ in range(400):
        code = ("11" if rng.random() < hot else f"{rng.randrange(5):02}") + f"{rng.choice([0, 0, rng.randrange(6)]):02}" + f"{rng.choice([0, rng.randrange(30)]):02}"
        if code not in ("110000", "020000", "030100"):
            rows.append((code, rng.choice([None, rng.randrange(100)])))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = spark.createDataFrame([(*r, "x") for r in rows], "code string, v long, parent string")
        assert {tuple(r) for r in hierarchy.code_tree(frame, "code", "v", widths).collect()} == force(rows, widths)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_codes(spark):
    assert hierarchy.code_tree(spark.createDataFrame([], "code string, v long"), "code", "v", [2, 4]).collect() == []


def test_levels(spark):
    rows = spark.createDataFrame([(None, "a", k % 4, 1) for k in range(8)] + [(None, "b", None, 5), (None, None, 7, 2)], "top string, mid string, low int, v long")
    go = lambda start, most: sorted(tuple(r) for r in hierarchy.level_results(rows, ["top", "mid", "low"], start, "v", most).collect())
    mid = [("mid", "a", 8, 8), ("mid", "b", 5, 1)]
    assert go("mid", 2) == mid
    assert [r[0] for r in go("mid", 1)] == ["low"] * 5
    assert [r[0] for r in go("low", 1)] == ["low"] * 5  # nothing lies below
    assert go("top", 9) == []  # nothing lies above
    assert sorted(tuple(r) for r in hierarchy.level_results(rows.withColumn("low", F.lit(None).cast("int")), ["top", "mid", "low"], "low", "v").collect()) == mid


def test_level_of_a_question(spark):
    asked = ["هزینه بخش سلامت", "بند و قسمت", "دستگاه اصلی", "دستگاه", "بخشنامه", "", None]
    got = spark.createDataFrame([(k, q) for k, q in enumerate(asked)], "k int, q string").select("k", hierarchy.detect_level("q").alias("l")).orderBy("k").collect()
    assert [r["l"] for r in got] == ["section", "part", "main_entity", "entity", "entity", "entity", "entity"]
