"""The most frequent sequences of words against plain counting, whatever the buckets hold."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import grams

TOPS = {3: 4, 2: 5, 1: 6}


def force(texts, least=2):
    out = []
    for n, top in TOPS.items():
        counts = Counter(" ".join(w[i : i + n]) for t in texts if t for w in [t.split(" ")] for i in range(len(w) - n + 1))
        out += sorted(((n, g, f) for g, f in counts.items() if f >= least), key=lambda x: (-x[2], x[1]))[:top]
    return sorted(out)


def found(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    return sorted(tuple(r) for r in grams.frequent_grams(rows, F.split("text", " "), TOPS).collect())


# with one bucket everything is counted at first; with few of many, sequences of buckets left out at first have to be found
@pytest.mark.parametrize(("buckets", "first"), [(1, 1), (8, 1), (1 << 16, 1), (1 << 16, 1 << 10)])
def test_equal_to_counting_all(spark, monkeypatch, buckets, first):
    monkeypatch.setattr(grams, "BUCKETS", buckets)
    monkeypatch.setattr(grams, "FIRST", first)
    monkeypatch.setattr(grams, "TEXTS", 7)
    # ties at every length, texts shorter than a sequence, sequences that only two neighbouring texts would make
    texts = ["a b c d e", "a b c d", "x y z", "x y z w", "one", "one two", None, *(f"k{i} m{i} n{i} ü{i}" for i in range(40) for _ in range(2 + i % 3)), *(["end", "start over"] * 9), "the " * 50 + "last"]
    assert found(spark, texts) == force(texts)


def test_few_and_no_sequences(spark):
    assert found(spark, ["a b", "c", None]) == []
    assert found(spark, ["a b", "a b"]) == [(1, "a", 2), (1, "b", 2), (2, "a b", 2)]
    rows = spark.createDataFrame([], "text string")
    assert grams.frequent_grams(rows, F.split("text", " "), TOPS).collect() == []


def test_what_travels_does_not_grow_with_distinct_sequences(spark, monkeypatch):
    written = []
    monkeypatch.setattr(grams, "BUCKETS", 64)
    monkeypatch.setattr(grams, "FIRST", 2)
    best = grams.stash
    monkeypatch.setattr(grams, "stash", lambda df, label: written.append(df) or best(df, label))
    texts = [*(f"s{i} t{i} u{i}" for i in range(3000)), *(["the same words again"] * 200), *(f"{x} {x} {x} {x}" for x in "pqrstv" for _ in range(150))]
    assert found(spark, texts) == force(texts)
    # of each length two buckets of 64 are counted at first; the last wanted one is more frequent than what fills any other bucket by chance
    assert len(written) <= 2
