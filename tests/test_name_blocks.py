"""Blocks of names against comparisons of all pairs; few pairs are left to compare."""

import random
from difflib import SequenceMatcher

from lodestone.operators import name_blocks
from tests.test_names import lev


def syllables(rng, n):
    parts = ["an", "el", "jo", "ström", "dal", "ham", "ber", "tan", "vic", "ez"]
    return sorted({"".join(rng.choices(parts, k=2)) + " " + "".join(rng.choices(parts, k=3)) for _ in range(n)})


def frames(spark, left, right):
    y = [(b, b.upper()) for b in right]
    return spark.createDataFrame([(a,) for a in left], "a string"), spark.createDataFrame(y, "b string, first string")


def test_edits_leave_few_pairs_beside_the_near_ones(spark):
    rng = random.Random(3)
    left, right = syllables(rng, 60), [*syllables(rng, 600), "", "a", "abcd", "x" * 70, "x" * 68 + "yz", "日本橋"]
    left += ["", "b", "x" * 71, "日本"]
    x, y = frames(spark, left, right)
    got = {tuple(r) for r in name_blocks.pairs_within_edits(x, y, 4).collect()}
    near = {(a, b) for a in left for b in right if lev(a, b) <= 4}
    assert near <= got
    assert len(got) <= 3 * len(near) < len(left) * len(right) / 50


def test_nearest_by_ratio(spark):
    rng = random.Random(5)
    left, right = syllables(rng, 25), [*syllables(rng, 500), "", "x" * 70, "x" * 300 + "y"]
    left += ["", "x" * 69, "x" * 250]
    x, y = frames(spark, left, right)
    got = {}
    for a, b, r in name_blocks.nearest_by_ratio(x, y, 0.7, 10).collect():
        got.setdefault(a, []).append((-r, b.upper(), b))
    want = {}
    for a in left:
        found = sorted((-r, b.upper(), b) for b in right if (r := SequenceMatcher(None, a, b).ratio()) >= 0.7)[:10]
        if found:
            want[a] = found
    assert {a: sorted(v)[:10] for a, v in got.items()} == want
