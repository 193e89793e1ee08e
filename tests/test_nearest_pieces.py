"""Nearest names read the right side in pieces: what is kept is no more than the best, and equal to difflib's."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from lodestone.operators import name_blocks
from tests.test_name_blocks import frames, syllables


def best(left, right, least, n):
    found = {a: sorted((-r, b.upper(), b) for b in right if (r := SequenceMatcher(None, a, b).ratio()) >= least)[:n] for a in left}
    return {a: v for a, v in found.items() if v}


def test_a_name_has_no_more_rows_than_its_best(spark):
    rng = random.Random(8)
    left, right = syllables(rng, 12), syllables(rng, 4200)
    got = {}
    for a, b, r in name_blocks.nearest_by_ratio(*frames(spark, left, right), 0.7, 10).collect():
        got.setdefault(a, []).append((-r, b.upper(), b))
    assert {a: sorted(v) for a, v in got.items()} == best(left, right, 0.7, 10)


@pytest.mark.parametrize("batch", [1, 40, 30_000])
def test_pieces_of_any_names(monkeypatch, batch):
    monkeypatch.setattr(name_blocks, "BATCH", batch)
    rng = random.Random(batch)
    odd = ["", "a", "ab", "ba", "日本", "日本橋", "x" * 64, "x" * 65, "x" * 63 + "y", "ab" * 40, "ab" * 150, "ab" * 140 + "c", "w" * 300]
    left, right = [*syllables(rng, 40), *odd], [*syllables(rng, 400), *odd, "xx", "本", "x" * 70, "ab" * 41, "ab" * 149 + "b"]
    letters = np.array(sorted(map(ord, set().union(*left, *right))), dtype=np.uint32)
    found, right = name_blocks._Nearest(left, letters, 0.7, 5), [*dict.fromkeys(right)]
    rng.shuffle(right)
    for at in range(0, len(right), 90):
        part = right[at : at + 90]
        found.read(part, [b.upper() for b in part])
    assert {a: v for a, v in zip(left, found.best, strict=True) if v} == best(left, right, 0.7, 5)


def test_matched_blocks_are_difflibs():
    rng = random.Random(2)
    pairs = [("".join(rng.choices("abc", k=rng.randrange(1, 20))), "".join(rng.choices("abc", k=rng.randrange(1, 20)))) for _ in range(800)]
    letters = np.array(sorted(map(ord, "abc")), dtype=np.uint32)
    x, y = (name_blocks._Names([p[k] for p in pairs], letters) for k in (0, 1))
    want = [sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks()) for a, b in pairs]
    assert name_blocks._matched(x.codes, y.codes, x.length, y.length).tolist() == want
