"""Indexes of names against comparisons of all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from lodestone.operators import names

FOLDER = "/root/testdata/sf0.01"


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, last = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


def typo(rng, s):
    for _ in range(rng.randrange(0, 3)):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + rng.choice("abx é") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("rsn") + s[i + 1 :]])
    return s


@pytest.fixture(scope="module")
def pair(spark):
    rng = random.Random(4)
    known = [r[0] for t, c in (("part", "p_name"), ("clients", "name"), ("vendors", "name")) for r in spark.read.parquet(f"{FOLDER}/{t}.parquet").select(c).dropna().distinct().orderBy(c).limit(110).collect()]
    known += ["", "a", "ab", "ba", "abc", "aaaa", "aa", "bank of x", "x bank", "x", " ", "nana nana nana", "日本", "日本橋"]
    asked = sorted({typo(rng, rng.choice(known)) for _ in range(160)} | {"", "a", "b", "ab", "aaa", "bank x", "日本", "nan", "small"})
    frame = lambda v, c: spark.createDataFrame([(s, 1) for s in [*v, v[0], None]], f"{c} string, key int")
    return asked, sorted(set(known)), frame(asked, "q"), frame(known, "name")


@pytest.mark.parametrize("k", [1, 2, 3])
def test_edits(pair, k):
    asked, known, q, n = pair
    got = {tuple(r) for r in names.within_edits(q, n, "q", "name", k).collect()}
    assert got == {(a, b, d) for a in asked for b in known if (d := lev(a, b)) <= k}


@pytest.mark.parametrize(("least", "share"), [(0.8, 2), (0.8, 1), (0.6, 2), (0.95, 2)])
def test_ratio(pair, least, share):
    asked, known, q, n = pair
    got = {(r["a"], r["b"]) for r in names.within_ratio(q, n, "q", "name", least, share).collect()}
    assert got == {(a, b) for a in asked for b in known if SequenceMatcher(None, a, b).ratio() >= least}


def test_containment(pair):
    asked, known, q, n = pair
    got = {tuple(r) for r in names.containing(q, n, "q", "name").collect()}
    assert got == {(a, b) for a in asked for b in known if a in b and (a or not b)}


def _key(spark, values):
    from lodestone.operators.entities import entity_key

    return {r[0]: r[1] for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", entity_key("v")).collect()}


def test_tiers_equal_all_pairs(spark, pair):
    asked, known, q, n = pair
    key = _key(spark, {*asked, *known})
    want = {}
    for a in asked:
        found = []
        for b in known:
            x, y = key[a], key[b]
            u, v = set(x.split()), set(y.split())
            j = len(u & v) / len(u | v) if u and v else 0
            r = SequenceMatcher(None, x, y).ratio()
            if x == y:
                s = 1.0
            elif x and x in y:
                s = 0.85 + 0.1 * len(x) / len(y)
            elif y and y in x:
                s = 0.8 + 0.1 * len(y) / len(x)
            elif j >= 0.7:
                s = 0.7 + 0.15 * j
            elif r >= 0.7:
                s = 0.6 + 0.15 * r
            else:
                continue
            found.append((-s, b))
        for rank, (s, b) in enumerate(sorted(found)[:10], 1):
            want[a, rank] = (b, pytest.approx(-s))
    got = {(r["q"], r["rank"]): (r["name"], r["score"]) for r in names.similar_names(q, n, "q", "name").collect()}
    assert got == want


def test_candidates_equal_all_pairs(spark, pair):
    from lodestone.functions.text import tokens

    asked, known, q, n = pair
    key = _key(spark, {*asked, *known})
    words = {r[0]: set(r[1]) for r in spark.createDataFrame([(v,) for v in {*key.values()}], "v string").select("v", tokens("v")).collect()}
    want = set()
    for a in asked:
        found = []
        for b in known:
            x, y = key[a], key[b]
            u, v = words[x], words[y]
            overlap = len(u & v) / min(len(u), len(v)) if u and v else 0
            lengths = min(len(x), len(y)) / max(len(x), len(y)) if x or y else 0
            s = 0.5 * SequenceMatcher(None, x, y).ratio() + 0.4 * overlap + 0.1 * lengths**0.5
            if s >= 0.5 + 1e-12:
                found.append((-round(s, 9), b))
        want |= {(a, b, -s) for s, b in sorted(found)[:5]}
    got = {(r["q"], r["name"], round(r["score"], 9)) for r in names.entity_candidates(q, n, "q", "name").collect()}
    assert {g for g in got if g[2] > 0.5 + 1e-9} == {w for w in want if w[2] > 0.5 + 1e-9}


def test_guard_by_type_words(spark):
    q = spark.createDataFrame([("office of science and energy",), ("bank melli",), ("science energy",), ("university of tehran x",)], "q string")
    n = spark.createDataFrame([("office of science and energy matters",), ("ministry of science and energy",), ("bank melli",), ("university of tehran",), ("hospital of tehran x",)], "name string")
    got = {r["q"]: r["name"] for r in names.guarded_match(q, n, "q", "name", ["office", "ministry", "bank", "university"], stop=("of", "and")).collect()}
    assert got == {"office of science and energy": "office of science and energy matters", "bank melli": "bank melli", "university of tehran x": "university of tehran"}
