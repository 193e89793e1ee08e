"""Corrections against every path of the lattice, and planted typos."""

import itertools
import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest

from lodestone.operators import correction


def test_likeness_of_words():
    r = lambda a, b: SequenceMatcher(None, a, b).ratio()
    assert correction.typo_score("قراردار", "قرارداد") == pytest.approx(r("قراردار", "قرارداد"))
    assert correction.typo_score("ظرف", "ضرف") == 1 > r("ظرف", "ضرف")  # they sound alike
    assert correction.typo_score("طار", "کار") == pytest.approx(0.6 * r("طار", "کار") + 0.4 * r("تآر", "کآر") + 0.3)
    assert correction.typo_score("abc", "abc") == 1


def brute(question, freq, pairs, most=100, n=5):
    words = re.findall(r"[^\W_]+", (question or "").lower())
    common = sorted((t for t in freq if len(t) >= 3), key=lambda t: (-freq[t], t))[:most]
    layers = []
    for w in words:
        found = []
        if len(w) >= 3 and w not in freq:
            for t in common:
                if abs(len(t) - len(w)) <= 3 and (s := correction.typo_score(w, t)) >= 0.4:
                    found.append((-s * (1 + 0.1 * min(freq[t], 10)), t))
        found = sorted(found)[:n]
        layers.append(([(t, math.log(-s)) for s, t in found], True) if found else ([(w, 0.0)], False))
    best = None
    for path in itertools.product(*(c for c, _ in layers)):
        score = sum(s for _, s in path)
        for k in range(1, len(path)):
            if layers[k][1] or layers[k - 1][1]:
                score += math.log(1 + pairs[path[k - 1][0], path[k][0]])
        best = max(best or (-math.inf, ()), (round(score, 9), tuple(w for w, _ in path)[::-1]))
    return [(k, w, best[1][::-1][k]) for k, (w, (_, o)) in enumerate(zip(words, layers, strict=True)) if o] if words else []


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()] + ["The annual budget of the ministry", "annual budget of health", "the budgie of the queen sings"] * 4
    frame = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string")
    freq = Counter(w for t in texts for w in re.findall(r"[^\W_]+", t.lower()))
    pairs = Counter(p for t in texts for ws in [re.findall(r"[^\W_]+", t.lower())] for p in itertools.pairwise(ws))
    return frame, freq, pairs


def test_best_path_is_that_of_all_paths(spark, corpus):
    frame, freq, pairs = corpus
    terms, met = correction.term_counts(frame, "t"), correction.pair_counts(frame, "t")
    assert {(r["term"], r["freq"]) for r in terms.collect()} == set(freq.items()) and {(r["first"], r["second"], r["n"]) for r in met.collect()} == {(*p, n) for p, n in pairs.items()}
    rng = random.Random(8)
    known = sorted(freq, key=freq.get)[-60:]
    ask = [" ".join(w if rng.random() < 0.55 else w[:1] + rng.choice("abqz") + w[2:] for w in rng.choices(known, k=rng.randrange(1, 7))) for _ in range(60)]
    ask += ["Annual budgt of the ministri!", "", None, "?!", "annual  budget", "xqzw", "The Budgi of the Queen"]
    frame2 = spark.createDataFrame(list(enumerate(ask)), "id long, q string")
    got = {r["id"]: r for r in correction.corrected(frame2, "id", "q", terms, met).collect()}
    assert len(got) == len(ask)
    for k, q in enumerate(ask):
        want = brute(q, freq, pairs)
        assert [tuple(c) for c in got[k]["changes"]] == want, q
        if not want:
            assert got[k]["corrected"] == q
    assert got[60]["corrected"] == "Annual budget of the ministry!"


def test_planted_typos_are_repaired(spark, corpus):
    """Four of five words of the hundred most frequent are put right after one letter is changed, dropped or doubled."""
    frame, freq, pairs = corpus
    rng = random.Random(12)
    texts = [r["t"] for r in frame.dropna().collect() if r["t"]]
    common = {w for w in sorted((t for t in freq if len(t) >= 5), key=lambda t: (-freq[t], t)) if w in sorted((t for t in freq if len(t) >= 3), key=lambda t: (-freq[t], t))[:100]}
    rows, planted = [], {}
    for t in texts:
        words = t.lower().split()
        places = [k for k, w in enumerate(words) if w in common]
        if not places:
            continue
        k = rng.choice(places)
        w, i = words[k], rng.randrange(1, len(words[k]))
        wrong = rng.choice([w[:i] + "q" + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:]])
        if wrong not in freq:
            planted[len(rows)] = (wrong, w)
            rows.append((len(rows), " ".join([*words[:k], wrong, *words[k + 1 :]])))
    terms, met = correction.term_counts(frame, "t"), correction.pair_counts(frame, "t")
    got = {r["id"]: {(c["word"], c["suggestion"]) for c in r["changes"]} for r in correction.corrected(spark.createDataFrame(rows, "id long, q string"), "id", "q", terms, met).collect()}
    right = sum(p in got[k] for k, p in planted.items())
    assert len(planted) > 10 and right >= 0.8 * len(planted), (right, len(planted))


def test_one_typo_of_a_question(spark, corpus):
    frame, freq, _ = corpus
    terms = correction.term_counts(frame, "t")
    q = spark.createDataFrame([(1, "anual budget of the minstry"), (2, "the annual budget")], "id long, q string")
    words = q.selectExpr("explode(split(q, ' ')) as word")
    got = correction.worst_typo(q, "id", "q", correction.suggestions(words, "word", terms)).collect()
    weights = {w: correction.typo_score(w, t) * math.log1p(freq[t]) for w, t in (("anual", "annual"), ("minstry", "ministry"))}
    assert [(r["id"], r["word"]) for r in got] == [(1, max(weights, key=weights.get))]
