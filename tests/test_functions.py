from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestone.functions import numeric, similarity, text
from lodestone.operators import chunking, entities, quality, search, structure, structured, web


def one(spark, column, **values):
    names = [*values]
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind(v)}" for k, v in values.items())).select(column.alias("x")).first()["x"] if names else None


def kind(v):
    return {str: "string", float: "double", int: "int", list: "array<string>" if v and isinstance(v[0], str) else "array<double>", type(None): "string"}[type(v)] if v != [] else "array<string>"


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("كتابي", "کتابی"), ("۱۲۳ ٤٥", "123 45"), ("می‌روم", "می روم"), ("‏a  b\n c﻿", "a b c"), (None, ""), ("nan", ""), ("", "")],
)
def test_normalize(spark, given, wanted):
    assert one(spark, text.normalize("t"), t=given) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("98", [1398]), ("403", [1403]), ("1403", [1403]), ("98 تا 1403", [1398, 1399, 1400, 1401, 1402, 1403]), ("12", [1412]), ("abc", []), ("1400-1402", [1400, 1401, 1402])],
)
def test_years(spark, given, wanted):
    assert one(spark, numeric.solar_years("t"), t=given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("1,234", 1234.0), ("12%", 0.12), ("3.2e5", 320000.0), ("۱۲", 12.0), ("x", None)])
def test_number(spark, given, wanted):
    assert one(spark, numeric.number("t"), t=given) == wanted


def test_codes(spark):
    assert one(spark, numeric.last_code("t"), t="110000 x 110101 1234567") == "110101"
    assert [one(spark, numeric.code_level("t"), t=c) for c in ("110000", "111000", "110100", "110101", "x")] == ["part", "section", "clause", "item", None]
    assert one(spark, numeric.dominant_digits("t"), t="no digits") is None


def test_vectors_and_sets(spark):
    assert one(spark, similarity.cosine("a", "b"), a=[1.0, 0.0], b=[1.0, 0.0]) == 1
    assert one(spark, similarity.cosine("a", "b"), a=[1.0, 0.0], b=[0.0, 1.0]) == 0
    assert one(spark, similarity.cosine("a", "b"), a=[1.0, 0.0], b=[-1.0, 0.0]) == -1
    assert one(spark, similarity.cosine("a", "b"), a=[0.0, 0.0], b=[1.0, 0.0]) == 0
    assert one(spark, similarity.jaccard("a", "b"), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)


def test_sequence_ratio_is_difflibs(spark):
    assert one(spark, similarity.sequence_ratio("a", "b"), a="ministry of health", b="health ministry") == SequenceMatcher(None, "ministry of health", "health ministry").ratio()


def test_growth_of_zero_and_missing(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 15.0), (4, None)], "y int, v double")
    assert [r["pct"] for r in structured.growth(rows, "y", "v").orderBy("y").collect()] == [0.0, 0.0, 50.0, None]


def test_signed_sum(spark):
    rows = spark.createDataFrame([("a", 1, 5.0, 1), ("a", 1, 9.0, 2), ("a", 2, 3.0, 1), ("b", 1, 7.0, 1)], "e string, p int, v double, r int")
    out = structured.signed_sum(rows, "e", "p", "v", F.col("p") == 2, "r").collect()
    assert [(r["e"], r["total"], r["periods"]) for r in out] == [("a", 2.0, 2)]


def test_tree_with_deduction(spark):
    rows = spark.createDataFrame([("root", None, 0.0), ("m", "root", 0.0), ("l1", "m", 5.0), ("l2", "m", -2.0), ("l3", "root", 1.0)], "n string, p string, v double")
    assert {r["n"]: r["v"] for r in structured.tree_rollup(rows, "n", "p", "v").collect()} == {"root": 4.0, "m": 3.0, "l1": 5.0, "l2": -2.0, "l3": 1.0}


def test_deep_trees_and_circles(spark):
    rows = spark.createDataFrame([(k, k - 1 if k else None, 1.0 if k == 11 else 0.0) for k in range(12)], "n int, p int, v double")
    assert {r["v"] for r in structured.tree_rollup(rows, "n", "p", "v").collect()} == {1.0}
    with pytest.raises(ValueError):
        structured.tree_rollup(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "n int, p int, v double"), "n", "p", "v", depth=5)


def test_neighbours_across_partitions(spark):
    rows = spark.createDataFrame([(k % 2, 10 * k) for k in range(40)] * 2, "g int, c int")
    got = {r["c"]: (r["previous"], r["next"]) for r in structured.neighbours(rows, "c").collect()}
    assert got == {10 * k: (10 * k - 10 if k else None, 10 * k + 10 if k < 39 else None) for k in range(40)}
    got = {r["c"]: (r["previous"], r["next"]) for r in structured.neighbours(rows, "c", ["g"]).collect()}
    assert got == {10 * k: (10 * k - 20 if k > 1 else None, 10 * k + 20 if k < 38 else None) for k in range(40)}


def test_gap_cut(spark):
    rows = spark.createDataFrame([("q", i, s) for i, s in enumerate([0.9, 0.85, 0.3, 0.28, 0.05])] + [("low", 9, 0.02)], "q string, id int, s double")
    kept = {(r["q"], r["id"]) for r in search.gap_cut(rows, "s", ["q"], "id").collect()}
    assert kept == {("q", 0), ("q", 1), ("low", 9)}


def test_rank_fusion_skips_nothing(spark):
    lists = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 1.0), ("b", "x", 1.0), ("c", "z", 1.0)], "s string, d string, v double")
    out = {r["d"]: r["rrf"] for r in search.reciprocal_rank_fusion(lists, "s", "d", "v").collect()}
    assert out["x"] == pytest.approx(2 / 61) and out["y"] == pytest.approx(1 / 62) and out["z"] == pytest.approx(1 / 61)


@pytest.mark.parametrize("given", ["", "a", "word " * 700, "x" * 3000, "One. Two! Three?\n\nFour. " * 80, "Article 1\nabc def ghi jkl mno pqr\nArticle 2\n" * 30])
@pytest.mark.parametrize("name", sorted(chunking.CHUNKERS))
def test_chunkers_end_and_cover(given, name):
    found = [*chunking.CHUNKERS[name](given)]
    if name in ("window", "word", "fenced"):
        assert {w for w in given.split()} <= {w for _, c in found for w in c.split()} or len(given.split()) <= 1
    assert all(c for _, c in found)


def test_windows_overlap_and_progress():
    found = [*chunking.windows("a " * 1000, 100, 99)]
    assert all(b[0] > a[0] for a, b in zip(found, found[1:])) and found[-1][0] + len(found[-1][1]) == 2000


def test_islands_and_codes(spark):
    rows = spark.createDataFrame([("t", i, s) for i, s in enumerate(["x", "# a", "y", "# b"])], "t string, i int, s string")
    assert [r["section"] for r in structure.islands(rows, ["t"], "i", F.col("s").startswith("#")).orderBy("i").collect()] == [0, 1, 1, 2]
    docs = spark.createDataFrame([(1, "110000 110100 110101 555101")], "d int, t string")
    out = {r["code"]: (r["clauses"], r["orphan"]) for r in structure.sections_with_clauses(structure.codes(docs, "d", "t")).collect()}
    assert out["110000"] == (2, False) and out["555101"] == (0, True)


def test_items_of_a_page():
    page = '<script type="application/ld+json">{"@type":"Product","name":"Pen","offers":{"price":3,"priceCurrency":"EUR"}}</script><meta property="og:title" content="Pen"><div itemprop="name">Ink</div>'
    assert web.page_items(page) == [("Pen", "3 EUR", "", "", 0.9), ("Ink", "", "", "", 0.8)]
    assert web.page_items("<script type='application/ld+json'>{broken</script>") == []


def test_hallucination_flag_comes_before_penalties(spark):
    flag, confidence = quality.hallucination(*(F.lit(0.61) for _ in range(5)), F.lit(5), F.lit(True))
    row = spark.range(1).select(flag.alias("f"), confidence.alias("c")).first()
    assert row["f"] is False and row["c"] == pytest.approx(0.61 * 0.9 * 0.85)


def test_typos(spark):
    vocab = spark.createDataFrame([("budget", 9), ("bucket", 1)], "term string, freq int")
    words = spark.createDataFrame([("budgte",), ("budget",)], "w string")
    out = entities.typos(words, "w", vocab, "term", "freq").collect()
    assert [(r["w"], r["suggestion"]) for r in out] == [("budgte", "budget")]


def test_typos_compares_all_terms(spark):
    import random

    rng = random.Random(5)
    drawn = lambda n: sorted({"".join(rng.choices("aderstu", k=rng.randint(3, 9))) for _ in range(n)})
    terms = {t: rng.randint(1, 12) for t in [*drawn(60), "eroues", "des", "ndes"]}
    unknown = [w for w in [*drawn(80), "therouou", "ndhesh"] if w not in terms]
    vocab = spark.createDataFrame(list(terms.items()), "term string, freq int")
    got = {r["w"]: (r["suggestion"], round(r["score"], 9)) for r in entities.typos(spark.createDataFrame([(w,) for w in unknown], "w string"), "w", vocab, "term", "freq").collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    wanted = {}
    for w in unknown:
        scored = [(-s * (1 + 0.1 * min(f, 10)), t) for t, f in terms.items() if abs(len(w) - len(t)) <= 3 and (s := 1 - edits(w, t) / max(len(w), len(t))) >= 0.4]
        if scored:
            wanted[w] = (min(scored)[1], round(-min(scored)[0], 9))
    assert got == wanted and "therouou" in got


def words_of(text):
    import re

    return re.findall(r"[^\W_]+", text.lower())


def test_lexical_rerank_scores_all_items_and_turns(spark, tmp_path):
    from lodestone.plans.catalogue import QUERIES

    items = [(k, f"item{k} word{k % 3} common") for k in range(7)]
    turns = [(c, t, r, f"{'The' if c % 2 else 'A'} common word{t} item{c}") for c in range(4) for t, r in enumerate(["user", "assistant", "user"])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["item_id"], r["conv_id"], r["turn"]): r["score"] for r in QUERIES["lexical_rerank"](spark, str(tmp_path)).collect()}
    wanted = {(i, c, t): round(0.7 * len(set(words_of(q)) & set(words_of(x))) / len(set(words_of(q))) + 0.3 * ("the" in x.lower()), 6) for i, q in items for c, t, _, x in turns}
    assert got == wanted


def test_ngram_keywords_of_all_sources(spark, tmp_path):
    from collections import Counter

    from lodestone.plans.catalogue import QUERIES

    texts = ["a b c d e", "a b c d", "x y z", "x y z w", "one", "one two", "", None, *(f"k{i} m{i} n{i} p{i}" for i in range(30) for _ in range(2 + i % 3))]
    spark.createDataFrame([(k, t, f"src{k % 4}") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["ngram_keywords"](spark, str(tmp_path)).collect()]
    wanted = []
    for n, top in ((3, 12), (2, 25), (1, 50)):
        counts = Counter(" ".join(w[i : i + n]) for t in texts if t for w in [words_of(t)] for i in range(len(w) - n + 1))
        wanted += sorted(((g, f) for g, f in counts.items() if f >= 2), key=lambda x: (-x[1], x[0]))[:top]
    assert got == wanted[:50]


def test_number_consistency_keeps_separated_numbers(spark, tmp_path):
    from lodestone.plans.catalogue import QUERIES

    turns = [(1, 0, "costs 1,250 and 3.5"), (1, 1, "it is 1250 and 3.50"), (1, 2, "it is 1,251"), (2, 0, "of 7"), (2, 1, "7")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["consistency"] for r in QUERIES["number_consistency"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): 1.0, (1, 1): 0.5, (2, 0): 1.0}
