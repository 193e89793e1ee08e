import pytest
from pyspark.sql import functions as F

from lodestone.functions import models
from lodestone.operators import fusion
from lodestone.plans import analysis


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("what is the budget", "simple_sum"), ("compare budget of a and b", "comparison"), ("surplus of income", "cross_table"), ("income by section", "breakdown"), ("largest costs", "top_n"), ("who wrote this", "non_financial"), ("difference and balance of income", "comparison")],
)
def test_category_precedence(text, wanted):
    assert analysis.category(text) == wanted


def test_years_and_rows():
    assert analysis.years("98 تا 1401") == [1398, 1399, 1400, 1401] and analysis.years("سال ۱۴۰۳") == [1403] and analysis.years("abc") == []
    assert [analysis.wanted_rows(t) for t in ("top 7 costs", "largest 500 costs", "which units have the largest cost", "the largest cost", "budget")] == [7, 100, 5, 1, 10]
    assert analysis.default_year("budget of x?") == "budget of x 1403" and analysis.default_year("budget 1402") == "budget 1402"


def test_routes_and_parts():
    assert analysis.route("سلام", True)[0] == "greeting" and analysis.route("total budget", True)[:2] == ("database", "rag") and analysis.route("who", False)[0] == "rag"
    assert analysis.sub_questions("what is income? what is cost?") == ["what is income", "what is cost"]
    assert analysis.compared_entities("compare health and education?") == ("health", "education") and analysis.compared_entities("x") is None
    assert analysis.analyse("compare income 1401 to 1402").comparison == "year_over_year" and 0 < analysis.complexity("ratio of a and b, c") <= 1


def test_multi_hop_merge(spark):
    hits = spark.createDataFrame([("q", "a", 1, 1, 0.9), ("q", "b", 1, 2, 0.5), ("q", "b", 2, 1, 0.4), ("q", "c", 2, 2, 0.3)], "q string, d string, hop int, r int, s double")
    out = [(r["d"], round(r["score"], 6)) for r in fusion.multi_hop_merge(hits, "q", "d", "hop", "r", "s", 3).orderBy("rank").collect()]
    assert out == [("a", 0.95), ("b", 0.65), ("c", 0.3)]


def test_merge_and_priority(spark):
    row = spark.range(1).select(fusion.merge_maps(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("")), F.create_map(F.lit("a"), F.lit("xyz"), F.lit("b"), F.lit("v"))).alias("m")).first()
    assert row["m"] == {"a": "xyz", "b": "v"}
    rows = spark.createDataFrame([("k", 2, "late"), ("k", 1, "soon"), ("j", 3, "x")], "k string, p int, v string")
    assert [(r["k"], r["v"]) for r in fusion.by_priority(rows, "k", "p", ["v"]).collect()] == [("k", "soon"), ("j", "x")]


def test_greedy_distinct(spark):
    rows = spark.createDataFrame([(1, 0, ["a", "b", "c", "d"]), (1, 1, ["a", "b", "c", "d", "e"]), (1, 2, ["x"]), (2, 0, None)], "g int, o int, w array<string>")
    assert sorted((r["g"], r["o"]) for r in fusion.greedy_distinct(rows, "g", "o", "w").collect()) == [(1, 0), (1, 2), (2, 0)]


def test_rounds_skip_what_was_found(spark):
    index = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 3)], "w string, doc int")
    more = {("a",): ("a", "b"), ("a", "b"): ("a", "b", "c")}
    out = fusion.retrieve_in_rounds(lambda words: index.where(F.col("w").isin(*words)).select("doc").distinct(), ("a",), lambda new, words: more.get(tuple(words), words))
    assert sorted((r["doc"], r["round"]) for r in out.collect()) == [(1, 0), (2, 1), (3, 2)]


def test_tables_and_context(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "g int, r int, t string")
    assert fusion.numbered_context(rows, "g", "r", "t").first()["context"] == "[1] a\n[2] b"
    assert fusion.markdown_table(rows, "g", "r", ["r", "t"]).first()["markdown"] == "| r | t |\n|---|---|\n| 1 | a |\n| 2 | b |"


def test_embedder_gives_a_row_for_a_row(spark):
    out = spark.createDataFrame([("a b",), (None,), ("",)], "t string").select(models.embedder()("t").alias("v")).collect()
    assert abs(sum(x * x for x in out[0]["v"]) - 1) < 1e-6 and out[1]["v"] is None and set(out[2]["v"]) == {0.0}


def test_registered_function(spark):
    f = models.Functions(spark)
    f.register("plus_one", lambda x: x + 1, "int")
    assert spark.sql("select plus_one(1) as x").first()["x"] == 2 and f.listed() == {"plus_one": "int"}
