"""Queries against their SQL on rows that the stored tables lack."""

import pytest

from lodestone.plans.catalogue import QUERIES, SQL
from tests.compare import connect, rows


def same(spark, name, folder):
    return rows(QUERIES[name](spark, str(folder)).toPandas()) == rows(connect(str(folder)).execute(SQL[name]).df())


@pytest.mark.parametrize("name", ["off_topic", "pattern_classes", "content_types"])
def test_words_next_to_letters_beyond_ascii(spark, tmp_path, name):
    texts = ["élesé", "les", "thé der", "éthe les", "ders", "der_", "les1", "Éder", "élles", "éapié", "Éclass", "", None]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert same(spark, name, tmp_path)


@pytest.mark.parametrize("name", ["follow_ups", "question_levels"])
def test_turns_with_words_next_to_letters_beyond_ascii(spark, tmp_path, name):
    texts = ["a b c d e f", "éthat b c d e f", "that b c d e f", "a bé andé c d e f", "éregion ofé", "a b c d e thats"]
    spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    assert same(spark, name, tmp_path)


def test_menus_with_marks_references_and_prices(spark, tmp_path):
    words = ["wa&amp;&amp;&amp;", "&lt;b&gt;", "12$$$", "$ 5", "w?", "w#", "w;", "w%%%", "w***", "été."]
    prose = "<h1>T</h1><p>pay $5 now</p><p>tel$$$ 4412 x</p><p>other text</p>"
    page = lambda w: f'<html><body><nav><ul>{"".join(f"""<li><a href="/{x}">{x}</a></li>""" for x in ("a", w, "b"))}</ul></nav><article>{prose}</article></body></html>'
    pages = [(k, "https://a.example.com/x/1?p=2#z", page(w)) for k, w in enumerate(words)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert same(spark, "repeated_page_items", tmp_path)


def test_turns_are_worked_out_before_they_meet_the_questions(spark):
    folder = "/root/testdata/sf0.001"
    plan = QUERIES["lexical_rerank"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    product = next(k for k, line in enumerate(plan.splitlines()) if "Join" in line)
    above = "\n".join(plan.splitlines()[:product])
    assert "lower(" not in above and "array_distinct" not in above
