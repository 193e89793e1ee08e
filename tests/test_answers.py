"""Answer operators that SQL does not express, against brute force; odd rows of the others."""

import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lodestone.operators import answers
from lodestone.plans.answers import CUES, PATTERNS, TERMS

TEXTS = [(1, "The national liberty, qualities; 1999"), (2, None), (3, ""), (4, "nothing alike"), (5, "nation nation sonderungen ab123 mail x@y.org in 2024"), (6, "a " * 5000 + "id zz9876")]


def test_keyword_similarity_is_brute_force(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    want = {}
    for key, text in TEXTS:
        words = set((text or "").strip().lower().split())
        best = [max((SequenceMatcher(None, t, w).ratio() for w in words), default=0) for t in TERMS]
        best = [b for b in best if b >= 0.8]
        if best:
            want[key] = round(0.4 * sum(best) / len(best) + 0.6 * len(best) / len(TERMS), 9)
    got = {r["doc_id"]: round(r["score"], 9) for r in answers.keyword_similarity(docs, "doc_id", "text", TERMS).collect()}
    assert got == want and {1, 5} <= set(got)


def test_typed_patterns_is_brute_force(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    want = []
    for key, text in TEXTS:
        for kind, p in PATTERNS:
            for m in re.finditer(p, text or "", re.IGNORECASE):
                near = text[max(0, m.start() - 50) : m.start() + 50].lower()
                want.append((key, kind, m[0], m.start(), m.end(), round(min(0.99, 0.7 + 0.1 * sum(c in near for c in CUES.get(kind, ()))), 6)))
    rows = answers.typed_patterns(docs, "doc_id", "text", PATTERNS, CUES).collect()
    assert sorted((r[0], r[1], r[2], r[3], r[4], round(r[6], 6)) for r in rows) == sorted(want) and len(want) == 5
    assert answers.typed_patterns(docs.limit(0), "doc_id", "text", PATTERNS, CUES).count() == 0


def test_json_tables_and_metrics_of_odd_rows(spark):
    texts = [(None,), ("",), ("```json\nbroken\n```",), ('a {"x": 1} b',), ("|x|",), ("say\n| a |\n| b |",)]
    rows = spark.createDataFrame(texts, "t string").select(answers.json_object("t").alias("j"), answers.split_table("t").alias("s")).collect()
    assert [r["j"] for r in rows] == [None, None, None, '{"x": 1}', None, None]
    assert [r["s"] and tuple(r["s"]) for r in rows] == [None, None, None, None, None, ("| a |\n| b |", "say")]
    empty = F.array().cast("array<array<string>>")
    one = F.array(F.array(F.lit("a")))
    got = spark.range(1).select(answers.context_metrics(empty, one).alias("a"), answers.context_metrics(one, empty).alias("b"), answers.context_metrics(one, one).alias("c")).first()
    assert [tuple(x) for x in got] == [(0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)]


def test_list_summary_of_no_rows(spark):
    rows = spark.createDataFrame([("a",), (None,), (None,)], "title string")
    assert tuple(answers.list_summary(rows, "title").first()) == (3, "a")
    assert tuple(answers.list_summary(rows.limit(0), "title").first()) == (0, None)
