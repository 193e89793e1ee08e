"""Evaluation metrics, gates and validation as column expressions over arrays of tokens, scores and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.numeric import numbers
from lodestone.functions.similarity import coverage, jaccard


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def retrieval_metrics(returned: DataFrame, gold: DataFrame, query: str, doc: str, rank: str) -> DataFrame:
    """Recall, reciprocal rank and hit per query; a query without gold scores 1 throughout."""
    wanted = gold.groupBy(query).agg(F.count_distinct(doc).alias("expected"))
    found = returned.join(gold.select(query, doc).distinct(), [query, doc]).groupBy(query).agg(F.count_distinct(doc).alias("found"), F.min(rank).alias("first_rank"))
    rows = returned.select(query).distinct().join(wanted, query, "left").join(found, query, "left")
    none = F.col("expected").isNull()
    return rows.select(
        query,
        F.when(none, 1.0).otherwise(F.coalesce(F.col("found") / F.col("expected"), F.lit(0.0))).alias("recall"),
        F.when(none, 1.0).otherwise(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr"),
        (none | F.col("found").isNotNull()).alias("hit"),
    )


def keyword_coverage(text: str | Column, words: list[str]) -> Column:
    """The share of keywords that the text contains."""
    t = F.lower(_c(text))
    return sum((t.contains(w.lower()).cast("int") for w in words), F.lit(0)) / max(1, len(words))


def score_gate(scores: str | Column, mean_least: float = 0.35, max_least: float = 0.40) -> Column:
    """Whether the top three scores are good enough; scores above 1 count as min(s / 1.5, 1)."""
    top = F.slice(F.reverse(F.array_sort(F.transform(_c(scores), lambda s: F.when(s > 1, F.least(s / 1.5, F.lit(1.0))).otherwise(s)))), 1, 3)
    mean = F.aggregate(top, F.lit(0.0), lambda a, s: a + s) / F.greatest(F.size(top), F.lit(1))
    return (F.size(top) > 0) & (mean >= mean_least) & (F.coalesce(F.try_element_at(top, F.lit(1)), F.lit(0.0)) >= max_least)


def unsupported_numbers(answer: str | Column, context: str | Column) -> Column:
    """Numbers of the answer that the context lacks."""
    return F.array_except(numbers(answer), numbers(context))


def number_consistency(answer: str | Column, context: str | Column) -> Column:
    return F.when(F.size(unsupported_numbers(answer, context)) > 0, 0.5).otherwise(1.0)


def sum_is_named(answer: str | Column, total: Column) -> Column:
    """matched if the answer names the total within .1 % (at least 1), unchecked for a total of 0, else corrected."""
    off = F.greatest(F.lit(1.0), F.abs(total) * 0.001)
    return F.when(total == 0, "unchecked").when(F.exists(numbers(answer), lambda n: F.abs(n - total) <= off), "matched").otherwise("corrected")


def correctness(answer: str | Column, truth: str | Column) -> Column:
    return jaccard(answer, truth)


def end_to_end(confidence: Column, correct: Column) -> Column:
    return F.least(5 * (0.6 * confidence + 0.4 * correct), F.lit(5.0))


def faithfulness(answer: str | Column, context: str | Column) -> Column:
    """The share of answer words that the context has."""
    return coverage(answer, context)


def hallucination(faithful: Column, self_check: Column, nums: Column, overlap: Column, citations: Column, words: Column, hedged: Column, least: float = 0.60) -> tuple[Column, Column]:
    """The flag, decided first, and the confidence after the penalties for short and hedged answers."""
    score = 0.35 * faithful + 0.25 * self_check + 0.20 * nums + 0.10 * overlap + 0.10 * citations
    return score < least, score * F.when(words < 15, 0.9).otherwise(1.0) * F.when(hedged, 0.85).otherwise(1.0)


def answer_confidence(top: Column, sources: Column, rows: Column, answer: Column, route: Column) -> Column:
    """.4 top score, .2 each for sources, rows and a long answer; floors by route; capped at 1."""
    raw = 0.4 * top + 0.2 * F.least(sources / 5, F.lit(1.0)) + 0.2 * F.least(rows / 10, F.lit(1.0)) + F.when(F.length(answer) > 50, 0.2).otherwise(0.0)
    floor = F.when(route == "database", 0.8).when(route == "hybrid", 0.7).otherwise(0.0)
    return F.least(F.greatest(raw, floor), F.lit(1.0))


def accuracy_level(share: Column) -> Column:
    return F.when(share >= 1, "exact").when(share > 0.8, "high").when(share > 0.5, "medium").otherwise("low")


def contradictions(contexts: DataFrame, group: str, key: str, words: str, opposites: list[tuple[str, str]], common_least: int = 2) -> DataFrame:
    """Pairs of a group's contexts (few by nature: the retrieved ones) where one has a word and the other its opposite."""
    a = contexts.select(F.col(group), F.col(key).alias("a"), F.col(words).alias("wa"))
    b = contexts.select(F.col(group), F.col(key).alias("b"), F.col(words).alias("wb"))
    hits = sum((((F.array_contains("wa", x) & F.array_contains("wb", y)) | (F.array_contains("wa", y) & F.array_contains("wb", x))).cast("int") for x, y in opposites), F.lit(0))
    pairs = a.join(b, group).where(F.col("a") < F.col("b")).withColumn("common", F.size(F.array_intersect("wa", "wb"))).withColumn("score", hits / len(opposites))
    return pairs.where((F.col("common") >= common_least) & (F.col("score") > 0)).select(group, "a", "b", "common", "score")
