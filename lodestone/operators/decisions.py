"""Decisions over questions, sources and answers: relevance, gates, accuracy, confidence, quality; as columns or small aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUALITY = ("low", "medium", "high", "excellent")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def level(name: str | Column, order: Sequence[str] = QUALITY) -> Column:
    """The place of a name in an order, from 1; null for others."""
    return F.nullif(F.array_position(F.array(*(F.lit(o) for o in order)), F.lower(_c(name))), F.lit(0))


def of_quality(rows: DataFrame, quality: str, least: str, order: Sequence[str] = QUALITY) -> DataFrame:
    """Rows whose quality is `least` or better; rows of an unknown quality go."""
    return rows.where(level(quality, order) >= order.index(least) + 1)


def content_statistics(rows: DataFrame, kind: str, quality: str, confidence: str, size: str) -> DataFrame:
    """Numbers, mean confidence and sizes by kind, by quality and of all rows, in one pass; `by` names the grouping."""
    grouped = rows.groupingSets([[F.col(kind)], [F.col(quality)], []], F.col(kind), F.col(quality))
    out = grouped.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.sum(size).alias("size"), F.avg(size).alias("mean_size"))
    by = F.when(F.col("g") == 1, "kind").when(F.col("g") == 2, "quality").otherwise("all")
    return out.select(by.alias("by"), F.coalesce(F.col(kind).cast("string"), F.col(quality).cast("string")).alias("value"), "n", "confidence", "size", "mean_size")


def private_host(host: str | Column) -> Column:
    """Whether a host is the machine itself or in a private or link-local range."""
    return _c(host).rlike(r"(?i)^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.0\.0\.0$|\[?::1\]?$|\[?f[cd][0-9a-f]{2}:)|\.local$|\.internal$")


def relevance(query: Column, sources: Column) -> Column:
    """The largest share of the query's distinct words that one of the first five sources has; 0.5 for a query without words."""
    words = F.array_distinct(query)
    best = F.array_max(F.transform(F.slice(sources, 1, 5), lambda s: F.size(F.array_intersect(words, s)) / F.size(words)))
    return F.when(F.size(words) == 0, 0.5).otherwise(F.coalesce(best, F.lit(0.0)))


def off_topic(text: str | Column, patterns: Sequence[str], anchors: Sequence[str]) -> Column:
    """Whether a text matches a pattern of another domain and holds no anchor of this one."""
    found = lambda ps: reduce(or_, (F.lower(_c(text)).rlike(p) for p in ps), F.lit(False))
    return found(patterns) & ~found(anchors)


def rank_confidence(rows: DataFrame, by: Sequence[str], score: str, key: str, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """Weighted sum of the best score, the mean of the best three and the gap between the first two, of each group."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), key)
    top = rows.withColumn("__r", F.row_number().over(order)).where("__r <= 3")
    at = lambda k: F.max(F.when(F.col("__r") == k, F.col(score)))
    first, second = at(1), F.coalesce(at(2), F.lit(0.0))
    return top.groupBy(*by).agg((weights[0] * first + weights[1] * F.avg(score) + weights[2] * (first - second)).alias("confidence"))


def question_match(asked: Column, known: Column, intents: Sequence[str]) -> Column:
    """score and match of two questions' distinct words: .4 Jaccard, .4 share of the asked words, .2 for a common intent word.

    A match has a score of .3, or a Jaccard index of .2 and a common intent. Without words: .5 and a match.
    """
    common, union = F.size(F.array_intersect(asked, known)), F.size(F.array_union(asked, known))
    jaccard, own = common / union, common / F.size(asked)
    marks = F.array(*(F.lit(i) for i in intents))
    of_asked, of_known = F.array_intersect(asked, marks), F.array_intersect(known, marks)
    intent = F.arrays_overlap(of_asked, of_known) | ((F.size(of_asked) == 0) & (F.size(of_known) == 0))
    score = 0.4 * jaccard + 0.4 * own + F.when(intent, 0.2).otherwise(0.0)
    empty = (F.size(asked) == 0) | (F.size(known) == 0)
    return F.struct(F.when(empty, 0.5).otherwise(score).alias("score"), (empty | (score >= 0.3) | ((jaccard >= 0.2) & intent)).alias("match"))


def coverage_check(critical: Column, general: Column, context: Column, least: float = 0.3) -> Column:
    """coverage (.7 of the critical words found, .3 of the general ones) and whether it passes: enough, and not without any
    critical word where there are some."""
    share = lambda words: F.when(F.size(words) > 0, F.size(F.array_intersect(words, context)) / F.size(words)).otherwise(1.0)
    total = 0.7 * share(critical) + 0.3 * share(general)
    return F.struct(total.alias("coverage"), ((total >= least) & (share(critical) > 0)).alias("passed"))


def similarity_gate(rows: DataFrame, similarity: str, domain: str, thresholds: dict[str, float], default: float = 0.28) -> DataFrame:
    """rows with `passed`: a similarity (0.5 where there is none) of at least the domain's threshold."""
    known = F.create_map(*(F.lit(v) for kv in thresholds.items() for v in kv)) if thresholds else None
    least = F.coalesce(known[F.col(domain)], F.lit(default)) if thresholds else F.lit(default)
    return rows.withColumn("passed", F.coalesce(F.col(similarity), F.lit(0.5)) >= least)


def numeric_accuracy(answer: Column, expected: Column, tolerance: float = 0.01) -> Column:
    """accuracy (share of the expected numbers that the answer has within the tolerance) and its level."""
    hit = F.filter(expected, lambda e: F.exists(answer, lambda a: F.abs(a - e) <= tolerance * F.greatest(F.abs(e), F.lit(1e-9))))
    share = F.when(F.size(expected) == 0, 1.0).otherwise(F.size(hit) / F.size(expected))
    name = F.when(share >= 0.95, "exact").when(share >= 0.7, "high").when(share >= 0.4, "partial").otherwise("low")
    return F.struct(share.alias("accuracy"), name.alias("level"))


def structural_accuracy(*issues: Column) -> Column:
    """1 less .2 for each issue, at least 0."""
    return F.greatest(F.lit(0.0), 1 - 0.2 * sum((F.coalesce(i, F.lit(True)).cast("int") for i in issues), F.lit(0)))


def answer_quality(text: str | Column, sources: Column, marks: Sequence[str]) -> Column:
    """One of five levels: 3 points, and one each for a number, for punctuation, for more than two marks and for more than two sources."""
    t = _c(text)
    held = sum((F.lower(t).contains(m).cast("int") for m in marks), F.lit(0))
    points = 3 + sum((F.coalesce(x, F.lit(False)).cast("int") for x in (t.rlike("[0-9]"), t.rlike("[.!?:;,]"), held > 2, sources > 2)), F.lit(0))
    return F.when(t.isNull() | (F.length(F.trim(t)) == 0), "poor").when(points >= 7, "excellent").when(points >= 6, "very good").when(points >= 5, "good").when(points >= 4, "fair").otherwise("poor")


def result_quality(rows: DataFrame, columns: int) -> DataFrame:
    """relevance (rows over 10), completeness (columns over 5) and confidence, their mean, of a query's result; one row."""
    n = rows.agg(F.least(F.count(F.lit(1)) / 10, F.lit(1.0)).alias("relevance")).withColumn("completeness", F.lit(min(columns / 5, 1.0)))
    return n.withColumn("confidence", (F.col("relevance") + F.col("completeness")) / 2)


def context_boost(score: str | Column, domain: Column, keyword: Column, table: Column) -> Column:
    """The score with .1 for the right domain, .05 for a keyword and .05 for a table, at most .3 more."""
    boost = F.when(domain, 0.1).otherwise(0.0) + F.when(keyword, 0.05).otherwise(0.0) + F.when(table, 0.05).otherwise(0.0)
    return _c(score) + F.least(boost, F.lit(0.3))


def enhanced_score(semantic: str | Column, keyword: str | Column, all_hit: Column) -> Column:
    """.4 of the semantic and .1 of the keyword score, and 1 where all keywords are hit."""
    return 0.4 * F.coalesce(_c(semantic), F.lit(0.0)) + 0.1 * F.coalesce(_c(keyword), F.lit(0.0)) + F.when(all_hit, 1.0).otherwise(0.0)


def keyword_only(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best rows of a positive keyword score, scaled by ten to at most 1."""
    return rows.where(F.col(score) > 0).orderBy(F.col(score).desc(), key).limit(k).withColumn("similarity", F.least(F.col(score) / 10, F.lit(1.0)))


def step_intent(text: str | Column, history: Column, before: str, after: str) -> Column:
    """direction, value and confidence of a question for the one before or after: .9 for a number of its own, .8 for the last
    number of 3 to 8 digits in the turns before; null otherwise."""
    t = F.lower(_c(text))
    way = F.when(t.rlike(before), "previous").when(t.rlike(after), "next")
    own = F.nullif(F.regexp_extract(t, r"(?<![0-9])([0-9]{3,8})(?![0-9])", 1), F.lit(""))
    held = F.filter(F.transform(history, lambda h: F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(h, F.lit(r"(?<![0-9])([0-9]{3,8})(?![0-9])"))), -1)), lambda x: x != "")
    last = F.when(F.size(held) > 0, F.element_at(held, -1))
    value = F.coalesce(own, last)
    return F.when(way.isNotNull() & value.isNotNull(), F.struct(way.alias("direction"), value.alias("value"), F.when(own.isNotNull(), 0.9).otherwise(0.8).alias("confidence")))


def idle_dropped(rows: DataFrame, ts: str, now: Column, seconds: int = 300) -> DataFrame:
    """Rows seen within the last so many seconds."""
    return rows.where(F.unix_timestamp(now) - F.unix_timestamp(ts) <= seconds)


def gate_counts(log: DataFrame, gate: str, decision: str, reason: str, rejected: str) -> DataFrame:
    """Numbers of rejected decisions by gate and reason."""
    return log.where(F.col(decision) == rejected).groupBy(gate, reason).agg(F.count(F.lit(1)).alias("n"))


def similar_turns(turns: DataFrame, by: str, order: str, vector: str, query: Sequence[float], last: int = 100, k: int = 3) -> DataFrame:
    """The k of each group's last turns that are nearest to the query vector by cosine (a small number keeps it defined)."""
    q = F.array(*(F.lit(float(v)) for v in query))
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    cosine = product(F.col(vector), q) / (F.sqrt(product(F.col(vector), F.col(vector))) * F.sqrt(product(q, q)) + 1e-8)
    recent = turns.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))).where(F.col("__r") <= last)
    best = Window.partitionBy(by).orderBy(F.col("similarity").desc(), order)
    return recent.withColumn("similarity", F.round(cosine, 9)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("__r")
