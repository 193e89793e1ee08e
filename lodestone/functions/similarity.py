"""Similarities of token sets, strings and vectors."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return _ratio(F.size(F.array_intersect(_c(a), _c(b))), F.size(F.array_union(_c(a), _c(b))))


def overlap_coefficient(a: str | Column, b: str | Column) -> Column:
    x, y = F.array_distinct(_c(a)), F.array_distinct(_c(b))
    return _ratio(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y)))


def token_similarity(a: str | Column, b: str | Column) -> Column:
    return 0.5 * jaccard(a, b) + 0.5 * overlap_coefficient(a, b)


def coverage(query: str | Column, found: str | Column, distinct: bool = False) -> Column:
    """The share of distinct query tokens that are found; `distinct` says that none repeats."""
    q = _c(query) if distinct else F.array_distinct(_c(query))
    return _ratio(F.size(F.array_intersect(q, _c(found))), F.size(q))


def answer_match(query: str | Column, found: str | Column) -> Column:
    return 0.3 * jaccard(query, found) + 0.4 * coverage(query, found) + 0.3 * coverage(found, query)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def edit_similarity(a: str | Column, b: str | Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(_c(a)), F.length(_c(b)))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(_c(a), _c(b)) / longest)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio, which no built-in expression gives; call it on few candidates."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def fuzzy(a: str | Column, b: str | Column) -> Column:
    """1 if equal; else the largest of ratio, .85 for containment, and .9 of the word overlap."""
    x, y = F.lower(F.trim(_c(a))), F.lower(F.trim(_c(b)))
    within = F.when((F.length(x) > 0) & (F.length(y) > 0) & (x.contains(y) | y.contains(x)), 0.85).otherwise(0.0)
    return F.when(x == y, 1.0).otherwise(F.greatest(sequence_ratio(x, y), within, 0.9 * overlap_coefficient(F.split(x, " "), F.split(y, " "))))


def combined(ratio: Column, overlap: Column, a: str | Column, b: str | Column) -> Column:
    """.5 ratio, .4 word overlap, .1 root of the length ratio."""
    la, lb = F.length(_c(a)), F.length(_c(b))
    return 0.5 * ratio + 0.4 * overlap + 0.1 * F.sqrt(_ratio(F.least(la, lb), F.greatest(la, lb)))
