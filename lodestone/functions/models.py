"""Pluggable scorers, with offline defaults that need no weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashing_vectors(texts: list[str | None], size: int = 64) -> np.ndarray:
    """Signed hashed word counts of unit length; a text without words is all 0."""
    out = np.zeros((len(texts), size), np.float32)
    for row, text in enumerate(texts):
        for w in (text or "").lower().split():
            h = xxhash.xxh3_64_intdigest(w)
            out[row, h % size] += 1 if h >> 63 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def embedder(model: Callable[[list[str | None]], np.ndarray] = hashing_vectors) -> Callable[[Column], Column]:
    """A column function that embeds texts in Arrow batches; one result a row, null for null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = model(texts.tolist())
            yield pd.Series([None if t is None else v.tolist() for t, v in zip(texts, vectors, strict=True)])

    return embed


class Functions:
    """A registry of named functions that queries can call from SQL."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, {}

    def register(self, name: str, function: Callable, returns: str) -> None:
        self.spark.udf.register(name, function, returns)
        self.names[name] = returns

    def listed(self) -> dict[str, str]:
        return dict(self.names)
