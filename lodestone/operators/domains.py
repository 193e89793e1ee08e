"""Multinomial naive Bayes over words: counts by aggregation, weights by lookups and joins; texts get the label that fits them best.

Texts are split once to learn and once to classify. Words are counted, and those that are looked up are summed, where the texts are;
what travels is a row for each word of some texts, and the words of a text that are not looked up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.grams import TEXTS, coded
from lodestone.sources.scratch import stash

#: a model has at most so many labels; each is a column of the sums
MOST_LABELS = 100
#: words of this share, over the number of labels, of all tokens learnt from are looked up by broadcast: there are at most as many
HOT = 200_000


class Model(NamedTuple):
    """word, n (its tokens) and w (the logarithm of its share in the texts of each label, one added to each count), with labels,
    priors and the number of all tokens."""

    weights: DataFrame
    labels: list[str]
    priors: list[float]
    tokens: int


def words(text: str | Column) -> Column:
    """Words between white space with A-Z in lower case; null has none."""
    t = F.col(text) if isinstance(text, str) else text
    lower = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(lower, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


def learn(rows: DataFrame, label: str, text: str) -> Model:
    """A model of the labelled texts; rows without a label are left out. Labels, of which there are at most a hundred, come to the driver."""
    rows = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), words(text).alias("words"))
    known = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").limit(MOST_LABELS + 1).collect()
    if not 0 < len(known) <= MOST_LABELS:
        raise ValueError(f"a model needs from 1 to {MOST_LABELS} labels")
    labels, texts = [r["label"] for r in known], sum(r["n"] for r in known)
    columns = [f"n{k}" for k in range(len(labels))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                codes, distinct, lengths = coded(part.column(1))
                label_of = np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), lengths)
                n = np.bincount(codes * len(columns) + label_of, minlength=len(distinct) * len(columns)).reshape(-1, len(columns))
                yield pa.RecordBatch.from_arrays([distinct.cast(pa.string()), *(pa.array(n[:, k], pa.int64()) for k in range(len(columns)))], ["word", *columns])

    numbered = rows.select((F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1).alias("label"), "words")
    found = numbered.mapInArrow(run, ", ".join(["word string", *(f"{c} long" for c in columns)]))
    counts = stash(found.groupBy("word").agg(*(F.sum(c).alias(c) for c in columns)), "word_counts")
    facts = counts.agg(F.count(F.lit(1)).alias("words"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns)).first()
    share = [F.log((F.col(c) + 1) / F.lit(float(facts[c] + facts["words"]))) for c in columns]
    weights = counts.select("word", sum((F.col(c) for c in columns), F.lit(0)).alias("n"), F.array(*share).alias("w"))
    return Model(weights, labels, [math.log(r["n"] / texts) for r in known], sum(facts[c] for c in columns))


def classify(docs: DataFrame, doc_id: str, text: str, model: Model) -> DataFrame:
    """doc_id, label, p (of the label, given the words) and n_known, the tokens that the model knows.

    Rows of one id count as one text. Unknown words are left out, so a text without known ones gets the most frequent label; of equal
    labels the first in order counts. The model's hot words are looked up by a bounded broadcast and summed with the text; the others,
    once a text with their number, meet their weights in a merge join, and their sums are combined within tasks before they travel.
    """
    size = range(len(model.labels))
    looked_up = model.weights.where(F.col("n") * (HOT // len(size)) >= model.tokens).select("word", "w").toArrow()
    hot, weights = looked_up["word"].combine_chunks(), np.array(looked_up["w"].combine_chunks().flatten()).reshape(-1, len(size))
    sums = [f"s{k}" for k in size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                codes, distinct, lengths = coded(part.column(1))
                owner = np.repeat(np.arange(part.num_rows), lengths)
                place = pc.fill_null(pc.index_in(distinct.cast(hot.type), value_set=hot), -1).to_numpy(zero_copy_only=False)[codes]
                near = place >= 0
                scores = [np.bincount(owner[near], weights[place[near], k], part.num_rows) for k in size]
                # the others, a number for each pair of a text and a word
                pair, tf = np.unique(owner[~near] * len(distinct) + codes[~near], return_counts=True)
                text, code = np.divmod(pair, max(1, len(distinct)))
                rest = pa.StructArray.from_arrays([distinct.take(pa.array(code)).cast(pa.string()), pa.array(tf, pa.int64())], ["word", "tf"])
                offsets = np.append(0, np.cumsum(np.bincount(text, minlength=part.num_rows))).astype(np.int32)
                known = np.bincount(owner[near], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, pa.float64()) for x in scores), pa.array(known, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), rest)],
                    ["doc_id", *sums, "n_known", "rest"],
                )

    found = docs.select(F.col(doc_id).alias("doc_id"), words(text).alias("words"))
    made = T.StructType([T.StructField("doc_id", found.schema["doc_id"].dataType), *(T.StructField(c, T.DoubleType()) for c in sums)])
    made = made.add("n_known", T.LongType()).add("rest", T.ArrayType(T.StructType().add("word", T.StringType()).add("tf", T.LongType())))
    texts = stash(found.mapInArrow(run, made), "texts")
    near = texts.select("doc_id", *sums, "n_known")
    rest = texts.select("doc_id", F.inline("rest")).join(model.weights.select("word", "w").hint("merge"), "word")
    far = rest.groupBy("doc_id").agg(*(F.sum(F.col("w")[k] * F.col("tf")).alias(f"s{k}") for k in size), F.sum("tf").alias("n_known"))
    both = near.unionByName(far).groupBy("doc_id").agg(*((F.sum(f"s{k}") + F.lit(model.priors[k])).alias(f"s{k}") for k in size), F.sum("n_known").alias("n_known"))
    best = F.greatest(*(F.col(f"s{k}") for k in size)) if len(size) > 1 else F.col("s0")
    label = F.coalesce(*(F.when(F.col(f"s{k}") == best, F.lit(x)) for k, x in enumerate(model.labels)))
    return both.select("doc_id", label.alias("label"), (F.lit(1.0) / sum((F.exp(F.col(f"s{k}") - best) for k in size), F.lit(0.0))).alias("p"), "n_known")
