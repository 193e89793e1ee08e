"""Lexical and dense retrieval, fusion and ranking.

Postings are (doc, term, tf); every query is a small table of terms that is broadcast, so a search reads the postings once
and shuffles only matching rows. Scores tie-break by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.similarity import coverage, dot

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60


def postings(docs: DataFrame, doc_id: str, words: Column) -> DataFrame:
    """doc, term, tf and the document's length."""
    rows = docs.select(F.col(doc_id).alias("doc"), words.alias("__w")).select("doc", F.size("__w").alias("length"), F.explode("__w").alias("term"))
    return rows.groupBy("doc", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(docs: DataFrame, words: Column) -> DataFrame:
    """term and df of the distinct words of docs, from one pass; the words never travel with their documents."""
    return docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(docs: DataFrame, words: Column) -> DataFrame:
    """term, df and idf = ln(N / df) + 1."""
    n_docs = docs.agg(F.count(F.lit(1)).alias("n"))
    return document_frequencies(docs, words).join(F.broadcast(n_docs), F.lit(True)).select("term", "df", (F.log(F.col("n") / F.col("df")) + 1).alias("idf"))


def bm25(docs: DataFrame, doc_id: str, query: Sequence[str], words: Column) -> DataFrame:
    """doc and score of every document that has a query term; repeated query terms count again.

    A negative idf is replaced by EPSILON times the mean idf over the whole vocabulary. One pass over the texts gives the
    vocabulary's frequencies, of which one row is kept; a second one scores each document where it stands, without a shuffle.
    """
    terms = list(dict.fromkeys(query))
    n_docs = docs.agg(F.count(F.lit(1)).alias("n"))
    # a document also brings one row without a term, which carries its length
    marked = F.concat(F.transform(F.array_distinct(words), lambda t: F.struct(t.alias("term"), F.lit(0).alias("length"))), F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size(words).alias("length"))))
    counted = docs.select(F.explode(marked).alias("x")).groupBy("x.term").agg(F.count(F.lit(1)).alias("df"), F.sum("x.length").alias("length"))
    raw = F.when(F.col("term").isNotNull(), F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    rated = counted.join(F.broadcast(n_docs), F.lit(True)).select("term", "n", "length", raw.alias("raw"))
    own = [F.max(F.when(F.col("term") == t, F.col("raw"))).alias(f"__idf{k}") for k, t in enumerate(terms)]
    facts = rated.agg(F.avg("raw").alias("__mean_idf"), (F.sum("length") / F.max("n")).alias("__mean_length"), *own)
    rows = docs.select(F.col(doc_id).alias("doc"), words.alias("__w")).select("doc", F.size("__w").alias("__n"), F.filter("__w", lambda w: w.isin(terms)).alias("__w")).where(F.size("__w") > 0)
    score = F.lit(0.0)
    for k, t in enumerate(terms):
        tf, idf = F.size("__w") - F.size(F.array_remove("__w", t)), F.col(f"__idf{k}")
        part = F.when(idf < 0, EPSILON * F.col("__mean_idf")).otherwise(idf) * query.count(t) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__n") / F.col("__mean_length")))
        score = score + F.coalesce(F.when(tf > 0, part), F.lit(0.0))
    return rows.join(F.broadcast(facts), F.lit(True)).select("doc", score.alias("score"))


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "doc") -> DataFrame:
    return scored.orderBy(F.col(score).desc(), key).limit(k)


def relative(scored: DataFrame, score: str = "score") -> DataFrame:
    """Scores over their maximum, which is one broadcast row."""
    top = scored.agg(F.max(score).alias("__top"))
    return scored.join(F.broadcast(top), F.lit(True)).withColumn(score, F.when(F.col("__top") > 0, F.col(score) / F.col("__top")).otherwise(0.0)).drop("__top")


def token_overlap(docs: DataFrame, doc_id: str, words: Column, query: Sequence[str]) -> DataFrame:
    """Distinct common tokens over the number of query tokens: the plain lexical score of hybrid search."""
    q = F.array(*(F.lit(t) for t in query))
    return docs.select(F.col(doc_id).alias("doc"), (F.size(F.array_intersect(F.array_distinct(words), q)) / max(1, len(query))).alias("lexical"))


def dense_scores(vectors: DataFrame, vec_id: str, vector: str, query: Sequence[float]) -> DataFrame:
    """Cosine with one query vector; 0 where a norm is 0."""
    q = F.array(*(F.lit(float(v)) for v in query))
    norm = F.sqrt(dot(vector, vector)) * F.sqrt(dot(q, q))
    return vectors.select(F.col(vec_id).alias("doc"), F.when(norm > 0, dot(vector, q) / norm).otherwise(0.0).alias("dense"))


def hybrid(dense: DataFrame, lexical: DataFrame, weight: float = 0.7) -> DataFrame:
    """Weighted sum over a full outer join; a missing side is 0."""
    both = dense.join(lexical, "doc", "full_outer")
    return both.select("doc", (weight * F.coalesce("dense", F.lit(0.0)) + (1 - weight) * F.coalesce("lexical", F.lit(0.0))).alias("score"))


def reciprocal_rank_fusion(lists: DataFrame, source: str, doc: str, score: str, k: int = RRF_K, depth: int = 1000) -> DataFrame:
    """Sum of 1 / (k + rank) over the sources that rank a document among their first `depth`.

    The limit lets every task drop all but its own first rows of a source before any meet.
    """
    rank = F.row_number().over(Window.partitionBy(source).orderBy(F.col(score).desc(), doc))
    return lists.select(doc, source, rank.alias("rank")).where(F.col("rank") <= depth).groupBy(doc).agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"), F.count_distinct(source).alias("sources"))


def rerank_fusion(rows: DataFrame, rerank: str, original: str, alpha: float = 0.65, by: Sequence[str] = ()) -> DataFrame:
    """alpha times the min-max scaled rerank score and the rest original; null where all rerank scores are equal."""
    if by:
        w = Window.partitionBy(*by)
        rows = rows.withColumn("__low", F.min(rerank).over(w)).withColumn("__high", F.max(rerank).over(w))
    else:
        # one row
        rows = rows.join(F.broadcast(rows.agg(F.min(rerank).alias("__low"), F.max(rerank).alias("__high"))), F.lit(True))
    low, high = F.col("__low"), F.col("__high")
    return rows.withColumn("final_score", F.when(high > low, alpha * (F.col(rerank) - low) / (high - low) + (1 - alpha) * F.col(original))).drop("__low", "__high")


def fallback_rerank(query: Column, words: Column, phrase: Column, distinct: bool = False) -> Column:
    """.7 word coverage and .3 for the phrase, where no model scores are given; with `distinct` no query word repeats."""
    return 0.7 * coverage(query, words, distinct) + 0.3 * phrase.cast("double")


def gap_cut(rows: DataFrame, score: str, by: Sequence[str], key: str, floor: float = 0.20, share: float = 0.40, ratio: float = 0.35, cap: int = 12) -> DataFrame:
    """Rows from the top down to the first gap: at least max(floor, share of the top), cut where a score falls below ratio of
    the one before; the top row stays in any case."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), key)
    top = F.first_value(score).over(order)
    ranked = rows.withColumn("__r", F.row_number().over(order)).withColumn("__low", F.col(score) < F.greatest(F.lit(floor), share * top)).withColumn("__gap", F.coalesce(F.col(score) / F.nullif(F.lag(score).over(order), F.lit(0.0)) < ratio, F.lit(False)))
    cut = F.max((F.col("__low") | F.col("__gap")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("__cut", cut).where(((F.col("__cut") == 0) | (F.col("__r") == 1)) & (F.col("__r") <= cap)).drop("__r", "__low", "__gap", "__cut")


def keep_scored(rows: DataFrame, score: str, by: Sequence[str], key: str, least: float = 0.3, fallback: float = 0.1) -> DataFrame:
    """Rows of a sufficient score; if none, the top row where it exceeds the fallback."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), key)
    whole = Window.partitionBy(*by)
    return rows.withColumn("__r", F.row_number().over(order)).withColumn("__top", F.max(score).over(whole)).where((F.col(score) >= least) | ((F.col("__top") < least) & (F.col("__r") == 1) & (F.col(score) > fallback))).drop("__r", "__top")


def first_score(*fields: str) -> Column:
    """The first score that is given and not 0 (a 0 falls through to the next field)."""
    return F.coalesce(*(F.nullif(F.col(f), F.lit(0.0)) for f in fields), F.lit(0.0))


def best_per_key(rows: DataFrame, key: Sequence[str], score: Column, columns: Sequence[str], tie: str) -> DataFrame:
    """The row of the largest score of each key, by partial aggregation and not by sorting all rows."""
    pick = F.max_by(F.struct(*columns), F.struct(score, (-F.col(tie)).alias("t"))).alias("__b")
    return rows.groupBy(*key).agg(pick).select(*key, *(F.col(f"__b.{c}").alias(c) for c in columns if c not in key))


def dynamic_k(base: int, words: int, parts: int = 1, multi_hop: bool = False, comparison: bool = False, low: int = 3, high: int = 30) -> int:
    """How many results a question calls for, by its length and kind."""
    k = base * (0.6 if words <= 5 else 1.4 if words > 15 else 1.0)
    k *= (1.5 if multi_hop else 1.0) * (1.6 if comparison else 1.0) * (1 + 0.2 * (parts - 1))
    return int(max(low, min(high, round(k))))


def keyword_score(text: Column, title: Column, weights: dict[str, float]) -> Column:
    """Sum of weighted occurrences, those in the title three times, with a bonus for coverage."""
    hits = [F.size(F.split(text, k)) - 1 for k in weights]
    named = [title.contains(k).cast("int") for k in weights]
    score = sum((w * (1.5 * h + 3 * t) for h, t, w in zip(hits, named, weights.values(), strict=True)), F.lit(0.0))
    covered = sum((((h > 0) | (t > 0)).cast("int") for h, t in zip(hits, named, strict=True)), F.lit(0)) / len(weights)
    return score + F.when(covered == 1, 12).when(covered >= 0.5, 6).otherwise(0)


def similar_texts(left: DataFrame, right: DataFrame, left_id: str, right_id: str, terms: str, least: float, most: int = 20_000) -> DataFrame:
    """Pairs of token sets of at least the Jaccard index, by a join on shared terms.

    A left side of at most `most` sets is counted and broadcast, so that the right one's terms stay where they are; a larger one
    is merged. Sets whose sizes rule the index out never meet, counts are made before the shuffle, and pairs without a common
    term never arise.
    """
    a = left.select(F.col(left_id).alias("a"), F.size(terms).alias("na"), F.explode(terms).alias("term"))
    b = right.select(F.col(right_id).alias("b"), F.size(terms).alias("nb"), F.explode(terms).alias("term"))
    a = F.broadcast(a) if left.count() <= most else a.hint("merge")
    sized = (F.least("na", "nb") >= least * F.greatest("na", "nb")) & (a["term"] == b["term"])
    common = b.join(a, sized).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("common"))
    return common.withColumn("jaccard", F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).where(F.col("jaccard") >= least)
