"""Entity resolution: candidates by shared words, scores by ratio and overlap, aliases, typos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.similarity import combined, edit_similarity, fuzzy, overlap_coefficient, sequence_ratio
from lodestone.functions.text import normalize, tokens


def entity_key(name: str | Column) -> Column:
    return F.lower(normalize(name))


def candidates(queries: DataFrame, entities: DataFrame, query: str, name: str) -> DataFrame:
    """Pairs that share a word, by a join on words; names without a common word score too low to matter."""
    q = queries.select(query).distinct().withColumn("__w", F.explode(F.array_distinct(tokens(entity_key(query)))))
    e = entities.select(name).distinct().withColumn("__w", F.explode(F.array_distinct(tokens(entity_key(name)))))
    return q.join(e, "__w").select(query, name).distinct()


def scored(pairs: DataFrame, query: str, name: str) -> DataFrame:
    """Pairs with the combined score of ratio, word overlap and length."""
    a, b = entity_key(query), entity_key(name)
    return pairs.withColumn("score", combined(sequence_ratio(a, b), overlap_coefficient(tokens(a), tokens(b)), a, b))


def best_matches(pairs: DataFrame, query: str, name: str, least: float = 0.6, n: int = 5) -> DataFrame:
    """The n best names of each query with their rank."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), name))
    return pairs.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= n)


def closest_by_edits(pairs: DataFrame, query: str, name: str, least: float = 0.5) -> DataFrame:
    """The name of the largest edit similarity of each query."""
    s = pairs.withColumn("score", edit_similarity(F.lower(query), F.lower(name))).where(F.col("score") >= least)
    return s.groupBy(query).agg(F.min_by(F.struct(name, "score"), F.struct(-F.col("score"), F.col(name))).alias("b")).select(query, F.col("b")[name].alias(name), F.col("b.score").alias("score"))


def ambiguity(ranked: DataFrame, query: str, high: float = 0.85, gap: float = 0.15) -> DataFrame:
    """Whether a query's best match needs asking back: not if it is high; else if the second is near or the score is middling."""
    top = ranked.groupBy(query).agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    near = F.coalesce(F.col("best") - F.col("second") < gap, F.lit(False))
    return top.withColumn("ambiguous", F.when(F.col("best") >= high, False).otherwise(near | (F.col("best") < 0.75)))


def aliases(corrections: DataFrame, wrong: str, right: str, ts: str) -> DataFrame:
    """The latest correction of each wrong name."""
    return corrections.groupBy(wrong).agg(F.max_by(right, ts).alias(right))


def resolve(names: DataFrame, name: str, alias_table: DataFrame, wrong: str, right: str) -> DataFrame:
    """Names with their alias where one is known."""
    a = alias_table.select(F.col(wrong).alias("__w"), F.col(right).alias("__r"))
    return names.join(a, F.lower(F.col(name)) == F.lower("__w"), "left").withColumn("resolved", F.coalesce("__r", name)).drop("__w", "__r")


def typos(words: DataFrame, word: str, vocab: DataFrame, term: str, freq: str, least: float = 0.4, gap: int = 3, blocks: int = 16) -> DataFrame:
    """Unknown words with the vocabulary's best suggestion: similarity times 1 + .1 min(freq, 10).

    Every unknown word is compared with every term of a length gap of at most `gap`: both meet on the length, words in blocks by hash.
    """
    unknown = words.select(word).distinct().join(vocab, F.col(word) == F.col(term), "left_anti").withColumn("__n", F.length(word)).withColumn("__b", F.pmod(F.xxhash64(word), F.lit(blocks)).cast("int"))
    lengths = F.explode(F.sequence(F.length(term) - gap, F.length(term) + gap))
    known = vocab.select(term, freq).withColumn("__n", lengths).withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = unknown.join(known, ["__n", "__b"]).select(word, term, freq)
    sim = pairs.withColumn("similarity", edit_similarity(word, term)).where(F.col("similarity") >= least)
    score = F.col("similarity") * (1 + 0.1 * F.least(F.col(freq), F.lit(10)))
    return sim.withColumn("score", score).groupBy(word).agg(F.min_by(F.struct(term, "score"), F.struct(-F.col("score"), F.col(term))).alias("b")).select(word, F.col(f"b.{term}").alias("suggestion"), F.col("b.score").alias("score"))


def fuzzy_best(pairs: DataFrame, query: str, name: str, least: float = 0.6) -> DataFrame:
    """The best name of each query by ratio, containment and overlap."""
    s = pairs.withColumn("score", fuzzy(query, name)).where(F.col("score") >= least)
    return s.groupBy(query).agg(F.min_by(F.struct(name, "score"), F.struct(-F.col("score"), F.col(name))).alias("b")).select(query, F.col("b")[name].alias(name), F.col("b.score").alias("score"))
