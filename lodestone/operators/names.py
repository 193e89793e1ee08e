"""Names that resemble each other, found completely and without comparing all pairs.

Edits and the best names by ratio are found in pairs of blocks, where arrays of bounds leave few pairs to compare (name_blocks).
The other measures have an index whose keys two names share whenever the measure reaches its threshold, so candidates come from
an equi-join and only they are compared:

- ratio: blocks that difflib matches hold the same characters, so a ratio of r takes r * (m + n) / 2 characters in common
  (each with its number among its like); of sets with that overlap the rarest members share `share` of them;
- containment: all runs of eight characters of the inner name are in the outer one, so its rarest one is;
- words: a common word is a key itself; for a Jaccard index one of the rarest words is common.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.similarity import combined, jaccard, overlap_coefficient, sequence_ratio
from lodestone.functions.text import tokens
from lodestone.operators.entities import entity_key
from lodestone.operators.name_blocks import nearest_by_ratio, pairs_within_edits


def _sides(left: DataFrame, right: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    return left.select(F.col(a).alias("a")).dropna().distinct(), right.select(F.col(b).alias("b")).dropna().distinct()


def _joined(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.hint("merge"), "key").select("a", "b").distinct()


def within_edits(left: DataFrame, right: DataFrame, a: str, b: str, k: int = 2) -> DataFrame:
    """a, b and edits of all pairs of distinct non-null names with at most k edits."""
    x, y = _sides(left, right, a, b)
    edits = F.levenshtein("a", "b", k)
    return pairs_within_edits(x, y, k).select("a", "b", edits.alias("edits")).where("edits >= 0")


def _numbered(name: str) -> Column:
    """The characters of a name, each with its number among its like before it."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i), lambda d: d == c)).cast("string")))


def within_ratio(left: DataFrame, right: DataFrame, a: str, b: str, least: float = 0.8, share: int = 2) -> DataFrame:
    """a, b and ratio (difflib's) of all pairs of distinct non-null names whose ratio is at least `least`.

    share (1 or 2) is how many rare characters make a key: two mean more keys, and fewer names that meet by chance.
    """
    x, y = _sides(left, right, a, b)
    x, y = x.withColumn("chars", _numbered("a")), y.withColumn("chars", _numbered("b"))
    known = x.select(F.explode("chars").alias("c")).unionAll(y.select(F.explode("chars").alias("c"))).groupBy("c").agg(F.count(F.lit(1)).alias("f"))

    def keyed(side: DataFrame, name: str) -> DataFrame:
        n = F.length(name)
        # of names this long and longer than their shortest partner, at least so many characters are common
        partner = F.ceil(F.round(n * least / (2 - least), 9))
        common = F.ceil(F.round((n + partner) * least / 2, 9))
        rare = side.select(name, F.explode("chars").alias("c")).join(known, "c").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("f", "c"))).alias("r"))
        first = lambda s: F.transform(F.slice("r", 1, F.greatest(F.lit(1), F.least(n, n - common + s)).cast("int")), lambda v: v["c"])
        pairs = F.flatten(F.transform(first(2), lambda c, i: F.transform(F.slice(first(2), i + 2, F.size(first(2))), lambda d: F.concat_ws("\0", c, d))))
        # names so short that one common character may do
        single = n <= math.floor(2 / least)
        keys = first(1) if share == 1 else F.when(single, F.concat(first(1), pairs)).otherwise(pairs)
        return rare.select(name, F.explode(keys).alias("key"))

    found = _joined(keyed(x, "a"), keyed(y, "b")).join(x, "a").withColumnRenamed("chars", "ca").join(y, "b")
    both = F.length("a") + F.length("b")
    found = found.where(2 * F.size(F.array_intersect("ca", "chars")) >= F.round(least * both, 9)).select("a", "b")
    # empty names have no characters; two of them are alike
    empty = x.where("a = ''").select("a").join(y.where("b = ''").select("b"))
    return found.unionByName(empty).withColumn("ratio", sequence_ratio("a", "b")).where(F.col("ratio") >= least)


#: inner names are sought by runs of so many characters, shorter ones by their whole
RUN = 8


def _grams(name: str, size: int = RUN) -> Column:
    """All runs of so many characters; of shorter names the whole."""
    n = F.length(name)
    return F.when(n <= size, F.array(F.col(name))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1)), lambda i: F.substring(name, i, F.lit(size)))))


def containing(inner: DataFrame, outer: DataFrame, a: str, b: str) -> DataFrame:
    """a and b of all pairs of distinct non-null names of which b contains a; the empty name is in none but itself."""
    x, y = _sides(inner, outer, a, b)
    # the outer names' runs are made for the lengths that the inner ones ask for, at most eight numbers
    sizes = sorted({max(1, r["n"]) for r in x.select(F.least(F.length("a"), F.lit(RUN)).alias("n")).distinct().collect()}) or [1]
    grams = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("b") - size + 1)), lambda i: F.substring("b", i, F.lit(size)))
    y = y.select("b", F.explode(F.array_distinct(F.concat(*(grams(s) for s in sizes)))).alias("key"))
    known = y.groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    parts = x.select("a", _grams("a").alias("g")).select("a", F.size("g").alias("n"), F.explode("g").alias("key")).join(known, "key")
    # a name is in another only if all its parts are known
    rarest = parts.groupBy("a", "n").agg(F.count(F.lit(1)).alias("m"), F.min_by("key", F.struct("f", "key")).alias("key")).where("n = m")
    return rarest.select("a", "key").join(y, "key").where(F.col("b").contains(F.col("a")) & ((F.length("a") > 0) | (F.length("b") == 0))).select("a", "b").distinct()


def sharing_words(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    x, y = _sides(left, right, a, b)
    words = lambda c: F.explode(F.array_distinct(tokens(F.col(c)))).alias("key")
    return _joined(x.select("a", words("a")), y.select("b", words("b")))


def alike_by_words(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """a and b of all pairs with a common word whose words' Jaccard index is at least `least`.

    A set of s words has ceil(least * s) of them in common with its partner, so one of its s - ceil(least * s) + 1 rarest is, and
    a word that many names bear is a key of those only that have no rarer one.
    """
    x, y = _sides(left, right, a, b)
    words = lambda side, name: side.select(name, F.explode(F.array_distinct(tokens(F.col(name)))).alias("w"))
    known = words(x, "a").select("w").unionAll(words(y, "b").select("w")).groupBy("w").agg(F.count(F.lit(1)).alias("f"))

    def keyed(side: DataFrame, name: str) -> DataFrame:
        rare = words(side, name).join(known, "w").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("r"))
        first = F.slice("r", F.lit(1), (F.size("r") - F.ceil(F.round(F.size("r") * least, 9)) + 1).cast("int"))
        return rare.select(name, F.explode(F.transform(first, lambda v: v["w"])).alias("key"))

    return _joined(keyed(x, "a"), keyed(y, "b")).where(jaccard(F.split("a", r"\s+"), F.split("b", r"\s+")) >= least)


def _keyed_names(rows: DataFrame, name: str, key: str) -> DataFrame:
    return rows.select(F.col(name).alias(f"{key}_name")).dropna().distinct().withColumn(key, entity_key(f"{key}_name"))


def _best(pairs: DataFrame, query: str, name: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("x_name").orderBy(F.col("score").desc(), "y_name"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("x_name").alias(query), F.col("y_name").alias(name), "score", "rank")


def similar_names(queries: DataFrame, names: DataFrame, query: str, name: str, least: float = 0.7, n: int = 10) -> DataFrame:
    """The n best names of each query: query, name, score, rank; nulls have none, ties go to the smaller name.

    The first tier that holds gives the score: equal 1; the query within the name .85 and .1 of the share of its length; the name
    within the query .8 and .1 likewise; words whose Jaccard is at least `least` .7 and .15 of it; a ratio of at least `least`
    .6 and .15 of it. Equal to a comparison of all pairs.
    """
    x, y = _keyed_names(queries, query, "x"), _keyed_names(names, name, "y")
    held = containing(x, y, "x", "y").select(F.col("a").alias("x"), F.col("b").alias("y"))
    holds = containing(y, x, "y", "x").select(F.col("b").alias("x"), F.col("a").alias("y"))
    words = alike_by_words(x, y, "x", "y", least).select(F.col("a").alias("x"), F.col("b").alias("y"))
    # any other tier gives more than a ratio can, so only the n best by ratio may be among the n best
    sides = x.select(F.col("x").alias("a")).distinct(), y.groupBy(F.col("y").alias("b")).agg(F.min("y_name").alias("first"))
    near = nearest_by_ratio(*sides, least, n).select(F.col("a").alias("x"), F.col("b").alias("y"), "ratio")
    pairs = held.unionByName(holds).unionByName(words).withColumn("ratio", F.lit(None).cast("double")).unionByName(near).groupBy("x", "y").agg(F.max("ratio").alias("ratio"))
    nx, ny, j = F.length("x"), F.length("y"), jaccard(F.split("x", r"\s+"), F.split("y", r"\s+"))
    score = (
        F.when(F.col("x") == F.col("y"), 1.0).when(F.col("y").contains(F.col("x")), 0.85 + 0.1 * nx / ny).when(F.col("x").contains(F.col("y")), 0.8 + 0.1 * ny / nx)
        .when(j >= least, 0.7 + 0.15 * j).otherwise(0.6 + 0.15 * F.col("ratio"))
    )
    return _best(pairs.withColumn("score", score).join(x, "x").join(y, "y"), query, name, n)


def entity_candidates(queries: DataFrame, names: DataFrame, query: str, name: str, least: float = 0.5, n: int = 5) -> DataFrame:
    """The n best names of each query by the combined score of ratio, word overlap and lengths, equal to a comparison of all pairs.

    Without a common word a score of `least` takes a ratio of (least - .1) / .5, so such pairs come from the index of ratios,
    and all others from their words.
    """
    x, y = _keyed_names(queries, query, "x"), _keyed_names(names, name, "y")
    alone = (least - 0.1) / 0.5
    if not 0 < alone <= 1:
        raise ValueError("least is to be above .1 and at most .6")
    pairs = sharing_words(x, y, "x", "y").unionByName(within_ratio(x, y, "x", "y", alone).select("a", "b")).distinct().select(F.col("a").alias("x"), F.col("b").alias("y"))
    score = combined(sequence_ratio("x", "y"), overlap_coefficient(tokens(F.col("x")), tokens(F.col("y"))), "x", "y")
    return _best(pairs.withColumn("score", score).where(F.col("score") >= least).join(x, "x").join(y, "y"), query, name, n)


def guarded_match(queries: DataFrame, names: DataFrame, query: str, name: str, types: list[str], least: float = 0.6, stop: tuple[str, ...] = ()) -> DataFrame:
    """The best name of each query that has one: query, name, ratio, overlap, score = .4 ratio + .6 overlap (of the query's words).

    A query that names a kind of body (one of types) only meets names with a common one. Queries of one or two words need a
    ratio of .75 and an overlap of .7, others `least` and half of the words; below a ratio of .75 the overlap must be .8. The best
    score must reach .6. A common word is needed throughout, so the pairs with one are all there are.
    """
    x, y = _keyed_names(queries, query, "x"), _keyed_names(names, name, "y")
    words = lambda c: F.array_except(F.array_distinct(F.split(F.trim(c), r"\s+")), F.array(*(F.lit(s) for s in stop)).cast("array<string>"))
    pairs = sharing_words(x, y, "x", "y").select(F.col("a").alias("x"), F.col("b").alias("y")).withColumn("wx", words("x")).withColumn("wy", words("y"))
    named = F.array_intersect("wx", F.array(*(F.lit(t) for t in types)).cast("array<string>"))
    overlap = F.size(F.array_intersect("wx", "wy")) / F.size("wx")
    pairs = pairs.where(F.size("wx") > 0).where((F.size(named) == 0) | (F.size(F.array_intersect(named, "wy")) > 0)).withColumn("overlap", overlap)
    brief = F.size("wx") <= 2
    pairs = pairs.where((F.col("overlap") >= 0.5) & (~brief | (F.col("overlap") >= 0.7))).withColumn("ratio", sequence_ratio("x", "y"))
    limit = F.when(brief, F.greatest(F.lit(0.75), F.lit(least))).otherwise(least)
    pairs = pairs.where((F.col("ratio") >= limit) & ((F.col("ratio") >= 0.75) | (F.col("overlap") >= 0.8))).withColumn("score", 0.4 * F.col("ratio") + 0.6 * F.col("overlap"))
    best = pairs.where("score >= 0.6").join(x, "x").join(y, "y").groupBy("x_name").agg(F.min_by(F.struct("y_name", "ratio", "overlap", "score"), F.struct(-F.col("score"), F.col("y_name"))).alias("m"))
    return best.select(F.col("x_name").alias(query), F.col("m.y_name").alias(name), "m.ratio", "m.overlap", "m.score")
