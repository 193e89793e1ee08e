"""Correction of whole questions: suggestions for each unknown word form a lattice, and the words around decide between them.

A word is unknown when the corpus lacks it. Suggestions come from the corpus's most frequent terms (`most` of them, a bounded
table), scored by the likeness of letters, of sounds and of keys side by side. The best path through a question's lattice has
the largest sum of the logarithms of its suggestions' scores and of 1 + n for each pair of neighbours that the corpus has n times.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}]+"
#: Fixed: letters that sound alike, each with the one it is compared as.
SOUNDS_FROM, SOUNDS_TO = "اآهحتطزذظضسصثوؤ", "آاحهطتذزززصسسؤو"
#: Fixed: keys side by side.
KEYS = {"ط": "ظک", "ک": "گقط", "ل": "مک", "ا": "آء"}
KEY_BONUS = 0.3
_SOUNDS = str.maketrans(SOUNDS_FROM, SOUNDS_TO)


def typo_score(a: str, b: str) -> float:
    """The largest of letters, sounds, and .6 letters + .4 sounds + a bonus where one letter differs by a neighbouring key."""
    letters, sounds = SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, a.translate(_SOUNDS), b.translate(_SOUNDS)).ratio()
    wrong = [(x, y) for x, y in zip(a, b, strict=False) if x != y] if len(a) == len(b) else []
    bonus = KEY_BONUS if len(wrong) == 1 and wrong[0][1] in KEYS.get(wrong[0][0], "") else 0.0
    return max(0.6 * letters + 0.4 * sounds + bonus, letters, sounds)


@F.pandas_udf(T.DoubleType())
def typo_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """typo_score of two columns, for which no built-in expression exists."""
    return pd.Series([None if x is None or y is None else typo_score(x, y) for x, y in zip(a, b, strict=True)])


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"))


def term_counts(corpus: DataFrame, text: str) -> DataFrame:
    """term and freq of the corpus."""
    return corpus.select(F.explode(words_of(text)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def pair_counts(corpus: DataFrame, text: str) -> DataFrame:
    """first, second and n of the neighbours within each text."""
    w = corpus.select(words_of(text).alias("w")).where(F.size("w") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.element_at("w", i).alias("first"), F.element_at("w", i + 1).alias("second")))
    return w.select(F.inline(pairs)).groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))


def suggestions(words: DataFrame, word: str, terms: DataFrame, least: float = 0.4, gap: int = 3, most: int = 100, n: int = 5, shortest: int = 3, stopwords: Sequence[str] = ()) -> DataFrame:
    """word, term, similarity, freq, score and rank: the n best of the `most` most frequent terms for each word that terms lack.

    Words shorter than `shortest` and stopwords are never unknown. The score is similarity * (1 + .1 min(freq, 10)); ties go to the
    smaller term.
    """
    asked = words.select(F.col(word).alias("word")).distinct().where(F.length("word") >= shortest)
    if stopwords:
        asked = asked.where(~F.col("word").isin(list(stopwords)))
    unknown = asked.join(terms, asked["word"] == terms["term"], "left_anti")
    common = terms.where(F.length("term") >= shortest).orderBy(F.desc("freq"), "term").limit(most)
    near = F.abs(F.length("word") - F.length("term")) <= gap
    pairs = unknown.join(F.broadcast(common), near).withColumn("similarity", typo_similarity("word", "term")).where(F.col("similarity") >= least)
    score = F.col("similarity") * (1 + 0.1 * F.least(F.col("freq"), F.lit(10)))
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "term"))
    return pairs.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= n)


def worst_typo(questions: DataFrame, question_id: str, text: str, found: DataFrame) -> DataFrame:
    """For each question with one, the unknown word whose best suggestion has the largest similarity * ln(1 + freq)."""
    best = found.where("rank = 1").select("word", F.col("term").alias("suggestion"), "similarity", (F.col("similarity") * F.log1p("freq")).alias("weight"))
    rows = questions.select(F.col(question_id).alias("id"), F.posexplode(words_of(text)).alias("at", "word")).join(best, "word")
    pick = rows.groupBy("id").agg(F.min_by(F.struct("word", "suggestion", "similarity"), F.struct(-F.col("weight"), F.col("at"))).alias("m"))
    return pick.select(F.col("id").alias(question_id), "m.*")


def corrected(questions: DataFrame, question_id: str, text: str, terms: DataFrame, pairs: DataFrame, **options) -> DataFrame:
    """question_id, corrected and changes (place from 0, word, suggestion): every question, with unknown words replaced by the best path.

    terms and pairs are those of term_counts and pair_counts; options go to suggestions. Of equal paths the one whose words are
    larger in reverse order wins. A word without a suggestion stays; what is between words stays as it is; a null text stays null.
    Ids are distinct.
    """
    rows = questions.select(F.col(question_id).alias("id"), F.col(text).alias("text"))
    at = rows.select("id", F.posexplode(words_of("text")).alias("at", "word"))
    found = suggestions(at, "word", terms, **options)
    choices = found.groupBy("word").agg(F.array_sort(F.collect_list(F.struct(F.col("term").alias("w"), F.log("score").alias("s")))).alias("choices"))
    own = F.array(F.struct(F.col("word").alias("w"), F.lit(0.0).alias("s")))
    lattice = at.join(choices, "word", "left").select("id", "at", "word", F.coalesce("choices", own).alias("choices"), F.col("choices").isNotNull().alias("open"))

    after = Window.partitionBy("id").orderBy("at")
    steps = lattice.withColumn("before", F.lag("choices").over(after)).withColumn("open_before", F.lag("open").over(after))
    # neighbours count only where there is a choice
    asked = steps.where("before is not null and (open or open_before)").select("id", "at", F.explode("before.w").alias("first"), F.col("choices.w").alias("seconds"))
    asked = asked.select("id", "at", "first", F.explode("seconds").alias("second"))
    counted = asked.join(pairs, ["first", "second"]).groupBy("id", "at").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "first", "second"), F.log1p("n")))).alias("joins"))
    steps = lattice.join(counted, ["id", "at"], "left")
    path = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "word", "choices", "open", "joins")), lambda a, b: a["at"] - b["at"]).alias("steps"))

    def extend(state: Column, step: Column) -> Column:
        def best(c: Column) -> Column:
            met = lambda s: F.coalesce(F.element_at(step["joins"], F.concat_ws(" ", s["words"][0], c["w"])), F.lit(0.0))
            ways = F.transform(state, lambda s: F.struct((s["score"] + met(s) + c["s"]).alias("score"), F.concat(F.array(c["w"]), s["words"]).alias("words")))
            return F.array_max(ways)

        return F.transform(step["choices"], best)

    start = F.transform(F.element_at("steps", 1)["choices"], lambda c: F.struct(c["s"].alias("score"), F.array(c["w"]).alias("words")))
    ends = F.aggregate(F.slice("steps", 2, F.greatest(F.lit(1), F.size("steps"))), start, extend)
    decoded = path.select("id", "steps", F.reverse(F.array_max(ends)["words"]).alias("best"))
    changes = F.filter(F.zip_with("steps", "best", lambda s, w: F.struct(s["at"].alias("at"), s["word"].alias("word"), w.alias("suggestion"), s["open"].alias("open"))), lambda c: c["open"])
    decoded = decoded.select("id", "best", F.transform("steps", lambda s: s["open"]).alias("open"), F.transform(changes, lambda c: F.struct(c["at"], c["word"], c["suggestion"])).alias("changes"))
    whole, gaps = F.regexp_extract_all("text", F.lit(f"({WORD})")), F.split("text", WORD)
    new = F.zip_with(F.arrays_zip(whole.alias("w"), F.col("open").alias("o")), "best", lambda x, b: F.when(x["o"], b).otherwise(x["w"]))
    text_of = F.when(F.size("changes") > 0, F.array_join(F.flatten(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda g, w: F.array(g, w))), "")).otherwise(F.col("text"))
    none = F.array().cast("array<struct<at:int,word:string,suggestion:string>>")
    return rows.join(decoded, "id", "left").select(F.col("id").alias(question_id), F.when(F.col("best").isNull(), F.col("text")).otherwise(text_of).alias("corrected"), F.coalesce("changes", none).alias("changes"))
