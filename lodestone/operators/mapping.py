"""What columns hold, by sketches of their values, and which columns of two tables hold the same."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: the classes of written values, the first that fits
CLASSES = {
    "integer": r"^[+-]?[0-9]+$",
    "decimal": r"^[+-]?[0-9]*\.[0-9]+(?:[eE][+-]?[0-9]+)?$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9:.]+)?$",
    "address": r"^[^@ ]+@[^@ ]+\.[^@ ]+$",
    "code": r"^[A-Za-z0-9_#-]*[0-9][A-Za-z0-9_#-]*$",
    "word": r"^[^ ]+$",
}
#: minima kept for each column, one for each value of a hash's first two hexadecimal digits
SLOTS = 256


def column_slots(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, slot, n, mark and sums of each slot of each column: the one pass over the table.

    A value falls into a slot by the first two digits of its MD5; `mark` is the least of the further digits in the slot. Sums are
    added before the shuffle, so each task sends at most 256 rows a column, whatever the values and however frequent one is.
    Values are compared as text; null and empty ones have no slot and are left out, as are columns that hold no others.
    """
    columns = list(columns or rows.columns)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.trim(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns)))
    held = rows.select(cells.alias("c")).select("c.*").where("value <> ''").withColumn("md5", F.md5("value"))
    kind = F.coalesce(*(F.when(F.col("value").rlike(p), k) for k, p in CLASSES.items()), F.when(F.length("value") > 100, "long").otherwise("phrase"))
    year = r"^(?:1[34][0-9]{2}|[89][0-9]|0[0-4])$"
    held = held.withColumn("kind", kind)
    return held.groupBy("column", F.substring("md5", 1, 2).alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.substring("md5", 3, 14)).alias("mark"), F.sum(F.length("value").cast("long")).alias("length"),
        F.count_if(F.col("value").try_cast("double").isNotNull()).alias("numbers"), F.count_if(F.col("value").rlike(r"[?؟]|چیست|چگونه|چرا|کجا|کدام")).alias("questions"),
        F.count_if(F.col("value").rlike(year)).alias("years"), F.count_if(F.col("value").rlike(r"^[0-9]{2,10}$|^[A-Za-z0-9_-]+$")).alias("codes"),
        *(F.count_if(F.col("kind") == k).alias(f"is_{k}") for k in [*CLASSES, "phrase", "long"]),
    )


def content_roles(slots: DataFrame) -> DataFrame:
    """column, n, mean_length, role and confidence of each column by all of its values.

    numeric (.7) above 80 % numbers; answer (.6) above a mean length of 100; question (.7) where a value asks; year (.8) from half of
    the values on; code (.7) for short values of which 70 % read as one; else unknown (.3).
    """
    sums = slots.groupBy("column").agg(*(F.sum(c).alias(c) for c in ("n", "length", "numbers", "questions", "years", "codes")))
    rows = sums.withColumn("mean_length", F.col("length") / F.col("n"))
    role = F.when(F.col("numbers") > 0.8 * F.col("n"), "numeric").when(F.col("mean_length") > 100, "answer").when(F.col("questions") > 0, "question").when(F.col("years") >= 0.5 * F.col("n"), "year")
    role = role.when((F.col("mean_length") <= 30) & (F.col("codes") >= 0.7 * F.col("n")), "code").otherwise("unknown")
    trust = F.when(role == "answer", 0.6).when(role == "year", 0.8).when(role == "unknown", 0.3).otherwise(0.7)
    return rows.select("column", "n", "mean_length", role.alias("role"), trust.alias("confidence"))


def column_matches(left: DataFrame, right: DataFrame, least: float = 0.3) -> DataFrame:
    """left_column, right_column, overlap, shapes and score of the pairs of columns with a score of at least `least`.

    `left` and `right` are slots of two tables. Overlap is the share of equal marks among the slots that either column fills, an
    estimate of the Jaccard index of their distinct values (exact where both hold one value a slot); shapes is the common share of
    the classes; score = .7 overlap + .3 shapes. The inputs have at most 256 rows a column, so what is joined grows with the
    number of columns only.
    """
    kinds = [*CLASSES, "phrase", "long"]

    def shares(slots: DataFrame, side: str) -> DataFrame:
        sums = slots.groupBy(F.col("column").alias(f"{side}_column")).agg(F.count(F.lit(1)).alias(f"{side}_slots"), F.sum("n").alias("n"), *(F.sum(f"is_{k}").alias(k) for k in kinds))
        return sums.select(f"{side}_column", f"{side}_slots", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), (F.col(k) / F.col("n")).alias(f"{side}_share")) for k in kinds))).alias("k")).select(
            f"{side}_column", f"{side}_slots", "k.*"
        )

    keys = ["left_column", "right_column"]
    common = F.least("left_share", "right_share")
    pairs = shares(left, "left").join(shares(right, "right"), "kind").groupBy(*keys, "left_slots", "right_slots").agg(F.sum(common).alias("shapes"))
    a = left.select(F.col("column").alias("left_column"), "slot", "mark")
    b = right.select(F.col("column").alias("right_column"), "slot", F.col("mark").alias("other"))
    met = a.join(b, "slot").groupBy(*keys).agg(F.count(F.lit(1)).alias("both"), F.count_if(F.col("mark") == F.col("other")).alias("same"))
    both = F.coalesce("both", F.lit(0))
    out = pairs.join(met, keys, "left").withColumn("overlap", F.coalesce("same", F.lit(0)) / (F.col("left_slots") + F.col("right_slots") - both))
    return out.withColumn("score", 0.7 * F.col("overlap") + 0.3 * F.col("shapes")).where(F.col("score") >= least).select(*keys, "overlap", "shapes", "score")


def assign(matches: DataFrame) -> dict[str, tuple[str, float]]:
    """Each left column's right one and their score: the best pair first, then the best of the columns that are left.

    Equal scores go by name. What comes to the driver is a row for each pair of columns of two tables.
    """
    out: dict[str, tuple[str, float]] = {}
    taken: set[str] = set()
    for r in matches.orderBy(F.desc(F.round("score", 9)), "left_column", "right_column").collect():
        if r["left_column"] not in out and r["right_column"] not in taken:
            out[r["left_column"]] = (r["right_column"], r["score"])
            taken.add(r["right_column"])
    return out


def renamed(rows: DataFrame, mapping: Mapping[str, tuple[str, float]], sure: float = 0.5) -> DataFrame:
    """The rows with the names that a mapping of at least this score gives; other columns keep theirs."""
    return rows.withColumnsRenamed({a: b for a, (b, score) in mapping.items() if score >= sure})
