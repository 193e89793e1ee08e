"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import release, shared_dir, stash, tidy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_join(rows: DataFrame, lookup: DataFrame, keys: list[str], copies: str, share: int = 1000, written: bool = False) -> DataFrame:
    """rows with the columns of lookup, which has one row a key and in `copies` how many rows have it.

    A key of one in `share` rows or more is looked up by broadcast, since there are at most `share` of them; the others are
    merged. So no task gets all rows of a hot key, whatever adaptive execution makes of it. Where lookup is a written copy, its
    rows are counted instead, so that rows are not worked out for that, and a join that no key needs is left out.
    """
    if written:
        total, least, most = lookup.agg(F.sum(copies), F.min(copies), F.max(copies)).first()
    else:
        total, least, most = rows.count(), None, None
    limit = max(1, (total or 0) // share)
    hot, rest = lookup.where(F.col(copies) >= limit).drop(copies), lookup.where(F.col(copies) < limit).drop(copies)
    if least is not None and least >= limit:
        return rows.join(F.broadcast(hot), keys)
    if most is not None and most < limit:
        return rows.join(rest, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that other columns of docs can bear any name."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def hashed_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most so many rows, those of the smallest hash of key; a threshold first keeps what each task sends small."""
    total = df.count()
    place = F.pmod(F.xxhash64(key), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return df.withColumn("place", place).where(F.col("place") <= min(1.0, (1.5 * rows + 100) / max(1, total))).orderBy("place", key).limit(rows).drop("place")


__all__ = ["F", "hashed_sample", "hot_join", "id_text", "release", "shared_dir", "stash", "table", "tidy"]
