"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Every row is hashed; equal rows are merged three times: within the map task (Spark's partial aggregation), within a
salted digest group, and across the salt winners. Each merge groups by the digest and by the whole normalised text, so
two texts are one group only when their contents are equal. A digest that a third of all rows share thus reaches the
second shuffle as at most `salts` rows. The winners are then joined back to the ids by digest; adaptive execution splits
a hot digest there, since each digest has one winner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import id_text

WHITE = r"[\x20\x09-\x0D]+"
STEP = "100000000000000000000BD"  # more than two longs apart
LAST = "9223372036854775808BD"  # so that every id gives a positive rank
SALTS = 8


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after all white space of WHITE is deleted; null counts as empty, so null,
    empty and blank texts form one group. The row with the most code points in its original text stays, ties go to the
    smallest id. Rows repeated with the same id are counted each and all marked kept if their id stays. A null id loses
    every tie with an id and gets keep_id null only if its whole group has null ids. An empty table gives no rows.
    Other columns of docs are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = (
        id_text(docs, id_col, text_col)
        .select("doc_id", F.length(text).alias("n"), F.regexp_replace(text, WHITE, "").alias("norm"))
        .select("doc_id", "n", "norm", F.sha2("norm", 256).alias("digest"))
    )
    # length first, then the smaller id, as one number that the hash aggregation can update in place; a null id adds 0
    best = F.expr(f"cast(cast(n as decimal(12,0)) * {STEP} + coalesce({LAST} - cast(doc_id as decimal(19,0)), 0BD) as decimal(38,0))")
    local = (
        rows.select("digest", "norm", best.alias("best"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
        .groupBy("digest", "salt", "norm")
        .agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("size"))
    )
    winners = local.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("size").alias("group_size"))
    winners = winners.select("digest", "group_size", F.expr(f"cast({LAST} - nullif(best % {STEP}, 0BD) as long)").alias("keep_id"))
    return rows.select("doc_id", "digest").join(winners, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )
