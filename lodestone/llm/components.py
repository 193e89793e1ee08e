"""Connected components of links by alternating large-star and small-star steps; ids and links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import release, stash


def stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u; then each v is the smallest id of its component. Edges are distinct, with u > v."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """id and component_id (smallest id reachable) of every id in links (two long columns); loops and repeats are fine.

    Each step joins links with the smallest neighbour of their node, which is one row a node, so a node of very many
    links is split by adaptive execution; the steps end when the links are stars, which no step changes, after about log(n)
    rounds.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    edges = stash(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while not stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        shorter = stash(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        release(edges)
        edges = shorter
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
