"""Ordered funnels over event rows, all funnels advanced together by a frontier that the definition rows drive.

Every time at which a client has events is a position, and what comes next after a position depends on the position alone.
So the attempts of a funnel that stand at one position are one row with a count, and each round joins those rows with the
definition of their next step, looks the step's successor up and keeps the survivors, whose rows are written before the
next round starts.

Successors are found in buckets of two widths, so that no group grows beyond a constant: a fine bucket holds at most its
width in microseconds times the kinds of distinct events, a coarse bucket holds at most two coarse widths of fine buckets.
A successor lies in the position's fine bucket, or is the first of a later fine bucket of this coarse bucket or the next,
because a coarse bucket is at least as wide as the time that a step may take. Percentiles are chosen by digits: a
histogram over the upper bits of the times, then the exact times of the one bin that holds the rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import release, stash, tidy

FINE_SHARE = 5 / 8  # of the bits of a coarse bucket
BIN_BITS = 16


@dataclass(frozen=True)
class Funnel:
    """Kinds in their order, and the kinds whose rows end an attempt."""

    name: str
    steps: tuple[str, ...]
    excluded: tuple[str, ...] = ()


FUNNELS = (
    Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
    Funnel("B", ("signup", "view", "click", "purchase"), ("error",)),
    Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
)


def micros(ts: str, zoned: bool) -> Column:
    """Microseconds since 1970; a time without a zone is taken as it stands, whatever the session's zone."""
    if zoned:
        return F.unix_micros(ts)
    days = F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + (F.expr(f"extract(second from `{ts}`)") * 1_000_000).cast("long")


def free_shuffles(spark: SparkSession) -> None:
    """Delete the shuffle files of finished steps; Spark holds on to the last query's plan until another one has run."""
    spark.range(1).selectExpr("id + 1").collect()
    tidy(spark)


def successors(events: DataFrame, kinds: Sequence[str], within: int) -> tuple[DataFrame, DataFrame]:
    """client_id, t, kinds (of the events at t) and nexts (kind and time of each kind's next event, at most `within` later).

    events has client_id, kind and t in microseconds, without nulls; rows may repeat. The second frame is the written copy that
    the first one reads, to be released when that is written, too.
    """
    coarse_bits = max(8, (within - 1).bit_length())
    fine_bits = int(coarse_bits * FINE_SHARE)
    names = range(len(kinds))
    rows = events.where(F.col("kind").isin(*kinds)).withColumn("fine", F.shiftright("t", fine_bits)).repartition("client_id", "fine")
    at = rows.groupBy("client_id", "fine", "t").agg(*(F.max(F.col("kind") == F.lit(k)).alias(f"at{i}") for i, k in enumerate(kinds)))
    time_of = [F.when(F.col(f"at{i}"), F.col("t")) for i in names]

    later = Window.partitionBy("client_id", "fine").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    near = at.select("*", *(F.min(time_of[i]).over(later).alias(f"near{i}") for i in names))

    coarse = F.shiftright("fine", coarse_bits - fine_bits)
    first = at.groupBy("client_id", "fine").agg(*(F.min(time_of[i]).alias(f"first{i}") for i in names))
    # every fine bucket shows itself to its own coarse bucket and to the one before
    shown = first.withColumn("back", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("coarse", coarse - F.col("back"))
    beyond = Window.partitionBy("client_id", "coarse").orderBy(F.desc("fine")).rowsBetween(Window.unboundedPreceding, -1)
    far = shown.select("client_id", "fine", "back", *(F.min(f"first{i}").over(beyond).alias(f"far{i}") for i in names)).where("back = 0")
    # only what some position of the fine bucket can reach travels back; the way there is freed before
    end = F.shiftleft(F.col("fine") + 1, fine_bits) + within
    far = far.select("client_id", "fine", *(F.when(F.col(f"far{i}") < end, F.col(f"far{i}")).alias(f"far{i}") for i in names))
    far = stash(far.where(F.coalesce(*(f"far{i}" for i in names)).isNotNull()), "far")
    free_shuffles(events.sparkSession)

    both = near.join(far.hint("merge"), ["client_id", "fine"], "left")
    found = [F.coalesce(f"near{i}", f"far{i}") for i in names]
    nexts = F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), found[i].alias("t")) for i, k in enumerate(kinds))), lambda s: s["t"] <= F.col("t") + within)
    here = F.array_compact(F.array(*(F.when(F.col(f"at{i}"), F.lit(k)) for i, k in enumerate(kinds))))
    return both.select("client_id", "t", here.alias("kinds"), nexts.alias("nexts")), far


def advance(standing: DataFrame) -> DataFrame:
    """Attempts that reach their next step: funnel, client_id, t of that step, took, n.

    standing has funnel, client_id, t, n, want, excluded and nexts. Of the wanted and the excluded successors the earliest
    decides, an excluded one before a wanted one of the same time.
    """
    seen = standing.select("funnel", "client_id", "t", "n", "want", "excluded", F.explode("nexts").alias("s"))
    wanted = F.col("s.kind") == F.col("want")
    seen = seen.where(wanted | F.array_contains("excluded", F.col("s.kind")))
    # a kind that is wanted and excluded at once ends the attempt
    free = wanted & ~F.array_contains("excluded", F.col("s.kind"))
    took = F.col("s.t") - F.col("t")
    best = seen.select("funnel", "client_id", "t", "n", took.alias("took"), free.alias("free"), (took * 2 + free.cast("long")).alias("o"))
    best = best.groupBy("funnel", "client_id", "t", "n").agg(F.min_by("took", "o").alias("took"), F.min_by("free", "o").alias("free"))
    return best.where("free").select("funnel", "client_id", (F.col("t") + F.col("took")).alias("t"), "took", "n")


def percentile(times: DataFrame, keys: list[str], value: str, n: str, share: int) -> DataFrame:
    """keys and value: the ceil(share * total / 100)-th smallest of non-negative values, each of which stands for n rows.

    No window holds more than 2 ** BIN_BITS bins or values for a key, as long as values are below 4 ** BIN_BITS.
    """
    bins = times.groupBy(*keys, F.shiftright(value, BIN_BITS).alias("bin")).agg(F.sum(n).alias("m"))
    whole, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("rank", F.floor((F.sum("m").over(whole) * share + 99) / 100)).withColumn("cum", F.sum("m").over(upto))
    chosen = bins.where("cum >= rank and cum - m < rank").select(*keys, "bin", (F.col("rank") - F.col("cum") + F.col("m")).alias("rest"))
    inside = times.withColumn("bin", F.shiftright(value, BIN_BITS)).join(chosen.hint("merge"), [*keys, "bin"])
    inside = inside.groupBy(*keys, "bin", "rest", value).agg(F.sum(n).alias("m"))
    upto = Window.partitionBy(*keys, "bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return inside.withColumn("cum", F.sum("m").over(upto)).where("cum >= rest and cum - m < rest").select(*keys, value)


def count_funnels(clicks: DataFrame, funnels: Sequence[Funnel] = FUNNELS, minutes: int = 60, share: int = 90, client: str = "client_id", kind: str = "kind", ts: str = "ts") -> DataFrame:
    """For each funnel and client with attempts: funnel, client_id, n1, n2, ..., deepest, t2, ..., same_depth.

    Rows with a null client, kind or time are left out and repeated ones count once. Every row of the first kind starts an
    attempt; its next step is the client's earliest row of that kind later than the step before, which is reached unless it
    is more than `minutes` later or an excluded row lies after the step before and not after it (an excluded row of the same
    time ends the attempt). t_k is the ceil(share * n_k / 100)-th smallest of the microseconds from step k - 1 to step k,
    null where no attempt gets there. Funnels may differ in length; a shorter one has 0 and null beyond its end. An empty
    table, or one without a first step, gives no rows. Other columns of clicks are not read.
    """
    spark, within = clicks.sparkSession, minutes * 60_000_000
    longest = max(len(f.steps) for f in funnels)
    kinds = sorted({k for f in funnels for k in (*f.steps, *f.excluded)})
    steps = [(f.name, k, f.steps[k], f.steps[k + 1] if k + 1 < len(f.steps) else None, list(f.excluded)) for f in funnels for k in range(len(f.steps))]
    definitions = spark.createDataFrame(steps, "funnel string, step int, kind string, want string, excluded array<string>")

    rows = clicks.select(clicks[client].cast("long").alias("client_id"), clicks[kind].cast("string").alias("kind"), clicks[ts].alias("ts"))
    zoned = rows.schema["ts"].dataType.typeName() == "timestamp"
    events = rows.dropna().select("client_id", "kind", micros("ts", zoned).alias("t"))
    found, far = successors(events, kinds, within)
    places = stash(found, "successors")
    del found
    release(far)
    free_shuffles(spark)

    first = F.broadcast(definitions.where("step = 0"))
    starting = places.select("client_id", "t", "nexts", F.explode("kinds").alias("kind")).join(first, "kind").withColumn("n", F.lit(1).cast("long"))
    counts = [starting.groupBy("funnel", "client_id").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit(1))]
    rounds: list[DataFrame] = []
    standing = starting.where("want is not null")
    for step in range(1, longest):
        rounds.append(stash(advance(standing), f"step{step + 1}"))
        free_shuffles(spark)
        counts.append(rounds[-1].groupBy("funnel", "client_id").agg(F.sum("n").alias("n")).withColumn("step", F.lit(step + 1)))
        # attempts that have met go on as one
        met = rounds[-1].groupBy("funnel", "client_id", "t").agg(F.sum("n").alias("n"))
        follow = F.broadcast(definitions.where((F.col("step") == step) & F.col("want").isNotNull()))
        standing = met.join(follow, "funnel").join(places.select("client_id", "t", "nexts").hint("merge"), ["client_id", "t"])

    reached = counts[0]
    for c in counts[1:]:
        reached = reached.unionByName(c)
    number = [F.coalesce(F.sum(F.when(F.col("step") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(1, longest + 1)]
    report = reached.groupBy("funnel", "client_id").agg(*number, F.max("step").alias("deepest"))
    if rounds:
        times = rounds[0].select("funnel", "client_id", F.lit(2).alias("step"), "took", "n")
        for k, r in enumerate(rounds[1:], 3):
            times = times.unionByName(r.select("funnel", "client_id", F.lit(k).alias("step"), "took", "n"))
        slow = percentile(times, ["funnel", "client_id", "step"], "took", "n", share)
        slow = slow.groupBy("funnel", "client_id").agg(*(F.max(F.when(F.col("step") == k, F.col("took"))).alias(f"t{k}") for k in range(2, longest + 1)))
        report = report.join(slow.hint("merge"), ["funnel", "client_id"], "left")
    report = stash(report, "funnels")
    release(places, *rounds)
    # a row for each funnel and step
    depths = report.groupBy("funnel", "deepest").agg(F.count(F.lit(1)).alias("same_depth"))
    return report.join(F.broadcast(depths), ["funnel", "deepest"]).select("funnel", "client_id", *(f"n{k}" for k in range(1, longest + 1)), "deepest", *(f"t{k}" for k in range(2, longest + 1)), "same_depth")
