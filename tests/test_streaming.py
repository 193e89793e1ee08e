import datetime as dt

from lodestone.sources.collections import Collection
from lodestone.streaming import stateful, windows

START = dt.datetime(2024, 1, 1)
SECONDS = [0, 30, 59, 60, 61]


def events(spark):
    return spark.createDataFrame([(i, "k", START + dt.timedelta(seconds=s)) for i, s in enumerate(SECONDS)], "id long, k string, ts timestamp")


def test_limiter_counts_admitted_events_only(spark):
    out = stateful.rate_limit(events(spark), "k", "ts", "id", cap=2).orderBy("id").collect()
    assert [r["allowed"] for r in out] == [True, True, False, True, False]


def test_limiter_on_a_stream(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, k string, ts timestamp").parquet(str(tmp_path / "in"))
    q = stateful.rate_limit_stream(stream, "k", "ts", "id", cap=2).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["allowed"] for r in spark.table("limited").orderBy("id").collect()] == [True, True, False, True, False]


def test_tumbling_on_a_stream_equals_batch(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, k string, ts timestamp").parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, "ts", "1 minute", ["k"], late="10 minutes").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = windows.tumbling(events(spark), "ts", "1 minute", ["k"])
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, batch.collect()))


def test_last_turns_and_retention(spark):
    rows = spark.createDataFrame([(1, t) for t in range(12)], "c int, t int")
    assert [r["t"] for r in windows.last_turns(rows, ["c"], "t", 10).orderBy("t").collect()] == [*range(2, 12)]


def test_upsert_keeps_the_newest(spark, tmp_path):
    path = str(tmp_path / "table")
    stateful.upsert(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, t int, v string"), path, "k", "t")
    stateful.upsert(spark.createDataFrame([(1, 2, "c")], "k int, t int, v string"), path, "k", "t")
    stateful.upsert(spark.createDataFrame([(2, 1, "a"), (2, 1, "c"), (2, 1, "b")], "k int, t int, v string"), path, "k", "t")
    assert {r["k"]: r["v"] for r in Collection(spark, path).read().collect()} == {1: "c", 2: "c"}


def test_timed_cache(spark, tmp_path):
    from lodestone.streaming import cache

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "request long, k string").coalesce(1).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("request long, k string").parquet(str(tmp_path / "in"))
        q = cache.cached(stream, "k").writeStream.format("memory").queryName("cached").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted((r["k"], r["hit"]) for r in spark.table("cached").collect()) == [("a", False), ("a", True), ("b", False)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
