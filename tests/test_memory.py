"""State with event-time timers: shuffled micro-batches give what the whole gives, and state goes by event time."""

import datetime as dt
import random
from collections import Counter

import pytest

from lodestone.streaming import memory

START = dt.datetime(2024, 1, 1)
SCHEMA = "id long, k string, ts timestamp, item string, names array<string>"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def events(seed, n=240):
    """Events of three keys over bursts and pauses, some at the same time; the seconds are whole."""
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 1, 2, 5, 20, 90])
        out.append((i, rng.choice(["a", "a", "b", None]), t, rng.choice("uvwxyz"), [rng.choice("PQ")] * rng.randrange(3) + [None] * rng.randrange(2)))
    return out


def streamed(spark, folder, name, rows, make, files=6):
    """The rows in disorder by up to 100 s, a file a micro-batch; a row of another key far later moves the watermark on."""
    rng = random.Random(name)
    mixed = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 100))
    size = -(-len(mixed) // files)
    parts = [mixed[k : k + size] for k in range(0, len(mixed), size)]
    parts.append([(-1, "end", 10**6, "u", [])])
    for part in parts:
        frame = spark.createDataFrame([(i, k, START + dt.timedelta(seconds=t), x, m) for i, k, t, x, m in part] + [(-2, "a", None, "u", [])], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    batches = {p["batchId"] for p in q.recentProgress if p["numInputRows"]}
    assert len(batches) == len(parts)
    return spark.table(name).where("k is null or k <> 'end'").collect(), q.lastProgress["stateOperators"][0]["numRowsTotal"]


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions(spark, tmp_path, seed):
    rows = events(seed)
    got, left = streamed(spark, tmp_path, f"sessions{seed}", rows, lambda s: memory.session_memory(s, "k", "ts", "id", "item", "200 seconds", 60, keep=4, names="names"))
    want = []
    for k, mine in by_key(rows).items():
        runs = []
        for r in mine:
            if not runs or r[2] - runs[-1][-1][2] >= 60:
                runs.append([])
            runs[-1].append(r)
        want += [(k or "", x[0][2], x[-1][2], len(x), [r[3] for r in x[-4:]], Counter(m for r in x for m in r[4] if m)) for x in runs]
    zero = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    have = [(r["k"] or "", r["first_us"] // 10**6 - zero, r["last_us"] // 10**6 - zero, r["n"], list(r["turns"]), Counter(r["mentions"])) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str) and len(want) > 10
    assert left < 10  # the last row's session and its timers only


@pytest.mark.parametrize("seed", [1, 2])
def test_limiter(spark, tmp_path, seed):
    rows = events(seed)
    got, left = streamed(spark, tmp_path, f"limits{seed}", rows, lambda s: memory.ordered_rate_limit(s, "k", "ts", "id", "200 seconds", 3, 30))
    want = set()
    for k, mine in by_key(rows).items():
        log = []
        for r in mine:
            log = [t for t in log if r[2] - t < 30]
            want.add((r[0], k, len(log) < 3))
            if len(log) < 3:
                log.append(r[2])
    assert len(got) == len(rows) and {(r["id"], r["k"], r["allowed"]) for r in got} == want
    assert {a for _, _, a in want} == {True, False} and left < 10


@pytest.mark.parametrize("seed", [1, 2])
def test_cache(spark, tmp_path, seed):
    rows = events(seed)
    got, left = streamed(spark, tmp_path, f"hits{seed}", rows, lambda s: memory.capped_cache(s, "k", "ts", "id", "item", "200 seconds", cap=3, ttl_seconds=100))
    want = set()
    for k, mine in by_key(rows).items():
        held = []  # [item, stored, used]
        for r in mine:
            known = next((h for h in held if h[0] == r[3]), None)
            hit = known is not None and r[2] - known[1] < 100
            want.add((r[0], k, hit))
            if hit:
                known[2] = r[2]
            else:
                held = [h for h in held if h is not known] + [[r[3], r[2], r[2]]]
            if len(held) > 3:
                held = [h for h in held if r[2] - h[1] < 100]
            if len(held) > 3:
                held.remove(min(held, key=lambda h: (h[2], h[0])))
    assert len(got) == len(rows) and {(r["id"], r["k"], r["hit"]) for r in got} == want
    assert {a for _, _, a in want} == {True, False} and left < 10
