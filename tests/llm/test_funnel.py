"""Funnels against a reading of each attempt by itself, and on odd rows."""

import bisect
import datetime as dt
import random
from collections import Counter, defaultdict

import pytest

from lodestone.llm.funnel import FUNNELS, Funnel, count_funnels, percentile

HOUR = 3_600_000_000
START = dt.datetime(2024, 3, 31, 1, 30)
SCHEMA = "client_id long, kind string, ts timestamp_ntz, t long, fine string, n string, funnel string"


def clicks(spark, rows):
    made = [(c, k, None if t is None else START + dt.timedelta(microseconds=t), 5, "clash", "clash", "clash") for c, k, t in rows]
    return spark.createDataFrame(made, SCHEMA)


def one_by_one(rows, funnels=FUNNELS, minutes=60):
    times = defaultdict(list)
    for c, k, t in sorted({r for r in rows if None not in r}):
        times[c, k].append(t)

    def after(c, k, t):
        i = bisect.bisect_right(times[c, k], t)
        return times[c, k][i] if i < len(times[c, k]) else None

    steps = defaultdict(lambda: defaultdict(list))
    for f in funnels:
        for c, k in list(times):
            if k != f.steps[0]:
                continue
            for t in times[c, k]:
                steps[f.name, c][1].append(0)
                for depth, want in enumerate(f.steps[1:], 2):
                    nxt = after(c, want, t)
                    if nxt is None or nxt - t > minutes * 60_000_000 or any((x := after(c, e, t)) is not None and x <= nxt for e in f.excluded):
                        break
                    steps[f.name, c][depth].append(nxt - t)
                    t = nxt
    longest = max(len(f.steps) for f in funnels)
    depths = {k: max(d for d, v in s.items() if v) for k, s in steps.items()}
    same = Counter((f, d) for (f, _), d in depths.items())
    out = set()
    for (f, c), s in steps.items():
        slow = [sorted(s[k])[-(-90 * len(s[k]) // 100) - 1] if s[k] else None for k in range(2, longest + 1)]
        out.add((f, c, *(len(s[k]) for k in range(1, longest + 1)), depths[f, c], *slow, same[f, depths[f, c]]))
    return out


def told(df):
    return {tuple(r) for r in df.collect()}


def test_funnels_equal_a_reading_by_attempt(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4]), rng.choice(["view", "view", "click", "click", "purchase", "signup", "error", "other"]), rng.randrange(0, 40) * HOUR // 7 + rng.choice([0, 0, 1, 5_000_000])) for _ in range(1500)]
    # one client holds a third of the rows within a second, so that all meet in one fine bucket
    rows += [(9, rng.choice(["view", "click", "purchase", "signup"]), rng.randrange(900_000)) for _ in range(700)]
    rows += [(9, "error", 450_000), (9, "click", 900_000 + HOUR), (9, "click", 2 * HOUR + 900_001)]
    rows += rows[:50] + [(None, "view", 1), (1, None, 1), (1, "view", None)]
    assert told(count_funnels(clicks(spark, rows))) == one_by_one(rows)


def test_limits_and_ties(spark):
    rows = [(1, "view", 0), (1, "click", HOUR), (2, "view", 0), (2, "click", HOUR + 1), (3, "view", 0), (3, "error", 10), (3, "click", 10), (4, "view", 5), (4, "error", 5), (4, "click", 6), (5, "signup", 3), (5, "view", 3), (6, "error", 1)]
    got = told(count_funnels(clicks(spark, rows)))
    assert got == one_by_one(rows)
    deepest = {(r[0], r[1]): r[6] for r in got}
    assert [deepest["A", c] for c in (1, 2, 3, 4)] == [2, 1, 1, 2] and ("B", 6) not in deepest


def test_own_funnels_zoned_times_and_empty_tables(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.choice("abcd"), rng.randrange(400) * 1_000_000) for _ in range(400)]
    own = (Funnel("short", ("a", "b")), Funnel("one", ("c",)), Funnel("long", ("a", "b", "a", "b", "c"), ("d", "c")))
    df = clicks(spark, rows)
    want = one_by_one(rows, own, 2)
    assert told(count_funnels(df, own, minutes=2)) == want
    assert told(count_funnels(df.withColumn("ts", df["ts"].cast("timestamp")), own, minutes=2)) == want
    assert count_funnels(clicks(spark, [])).count() == 0
    assert count_funnels(clicks(spark, [(1, "error", 5)])).count() == 0


def test_times_without_a_zone_do_not_follow_the_session(spark):
    # 02:00 to 03:00 does not exist on that day in Berlin
    rows = [(1, "view", 0), (1, "click", HOUR // 2 + 5), (1, "view", HOUR), (1, "purchase", HOUR + HOUR // 2)]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert told(count_funnels(clicks(spark, rows))) == one_by_one(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("share", [1, 50, 90, 100])
def test_percentile_by_digits(spark, share):
    rng = random.Random(share)
    rows = [("k" + str(rng.randrange(3)), rng.choice([rng.randrange(10), rng.randrange(2**31), 7]), rng.randrange(1, 4)) for _ in range(300)]
    got = {(r["key"], r["v"]) for r in percentile(spark.createDataFrame(rows, "key string, v long, m long"), ["key"], "v", "m", share).collect()}
    want = set()
    for key in {r[0] for r in rows}:
        values = sorted(v for k, v, m in rows if k == key for _ in range(m))
        want.add((key, values[-(-share * len(values) // 100) - 1]))
    assert got == want
