"""Stateful operators: a sliding-log rate limiter and a time-to-live cache, with batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.sources.collections import Collection


def _admit(times: list[float], log: list[float], cap: int, seconds: float) -> tuple[list[bool], list[float]]:
    """An event is admitted if fewer than cap admitted ones lie in the last so many seconds; refused ones don't count."""
    out = []
    for t in times:
        log = [x for x in log if t - x < seconds]
        ok = len(log) < cap
        if ok:
            log.append(t)
        out.append(ok)
    return out, log


def rate_limit(events: DataFrame, key: str, ts: str, event_id: str, cap: int, seconds: float = 60.0) -> DataFrame:
    """event_id, key and allowed for every event of a batch, in time order within the key.

    One key is sequential by definition: an admission depends on those before it. Its state is at most cap times, and rows
    arrive sorted in Arrow batches, so a hot key costs time, not memory.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, []
        for pdf in frames:
            allowed = []
            for k, t in zip(pdf[key], pdf["__t"], strict=True):
                if k != current:
                    current, log = k, []
                ok, log = _admit([t], log, cap, seconds)
                allowed += ok
            yield pd.DataFrame({event_id: pdf[event_id], key: pdf[key], "allowed": allowed})

    rows = events.selectExpr(event_id, key, f"unix_micros(cast({ts} as timestamp)) / 1000000.0D AS __t").repartition(key).sortWithinPartitions(key, "__t", event_id)
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"{event_id} {kinds[event_id]}, {key} {kinds[key]}, allowed boolean")


def rate_limit_stream(events: DataFrame, key: str, ts: str, event_id: str, cap: int, seconds: float = 60.0) -> DataFrame:
    """The same for a streaming frame; the log of each key is its state, dropped after an idle window."""
    rows = events.selectExpr(event_id, key, f"unix_micros(cast({ts} as timestamp)) / 1000000.0D AS __t")
    kinds = dict(rows.dtypes)

    def step(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(frames)).sort_values(["__t", event_id])
        allowed, log = _admit(pdf["__t"].tolist(), log, cap, seconds)
        state.update((log,))
        state.setTimeoutDuration(int(seconds * 1000))
        yield pd.DataFrame({event_id: pdf[event_id], key: group[0], "allowed": allowed})

    schema = f"{event_id} {kinds[event_id]}, {key} {kinds[key]}, allowed boolean"
    return rows.groupBy(key).applyInPandasWithState(step, schema, "log array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def upsert(batch: DataFrame, path: str, key: str, ts: str) -> None:
    """For foreachBatch: the newest row of each key, old and new; of rows with equal time the largest by all columns.

    The rows are a new version of the collection at path, which Collection.read gives: a reader sees the old or the new one, and a
    failure leaves the old one.
    """
    table = Collection(batch.sparkSession, path)
    if table.exists():
        batch = batch.unionByName(table.read(), allowMissingColumns=True)
    columns = batch.columns
    newest = batch.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(ts, *columns)).alias("r")).select("r.*")
    table.overwrite(newest)
