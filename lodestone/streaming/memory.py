"""Keyed state in the order of event time: memory of sessions, a rate limiter and a capped cache, all with event-time timers.

Events may come in any order within the watermark's delay and in any split into micro-batches: the rows that come out are the same.
State with timers needs the RocksDB state store. Rows without a time have no place and are left out; later than the watermark, Spark
drops them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _millis(micros: int) -> int:
    return -(-micros // 1000)


def _plain(v):
    return v.item() if hasattr(v, "item") else None if v is pd.NA or v is pd.NaT or v != v else v


class _Sessions(StatefulProcessor):
    """Open sessions as fragments that merge: bounds, a count, the last turns and counts of mentions.

    The last turns of two fragments' union are among the last turns of both, so a fragment needs no more of them. A key holds as many
    fragments as gaps fit into the delay, and one more.
    """

    def __init__(self, key: str, gap: int, keep: int) -> None:
        self.key, self.gap, self.keep = key, gap, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fragments = handle.getListState("fragments", "first long, last long, n long, times array<long>, orders array<long>, texts array<string>, names array<string>, counts array<long>")

    def joined(self, parts: list[tuple]) -> list[tuple]:
        out: list[list[tuple]] = []
        end = None
        for p in sorted(parts, key=lambda p: (p[0], p[1])):
            if end is not None and p[0] - end < self.gap:
                out[-1].append(p)
                end = max(end, p[1])
            else:
                out.append([p])
                end = p[1]
        return [self.merged(g) if len(g) > 1 else g[0] for g in out]

    def merged(self, group: list[tuple]) -> tuple:
        turns = sorted((t, o, x or "") for p in group for t, o, x in zip(p[3], p[4], p[5], strict=True))[-self.keep :]
        names: Counter[str] = Counter()
        for p in group:
            names.update(dict(zip(p[6], p[7], strict=True)))
        kept = sorted(names.items())
        return (group[0][0], max(p[1] for p in group), sum(p[2] for p in group), *([t[k] for t in turns] for k in range(3)), [a for a, _ in kept], [b for _, b in kept])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [tuple(list(v) if isinstance(v, (list, tuple)) or hasattr(v, "tolist") else v for v in p) for p in self.fragments.get()]
        for pdf in rows:
            for t, o, x, names in zip(pdf["held_t"], pdf["held_order"], pdf["held_text"], pdf["held_names"], strict=True):
                counted = sorted(Counter(n for n in (names if names is not None else ()) if n is not None).items())
                parts.append((int(t), int(t), 1, [int(t)], [int(o)], [x], [a for a, _ in counted], [b for _, b in counted]))
            parts = self.joined(parts)
        self.fragments.put(parts)
        for p in parts:
            self.handle.registerTimer(_millis(p[1] + self.gap))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        for p in self.fragments.get():
            (due if p[1] + self.gap <= now else rest).append(p)
        if due:
            if rest:
                self.fragments.put(rest)
            else:
                self.fragments.clear()
            rows = [(key[0], p[0], p[1], p[2], list(p[5]), dict(zip(p[6], p[7], strict=True))) for p in due]
            yield pd.DataFrame(rows, columns=[self.key, "first_us", "last_us", "n", "turns", "mentions"])

    def close(self) -> None:
        pass


def session_memory(events: DataFrame, key: str, ts: str, order: str, text: str, delay: str, gap_seconds: float = 1800, keep: int = 10, names: str | None = None) -> DataFrame:
    """key, first and last time (microseconds), n, the last `keep` texts and counts of the names of each session, once it is over.

    A session is over when the watermark is `gap_seconds` beyond its last event; its state is removed then. Of events of one time the
    one with the larger `order` (a whole number) is later; null texts count as empty.
    """
    rows = events.withWatermark(ts, delay).where(F.col(ts).isNotNull())
    named = F.col(names) if names else F.array().cast("array<string>")
    rows = rows.select(key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("held_t"), F.coalesce(F.col(order).cast("long"), F.lit(0)).alias("held_order"), F.coalesce(text, F.lit("")).alias("held_text"), named.alias("held_names"))
    schema = f"{key} {dict(rows.dtypes)[key]}, first_us long, last_us long, n long, turns array<string>, mentions map<string,long>"
    return rows.groupBy(key).transformWithStateInPandas(_Sessions(key, int(gap_seconds * 1_000_000), keep), schema, "append", "EventTime")


class _InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then takes them by time and number."""

    def __init__(self, key: str, identity: str, fields: str) -> None:
        self.key, self.identity, self.fields = key, identity, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "t long, " + self.fields)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            found = [tuple(map(_plain, r)) for r in zip(*(pdf[c] for c in pdf.columns if c.startswith("held_")), strict=True)]
            self.pending.appendList(found)
            least = min(r[0] for r in found)
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(_millis(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        for r in self.pending.get():
            (due if r[0] <= now else rest).append(tuple(r))
        if due:
            if rest:
                self.pending.put(rest)
                self.handle.registerTimer(_millis(min(r[0] for r in rest)))
            else:
                self.pending.clear()
            due.sort()
        out = self.taken(due, now)
        if due:
            yield pd.DataFrame({self.identity: [r[1] for r in due], self.key: [key[0]] * len(due), self.answer: out})

    def close(self) -> None:
        pass


class _Limiter(_InOrder):
    answer = "allowed"

    def __init__(self, key: str, identity: str, fields: str, cap: int, span: int) -> None:
        super().__init__(key, identity, fields)
        self.cap, self.span = cap, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.log = handle.getListState("log", "t long")

    def taken(self, due: list[tuple], now: int) -> list[bool]:
        log, out = sorted(t for (t,) in self.log.get()), []
        for t, *_ in due:
            log = [x for x in log if t - x < self.span]
            out.append(len(log) < self.cap)
            if out[-1]:
                log.append(t)
        log = [x for x in log if now - x < self.span]
        if log:
            self.log.put([(x,) for x in log])
            self.handle.registerTimer(_millis(log[-1] + self.span))
        else:
            self.log.clear()
        return out


class _Cache(_InOrder):
    answer = "hit"

    def __init__(self, key: str, identity: str, fields: str, cap: int, out_at_once: int, ttl: int) -> None:
        super().__init__(key, identity, fields)
        self.cap, self.out_at_once, self.ttl = cap, out_at_once, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getMapState("held", "item string", "stored long, used long")

    def taken(self, due: list[tuple], now: int) -> list[bool]:
        before = {k[0]: tuple(v) for k, v in self.held.iterator()}
        held, out = dict(before), []
        for t, _, item in due:
            known = held.get(item)
            out.append(known is not None and t - known[0] < self.ttl)
            held[item] = (known[0] if out[-1] else t, t)
            if len(held) > self.cap:
                held = {k: v for k, v in held.items() if t - v[0] < self.ttl}
            if len(held) > self.cap:
                for k in sorted(held, key=lambda k: (held[k][1], k))[: self.out_at_once]:
                    del held[k]
        held = {k: v for k, v in held.items() if now - v[0] < self.ttl}
        for k in before.keys() - held.keys():
            self.held.removeKey((k,))
        for k, v in held.items():
            if before.get(k) != v:
                self.held.updateValue((k,), v)
        if held:
            self.handle.registerTimer(_millis(min(v[0] for v in held.values()) + self.ttl))
        return out


def _in_order(events: DataFrame, key: str, ts: str, event_id: str, delay: str, more: list) -> tuple[DataFrame, dict[str, str]]:
    rows = events.withWatermark(ts, delay).where(F.col(ts).isNotNull())
    rows = rows.select(key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("held_t"), F.col(event_id).cast("long").alias("held_id"), *more)
    return rows, dict(rows.dtypes)


def ordered_rate_limit(events: DataFrame, key: str, ts: str, event_id: str, delay: str, cap: int, seconds: float = 60.0) -> DataFrame:
    """event_id (long), key and allowed of a stream, as `stateful.rate_limit` gives them for the whole: an event is admitted if fewer
    than `cap` admitted ones lie in the last `seconds`. The answer comes once the watermark has passed the event.
    """
    rows, kinds = _in_order(events, key, ts, event_id, delay, [])
    limiter = _Limiter(key, event_id, "id long", cap, int(seconds * 1_000_000))
    return rows.groupBy(key).transformWithStateInPandas(limiter, f"{event_id} long, {key} {kinds[key]}, allowed boolean", "append", "EventTime")


def capped_cache(events: DataFrame, key: str, ts: str, event_id: str, item: str, delay: str, cap: int = 3000, share: float = 0.1, ttl_seconds: float = 7200) -> DataFrame:
    """event_id (long), key and hit of a stream of requests for items (null: empty) of a key's cache.

    A request hits if the item was stored less than `ttl_seconds` before; else it is stored. Beyond `cap` items the expired ones go,
    and if that is not enough the `share` of cap (one at least) that was used least recently. State of expired items is removed.
    """
    rows, kinds = _in_order(events, key, ts, event_id, delay, [F.coalesce(F.col(item).cast("string"), F.lit("")).alias("held_item")])
    cache = _Cache(key, event_id, "id long, item string", cap, max(1, int(cap * share)), int(ttl_seconds * 1_000_000))
    return rows.groupBy(key).transformWithStateInPandas(cache, f"{event_id} long, {key} {kinds[key]}, hit boolean", "append", "EventTime")
