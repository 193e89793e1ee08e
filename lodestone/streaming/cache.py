"""A keyed cache over a stream with a time to live, by the state API that expires values itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class TimedCache(StatefulProcessor):
    """Says of each request whether its key was answered within the time to live; a miss is stored."""

    def __init__(self, key: str, ttl_ms: int):
        self.key, self.ttl_ms = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "id long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            hits = []
            for request in pdf["request"]:
                hits.append(self.value.exists())
                if not hits[-1]:
                    self.value.update((int(request),))
            yield pd.DataFrame({"request": pdf["request"], self.key: key[0], "hit": hits})

    def close(self) -> None:
        pass


def cached(requests: DataFrame, key: str, ttl_seconds: int = 7200) -> DataFrame:
    """request (long), key and hit of a streaming frame; needs the RocksDB state store, as all state with a time to live."""
    kind = dict(requests.dtypes)[key]
    return requests.groupBy(key).transformWithStateInPandas(TimedCache(key, ttl_seconds * 1000), f"request long, {key} {kind}, hit boolean", "append", "ProcessingTime")
