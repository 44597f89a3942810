"""Keyed state with event-time timers: requests that wait for the watermark, so that order among files doesn't matter."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

_REQUESTS = StructType([StructField("request_id", LongType()), StructField("at", LongType()), StructField("told", LongType())])


class TrailingRequests(StatefulProcessor):
    """Counts each request's client's requests of the trailing ``micros``, itself and those of its moment included.

    The state is the client's requests that are not told yet or still count for others: those since ``micros`` before the watermark.  A
    request is told when the watermark passes it, as none before it can come any more; an event-time timer wakes the client then, and
    again when its last request has expired, so that the state of a client that stays away is cleared.
    """

    def __init__(self, micros: int):
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.requests = handle.getListState("requests", _REQUESTS)

    def _wake(self, at: int) -> None:
        """A timer for the first watermark at or after ``at`` (microseconds)."""
        when = -(-at // 1000)
        if when not in set(self.handle.listTimers()):
            self.handle.registerTimer(when)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            times = part["at"].tolist()
            self.requests.appendList([(i, t, 0) for i, t in zip(part["request_id"].tolist(), times, strict=True)])
            first = min([first, *times] if first is not None else times)
        if first is not None:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known = sorted(self.requests.get(), key=lambda r: (r[1], r[0]))
        out, window, at = [], deque(), 0
        while at < len(known) and known[at][1] <= passed:
            end = at
            while end < len(known) and known[end][1] == known[at][1]:
                window.append(known[end][1])
                end += 1
            while window[0] < known[at][1] - self.micros:
                window.popleft()
            out += [(r[0], len(window)) for r in known[at:end] if not r[2]]
            at = end
        kept = [(r[0], r[1], int(r[1] <= passed)) for r in known if r[1] > passed - self.micros]
        if kept:
            self.requests.put(kept)
            waiting = [r[1] for r in kept if not r[2]]
            self._wake(min(waiting) if waiting else kept[-1][1] + self.micros)
        else:
            self.requests.clear()
        yield pd.DataFrame({"request_id": pd.Series([i for i, _ in out], dtype="int64"), "in_window": pd.Series([n for _, n in out], dtype="int64")})

    def close(self) -> None:
        pass


def trailing_counts(requests: DataFrame, seconds: int, lateness: str) -> DataFrame:
    """``request_id, in_window`` of a stream ``requests(request_id, client, timestamp)``, each once the watermark has passed it.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = requests.withWatermark("timestamp", lateness).select("request_id", "client", "timestamp", F.unix_micros("timestamp").alias("at"))
    layout = StructType([StructField("request_id", LongType()), StructField("in_window", LongType())])
    return rows.groupBy("client").transformWithStateInPandas(TrailingRequests(seconds * 1_000_000), layout, "Append", "EventTime")
