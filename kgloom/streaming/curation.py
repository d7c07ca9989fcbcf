"""Curator actions as a stream (an extension of this engine's own): current versions and windowed counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ACTION = "event_id long, chain_id string, at timestamp, action string"


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events once each, as long as a repetition is at most ``late`` behind."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """Actions by window; ``late`` None keeps the watermark that the events have."""
    marked = events if late is None else events.withWatermark("at", late)
    return marked.groupBy(F.window("at", window), "action").agg(F.count("*").alias("n")).select("window.start", "action", "n")


STATUS = "chain_id string, version long, action string, closed boolean"
#: The store of keyed state that expires (RocksDB), to be set in the session: state isn't held on the heap.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Chain(StatefulProcessor):
    """A chain's number of actions and its last one, by time and then by event, until nothing has come for a while."""

    def __init__(self, rest_ms: int):
        self.rest_ms = rest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("chain", "version long, at long, event long, action string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        version, last = 0, (-1, -1, None)
        if self.state.exists():
            version, *last = self.state.get()
        for frame in rows:
            version += len(frame)
            moments = frame["at"].astype("datetime64[us]").astype("int64") // 1000
            last = max([tuple(last), *zip(moments.tolist(), frame["event_id"].tolist(), frame["action"].tolist(), strict=True)], key=lambda x: x[:2])
        self.state.update((version, *last))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(last[0]) + self.rest_ms)
        yield pd.DataFrame({"chain_id": [key[0]], "version": [version], "action": [last[2]], "closed": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        version, _, _, action = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"chain_id": [key[0]], "version": [version], "action": [action], "closed": [True]})

    def close(self) -> None:
        pass


def current_status(events: DataFrame, late: str = "1 hour", rest_ms: int = 24 * 3_600_000) -> DataFrame:
    """(chain_id, version, action, closed): a row for each batch in which a chain moved on, and one as it closes.

    ``version`` counts a chain's events and ``action`` is that of the last one by time, ties by event, so the order in
    which they come within ``late`` doesn't matter.  Once the watermark is ``rest_ms`` behind a chain's last event its
    state is dropped; an event after that begins anew.  The session needs ``STATE_STORE``.
    """
    return events.withWatermark("at", late).groupBy("chain_id").transformWithStateInPandas(_Chain(rest_ms), STATUS, "Update", "EventTime")
