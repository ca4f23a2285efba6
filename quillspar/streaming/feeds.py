"""Streaming counterparts: debounced change feeds and token buckets that forget idle keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quillspar.operators.changes import Bucket


def debounced(changes: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """One row for each burst of changes (root, ts, path) of a root, node_modules left out; the watermark delays a burst by `late`."""
    kept = changes.filter(~F.col("path").contains("node_modules")).withWatermark("ts", late)
    return kept.groupBy("root", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("ts").alias("last")).drop("session_window")


class _Limiter(StatefulProcessor):
    """A bucket a key, with a timer that looks a window after the key's last call whether it may go."""

    def __init__(self, key: str, most: int, window_ms: int):
        self.key, self.most, self.window = key, most, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens long, since long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.bucket.get()
        parts = [(p["at_ms"].to_numpy(), p["event_id"].to_numpy()) for p in rows]
        at, event = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((event, at))
        at, event = at[order], event[order]
        tokens, since, last = held or (None, None, None)
        bucket = Bucket(self.most, self.window, tokens, since)
        allowed = [bucket.take(int(t)) for t in at]
        last = int(at[-1]) if last is None else max(last, int(at[-1]))
        self.bucket.update((bucket.tokens, bucket.since, last))
        if held is None:
            self.handle.registerTimer(last + self.window)
        yield pd.DataFrame({self.key: [key[0]] * len(at), "event_id": event, "at_ms": at, "allowed": allowed})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.bucket.get()
        if held is not None:
            if held[2] + self.window <= timerValues.getCurrentWatermarkInMs():
                self.bucket.clear()
            else:
                self.handle.registerTimer(held[2] + self.window)
        return iter(())

    def close(self) -> None:
        pass


def rate_limited(calls: DataFrame, key: str, most: int, window_ms: int, late: str = "10 seconds") -> DataFrame:
    """calls (key, event_id, at_ms) with `allowed`; the bucket of a key is kept as state until the watermark is a window past its last call.

    A bucket idle for a window is full again, so one that is forgotten decides as one that is kept. Calls `late` or more behind
    the latest one of earlier triggers are not decided. A key's calls of one trigger are sorted in memory (two numbers each). The session
    needs the RocksDB state store, as `build_session` sets it.
    """
    kind = dict(calls.dtypes)[key]
    # a row at the watermark counts as late, so times are moved by one: the first watermark is 0
    timed = calls.select(key, "event_id", "at_ms", F.timestamp_millis(F.col("at_ms") + 1).alias("_ts")).withWatermark("_ts", late)
    return timed.groupBy(key).transformWithStateInPandas(_Limiter(key, most, window_ms), f"{key} {kind}, event_id long, at_ms long, allowed boolean", "append", "eventTime")
