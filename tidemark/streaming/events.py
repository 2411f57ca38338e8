"""Streaming forms of the de-duplication rules: extensions for live event streams.

Each takes a streaming table (clip, ts timestamp, id, conf).  Rows behind the watermark are dropped as late; all others count in
order of their times, in whatever order they arrive.  State is lists and timers, which need the RocksDB state store:
spark.sql.streaming.stateStore.providerClass = ROCKS_DB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "clip string, id long, t long, conf double"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def gap_chains(stream: DataFrame, window: str, late: str) -> DataFrame:
    """Gap chains as session windows: clip, start, last, n, best confidence; a chain is emitted once the watermark has passed it."""
    s = F.session_window("ts", window)
    g = stream.withWatermark("ts", late).groupBy("clip", s.alias("s"))
    return g.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.max("conf").alias("best")).drop("s")


class OrderedFold(StatefulProcessor):
    """Keeps one open survivor a key and the rows that the watermark has not passed.

    Rows wait in a list until the watermark is behind them, and are then taken in order of time, whatever order they came in:
    no row before them can come any more.  A survivor is emitted when a row beyond the gap is taken, or when the watermark is
    the gap behind it.
    """

    def __init__(self, gap: int, anchored: bool, replace: bool) -> None:
        self.gap, self.anchored, self.replace = gap, anchored, replace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, id long, conf double")
        self.survivor = handle.getValueState("survivor", "t long, id long, conf double, anchor long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            if len(part):
                self.waiting.appendList([tuple(r) for r in part[["t", "id", "conf"]].astype({"conf": float}).itertuples(index=False)])
                self._wake(int(part["t"].min()))
        yield pd.DataFrame(columns=["clip", "id", "t", "conf"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000  # rows before this can't come any more
        rows = sorted(self.waiting.get())
        ready, rest = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        current = list(self.survivor.get()) if self.survivor.exists() else None
        out = []
        for t, i, conf in ready:
            if current is not None and t - current[3 if self.anchored else 0] < self.gap:
                if self.replace and conf > current[2]:
                    current = [t, i, conf, current[3]]
            else:
                if current is not None:
                    out.append((key[0], current[1], current[0], current[2]))
                current = [t, i, conf, t]
        if current is not None and current[3 if self.anchored else 0] + self.gap <= min(passed, rest[0][0] if rest else passed):
            out.append((key[0], current[1], current[0], current[2]))
            current = None
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        if current is None:
            self.survivor.clear()
        else:
            self.survivor.update(tuple(current))
            self._wake(current[3 if self.anchored else 0] + self.gap)
        yield pd.DataFrame(out, columns=["clip", "id", "t", "conf"])

    def _wake(self, t: int) -> None:
        self.handle.registerTimer(t // 1000 + 1)

    def close(self) -> None:
        pass


def _fold(stream: DataFrame, gap: int, late: str, anchored: bool, replace: bool) -> DataFrame:
    x = stream.withWatermark("ts", late).select(F.col("clip").cast("string").alias("clip"), "ts", F.col("id").cast("long").alias("id"), F.unix_micros("ts").alias("t"), F.col("conf").cast("double").alias("conf"))
    return x.groupBy("clip").transformWithStateInPandas(OrderedFold(gap, anchored, replace), OUT, "append", "EventTime")


def nms_anchored(stream: DataFrame, window: int, late: str) -> DataFrame:
    """The best of every row less than `window` after a cluster's first; equals the batch rule, but for survivors that the watermark has not passed."""
    return _fold(stream, window, late, anchored=True, replace=True)


def dedup_last_kept(stream: DataFrame, gap: int, late: str) -> DataFrame:
    """The last-kept rule; equals the batch rule, but for survivors that the watermark has not passed."""
    return _fold(stream, gap, late, anchored=False, replace=True)


def thin_keep_first(stream: DataFrame, gap: int, late: str) -> DataFrame:
    """The keep-first rule; equals the batch rule, but for survivors that the watermark has not passed."""
    return _fold(stream, gap, late, anchored=True, replace=False)
