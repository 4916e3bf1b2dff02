"""Streams with state: sliding and session windows, and the latest row of each key, with late rows and idle keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """States that outgrow memory and have timers are kept by RocksDB; to be called before such a stream is started."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def sliding_tallies(checks: DataFrame, at: str, length: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """window_start, status, n_checks in overlapping windows; rows later than `late` are left out, as are null times."""
    grouped = checks.withWatermark(at, late).groupBy(F.window(at, length, slide).alias("w"), F.upper("status").alias("status")).count()
    return grouped.select(F.col("w.start").alias("window_start"), "status", F.col("count").alias("n_checks"))


def sessions(rows: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, started, ended, n_rows: rows of a key with less than `gap` from one to the next are a session, which ends a gap after its last."""
    grouped = rows.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).count()
    return grouped.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), F.col("count").alias("n_rows"))


class Newest(StatefulProcessor):
    """Keeps the newest row of a key, passes it on when it changes, and forgets a key that has been idle for long."""

    def __init__(self, state: T.StructType, key: str, at: str, tie: str, idle: int):
        self.state, self.key, self.at, self.tie, self.idle = state, key, at, tie, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = [f.name for f in self.state]
        held = self.newest.get() if self.newest.exists() else None
        order = lambda r: (r[names.index(self.at)], r[names.index(self.tie)])
        best = held
        for batch in rows:
            batch = batch[batch[self.at].notna()]
            if len(batch):
                top = batch.sort_values([self.at, self.tie], kind="stable").iloc[-1]
                row = tuple(None if pd.isna(x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x for x in (top[n] for n in names))
                best = row if best is None or order(row) > order(best) else best
        if best is not None and best != held:
            self.newest.update(best)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(pd.Timestamp(best[names.index(self.at)]).timestamp() * 1000) + self.idle)
            yield pd.DataFrame([(*key, *best, False)], columns=[self.key, *names, "idle"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.newest.exists():
            held = self.newest.get()
            self.newest.clear()
            yield pd.DataFrame([(*key, *held, True)], columns=[self.key, *[f.name for f in self.state], "idle"])

    def close(self) -> None:
        pass


def latest_stream(rows: DataFrame, key: str, at: str, tie: str, columns: list[str], late: str = "1 hour", idle_seconds: int = 86_400) -> DataFrame:
    """key, at, tie, columns, idle: the newest row of each key whenever it changes; and once more, with idle, when the key is forgotten.

    A key is forgotten when the watermark is `idle_seconds` beyond its newest row. Rows later than `late` don't count, nor do null
    times; of equal times the larger tie is newer. Append mode; prepare() first.
    """
    kinds = rows.schema
    state = T.StructType([kinds[c] for c in (at, tie, *columns)])
    out = T.StructType([kinds[key], *state.fields, T.StructField("idle", T.BooleanType())])
    return rows.withWatermark(at, late).select(key, at, tie, *columns).groupBy(key).transformWithStateInPandas(Newest(state, key, at, tie, 1000 * idle_seconds), out, "Append", "EventTime")
