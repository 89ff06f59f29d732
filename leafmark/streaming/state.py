"""State with timers and time to live: sessions, failures in a row and in all, and queries that errors stop.

Sessions are windows; the stateful processor needs the RocksDB state store; ``store`` sets it for what it runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def store(spark: SparkSession) -> Iterator[None]:
    """Within this block, queries that start keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype("int64")


def sessions(events: DataFrame, ttl: float, late: str = "1 minute", key: str = "user_id") -> DataFrame:
    """(key, started_at, last_seen, n): a stream's sessions that are over: no event of the key for ``ttl`` seconds.

    Sessions end by the time of events, when the watermark (``late`` behind the
    newest) has passed; rows whose own session would be over by then are dropped.
    Results don't depend on how rows fall into batches. Rows without a time or
    key are left out.
    """
    rows = events.filter(F.col("ts").isNotNull() & F.col(key).isNotNull()).select(key, "ts").withWatermark("ts", late)
    found = rows.groupBy(key, F.session_window("ts", f"{int(ttl * 1e6)} microseconds")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))
    return found.select(key, "started_at", "last_seen", "n")


class _Failures(StatefulProcessor):
    """Failures of a key in a row and in all, and its last time; a timer drops what has been silent for ``ttl`` microseconds."""

    def __init__(self, key: str, run: int, total: int, ttl: int):
        self.key, self.run, self.total, self.ttl = key, run, total, ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "run long, total long, last long")

    def _rows(self, key: tuple, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(found), "event_id": np.array([f[0] for f in found], "int64"), "outcome": pd.Series([f[1] for f in found], dtype=object)})

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        bad, ids, times = frame["bad"].to_numpy(bool), frame["event_id"].to_numpy("int64"), _micros(frame["ts"])
        run, total, last = self.seen.get() if self.seen.exists() else (0, 0, int(times[0]))
        anew = np.diff(times, prepend=last) >= self.ttl
        if anew[0]:
            run = total = 0
        place, first = np.arange(len(bad)), np.cumsum(anew) == anew[0]  # rows that go on from the state
        base = np.maximum.accumulate(np.where(anew, place, 0))
        sums = np.cumsum(bad)
        sums = sums - (sums - bad)[base] + np.where(first, total, 0)
        before = np.maximum.accumulate(np.where(bad, np.where(anew, place - 1, -1), place))  # the last row ahead of each run
        length = np.where(before >= 0, place - before, place + 1 + run)
        self.seen.update((int(length[-1]) % self.run if bad[-1] else 0, int(sums[-1]), max(last, int(times[-1]))))
        self.handle.registerTimer(-(-(max(last, int(times[-1])) + self.ttl) // 1000))
        trips, once = bad & (length % self.run == 0), bad & (sums == self.total)
        yield self._rows(key, [(i, "breaker") for i in ids[trips]] + [(i, "threshold") for i in ids[once]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.seen.exists() and self.seen.get()[2] + self.ttl <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.seen.clear()
        yield self._rows(key, [])

    def close(self) -> None:
        pass


def failures(events: DataFrame, bad: str, run: int, total: int, ttl: float = 86400.0, late: str = "1 minute", key: str = "user_id") -> DataFrame:
    """(key, event_id, outcome): a stream's events that complete ``run`` bad ones in a row (``breaker``; the run starts again behind them), or bring the key to ``total`` (``threshold``, once).

    A key that is silent for ``ttl`` seconds starts anew, and its state is
    dropped. Within a micro-batch events are taken by time and id, between
    batches as they come; rows without key or time are left out.
    """
    kind = events.schema[key].dataType.simpleString()
    whole = events.filter(F.col("ts").isNotNull() & F.col(key).isNotNull()).withWatermark("ts", late)
    rows = whole.select(key, "ts", "event_id", F.coalesce(F.col("event_type") == bad, F.lit(False)).alias("bad"))
    return rows.groupBy(key).transformWithStateInPandas(_Failures(key, run, total, int(ttl * 1e6)), f"{key} {kind}, event_id long, outcome string", "append", "eventTime")


def until_errors(stream: DataFrame, bad: Column, limit: int, folder: str) -> tuple[DataFrame, int, bool]:
    """(rows, errors, stopped): what a stream wrote below ``folder`` until its rows that are ``bad`` reached ``limit``, which stops it.

    Rows and errors of a batch are written under its number, so a batch that is
    done again replaces itself, and a stopped query that is started again stops
    at once. The batch that reaches the limit is kept.
    """
    spark = stream.sparkSession

    def total() -> int:
        found = spark.read.schema("errors long, batch long").parquet(f"{folder}/errors")
        return found.agg(F.coalesce(F.sum("errors"), F.lit(0))).head()[0]

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation(f"errors_{number}")
        counted = batch.observe(seen, F.count("*").alias("rows"), F.count_if(bad).alias("errors"))
        counted.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        row = spark.range(1).select(F.lit(int(seen.get["errors"])).cast("long").alias("errors"))
        row.write.mode("overwrite").parquet(f"{folder}/errors/batch={number}")
        if total() >= limit:
            raise OverflowError(f"{limit} errors")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    stopped = False
    try:
        query.awaitTermination()
    except Exception as error:
        if f"OverflowError: {limit} errors" not in str(error):
            raise
        stopped = True
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns), total(), stopped
