"""The event stream: filters, levels, throttled progress, breakers, dedup; batch and Structured Streaming forms.

Functions take a DataFrame that may be a stream unless they say otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark import schemas
from leafmark.functions import text as T
from leafmark.session import work_folder

#: Event types and their log levels.
LEVELS = {
    "app.started": 20, "app.stopping": 20, "app.stopped": 20,
    "scan.started": 20, "scan.completed": 20, "scan.progress": 10, "scan.cancel_requested": 20, "scan.cancelled": 20,
    "file.processing_failed": 40, "db.query_slow": 30, "db.error": 40, "operation.timed_out": 30, "search.performed": 20,
    "http.request_started": 10, "http.request_completed": 20, "auth.auto_login": 20, "coord.anomaly_detected": 30,
    "module.loaded": 20, "module.load_failed": 40, "module.error": 40,
}
#: Fixed value: the level of types without one.
INFO = 20
#: Types of a progress feed, those that end it, and the seconds after which a silent one beats.
FEED = ("scan.progress", "scan.completed", "scan.secondary.started", "scan.secondary.progress", "scan.secondary.completed")
LAST = ("scan.completed", "scan.secondary.completed")
BEAT = 60.0


def read_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """Event files of a folder as a stream, ``files`` at a time."""
    return spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", files).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


def subscribe(events: DataFrame, types: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Events of some exact types, or whose type begins with a prefix; all without either."""
    if types is not None:
        return events.filter(F.col("event_type").isin(types))
    return events.filter(F.startswith("event_type", F.lit(prefix))) if prefix is not None else events


def level_of(event_type: Column, levels: dict[str, int] = LEVELS) -> Column:
    """The level of a type; unknown ones count as INFO."""
    out = F.lit(INFO)
    for name, level in levels.items():
        out = F.when(event_type == name, level).otherwise(out)
    return out


def at_level(events: DataFrame, level: int, levels: dict[str, int] = LEVELS) -> DataFrame:
    """Events of ``level`` or above, with their level."""
    return events.withColumn("level", level_of(F.col("event_type"), levels)).filter(F.col("level") >= level)


def throttled(events: DataFrame, every: str = "1 second", forced: Column | None = None) -> DataFrame:
    """The last event of each type in each tumbling window, and every one that is ``forced``; with a watermark on a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", "1 minute")
    own = F.lit(None).cast("long") if forced is None else F.when(forced, F.col("event_id"))
    g = events.groupBy(F.window("ts", every).alias("w"), "event_type", own.alias("_own"))
    last = F.max(F.struct("ts", "event_id", "value"))
    return g.agg(last.alias("_l"), F.count("*").alias("n")).select(F.col("w.start").alias("second"), "event_type", F.col("_l.event_id").alias("event_id"), F.col("_l.value").alias("value"), "n")


def counts(events: DataFrame, every: str = "1 hour") -> DataFrame:
    """Events by window and type."""
    if events.isStreaming:
        events = events.withWatermark("ts", "1 minute")
    return events.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def dedup(events: DataFrame, key: list[str], time: str | None = None, keep: str = "1 hour") -> DataFrame:
    """The first event of each key; with a ``time`` column a stream forgets keys after ``keep``, else it keeps them all."""
    if time is None:
        return events.dropDuplicates(key)
    return events.withWatermark(time, keep).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def slow(events: DataFrame, over: float) -> DataFrame:
    return events.filter(F.col("value") > over)


def latest(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The last event of each key by time, then id."""
    return events.groupBy(key).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("_l")).select(key, F.col("_l.event_id").alias("event_id"), F.col("_l.event_type").alias("event_type"))


def longest_runs(events: DataFrame, bad: str, key: str = "user_id") -> DataFrame:
    """(key, longest_run) of events of type ``bad`` in a row by time; batch only."""
    order = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    fine = F.sum((F.col("event_type") != bad).cast("long")).over(order)
    runs = events.withColumn("_run", fine).filter(F.col("event_type") == bad).groupBy(key, "_run").agg(F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest_run"))


def at_threshold(events: DataFrame, bad: str, limit: int, key: str = "user_id") -> DataFrame:
    """(key, event_id) of the event that brings each key to ``limit`` bad ones; batch only."""
    order = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = events.filter(F.col("event_type") == bad).withColumn("_n", F.count("*").over(order))
    return e.filter(F.col("_n") == limit).select(key, "event_id")


def durations(starts: DataFrame, ends: DataFrame, at_most: str = "10 minutes") -> DataFrame:
    """(correlation_id, started_at, ms) of requests that ended; streams keep a start for ``at_most``."""
    s = starts.select("correlation_id", F.col("ts").alias("started_at")).withWatermark("started_at", at_most)
    e = ends.select(F.col("correlation_id").alias("_id"), F.col("ts").alias("_end")).withWatermark("_end", at_most)
    near = (F.col("correlation_id") == F.col("_id")) & (F.col("_end") >= F.col("started_at")) & (F.col("_end") <= F.col("started_at") + F.expr(f"INTERVAL {at_most}"))
    ms = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("_end")) / 1000
    return s.join(e, near).select("correlation_id", "started_at", ms.alias("ms"))


def expired(sessions: DataFrame, now: Column, ttl: str = "8 hours") -> DataFrame:
    """Sessions (last_seen) whose time is over."""
    return sessions.filter(F.col("last_seen") + F.expr(f"INTERVAL {ttl}") <= now)


def until_last(events: DataFrame, key: str = "user_id", last: tuple[str, ...] = LAST) -> DataFrame:
    """Events of each key up to its first terminal one; batch only."""
    order = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(F.col("event_type").isin(*last).cast("int")).over(order), F.lit(0))
    return events.withColumn("_e", ended).filter("_e = 0").drop("_e")


def feed(events: DataFrame, key: str = "user_id", types: tuple[str, ...] = FEED, last: tuple[str, ...] = LAST, beat: float | None = None) -> DataFrame:
    """(key, event_id, event_type): a stream's events of ``types`` up to the first of ``last`` for each key, which is the end of its feed.

    With ``beat``, such as ``BEAT``, a feed that is silent for so many seconds
    gets rows of type ``heartbeat`` without id; such a stream has no last batch,
    so it needs a trigger by time. Within a micro-batch events are taken by time.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.setTimeoutDuration(int(beat * 1000))
            yield pd.DataFrame({key: [k[0]], "event_id": pd.array([None], "Int64"), "event_type": ["heartbeat"]})
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        if state.exists and state.get[0]:
            return
        ended = rows["event_type"].isin(last).to_numpy()
        state.update((bool(ended.any()),))
        if ended.any():
            rows = rows[: ended.argmax() + 1]
        elif beat:
            state.setTimeoutDuration(int(beat * 1000))
        yield pd.DataFrame({key: [k[0]] * len(rows), "event_id": rows["event_id"].astype("Int64").to_numpy(), "event_type": rows["event_type"].to_numpy()})

    narrow = events.filter(F.col("event_type").isin(*types)).select(key, "ts", "event_id", "event_type")
    return narrow.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long, event_type string", "ended boolean", "append", "ProcessingTimeTimeout" if beat else "NoTimeout")


def snapshot(scans: DataFrame) -> DataFrame:
    """One row (scan_id, phase, status, processed_files, total_files, progress_percent): what a feed begins with; an idle one if no scan has run."""
    newest = scans.agg(F.max(F.struct("scan_id", "phase", "status", "processed_files", "total_files")).alias("s")).select("s.*")
    idle = {"scan_id": F.lit(0).cast("long"), "phase": F.lit("idle"), "status": F.lit("idle"), "processed_files": F.lit(0).cast("long"), "total_files": F.lit(0).cast("long")}
    out = newest.select(*(F.coalesce(c, x).alias(c) for c, x in idle.items()))
    return out.withColumn("progress_percent", T.percent(F.col("processed_files"), F.col("total_files")))


def statistics(query) -> dict[str, int]:
    """What a streaming query has done so far: batches and rows that it keeps record of, rows in state and rows that came too late."""
    progress = query.recentProgress
    state = [o for p in progress[-1:] for o in p["stateOperators"]]
    late = sum(o.get("numRowsDroppedByWatermark", 0) for p in progress for o in p["stateOperators"])
    return {"batches": len(progress), "rows": sum(p["numInputRows"] for p in progress), "held": sum(o["numRowsTotal"] for o in state), "dropped": late}


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, and return what it wrote.

    Appended rows go to Parquet in the shared folder; complete results, which
    are small aggregates, to a table in memory.
    """
    spark = stream.sparkSession
    folder = work_folder(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    writer.format("memory").queryName(name).start().awaitTermination()
    return spark.table(name)


def log_sink(events: DataFrame, path: str, checkpoint: str, level: int = 20):
    """Start writing events of a level and above as JSON lines."""
    lines = at_level(events, level).select(F.to_json(F.struct("ts", "level", "event_type", "value", "props")).alias("value"))
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
