"""Counts of what streams and subscribers do: observed metrics through a listener, and queues with a limit."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


class Counters(StreamingQueryListener):
    """Sums over all batches of each query: rows, batches, rows that came too late, and the observed metrics, which must be counts.

    Keeps sums only, so its size doesn't grow with batches; ``addListener`` it to
    ``spark.streams`` and read a query by its run id.
    """

    def __init__(self) -> None:
        self._sums: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self._ended: dict[str, threading.Event] = defaultdict(threading.Event)
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._sums[str(event.runId)]["running"] = 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            sums = self._sums[str(p.runId)]
            sums["batches"] += 1
            sums["rows"] += max(p.numInputRows, 0)
            sums["late"] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
            for name, row in p.observedMetrics.items():
                for metric, n in row.asDict().items():
                    sums[f"{name}.{metric}"] += n or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._sums[str(event.runId)]["running"] = 0
            ended = self._ended[str(event.runId)]
        ended.set()

    def of(self, run_id: str, seconds: float = 0.0) -> dict[str, int]:
        """The sums of a query; with ``seconds`` waits so long for its end to be told, TimeoutError if it isn't."""
        with self._lock:
            ended = self._ended[run_id]
        if seconds and not ended.wait(seconds):
            raise TimeoutError(f"the end of {run_id} wasn't told in {seconds} s")
        with self._lock:
            return dict(self._sums[run_id])


def observed(events: DataFrame, name: str, **what: Column) -> DataFrame:
    """``events`` with counts of the rows where each condition holds, and of all; for batches (``Observation``) and streams."""
    return events.observe(name, F.count(F.lit(1)).alias("all"), *(F.count_if(c).alias(n) for n, c in what.items()))


def admitted(events: DataFrame, limit: int, every: str = "1 second", key: str = "user_id") -> DataFrame:
    """Events that each subscriber's queue takes: the first ``limit`` of each span by time and id; batch only.

    A queue that holds ``limit`` and is emptied once a span drops what comes when it is full.
    """
    place = Window.partitionBy(key, F.window("ts", every)).orderBy("ts", "event_id")
    return events.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= limit).drop("_n")


def queues(events: DataFrame, limit: int, every: str = "1 second", key: str = "user_id") -> DataFrame:
    """(key, published, delivered, dropped, peak) of each subscriber whose queue takes ``limit`` events a span; two aggregations, so a busy subscriber is no single task."""
    n = F.count("*").alias("n")
    spans = events.filter(F.col("ts").isNotNull()).groupBy(key, F.window("ts", every).alias("w")).agg(n)
    taken = F.least(F.col("n"), F.lit(limit))
    return spans.groupBy(key).agg(F.sum("n").alias("published"), F.sum(taken).alias("delivered"), F.sum(F.col("n") - taken).alias("dropped"), F.max(taken).cast("long").alias("peak"))
