"""Bookkeeping around scans and queries: scan records, module registry, cached status, time limits, slow queries."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark import schemas
from leafmark.operators.ingest import upsert

#: Seconds that a status is good for, and between two refreshes.
FRESH, PAUSE = 300.0, 30.0


def start_scan(scans: DataFrame, phase: str) -> DataFrame:
    """``scans`` with a running record behind the latest."""
    now = F.current_timestamp()
    row = scans.agg((F.coalesce(F.max("scan_id"), F.lit(0)) + 1).alias("scan_id")).select(
        "scan_id", F.lit(phase).alias("phase"), F.lit("running").alias("status"), now.alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"),
        F.lit(0).cast("long").alias("total_files"), F.lit(0).cast("long").alias("processed_files"), F.lit(None).cast("string").alias("current_file"), F.lit(0).cast("long").alias("errors"),
    )
    return scans.unionByName(row)


def complete_scan(scans: DataFrame, scan_id: int, counters: DataFrame, failed: bool = False) -> DataFrame:
    """``scans`` with one record completed from the one row of ``counters``."""
    c = F.broadcast(counters.select(F.col("total").alias("_total"), F.col("processed").alias("_done"), F.col("error").alias("_errors")))
    mine = (F.col("scan_id") == scan_id) & (F.col("status") == "running")
    new = {"status": F.lit("failed" if failed else "completed"), "completed_at": F.current_timestamp(), "total_files": F.col("_total"), "processed_files": F.col("_done"), "errors": F.col("_errors")}
    return scans.crossJoin(c).select(*(F.when(mine, new[n]).otherwise(F.col(n)).alias(n) if n in new else F.col(n) for n in scans.columns))


def empty_scans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.SCAN_STATE)


def register_modules(registry: DataFrame, manifests: DataFrame, status: str = "loaded") -> DataFrame:
    """The registry with a row for each manifest, replacing rows of the same names."""
    rows = manifests.select("module_name", "version", "api_version", F.lit(status).alias("status"), "scan_phase", "description", F.to_json("managed_tables").alias("managed_tables"), "data_version", F.lit(None).cast("string").alias("error_message"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("initialized_at"))
    return upsert(registry, rows, "module_name")


def set_module_status(registry: DataFrame, name: str, status: str, error: str | None = None) -> DataFrame:
    mine = F.col("module_name") == name
    return registry.withColumn("status", F.when(mine, status).otherwise(F.col("status"))).withColumn("error_message", F.when(mine, F.lit(error)).otherwise(F.col("error_message")))


def setting(value: Column, kind: str) -> Column:
    """A setting's text as ``string``, ``int`` or ``boolean``; null where it is none."""
    if kind == "boolean":
        low = F.lower(F.trim(value))
        return F.when(low.isin("true", "1", "yes", "on"), True).when(low.isin("false", "0", "no", "off"), False)
    return F.trim(value).try_cast("int") if kind == "int" else value


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


@dataclass
class StatusCache:
    """The last index state, made anew when it is old or asked for, but not twice within ``PAUSE`` seconds unless forced."""

    make: Callable[[], object]
    clock: Callable[[], float] = time.monotonic
    value: object = None
    made: float = field(default=float("-inf"))

    def get(self, refresh: bool = False, force: bool = False) -> object:
        age = self.clock() - self.made
        if force or age >= FRESH or (refresh and age >= PAUSE):
            self.value, self.made = self.make(), self.clock()
        return self.value


#: Seconds that operations may take.
LIMITS = {
    "scan.extract": 300.0, "scan.directory_scan": 600.0, "scan.db_write_batch": 60.0, "scan.cache_load": 30.0, "scan.cancel_grace": 5.0, "index.refresh": 600.0,
    "search.query": 30.0, "document.page_load": 30.0, "document.delete": 30.0,
}


def within(spark: SparkSession, seconds: float | None, action: Callable[[], object], name: str = "search.query", publish: Callable[[dict], None] | None = None) -> object:
    """What ``action`` returns; TimeoutError, an event and its Spark jobs cancelled if it takes longer, by default than ``LIMITS`` says for ``name``."""
    seconds = LIMITS[name] if seconds is None else seconds
    context, group = spark.sparkContext, f"leafmark-{name}-{time.monotonic_ns()}"
    timer = threading.Timer(seconds, lambda: context.cancelJobGroup(group))
    began = time.monotonic()
    context.setJobGroup(group, name, interruptOnCancel=True)
    timer.start()
    try:
        return action()
    except Exception as error:
        if time.monotonic() - began >= seconds:
            if publish:
                publish({"event_type": "operation.timed_out", "operation": name, "timeout_seconds": seconds})
            raise TimeoutError(f"{name} took more than {seconds} s") from error
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def watch(df: DataFrame, action: Callable[[DataFrame], object], publish: Callable[[dict], None], slow_ms: float = 1000.0) -> object:
    """Run an action; publish its time and plan if it was slow, its error if it failed."""
    began = time.monotonic()
    try:
        out = action(df)
    except Exception as error:
        publish({"event_type": "db.error", "error_type": type(error).__name__, "message": str(error)[:500]})
        raise
    if (took := (time.monotonic() - began) * 1000) > slow_ms:
        publish({"event_type": "db.query_slow", "duration_ms": took, "plan": df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))})
    return out
