"""Tables that a job writes in order to cut its lineage.

Every intermediate goes to the folder that the session names in
``spark.checkpoint.dir``; all executors share it, so a lost executor costs a
re-read and nothing else. Only a local session without that setting (tests,
notebooks) gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
#: Paths that this driver handed out, in order.
_made: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder, as a URI without a trailing slash."""
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="leafmark-")
    return _local_root


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses, below a folder of this application."""
    _made.append(f"{root(spark)}/leafmark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def mark(spark: SparkSession) -> int:
    """Where ``free`` begins."""
    return len(_made)


def free(spark: SparkSession, since: int, but: DataFrame) -> None:
    """Delete what was written since ``mark`` and is of no more use, all but the table ``but``."""
    keep = {path.rstrip("/").rsplit("/", 2)[-2] for path in but.inputFiles()}
    for path in _made[since:]:
        if path.rsplit("/", 1)[1] not in keep:
            _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete everything that this application wrote below the shared folder."""
    _delete(spark, f"{root(spark)}/leafmark/{spark.sparkContext.applicationId}")
