"""Tables that change together: immutable parts, and a list of parts for each version.

A change writes its rows as a part of their own and becomes visible with the
list that names it, which is renamed into place in one step. Whoever reads a
version keeps reading it while later ones are written; a change that breaks off
leaves a part that no list names. Rows of a document are replaced by a part that
names the document as gone from all earlier parts.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The table of documents that a part replaces or deletes.
GONE = "gone"


class Conflict(Exception):
    """Another writer made the next version first."""


@dataclass(frozen=True)
class Part:
    """``order`` grows from change to change; ``about`` holds numbers that the writer knows."""

    name: str
    order: int
    tables: dict[str, str]
    about: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Versions:
    """The tables below ``path`` as of one version; 0 has none. ``tables`` are schemas by name; each has a doc_id."""

    spark: SparkSession
    path: str
    version: int
    parts: tuple[Part, ...]

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> Versions:
        """The newest version, or the one with a number; KeyError if that doesn't exist."""
        folder, system = cls._folder(spark, path)
        numbers = [int(s.getPath().getName()[:-5]) for s in system.listStatus(folder) if s.getPath().getName().endswith(".json")] if system.exists(folder) else []
        wanted = max(numbers, default=0) if version is None else version
        if not wanted:
            return cls(spark, path, 0, ())
        if wanted not in numbers:
            raise KeyError(wanted)
        stream = system.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{wanted:012d}.json"))
        told = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        return cls(spark, path, wanted, tuple(Part(**p) for p in told))

    @staticmethod
    def _folder(spark: SparkSession, path: str):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_versions")
        return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, tables: dict[str, DataFrame], about: dict[str, float] | None = None, order: int | None = None) -> Part:
        """Write a part; nobody sees it before ``commit``."""
        name = uuid.uuid4().hex
        for table, rows in tables.items():
            rows.write.parquet(f"{self.path}/{name}/{table}")
        nth = max((p.order for p in self.parts), default=0) + 1 if order is None else order
        return Part(name, nth, {table: rows.schema.json() for table, rows in tables.items()}, about or {})

    def commit(self, parts: tuple[Part, ...]) -> Versions:
        """Make ``parts`` the next version; Conflict if there is one already."""
        jvm = self.spark.sparkContext._jvm
        folder, system = self._folder(self.spark, self.path)
        beside, target = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(folder, f"{self.version + 1:012d}.json")
        out = system.create(beside, False)
        out.write(bytearray(json.dumps([p.__dict__ for p in parts]).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            context.rename(context.makeQualified(beside), context.makeQualified(target), options)
        except Py4JJavaError as error:
            system.delete(beside, False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                raise Conflict(self.version + 1) from None
            raise
        return Versions(self.spark, self.path, self.version + 1, tuple(parts))

    def add(self, tables: dict[str, DataFrame], gone: DataFrame | None = None, about: dict[str, float] | None = None) -> Versions:
        """The next version: rows of ``tables`` are added, and the documents ``gone`` (doc_id) lose all that they had."""
        if gone is not None and self.parts:
            tables = tables | {GONE: gone.select("doc_id").distinct()}
        return self.commit((*self.parts, self.write(tables, about)))

    def read(self, part: Part, table: str) -> DataFrame:
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(part.tables[table]))).parquet(f"{self.path}/{part.name}/{table}")

    def raw(self, table: str, parts: tuple[Part, ...] | None = None) -> DataFrame | None:
        """Rows of all parts with ``_order``; None if no part has the table."""
        found = [self.read(p, table).withColumn("_order", F.lit(p.order)) for p in (self.parts if parts is None else parts) if table in p.tables]
        return reduce(lambda a, b: a.unionByName(b), found) if found else None

    def alive(self, rows: DataFrame) -> DataFrame:
        """``rows`` (doc_id, _order) that no later part replaced or deleted, without ``_order``."""
        gone = self.raw(GONE)
        if gone is None:
            return rows.drop("_order")
        last = gone.groupBy("doc_id").agg(F.max("_order").alias("_gone"))
        kept = rows.join(last, "doc_id", "left").filter("_gone IS NULL OR _gone <= _order")
        return kept.select(*(c for c in rows.columns if c != "_order"))

    def table(self, name: str) -> DataFrame | None:
        """A table as of this version."""
        rows = self.raw(name)
        return None if rows is None else self.alive(rows)
