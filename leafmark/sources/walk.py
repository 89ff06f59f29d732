"""Folders walked level by level as Spark jobs, and files read and hashed where their rows are.

The driver lists nothing: each level's folders are dealt to tasks, which write
what they find; only whether a level has folders comes back. Local folders are
listed as they are, others through the file systems that pyarrow knows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.session import work_folder

FOUND = "path string, is_folder boolean, length long, modified_us long, error string"
#: Rows of a batch of a listing, and bytes of a read.
BATCH, CHUNK = 10_000, 1 << 20


def local(path: str) -> str | None:
    """The plain path of a local file or folder; None for other file systems."""
    if path.startswith("/"):
        return path
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else None


def opened(path: str):
    """A file of any known file system, open for reading."""
    if (plain := local(path)) is not None:
        return open(plain, "rb")
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_stream(name)


def created(path: str):
    """A file of any known file system, open for writing; its folders are made."""
    if (plain := local(path)) is not None:
        os.makedirs(os.path.dirname(plain), exist_ok=True)
        return open(plain, "wb")
    system, name = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(name))
    return system.open_output_stream(name)


def _local_entries(plain: str) -> Iterator[tuple]:
    with os.scandir(plain) as entries:
        for e in entries:
            try:
                if e.is_dir(follow_symlinks=False):
                    yield f"file:{e.path}", True, 0, 0, None
                elif e.is_file():  # a link to a file is a file; links to folders aren't followed, so no walk is endless
                    s = e.stat()
                    yield f"file:{e.path}", False, s.st_size, s.st_mtime_ns // 1000, None
            except OSError as error:
                yield f"file:{e.path}", False, None, None, str(error)


def _entries(folder: str) -> Iterator[tuple]:
    if (plain := local(folder)) is not None:
        yield from _local_entries(plain)
        return
    system, name = fs.FileSystem.from_uri(folder)
    scheme = folder[: folder.index(name)] if name in folder else folder.split("://")[0] + "://"
    for i in system.get_file_info(fs.FileSelector(name)):
        yield scheme + i.path, i.type == fs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 1000, None


def _listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "is_folder", "length", "modified_us", "error"]
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"length": "Int64", "modified_us": "Int64"})
    for given in frames:
        rows = []
        for folder in given["path"]:
            try:
                for row in _entries(folder):
                    rows.append(row)
                    if len(rows) >= BATCH:
                        yield frame(rows)
                        rows = []
            except OSError as error:
                rows.append((folder, False, None, None, str(error)))
        if rows:
            yield frame(rows)


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified_us, error) of all files below a folder, those without bytes too.

    A folder that can't be read is a row with its error and the others go on; one
    that doesn't exist is such a row. Links to files are files, links to folders
    are left out. Levels are kept in the shared folder until the session's is cleared.
    """
    at, levels = work_folder(spark, "walk"), []
    front = spark.createDataFrame([(folder,)], "path string")
    while True:
        level = f"{at}/{len(levels)}"
        front.mapInPandas(_listed, FOUND).write.parquet(level)
        levels.append(spark.read.schema(FOUND).parquet(level))
        front = levels[-1].filter("is_folder").select("path")
        if front.isEmpty():
            break
        front = front.repartition(spark.sparkContext.defaultParallelism)
    return reduce(DataFrame.unionAll, levels).filter("NOT is_folder").drop("is_folder")


def _schema(files: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)


def hashed(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """``files`` (file_path, ...) with file_hash, read in pieces by the tasks that have their rows; null for empty and unreadable files.

    ``algorithm`` is a name that hashlib knows; ValueError for others.
    """
    hashlib.new(algorithm)

    def read(path: str) -> str | None:
        digest, some = hashlib.new(algorithm), False
        try:
            with opened(path) as f:
                while piece := f.read(CHUNK):
                    digest.update(piece)
                    some = True
        except OSError:
            return None
        return digest.hexdigest() if some else None

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(file_hash=pd.Series([read(p) for p in frame["file_path"]], dtype=object, index=frame.index))

    plain = files.drop("file_hash")
    return plain.mapInPandas(add, f"{_schema(plain)}, file_hash string")


def contents(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """``files`` (file_path, ...) with content and file_hash; a task holds one file at a time, those that can't be read have neither."""
    hashlib.new(algorithm)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, path in enumerate(frame["file_path"]):
                try:
                    with opened(path) as f:
                        data = f.read()
                except OSError:
                    data = None
                digest = hashlib.new(algorithm, data).hexdigest() if data else None
                yield frame[i : i + 1].assign(content=pd.Series([data], dtype=object, index=frame.index[i : i + 1]), file_hash=pd.Series([digest], dtype=object, index=frame.index[i : i + 1]))

    plain = files.drop("content", "file_hash")
    return plain.mapInPandas(add, f"{_schema(plain)}, content binary, file_hash string")


def manifest(files: DataFrame, folder: str, run: int, parts: int) -> None:
    """Write the files (file_path) of a scan as run ``run`` of a manifest, in ``parts`` lists; again with the same number replaces it."""
    files.select("file_path").repartition(parts).write.mode("overwrite").parquet(f"{folder}/run={run:09d}")
