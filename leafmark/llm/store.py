"""Sorted arrays in the shared folder, memory-mapped by workers.

Keys are unsigned 64-bit hashes, or numbers from 0 up. The key space is cut into
equal *cells*, so many that one fits a worker, and the cells in a row into at
most ``FILES`` *files*. Rows are dealt by file and sorted by cell; a task merges
one cell after the other and appends it to the arrays of its file, so a file may
outgrow the memory of a task, and a lookup maps a bounded number of files
however large the input.

Files are written under names of their own and then renamed, so a task that runs
again leaves the same file. A file that no row reached does not exist and reads
as empty. Where the shared folder is not a mounted file system, files are
written through its Arrow file system, and each executor copies those that it
maps once into the folder that Spark keeps for the application's files.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files of an array set at most.
FILES = 1024


def mounted(folder: str) -> str | None:
    """The path of a folder on a mounted file system, else None."""
    return folder.removeprefix("file:").replace("///", "/", 1) if folder.startswith("file:") else None if "://" in folder else folder


class Out:
    """The arrays of one file, appended to part by part and renamed when all is written."""

    def __init__(self, folder: str, file: object) -> None:
        self.folder, self.file, self.path = folder, file, mounted(folder)
        self.attempt, self.streams, self.sizes = uuid.uuid4().hex, {}, {}
        if self.path is None:
            self.system, self.path = fs.FileSystem.from_uri(folder)
        else:
            self.system = fs.LocalFileSystem()

    def add(self, name: str, array: np.ndarray) -> None:
        if not len(array):
            return
        if name not in self.streams:
            self.system.create_dir(self.path)
            self.streams[name] = self.system.open_output_stream(f"{self.path}/{name}-{self.file}.{self.attempt}.part")
        self.streams[name].write(np.ascontiguousarray(array).data.cast("B"))
        self.sizes[name] = self.size(name) + len(array)

    def size(self, name: str) -> int:
        """Entries of an array so far."""
        return self.sizes.get(name, 0)

    def __enter__(self) -> Out:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        for name, stream in self.streams.items():
            stream.close()
            part = f"{self.path}/{name}-{self.file}.{self.attempt}.part"
            if kind is not None:
                self.system.delete_file(part)
            elif isinstance(self.system, fs.LocalFileSystem):
                os.replace(part, f"{self.path}/{name}-{self.file}")
            else:
                self.system.move(part, f"{self.path}/{name}-{self.file}")


@lru_cache(maxsize=8 * FILES)
def load(folder: str, name: str, file: object, kind: str = "<u8") -> np.ndarray:
    """An array of a file, mapped read-only."""
    path = mounted(folder)
    if path is None:
        path = _copied(folder, f"{name}-{file}")
    try:
        with open(f"{path}/{name}-{file}", "rb") as f:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), kind)
    except FileNotFoundError:
        return np.empty(0, kind)


def _copied(folder: str, name: str) -> str:
    system, remote = fs.FileSystem.from_uri(folder)
    path = f"{SparkFiles.getRootDirectory()}/{folder.rsplit('/', 1)[1]}"
    if not os.path.exists(f"{path}/{name}") and system.get_file_info(f"{remote}/{name}").type == fs.FileType.File:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/{name}.{uuid.uuid4().hex}.part"
        with system.open_input_stream(f"{remote}/{name}") as source, open(part, "wb") as out:
            while block := source.read(1 << 24):
                out.write(block)
        os.replace(part, f"{path}/{name}")
    return path


@dataclass(frozen=True)
class Layout:
    """Where an array set is, and how ``cells`` cut the keys: hashes by their upper 32 bits, or numbers below ``numbers``."""

    folder: str
    cells: int
    numbers: int = 0

    @property
    def files(self) -> int:
        return min(self.cells, FILES)

    def cell(self, keys: np.ndarray) -> np.ndarray:
        if self.numbers:
            return keys.astype(np.int64) * self.cells // self.numbers
        return ((keys >> np.uint64(32)) * np.uint64(self.cells) >> np.uint64(32)).astype(np.int64)

    def file(self, keys: np.ndarray) -> np.ndarray:
        return self.cell(keys) * self.files // self.cells

    def array(self, name: str, file: int, kind: str = "<u8") -> np.ndarray:
        return load(self.folder, name, file, kind)

    def find(self, name: str, keys: np.ndarray, by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted ``keys``: their files, and the first and end of their places there, which are equal for keys that are not stored.

        ``by``, in the same order, chooses the files where these are not cut by the keys themselves.
        """
        files = self.file(keys if by is None else by)
        first, end = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for file, a, b in stretches(files):
            known = self.array(name, file)
            first[a:b] = np.searchsorted(known, keys[a:b])
            at = first[a:b]
            more = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == keys[a:b]) if len(known) else at[:0]
            end[a:b] = at
            end[a:b][more] = np.searchsorted(known, keys[a:b][more], "right")
        return files, first, end

    def take(self, name: str, files: np.ndarray, places: np.ndarray, kind: str = "<i8", width: int = 1) -> np.ndarray:
        """Entries of an array at places of sorted ``files``; 0 where the place is negative."""
        out = np.zeros((len(places), width), kind)
        for file, a, b in stretches(files):
            found = np.flatnonzero(places[a:b] >= 0) + a
            if len(found):
                out[found] = self.array(name, file, kind).reshape(-1, width)[places[found]]
        return out if width > 1 else out[:, 0]

    def values(self, name: str, of: str, keys: np.ndarray, by: np.ndarray | None = None, width: int = 1) -> np.ndarray:
        """Entries (longs) of the array ``of`` for sorted ``keys`` of the array ``name``, which holds a key once; 0 for others."""
        files, first, end = self.find(name, keys, by)
        return self.take(of, files, np.where(end > first, first, -1), "<i8", width)


def stretches(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of equal neighbours."""
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])).tolist() if len(values) else []
    for a, b in zip(edges, edges[1:]):
        yield int(values[a]), a, b


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    for batch in batches:
        for cell, a, b in stretches(batch.column(1).to_numpy()):
            yield batch.column(0)[a].as_py(), cell, batch.slice(a, b - a)


Merge = Callable[[Out, int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def write(rows: DataFrame, layout: Layout, merge: Merge, ddl: str) -> DataFrame:
    """Deal ``rows`` (cell long, ...) to files and merge them cell by cell; what the merges yield is a table of ``ddl``.

    A merge gets the batches of a cell, with a file number put before their
    columns, and adds arrays to the file. Cells of a file come in order.
    """
    cells, files = layout.cells, layout.files
    dealt = rows.select(F.expr(f"CAST(cell * {files} div {cells} AS INT)").alias("file"), *rows.columns)
    sorted_rows = dealt.repartitionById(files, "file").sortWithinPartitions("file", "cell")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, own in groupby(_slices(batches), itemgetter(0)):
            with Out(layout.folder, file) as out:
                for cell, parts in groupby(own, itemgetter(1)):
                    yield from merge(out, cell, (part for _, _, part in parts))

    return sorted_rows.mapInArrow(stream, ddl)
