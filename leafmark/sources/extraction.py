"""Pages and word boxes from files: a data source for batches and streams, with extraction guarded by a deadline.

Scans write lists of files (``walk.manifest``); a list is a partition of the
source, so planning reads names of lists only. A stream takes the lists of new runs.
"""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import count, islice

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from leafmark.functions import text as T
from leafmark.operators.scans import LIMITS
from leafmark.sources.walk import local, opened

WORD = "x0 double, y0 double, x1 double, y1 double, original string, block_no int, line_no int, word_no int"
PAGE = f"doc_id string, outcome string, error string, page_count int, page_number int, piece int, text string, page_width double, page_height double, words array<struct<{WORD.replace(' double', ': double').replace(' string', ': string').replace(' int', ': int')}>>"


#: Words of a row at most: a page with more has further rows, numbered by ``piece``, without text.
PIECE = 1 << 16
#: Bytes of texts and rows of a batch that an extractor's process hands over.
TEXT, ROWS = 1 << 22, 1024
_WORD = pa.struct([(n, t) for n, t in zip(("x0", "y0", "x1", "y1", "original", "block_no", "line_no", "word_no"), [pa.float64()] * 4 + [pa.string()] + [pa.int32()] * 3)])
_FOUND = pa.schema([("page_number", pa.int32()), ("piece", pa.int32()), ("text", pa.string()), ("page_width", pa.float64()), ("page_height", pa.float64()), ("words", pa.list_(_WORD))])
_ROW = pa.schema([("doc_id", pa.string()), ("outcome", pa.string()), ("error", pa.string()), ("page_count", pa.int32()), *_FOUND])


@dataclass
class Page:
    """What an extractor finds on a page; ``words`` are tuples of ``WORD``, which may come from a generator."""

    text: str
    width: float = 0.0
    height: float = 0.0
    words: Iterable[tuple] = ()


#: Bytes of a file to its pages, which may come from a generator; an error or None where it can't be opened.
Extractor = Callable[[bytes], Iterable[Page] | None]


def _packed(rows: list[tuple], words: list[tuple], ends: list[int]) -> bytes:
    columns = list(zip(*words)) or [()] * len(_WORD)
    flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WORD)], fields=list(_WORD))
    plain = [pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)]
    batch = pa.record_batch([*plain, pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), flat)], schema=_FOUND)
    return batch.serialize().to_pybytes()


def _batches(pages: Iterable[Page]) -> tuple[int, list[bytes]]:
    """The number of pages, and their rows as packed batches; only one batch at a time is held as objects."""
    out, number, rows, words, ends, size = [], -1, [], [], [], 0
    for number, page in enumerate(pages):
        rest = iter(page.words)
        for piece in count():
            part = list(islice(rest, PIECE))
            if piece and not part:
                break
            rows.append((number, piece, None if piece else page.text, float(page.width), float(page.height)))
            words += part
            ends.append(len(words))
            size += 0 if piece else len(page.text)
            if len(words) >= PIECE or size >= TEXT or len(rows) >= ROWS:
                out.append(_packed(rows, words, ends))
                rows, words, ends, size = [], [], [], 0
            if len(part) < PIECE:
                break
    if rows:
        out.append(_packed(rows, words, ends))
    return number + 1, out


class Guard:
    """Runs an extractor in a child process of the worker, which is killed and replaced when a file takes longer than ``seconds``.

    Zero or less: no limit. A child that dies (out of memory, a crash in a native
    library) fails its file only. Rows come over as Arrow batches, one at a time.
    """

    def __init__(self, extract: Extractor, seconds: float):
        self.extract, self.seconds, self.child, self.pipe = extract, seconds, None, None

    def _serve(self, pipe) -> None:
        while True:
            try:
                data = pipe.recv_bytes()
            except EOFError:
                return
            try:
                pages = self.extract(data)
                if pages is None:
                    pipe.send(("error", "can't be opened", None, 0))
                    continue
                number, found = _batches(pages)
            except Exception as error:  # any broken file
                pipe.send(("error", f"{type(error).__name__}: {error}"[:500], None, 0))
                continue
            pipe.send(("ok", None, number, len(found)))
            for batch in found:
                pipe.send_bytes(batch)
            del found

    def _told(self, data: bytes) -> tuple[str, str | None, int | None, int]:
        if self.child is None:
            context = multiprocessing.get_context("fork")
            self.pipe, other = context.Pipe()
            self.child = context.Process(target=self._serve, args=(other,), daemon=True)
            self.child.start()
            other.close()
        try:
            self.pipe.send_bytes(data)
            if self.pipe.poll(self.seconds if self.seconds > 0 else None):
                return self.pipe.recv()
        except (EOFError, OSError):
            self.close()
            return "error", "the extractor died", None, 0
        self.close()
        return "timed_out", f"operation.timed_out: scan.extract took more than {self.seconds} s", None, 0

    def rows(self, path: str, data: bytes) -> Iterator[pa.RecordBatch]:
        """Rows of ``PAGE`` of a file; outcomes are ``ok``, ``error`` and ``timed_out``. EOFError if the child dies while it hands over, for the task to be run again."""
        outcome, error, number, batches = self._told(data)
        if not batches:
            yield _without_page(path, outcome, error, number)
        for _ in range(batches):
            found = pa.ipc.read_record_batch(self.pipe.recv_bytes(), _FOUND)
            same = [pa.array([v] * len(found), f.type) for v, f in zip((path, outcome, error, number), _ROW)]
            yield pa.RecordBatch.from_arrays([*same, *found.columns], schema=_ROW)

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None


def _without_page(path: str, outcome: str, error: str | None, number: int | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((path, outcome, error, number, *[None] * len(_FOUND)), _ROW)], schema=_ROW)


@dataclass
class FileList(InputPartition):
    path: str


def _lists(folder: str, after: int = -1, until: int | None = None) -> list[FileList]:
    """The lists of finished runs with numbers above ``after`` and up to ``until``."""
    system, top = (fs.LocalFileSystem(), local(folder)) if local(folder) else fs.FileSystem.from_uri(folder)
    out = []
    for number in _runs(folder):
        if number > after and (until is None or number <= until):
            found = system.get_file_info(fs.FileSelector(f"{top}/run={number:09d}"))
            out += [FileList(i.path) for i in found if i.base_name.startswith("part-")]
    return out


def _runs(folder: str) -> list[int]:
    system, top = (fs.LocalFileSystem(), local(folder)) if local(folder) else fs.FileSystem.from_uri(folder)
    folders = [i for i in system.get_file_info(fs.FileSelector(top, allow_not_found=True)) if i.base_name.startswith("run=")]
    marks = system.get_file_info([f"{i.path}/_SUCCESS" for i in folders])
    return sorted(int(i.base_name[4:]) for i, m in zip(folders, marks) if m.type == fs.FileType.File)


class _Pages:
    """Rows of ``PAGE`` of the files of a list."""

    def __init__(self, folder: str, seconds: float, extract: Extractor):
        self.folder, self.seconds, self.extract = folder, seconds, extract

    def read(self, partition: FileList | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no lists
            return
        system = fs.LocalFileSystem() if local(self.folder) else fs.FileSystem.from_uri(self.folder)[0]
        guard = Guard(self.extract, self.seconds)
        try:
            for batch in pq.ParquetFile(system.open_input_file(partition.path)).iter_batches(1024, columns=["file_path"]):
                for path in batch.column(0).to_pylist():
                    yield from self._file(path, guard)
        finally:
            guard.close()

    @staticmethod
    def _file(path: str, guard: Guard) -> Iterator[pa.RecordBatch]:
        try:
            with opened(path) as f:
                data = f.read()
        except OSError as error:
            yield _without_page(path, "error", str(error), None)
            return
        yield from guard.rows(path, data)


class _Batch(_Pages, DataSourceReader):
    def partitions(self) -> list[FileList]:
        return _lists(self.folder)


class _Stream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"run": -1}

    def latestOffset(self) -> dict:
        return {"run": max(_runs(self.folder), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[FileList]:
        return _lists(self.folder, start["run"], end["run"])

    def commit(self, end: dict) -> None:
        pass


def source(extract: Extractor, short_name: str = "leafmark_pages") -> type[DataSource]:
    """A data source class around an extractor, for ``spark.dataSource.register``.

    Options: ``path``, the folder of the lists, and ``seconds`` a file. A file
    without pages, or one that failed, gives one row without page.
    """

    class PageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return short_name

        def schema(self) -> str:
            return PAGE

        def _given(self) -> tuple:
            return self.options["path"], float(self.options.get("seconds", LIMITS["scan.extract"])), extract

        def reader(self, schema) -> DataSourceReader:
            return _Batch(*self._given())

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(*self._given())

    return PageSource


def read(spark: SparkSession, lists: str, extract: Extractor, seconds: float | None = None, short_name: str = "leafmark_pages", stream: bool = False) -> DataFrame:
    """Pages of the files in the lists of a folder, as a table or a stream."""
    spark.dataSource.register(source(extract, short_name))
    reader = (spark.readStream if stream else spark.read).format(short_name).option("path", lists)
    return reader.option("seconds", LIMITS["scan.extract"] if seconds is None else seconds).load()


def boxes(pages: DataFrame) -> DataFrame:
    """Word boxes of read pages, as ``highlights`` takes them."""
    words = pages.select("doc_id", "page_number", "page_width", "page_height", F.explode("words").alias("w"))
    return words.select("doc_id", "page_number", "w.*", T.normalize_text(F.col("w.original")).alias("normalized"), "page_width", "page_height")


def timed_out(pages: DataFrame) -> DataFrame:
    """Events (event_type, file_path, message) of the files whose extraction was stopped."""
    return pages.filter("outcome = 'timed_out'").select(F.lit("operation.timed_out").alias("event_type"), F.col("doc_id").alias("file_path"), F.col("error").alias("message"))
