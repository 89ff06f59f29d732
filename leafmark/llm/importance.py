"""Drawing documents that look like a target: importance weights over hashed features, by an external sort-count.

A pass over the texts writes the bucket of each feature as a packed stream of
unsigned 16-bit numbers, with the places where documents begin. Counting sorts
these streams and encodes their runs; weighing gathers the gains of a stream and
sums them from one document's place to the next. Texts are read once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import ranks, scratch
from leafmark.llm.words import chunks, terms

#: Buckets of features, words of a feature at most, words of a document that may be drawn, percent of these that are drawn, and the seed of the draw.
BUCKETS, RUN, LEAST, PERCENT, SEED = 10_000, 1, 20, 10, 2024


class _Buckets(dict):
    """Bucket of each feature that a worker has met lately."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.buckets
        return bucket


def _stream(text: bytes, buckets: _Buckets, run: int) -> tuple[np.ndarray, int]:
    """Buckets of all runs of 1 to ``run`` words, and the number of words."""
    out, words, last = [], 0, []
    for part in terms(text):
        words += len(part)
        out.append(np.fromiter(map(buckets.__getitem__, part), "<u2", len(part)))
        for k in range(2, run + 1):  # runs that end in this part
            reach = last[len(last) - k + 1 :] + part if len(last) >= k - 1 else last + part
            out.append(np.array([buckets[b" ".join(reach[i : i + k])] for i in range(len(reach) - k + 1)], "<u2"))
        last = (last + part)[-(run - 1) :] if run > 1 else []
    return np.concatenate(out) if out else np.empty(0, "<u2"), words


def streams(docs: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(doc_ids, n_words, starts, stream) of blocks of documents: their ids and words, where each begins and the last ends in the stream of buckets."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket is an unsigned 16-bit number")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for piece, texts in chunks(batches):
            rows = [_stream(text, known, run) for text in texts]
            starts = np.cumsum([0] + [len(s) for s, _ in rows]).astype("<i8")
            packed = np.concatenate([s for s, _ in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([[n for _, n in rows]], pa.list_(pa.int64())), pa.array([starts.tobytes()]), pa.array([packed.tobytes()])],
                ["doc_ids", "n_words", "starts", "stream"],
            )

    ddl = "doc_ids array<long>, n_words array<long>, starts binary, stream binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(apply, ddl)


def bucket_counts(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket long, n long) over all streams: each is sorted and its runs are counted; a task sends one row a bucket at most."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                values = np.sort(np.frombuffer(cell.as_buffer(), "<u2"))
                edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)
                total[values[edges[:-1]]] += np.diff(edges)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return blocks.select("stream").mapInArrow(apply, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from the counts (bucket, n) of both sides. One row a bucket reaches the driver, so the parameter bounds it."""
    every = documents.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(documents.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    total = both.agg(F.sum("s").cast("double").alias("_s"), F.sum("t").cast("double").alias("_t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * (F.col("_s") + buckets) / ((s + 1) * (F.col("_t") + buckets))
    rows = both.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()  # one row of totals
    out = np.zeros(buckets, np.int64)
    out[[r["bucket"] for r in rows]] = [r["gain"] for r in rows]
    return out


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of the documents of ``streams``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                starts = np.frombuffer(batch.column(2)[i].as_buffer(), "<i8")
                size = np.diff(starts)
                gathered = np.append(gain[np.frombuffer(batch.column(3)[i].as_buffer(), "<u2")], 0)
                weight = np.where(size > 0, np.add.reduceat(gathered, starts[:-1]), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(size), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(apply, "doc_id long, n_words long, n_features long, weight long")


def draw(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, run: int = RUN, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all ``docs`` (doc_id, text); ``rank`` numbers those that are drawn to look like ``target`` (text).

    Scores are weights with Gumbel noise that follows from seed and doc_id, so
    the best ones are a draw without replacement. Null and empty texts have no
    features and weight 0, and are drawn only with ``least`` 0. Equal scores go
    by doc_id, null ids last, with the noise of an empty id; rows that repeat
    are documents of their own, and which of equal rows has which rank makes no
    difference. Other columns are left out. An empty target has no counts;
    empty ``docs`` give an empty table. Long texts are read part by part.
    """
    blocks = scratch.store(streams(docs, buckets, run), "streams")
    wanted = streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, run)
    weighed = weights(blocks, gains(bucket_counts(blocks, buckets), bucket_counts(wanted, buckets), buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("_may", F.col("n_words") >= least)
    placed = ranks.in_order(scored, [F.desc("_may"), F.desc("score"), F.asc_nulls_last("doc_id")])
    drawn = F.expr(f"{int(percent)} * _all div 100")
    total = placed.agg(F.coalesce(F.sum(F.col("_may").cast("long")), F.lit(0)).alias("_all"))
    rank = F.when(F.col("_may") & (F.col("_rank") < drawn), F.col("_rank") + 1)
    return placed.crossJoin(F.broadcast(total)).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))  # one row


def op11_sort_count_resampling(spark, sf_dir: str) -> DataFrame:
    """All documents with their weights towards the benchmark's texts, and the ranks of the tenth that is drawn."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return draw(docs.select("doc_id", "text"), target.select("text"))


_SHIFT = "list_reduce(list_prepend({x}, range(CAST(8 AS BIGINT))), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)"
_COUNTS = "SELECT crc % 10000 AS bucket, COUNT(*) AS n FROM {side} JOIN crcs USING (word) GROUP BY bucket"
#: The CRC of a word goes over its bytes in hexadecimal.
OP11_SQL = f"""WITH shifts AS (SELECT list({_SHIFT.format(x="i")} ORDER BY i) AS t FROM range(256) r(i)),
words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM documents),
target AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
digits AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM words UNION SELECT word FROM target)),
bytes AS (SELECT word, list_transform(range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)) AS b FROM digits),
crcs AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS crc FROM bytes, shifts),
s AS ({_COUNTS.format(side="words")}), t AS ({_COUNTS.format(side="target")}),
totals AS (SELECT CAST((SELECT COALESCE(SUM(n), 0) FROM s) AS DOUBLE) AS ss, CAST((SELECT COALESCE(SUM(n), 0) FROM t) AS DOUBLE) AS tt),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(COALESCE(t.n, 0) AS DOUBLE) + 1) * (ss + 10000) / ((CAST(s.n AS DOUBLE) + 1) * (tt + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket), totals),
weighed AS (SELECT doc_id, COUNT(*) AS n_features, CAST(SUM(g) AS BIGINT) AS weight FROM words JOIN crcs USING (word) JOIN gain ON gain.bucket = crc % 10000 GROUP BY doc_id),
every AS (SELECT d.doc_id, COALESCE(n_features, 0) AS n_features, COALESCE(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM documents d LEFT JOIN weighed USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM every),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, COUNT(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM placed"""
