"""Ranked lexical search by Fagin's threshold algorithm.

One pass over the texts counts, for blocks of documents, the terms of each and
how often it holds the terms of the queries; these counts are the *forward
index*, written to the shared folder. Searching turns a block's counts into
impacts and sorts the documents of each term by them. A query reads its lists in
turns, a few entries of each, looks up whole scores of the documents that it
meets in the forward index, and stops when no document further down can reach
the last place, that is when the sum of the impacts at the ends of what it read
is strictly below the score of the k-th. A task keeps its best documents from
one block to the next, so later blocks stop sooner; the best of all tasks are
merged by rank.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm import scratch
from leafmark.llm.words import as_bytes, chunks, terms

#: Places of a ranking, bytes of query texts that share a pass over the documents, bytes of text of a block, and entries of a list that the first turn reads.
PLACES, QUERIES, BLOCK, TURN = 20, 1 << 20, 8 << 20, 32
#: Fixed values of the score: the share of the length in percent, and the steepness times 1,000.
LENGTH_SHARE, STEEP, ONE = 25, 12, 1_000_000_000


def forward_index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_ids, sizes, starts, terms, counts) of blocks of documents (doc_id, text).

    ``sizes`` are all terms of a document; those of ``vocabulary`` that it holds
    are numbers in ascending order from ``starts`` on, with their counts.
    """
    numbers = {t: i for i, t in enumerate(vocabulary)}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in chunks(batches, limit=BLOCK):
            sizes, starts, held, counts = [], [0], [], []
            for text in texts:
                found: Counter[int] = Counter()
                size = 0
                for part in terms(text):
                    size += len(part)
                    found.update(filter(None.__ne__, map(numbers.get, part)))
                own = sorted(found)
                sizes.append(size)
                starts.append(starts[-1] + len(own))
                held += own
                counts += [found[t] for t in own]
            arrays = [pa.array([np.array(x, kind).tobytes()]) for x, kind in ((sizes, "<i8"), (starts, "<i8"), (held, "<i4"), (counts, "<i4"))]
            yield pa.RecordBatch.from_arrays([pa.array([piece.column(0).to_pylist()], pa.list_(pa.int64())), *arrays], ["doc_ids", "sizes", "starts", "terms", "counts"])

    ddl = "doc_ids array<long>, sizes binary, starts binary, terms binary, counts binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(apply, ddl)


def statistics(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and the documents that hold each term of the vocabulary, which bounds what the driver gets."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some, total = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            for sizes, own in zip(batch.column(0), batch.column(1)):
                sizes = np.frombuffer(sizes.as_buffer(), "<i8")
                some, total = some + int(np.count_nonzero(sizes)), total + int(sizes.sum())
                held += np.bincount(np.frombuffer(own.as_buffer(), "<i4"), minlength=n_terms)
        known = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-2, -1], known)), pa.array(np.append([some, total], held[known]))], ["term", "n"])

    rows = index.select("sizes", "terms").mapInArrow(apply, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(t, 0) for t in range(n_terms)], np.int64)


class Best:
    """The k best (score, doc_id) so far: higher scores, then smaller ids, null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.unnamed = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """Score of the k-th; 0 while there are fewer."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        good = (scores > 0) & (scores >= self.least)
        if not good.any():
            return
        scores, ids, unnamed = (np.concatenate(x) for x in ((self.scores, scores[good]), (self.ids, ids[good]), (self.unnamed, unnamed[good])))
        order = np.lexsort((ids, unnamed, -scores))[: self.k]
        self.scores, self.ids, self.unnamed = scores[order], ids[order], unnamed[order]


class Block:
    """Impact-sorted lists and the forward index of one block."""

    def __init__(self, row: dict, weights: np.ndarray, some: int, total: int) -> None:
        sizes, self.starts, self.terms, counts = (np.frombuffer(row[c], kind).astype(np.int64) for c, kind in (("sizes", "<i8"), ("starts", "<i8"), ("terms", "<i4"), ("counts", "<i4")))
        ids = pa.array(row["doc_ids"], pa.int64())
        self.unnamed = np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy()
        self.width = len(weights)
        docs = np.repeat(np.arange(len(sizes)), np.diff(self.starts))
        length = 100 - LENGTH_SHARE + (LENGTH_SHARE * sizes * some) // max(1, total)
        self.impacts = weights[self.terms] * ((ONE * counts) // (1000 * counts + STEEP * length[docs]))
        self.keys = docs * self.width + self.terms  # ascending
        order = np.lexsort((-self.impacts, self.terms))
        self.docs, self.sorted = docs[order], self.impacts[order]
        self.lists = np.searchsorted(self.terms[order], np.arange(self.width + 1))

    def scores(self, docs: np.ndarray, query: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Whole scores of documents, looked up in the forward index."""
        keys = (docs[:, None] * self.width + query[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = np.where(self.keys[at] == keys, self.impacts[at], 0).reshape(len(docs), len(query))
        return found @ times

    def search(self, query: np.ndarray, times: np.ndarray, best: Best) -> int:
        """Put the documents of this block into the ranking of a query, terms in ascending order with their repeats. Returns how many entries were read."""
        at, end = self.lists[query], self.lists[query + 1]
        query, times, at, end = (x[end > at] for x in (query, times, at, end))
        seen = np.zeros(len(self.ids), bool)
        turn, read = TURN, 0
        while len(at):
            upto = np.minimum(at + turn, end)
            size = upto - at
            places = np.arange(int(size.sum())) + np.repeat(at - np.append(0, np.cumsum(size)[:-1]), size)
            read += len(places)
            fresh = np.zeros(len(self.ids), bool)
            fresh[self.docs[places]] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            if len(new):
                best.add(self.scores(new, query, times), self.ids[new], self.unnamed[new])
            # lists that are read to their end add nothing; no document that is still unseen scores more than the others' last impacts
            more = upto < end
            if int(self.sorted[upto[more] - 1] @ times[more]) < best.least:
                break
            at, end, turn = np.where(more, upto, end), end, 2 * turn
            if not more.any():
                break
        return read


def _ranked(docs: DataFrame, queries: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """(item, doc_id, score, rank) for queries of some bytes in all."""
    vocabulary = sorted({t for _, own in queries for t in own})
    index = scratch.store(forward_index(docs, vocabulary), "forward")
    some, total, held = statistics(index, len(vocabulary))
    weights = np.array([int(x) for x in np.floor(1000 * np.log((2 * some + 2) / (2 * held + 1)))], np.int64)
    numbers = {t: i for i, t in enumerate(vocabulary)}
    asked = []
    for item, own in queries:
        counts = Counter(numbers[t] for t in own)
        terms_of = np.array(sorted(counts), np.int64)
        asked.append((item, terms_of, np.array([counts[t] for t in terms_of.tolist()], np.int64)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Best(k) for item, _, _ in asked}
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block({c: batch.column(c)[i].as_py() for c in batch.schema.names}, weights, some, total)
                for item, own, times in asked:
                    block.search(own, times, best[item])
        for item, found in best.items():
            ids = pa.array(found.ids, pa.int64(), mask=found.unnamed)
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), ids, pa.array(found.scores)], ["item", "doc_id", "score"])

    found = index.mapInArrow(apply, "item long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = PLACES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs`` (doc_id, text) with a score above 0 for each row of ``queries`` (item_id, text).

    Null and empty texts have no terms: such a document is in no ranking, such a
    query has none. Equal scores go by doc_id, null ids last. Rows that repeat
    are documents of their own; a query that repeats is ranked again, also under
    one item_id. Other columns are left out; empty tables give an empty table.
    Long texts are read part by part. Queries are taken in blocks of about
    ``QUERIES`` bytes, one pass over the documents each.
    """
    spark = docs.sparkSession
    kind = queries.schema["item_id"].dataType.simpleString()
    asked = queries.select("item_id", F.col("text").cast("binary").alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).head()[0]
    blocks = max(1, -(-size // QUERIES))
    out = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        own = [(i, [t for part in terms(text) for t in part]) for i, text in enumerate(as_bytes(pa.array([r["text"] for r in rows], pa.binary())))]
        named = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {kind}")
        found = _ranked(docs, own, k).join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")  # as many as a block has queries
        out = found if out is None else out.unionAll(found)
    return out


def op13_threshold_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark text."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return search(docs.select("doc_id", "text"), items.select("item_id", "text"))


_TERM = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""WITH every AS (SELECT doc_id, unnest({_TERM}) AS term FROM documents), sizes AS (SELECT doc_id, COUNT(*) AS n FROM every GROUP BY doc_id),
totals AS (SELECT COUNT(*) AS nn, CAST(SUM(n) AS BIGINT) AS ll FROM sizes), tfs AS (SELECT doc_id, term, COUNT(*) AS tf FROM every GROUP BY doc_id, term), dfs AS (SELECT term, COUNT(*) AS df FROM tfs GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM dfs, totals),
lengths AS (SELECT doc_id, 75 + (25 * n * nn) // ll AS m FROM sizes, totals),
impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS impact FROM tfs JOIN lengths USING (doc_id) JOIN weights USING (term)),
asked AS (SELECT item_id, unnest({_TERM}) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, CAST(SUM(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20"""
