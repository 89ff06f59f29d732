"""Interpolated modified Kneser-Ney bigram model over all training documents.

Workers count in runs of about a million tokens and shuffle the runs as packed
sorted arrays, one for each cell of the key space. The model is sorted arrays in
the shared folder (``store``): word hashes with counts; pairs of word numbers
with counts; and what the estimates need of each word. Scoring maps them into
memory and looks up sorted runs. Nothing but totals, discounts and the number of
words in each file reaches the driver.

Pairs lie in the cell of their first word. Those of a word with more than ``hot``
tokens, and of the start of documents, lie in the cells of their second words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import scratch, store
from leafmark.llm.words import Tokens, arrow_schema, chunks, joined, tokens

#: The end of a document, as a word's hash.
END = np.uint64(1)
COUNTED = "cell long, hot boolean, keys binary, counts binary"
KINDS = "kind string, cell long, keys binary, counts binary, n1 long, n2 long, n3 long, n4 long"
SEEN = "pairs long, more long, n1 long, n2 long, n3 long, n4 long"


@dataclass(frozen=True)
class Counting:
    """``run``: tokens of a counting run, which bounds what a worker holds; ``cell``: text bytes for each cell; ``hot``: tokens from which a word's pairs are spread. None of these changes a score."""

    run: int = 1_000_000
    cell: int = 16 << 20
    hot: int = 1 << 20


@dataclass
class Model:
    """Where the arrays are and what holds for all of them.

    ``vocabulary``, by hash: v the hashes, c the counts. By word number: in
    ``pairs`` b and n (first word and second, with counts), q and o (second and
    first where the first is hot), t and u (words with their total and the
    numbers of followers seen once, twice and more often); in ``preceded`` k and
    m (words with the number of words before them), g and s (t and u of hot
    words). ``offsets``: the number of each file's first word. Number ``words`` is
    the start of a document, which is hot.
    """

    vocabulary: store.Layout
    offsets: np.ndarray
    tokens: int
    hot: int
    pairs: store.Layout | None = None
    preceded: store.Layout | None = None
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    lower: tuple[float, float, float] = (0.0, 0.0, 0.0)
    different: int = 0
    spare: float = 1.0

    @property
    def words(self) -> int:
        return int(self.offsets[-1])

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of sorted word hashes, or -1, and their counts."""
        files, first, end = self.vocabulary.find("v", hashes)
        known = end > first
        return np.where(known, self.offsets[files] + first, -1), self.vocabulary.take("c", files, np.where(known, first, -1))


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Discounts for counts 1, 2 and more from how many have counts 1 to 4; half a count where too few are seen to tell."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5)
    return tuple(min(max(x, 0.0), k) for x, k in zip(d, (1.0, 2.0, 3.0)))


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(counts > 2, d[2], np.where(counts == 2, d[1], np.where(counts == 1, d[0], 0.0)))


def _histogram(counts: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(counts == k) for k in (1, 2, 3, 4)], np.int64)


class Sums:
    """Sums of counts by key, out of packed runs; merged whenever twice as much is held as after the last merge."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held, self.limit = [], [], 0, 1 << 22

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > self.limit:
            keys, counts = self.done()
            self.keys, self.counts, self.held, self.limit = [keys], [counts], len(keys), max(1 << 22, 2 * len(keys))

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted different keys and their sums."""
        if not self.keys:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        k, c = np.concatenate(self.keys), np.concatenate([x.astype(np.int64) for x in self.counts])
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = _firsts(k)
        return k[first], np.add.reduceat(c, first) if len(k) else c


def _firsts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def _add_all(sums: Sums, part: pa.RecordBatch, kind: str = "<u4") -> None:
    for keys, counts in zip(part.column("keys").to_pylist(), part.column("counts").to_pylist()):
        sums.add(np.frombuffer(keys, "<u8"), np.frombuffer(counts, kind))


def _by_word(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different words in order, and the sums of their rows."""
    order = np.argsort(words, kind="stable")
    words, rows = words[order], rows[order]
    first = _firsts(words)
    return words[first], np.add.reduceat(rows, first) if len(words) else rows


def token_runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows, token hashes and where each row's tokens begin, about ``size`` tokens at a time; every row ends with END."""
    rows, parts, n = [], [], 0
    for piece, texts in chunks(batches, limit=1 << 20):
        parts.append(tokens(texts, lower=True))
        rows.append(piece)
        n += len(parts[-1].begin) + len(texts)
        if n >= size:
            yield _with_ends(rows, joined(parts))
            rows, parts, n = [], [], 0
    if rows:
        yield _with_ends(rows, joined(parts))


def _with_ends(rows: list[pa.RecordBatch], t: Tokens) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    docs = np.arange(len(t.starts) - 1)
    word = np.ones(len(t.hashes) + len(docs), bool)
    word[t.starts[1:] + docs] = False
    run = np.full(len(word), END)
    run[word] = t.hashes
    return pa.Table.from_batches(rows), run, t.starts[:-1] + docs


def _batch(rows: Iterable[tuple], ddl: str) -> pa.RecordBatch:
    schema, rows = arrow_schema(ddl), list(rows)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _text(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, F.col("text").cast("binary").alias("text"))


def train(docs: DataFrame, how: Counting = Counting()) -> Model:
    """A model of documents (text); null texts are empty and count as documents. No rows give a model without words."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))).head()[0] or 0
    cells = max(4, -(-total // how.cell))
    vocabulary = store.Layout(scratch.fresh(spark, "vocabulary"), cells)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, run, _ in token_runs(batches, how.run):
            keys, counts = np.unique(run, return_counts=True)
            yield _batch([(cell, False, keys[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()) for cell, a, b in store.stretches(vocabulary.cell(keys))], COUNTED)

    def merge_words(out: store.Out, cell: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for part in parts:
            _add_all(sums, part)
        keys, counts = sums.done()
        out.add("v", keys)
        out.add("c", counts)
        yield _batch([(cell * vocabulary.files // cells, len(keys), int(counts.sum()))], "file int, words long, tokens long")

    merged = store.write(_text(docs).mapInArrow(count_words, COUNTED), vocabulary, merge_words, "file int, words long, tokens long")
    merged = scratch.store(merged, "words").groupBy("file").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).collect()  # a row a file
    words = np.zeros(vocabulary.files, np.int64)
    for r in merged:
        words[r["file"]] = r["words"]
    m = Model(vocabulary, np.concatenate([[0], np.cumsum(words)]), sum(r["tokens"] for r in merged), how.hot)
    if not m.tokens:
        return m
    if m.words >= (1 << 32) - 1:
        raise ValueError("a pair holds two word numbers of 32 bits, and there are more different words")
    m.pairs = store.Layout(scratch.fresh(spark, "pairs"), cells, m.words + 1)
    m.preceded = store.Layout(scratch.fresh(spark, "preceded"), cells, m.words + 1)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, run, starts in token_runs(batches, how.run):
            different, inverse = np.unique(run, return_inverse=True)
            numbers, counts = m.look_up(different)
            second = numbers[inverse]
            first = np.concatenate([[0], second[:-1]])
            hot = np.concatenate([[False], (counts > m.hot)[inverse][:-1]])
            first[starts], hot[starts] = m.words, True
            for spread in (False, True):
                own = hot == spread
                by, other = (second[own], first[own]) if spread else (first[own], second[own])
                keys, n = np.unique(by.astype(np.uint64) << np.uint64(32) | other.astype(np.uint64), return_counts=True)
                yield _batch([(cell, spread, keys[a:b].tobytes(), n[a:b].astype("<u4").tobytes()) for cell, a, b in store.stretches(m.pairs.cell(keys >> np.uint64(32)))], COUNTED)

    def merge_pairs(out: store.Out, cell: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cold, spread = Sums(), Sums()
        for part in parts:
            hot = part.column("hot")
            _add_all(cold, part.filter(pc.invert(hot)))
            _add_all(spread, part.filter(hot))
        keys, counts = cold.done()
        out.add("b", keys)
        out.add("n", counts)
        kinds = lambda n: np.stack([n, n == 1, n == 2, n > 2], axis=1).astype(np.int64)
        words, sums = _by_word(keys >> np.uint64(32), kinds(counts))
        out.add("t", words)
        out.add("u", sums)
        hot_keys, hot_counts = spread.done()
        out.add("q", hot_keys)
        out.add("o", hot_counts)
        low = np.uint64(0xFFFFFFFF)
        follow, times = np.unique(np.concatenate([keys & low, hot_keys >> np.uint64(32)]), return_counts=True)
        rows = [("w", c, follow[a:b].tobytes(), times[a:b].astype("<i8").tobytes(), 0, 0, 0, 0) for c, a, b in store.stretches(m.preceded.cell(follow))]
        words, sums = _by_word(hot_keys & low, kinds(hot_counts))
        rows += [("h", c, words[a:b].tobytes(), sums[a:b].tobytes(), 0, 0, 0, 0) for c, a, b in store.stretches(m.preceded.cell(words))]
        rows.append(("n", cell, b"", b"", *(_histogram(counts) + _histogram(hot_counts)).tolist()))
        yield _batch(rows, KINDS)

    written = scratch.store(store.write(_text(docs).mapInArrow(count_pairs, COUNTED), m.pairs, merge_pairs, KINDS), "followers")
    m.discounts = discounts(np.array(written.filter("kind = 'n'").agg(*(F.sum(f"n{k}") for k in (1, 2, 3, 4))).head()))

    def merge_preceded(out: store.Out, cell: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, hot_words, hot_sums = Sums(), [np.empty(0, np.uint64)], [np.empty((0, 4), np.int64)]
        for part in parts:
            of_hot = pc.equal(part.column("kind"), "h")
            _add_all(before, part.filter(pc.invert(of_hot)), "<i8")
            for keys, counts in zip(part.filter(of_hot).column("keys").to_pylist(), part.filter(of_hot).column("counts").to_pylist()):
                hot_words.append(np.frombuffer(keys, "<u8"))
                hot_sums.append(np.frombuffer(counts, "<i8").reshape(-1, 4))
        words, counts = before.done()
        out.add("k", words)
        out.add("m", counts)
        hot, sums = _by_word(np.concatenate(hot_words), np.concatenate(hot_sums))
        out.add("g", hot)
        out.add("s", sums)
        yield _batch([(int(counts.sum()), int(np.count_nonzero(counts > 2)), *_histogram(counts).tolist())], SEEN)

    seen = scratch.store(store.write(written.filter("kind != 'n'").select("cell", "kind", "keys", "counts"), m.preceded, merge_preceded, SEEN), "preceded")
    pairs, more, *n = seen.agg(*(F.sum(c) for c in seen.columns)).head()
    m.different, m.lower = pairs, discounts(np.array(n))
    m.spare = (m.lower[0] * n[0] + m.lower[1] * n[1] + m.lower[2] * more) / pairs
    return m


def word_scores(m: Model, run: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training count and log10 probability of each token of a run."""
    if not m.tokens:
        return np.zeros(len(run), np.int64), np.zeros(len(run))
    different, inverse = np.unique(run, return_inverse=True)
    numbers, counts = m.look_up(different)
    # words by number, unknown ones first, and behind them the start of documents
    order = np.argsort(numbers, kind="stable")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    numbers, counts, second = np.append(numbers[order], m.words), np.append(counts[order], 0), back[inverse]
    known = numbers >= 0
    hot = counts > m.hot
    hot[-1] = True
    words = numbers[known].astype(np.uint64)
    preceded, stats = np.zeros(len(numbers), np.int64), np.zeros((len(numbers), 4), np.int64)
    preceded[known] = m.preceded.values("k", "m", words)
    stats[known] = np.where(hot[known, None], m.preceded.values("g", "s", words, width=4), m.pairs.values("t", "u", words, width=4))
    lower = np.maximum(preceded - _discount(preceded, m.lower), 0) / max(1, m.different) + m.spare / (m.words + 1)
    first = np.concatenate([[0], second[:-1]])
    first[starts] = len(numbers) - 1
    rest = np.where(stats[:, 0] > 0, (stats[:, 1:] * np.array(m.discounts)).sum(axis=1) / np.maximum(stats[:, 0], 1), 1.0)
    p = rest[first] * lower[second]
    for spread, pair, count in ((False, "b", "n"), (True, "q", "o")):
        at = np.flatnonzero(known[first] & known[second] & (stats[first, 0] > 0) & (hot[first] == spread))
        a, b = numbers[first[at]].astype(np.uint64), numbers[second[at]].astype(np.uint64)
        keys, place = np.unique((b << np.uint64(32) | a) if spread else (a << np.uint64(32) | b), return_inverse=True)
        c = m.pairs.values(pair, count, keys, keys >> np.uint64(32))[place]
        p[at] += np.maximum(c - _discount(c, m.discounts), 0) / stats[first[at], 0]
    return counts[second], np.log10(p)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, m: Model, how: Counting = Counting()) -> DataFrame:
    """SCORES of documents (doc_id, held_out, text).

    ``base_score`` is the log10 probability by add-one counts of single tokens,
    ``score`` the model's; ``10 ** (-score / n_tokens)`` is the perplexity. A
    null or empty text has the end as its one token.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, run, starts in token_runs(batches, how.run):
            counts, logs = word_scores(m, run, starts)
            base = np.log10((counts + 1) / (m.tokens + m.words + 1))
            sums = [np.add.reduceat(x, starts) for x in ((counts > 0).astype(np.int64), base, logs)]
            lengths = np.diff(np.concatenate([starts, [len(run)]]))
            out = pa.Table.from_arrays([rows.column("doc_id"), rows.column("held_out"), *map(pa.array, (lengths, *sums))], schema=arrow_schema(SCORES))
            yield from out.combine_chunks().to_batches()

    return _text(docs, F.col("doc_id").cast("long").alias("doc_id"), "held_out").mapInArrow(apply, SCORES)


def op7_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model of six sevenths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    docs = docs.select("doc_id", held.alias("held_out"), "text")
    m = train(docs.filter("not held_out"))
    return score(docs, m).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(m.tokens).cast("long").alias("train_tokens"), "base_score", "score")
