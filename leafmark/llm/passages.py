"""Substring dedup by repeated-phrase automata.

A passage is a window of ``window`` words. Its *anchor* is the phrase of
``phrase`` words in it with the least hash, so equal passages have equal
anchors, and a document has about one anchor for every eight words.

1. Anchors are counted over all documents; what occurs once can't be in a
   recurring passage.
2. The words around recurring anchors are gathered by anchor and compared: the
   passages found twice are confirmed. The store keeps for each phrase its
   confirmed passages, with their words and first places.
3. All documents stream through Aho-Corasick automata. One of all phrases would
   not fit a worker, so each run of documents compiles the shard of those that it
   may hold, out of the mapped store. A place that the automaton reports leads to
   the passages of its phrase, and to nothing else; those with the words around
   the place are occurrences, and the words of occurrences that also start earlier
   elsewhere are removed.

Hashes choose what to gather, to compile and to compare. Words decide. A phrase
that anchors more than ``hot`` places is gathered and found by whole passages
instead, so its many surroundings lie in many cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import scratch, store
from leafmark.llm.words import Tokens, arrow_schema, chunks, joined, span_hashes, tokens

#: The order of a document without an id: behind all others.
LAST = np.iinfo(np.int64).max
COUNTED = "cell long, keys binary, counts binary"
AROUND = "cell long, keys binary, docs binary, starts binary, counts binary, phrases binary, texts binary"


@dataclass(frozen=True)
class Passages:
    """Words of a passage and of a phrase.

    ``run``: words of a run; ``cell``: text bytes for each cell; ``hot``: places from which a
    phrase is hot; ``gathered``: surroundings of a cell from which repeats among
    them are merged before more are read; ``bits``: those of a hash. None of these
    changes a result.
    """

    window: int = 20
    phrase: int = 4
    run: int = 500_000
    cell: int = 4 << 20
    hot: int = 1 << 15
    gathered: int = 1 << 17
    bits: int = 64


@dataclass
class Run:
    """Rows of some documents and their words."""

    rows: pa.Table
    tokens: Tokens
    raw: bytes

    @property
    def starts(self) -> np.ndarray:
        return self.tokens.starts

    def words(self, first: int, end: int) -> bytes:
        """Words ``first`` to ``end`` of a document, joined by one space."""
        t = self.tokens
        return self.raw[t.begin[first] : t.begin[end - 1] + t.size[end - 1]]


def runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Run]:
    """Runs of about ``size`` words; a longer document is a run of its own."""
    rows, parts, n = [], [], 0

    def done() -> Run:
        t = joined(parts)
        return Run(pa.Table.from_batches(rows), t, t.text.tobytes())

    for piece, texts in chunks(batches, limit=1 << 20):
        parts.append(tokens(texts))
        rows.append(piece)
        n += len(parts[-1].begin)
        if n >= size:
            yield done()
            rows, parts, n = [], [], 0
    if rows:
        yield done()


def hash_spans(hashes: np.ndarray, k: int, bits: int = 64) -> np.ndarray:
    """A hash of each k words in a row; its upper ``bits``."""
    return span_hashes(hashes, k) & np.uint64((1 << 64) - (1 << (64 - bits)))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of the first least one, by windows that double in width."""
    n, size = len(values) - width + 1, 1
    best, at = values, np.arange(len(values))
    while size < width:
        step = min(size, width - size)
        n_now = len(best) - step
        right = best[step:] < best[:n_now]
        at = np.where(right, at[step:], at[:n_now])
        best = np.minimum(best[:n_now], best[step:])
        size += step
    return at[:n]


@dataclass
class Marked:
    """Passages of a run that begin at ``starts`` and whose anchors begin at ``anchors``; hashes of all phrases and passages by where they begin."""

    starts: np.ndarray
    anchors: np.ndarray
    phrases: np.ndarray
    passages: np.ndarray


def marked(run: Run, p: Passages) -> Marked:
    hashes = run.tokens.hashes
    n, ends = len(hashes), run.starts[1:]
    phrases = hash_spans(hashes, p.phrase, p.bits)
    if n < p.window:
        return Marked(np.empty(0, np.int64), np.empty(0, np.int64), phrases, np.empty(0, np.uint64))
    whole = np.arange(n - p.window + 1) + p.window <= np.repeat(ends, np.diff(run.starts))[: n - p.window + 1]
    starts = np.flatnonzero(whole)
    return Marked(starts, least_places(phrases, p.window - p.phrase + 1)[starts], phrases, hash_spans(hashes, p.window, p.bits))


def _doc_ids(run: Run) -> np.ndarray:
    return np.array([LAST if x is None else x for x in run.rows.column("doc_id").to_pylist()], np.int64)


def _owners(run: Run, at: np.ndarray) -> np.ndarray:
    """The document, by its place in the run, that a word is in."""
    return np.searchsorted(run.starts, at, "right") - 1


def _firsts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _all(parts: list[pa.RecordBatch], name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for part in parts for x in part.column(name).to_pylist()])


@dataclass
class Spans:
    """Groups of passages that share an anchor: passages ``first`` to ``last`` begin one word after the other. ``key`` is the hash of ``size`` words at ``at`` that leads to them."""

    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    at: np.ndarray
    size: np.ndarray


def spans(m: Marked, recurring: store.Layout, p: Passages) -> Spans:
    """Passages whose anchors recur: all of an anchor together, those of hot anchors one by one."""
    begins = _firsts(m.anchors)  # passages of an anchor are neighbours
    places, counts = m.anchors[begins], np.diff(np.concatenate([begins, [len(m.anchors)]]))
    keys, back = np.unique(m.phrases[places], return_inverse=True)
    files, first, end = recurring.find("r", keys)
    hot = (recurring.take("h", files, np.where(end > first, first, -1), "u1") > 0)[back]
    known = (end > first)[back]
    cold = known & ~hot
    one = np.repeat(known & hot, counts)
    low = m.starts[begins[cold]]
    alone = m.starts[one]
    sizes = np.concatenate([np.full(len(low), p.phrase), np.full(len(alone), p.window)])
    return Spans(np.concatenate([low, alone]), np.concatenate([low + counts[cold] - 1, alone]), np.concatenate([m.phrases[places[cold]], m.passages[alone]]), np.concatenate([places[cold], alone]), sizes)


@dataclass
class Store:
    """Layout of the recurring anchors (r, and h: whether they are hot) and of the confirmed passages.

    Of phrases, by hash: a the hashes, e the ends of their words in x, f the ends
    of their passages. Of passages: w the hashes, d and s the first places, t and
    l where their words are in y.
    """

    anchors: store.Layout
    passages: store.Layout


def confirm(docs: DataFrame, p: Passages) -> Store:
    """Steps 1 and 2 over documents (doc_id, text)."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))).head()[0] or 0
    cells = max(4, -(-total // p.cell))
    found = Store(store.Layout(scratch.fresh(spark, "anchors"), cells), store.Layout(scratch.fresh(spark, "passages"), cells))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, p.run):
            m = marked(run, p)
            keys, counts = np.unique(m.phrases[m.anchors[_firsts(m.anchors)]], return_counts=True)
            yield _batch([(cell, keys[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()) for cell, a, b in store.stretches(found.anchors.cell(keys))], COUNTED)

    def merge_anchors(out: store.Out, cell: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(parts)
        keys, counts = _all(held, "keys", "<u8"), _all(held, "counts", "<u4")
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = _firsts(keys)
        sums = np.add.reduceat(counts, first)
        out.add("r", keys[first][sums > 1])
        out.add("h", (sums[sums > 1] > p.hot).astype("u1"))
        yield _batch([(cell,)], "cell long")

    store.write(docs.mapInArrow(count_anchors, COUNTED), found.anchors, merge_anchors, "cell long").count()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, p.run):
            s = spans(marked(run, p), found.anchors, p)
            owner = _owners(run, s.first)
            docs_of, starts_of = _doc_ids(run)[owner].tolist(), (s.first - run.starts[owner]).tolist()
            whole = (s.size == p.window).tolist()
            seen: dict[bytes, list] = {}
            t = run.tokens
            for i, (a, b) in enumerate(zip(t.begin[s.first].tolist(), (t.begin + t.size)[s.last + p.window - 1].tolist())):
                text, here = run.raw[a:b], (docs_of[i], starts_of[i])
                known = seen.get(text)
                if known is None:
                    seen[text] = [here, 1, i]
                else:
                    known[1] += 1
                    if here < known[0]:
                        known[0] = here
            at = np.array([x[2] for x in seen.values()], np.int64)
            texts, keys = list(seen), s.key[at]
            order = np.argsort(keys, kind="stable")
            place = np.array([x[0] for x in seen.values()], np.int64).reshape(-1, 2)[order]
            counts = np.array([x[1] for x in seen.values()], "<u4")[order]
            # where the phrase begins; 255 for whole passages
            phrase = np.where(np.array(whole, bool)[at], 255, s.at[at] - s.first[at]).astype("u1")[order]
            order, keys = order.tolist(), keys[order]
            yield _batch([(cell, keys[a:b].tobytes(), place[a:b, 0].tobytes(), place[a:b, 1].tobytes(), counts[a:b].tobytes(), phrase[a:b].tobytes(), b"\n".join(texts[i] for i in order[a:b])) for cell, a, b in store.stretches(found.passages.cell(keys))], AROUND)

    def merge_passages(out: store.Out, cell: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Gathered(p.gathered)
        for part in parts:
            g.add(part)
        g.confirmed(out, p)
        yield _batch([(cell,)], "cell long")

    store.write(docs.mapInArrow(gather, AROUND), found.passages, merge_passages, "cell long").count()
    return found


class Gathered:
    """Surroundings of anchors in one cell: ``texts`` with key, first place, count and where the phrase begins."""

    def __init__(self, limit: int) -> None:
        self.texts: list[bytes] = []
        self.columns: list[np.ndarray] = [np.empty(0, kind) for kind in ("<u8", "<i8", "<i8", "<i8", "u1")]
        self.least = self.limit = limit

    def add(self, part: pa.RecordBatch) -> None:
        for text in part.column("texts").to_pylist():
            self.texts += text.split(b"\n")
        kinds = (("keys", "<u8"), ("docs", "<i8"), ("starts", "<i8"), ("counts", "<u4"), ("phrases", "u1"))
        self.columns = [np.concatenate([old, _all([part], name, kind)]) for old, (name, kind) in zip(self.columns, kinds)]
        if len(self.texts) > self.limit:
            self.merge()
            self.limit = max(self.least, 2 * len(self.texts))

    def merge(self) -> None:
        """Equal surroundings become one with the least place and the sum of counts."""
        number: dict[bytes, int] = {}
        group = np.fromiter((number.setdefault(t, len(number)) for t in self.texts), np.int64, len(self.texts))
        keys, docs, starts, counts, phrases = self.columns
        order = np.lexsort((starts, docs, group))
        first = order[_firsts(group[order])]
        sums = np.bincount(group, weights=counts, minlength=len(number)).astype(np.int64)  # exact below 2**53
        self.texts, self.columns = list(number), [keys[first], docs[first], starts[first], sums, phrases[first]]

    def confirmed(self, out: store.Out, p: Passages) -> None:
        """Add phrases with their confirmed passages to the arrays of a file."""
        self.merge()
        keys, docs, starts, counts, phrases = self.columns
        if not self.texts:
            return
        t = tokens(self.texts)
        ids, first_word = numbered(t), t.starts[:-1]
        # phrases by hash, then by words
        whole = phrases == 255
        begin = first_word + np.where(whole, 0, phrases)
        size = np.where(whole, p.window, p.phrase)
        end = begin + size - 1
        phrase_of = grouped(keys, ids, begin, size)
        # passages in each surrounding, told apart by their words' numbers
        each = np.diff(t.starts) - p.window + 1
        of = np.repeat(np.arange(len(each)), each)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        at_word = first_word[of] + inner
        key = hash_spans(t.hashes, p.window, p.bits)[at_word]
        passage = grouped(key, ids, at_word, np.full(len(of), p.window))
        order = np.argsort(passage, kind="stable")
        first = _firsts(passage[order])
        doc, start = docs[of][order], (starts[of] + inner)[order]
        least = np.minimum.reduceat(doc, first)
        least_start = np.minimum.reduceat(np.where(doc == np.repeat(least, np.diff([*first, len(order)])), start, LAST), first)
        twice = np.add.reduceat(counts[of][order], first) > 1
        chosen, least, least_start = order[first[twice]], least[twice], least_start[twice]
        if not len(chosen):
            return
        phrase = phrase_of[of[chosen]]
        order = np.lexsort((key[chosen], phrase))
        chosen, least, least_start, phrase = chosen[order], least[order], least_start[order], phrase[order]
        used = np.unique(of[chosen])
        base = np.zeros(len(each), np.int64)
        spread = np.array([len(self.texts[i]) + 1 for i in used.tolist()], np.int64)
        base[used] = out.size("y") + np.cumsum(spread) - spread
        starts_at, last = t.begin[at_word[chosen]], at_word[chosen] + p.window - 1
        passages = out.size("w")
        out.add("y", np.frombuffer(b"\n".join(self.texts[i] for i in used.tolist()) + b"\n", "u1"))
        out.add("w", key[chosen])
        out.add("d", least)
        out.add("s", least_start)
        out.add("t", base[of[chosen]] + starts_at - t.begin[first_word[of[chosen]]])
        out.add("l", t.begin[last] + t.size[last] - starts_at)
        held, at, n = np.unique(phrase, return_index=True, return_counts=True)
        names = of[chosen[at]]  # a surrounding of each phrase
        raw, low, high = t.text.tobytes(), t.begin[begin[names]].tolist(), (t.begin + t.size)[end[names]].tolist()
        texts = [raw[a:b] for a, b in zip(low, high)]
        out.add("a", keys[names])
        out.add("e", out.size("x") + np.cumsum([len(x) for x in texts]))
        out.add("x", np.frombuffer(b"".join(texts), "u1"))
        out.add("f", passages + np.cumsum(n))


def numbered(t: Tokens) -> np.ndarray:
    """A number for each word, the same for the same bytes only; by hashes, and where these deceive by the words themselves."""
    _, at, ids = np.unique(t.hashes, return_index=True, return_inverse=True)
    like = t.begin[at][ids]
    same = (t.size == t.size[at][ids]).all()
    for a in range(0, len(ids) if same else 0, 1 << 16):  # bytes are compared a few words at a time
        n = t.size[a : a + (1 << 16)]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = same and np.array_equal(t.text[np.repeat(t.begin[a : a + (1 << 16)], n) + inner], t.text[np.repeat(like[a : a + (1 << 16)], n) + inner])
    if same:
        return ids.astype(np.int32)
    raw, seen = t.text.tobytes(), {}
    return np.array([seen.setdefault(raw[a : a + n], len(seen)) for a, n in zip(t.begin.tolist(), t.size.tolist())], np.int32)


def grouped(keys: np.ndarray, ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each span of words, in the order of ``keys``; the same for the same key and words only."""
    _, at, group = np.unique(keys, return_index=True, return_inverse=True)
    like, same = begin[at][group], size == size[at][group]
    for k in range(int(size.max()) if len(size) else 0):
        inner = np.flatnonzero(size > k) if size.min() <= k else slice(None)
        same[inner] &= ids[np.minimum(begin[inner] + k, len(ids) - 1)] == ids[np.minimum(like[inner] + k, len(ids) - 1)]
    if same.all():
        return group
    names = [(key, *ids[a : a + n].tolist()) for key, a, n in zip(keys.tolist(), begin.tolist(), size.tolist())]
    number = {name: i for i, name in enumerate(sorted(set(names)))}
    return np.array([number[name] for name in names], np.int64)


@dataclass
class Phrases:
    """Phrases of a run's automaton: ``words``, the file of each, and its passages there, ``first`` to ``end``."""

    words: list[bytes]
    files: np.ndarray
    first: np.ndarray
    end: np.ndarray


def called(keys: np.ndarray, s: Store) -> Phrases:
    """The phrases of the store with one of the hashes ``keys``."""
    files, first, end = s.passages.find("a", np.unique(keys))
    n = end - first
    files, place = np.repeat(files, n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    words, low, high = [], np.zeros(len(files), np.int64), np.zeros(len(files), np.int64)
    for file, a, b in store.stretches(files):
        ends, text, last = s.passages.array("e", file, "<i8"), s.passages.array("x", file, "u1"), s.passages.array("f", file, "<i8")
        at = place[a:b]
        for x, y in zip(np.where(at > 0, ends[at - 1], 0).tolist(), ends[at].tolist()):
            words.append(text[x:y].tobytes())
        low[a:b], high[a:b] = np.where(at > 0, last[at - 1], 0), last[at]
    return Phrases(words, files, low, high)


def automaton(phrases: list[bytes]) -> ahocorasick.Automaton | None:
    """Of phrases, each with its number; bytes are characters of Latin-1, so places are byte offsets."""
    if not phrases:
        return None
    a = ahocorasick.Automaton()
    for i, phrase in enumerate(phrases):
        a.add_word(phrase.decode("latin-1"), i)
    a.make_automaton()
    return a


def occurrences(run: Run, phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of a run that begin one of ``phrases``, and the numbers of these; all documents stream through the automaton.

    What begins or ends within a word is no occurrence.
    """
    a, t = automaton(phrases), run.tokens
    found = np.array(list(a.iter(run.raw.decode("latin-1"))) if a else [], np.int64).reshape(-1, 2)
    last, number = found[:, 0] + 1, found[:, 1]
    first = last - np.fromiter(map(len, phrases), np.int64, len(phrases))[number]
    word, after = np.searchsorted(t.begin, first), np.searchsorted(t.begin, last)
    starts = t.begin[np.minimum(word, len(t.begin) - 1)] == first if len(t.begin) else first < 0
    ends = (t.begin + t.size)[after - 1] == last if len(t.begin) else first < 0
    return word[starts & ends], number[starts & ends]


def covered(run: Run, s: Store, p: Passages) -> np.ndarray:
    """Which words of a run are in a passage that starts earlier elsewhere.

    The anchors of the run call for the phrases of its automaton, through which
    all its documents stream. A place that the automaton reports gives the
    passages of the reported phrase; of the run's passages around that place
    those with the same words count.
    """
    m = marked(run, p)
    around = spans(m, s.anchors, p)
    phrases = called(around.key, s)
    at, number = occurrences(run, phrases.words)
    # the run's passages around reported places: an anchor and the size of its phrase name a span
    order = np.argsort(around.at * 2 + (around.size == p.window), kind="stable")
    names = (around.at * 2 + (around.size == p.window))[order]
    sizes = np.array([x.count(b" ") + 1 for x in phrases.words], np.int64)
    wanted = at * 2 + (sizes[number] == p.window) if len(at) else at
    low, high = np.searchsorted(names, wanted), np.searchsorted(names, wanted, "right")
    hit = np.flatnonzero(high > low)
    span, number = order[low[hit]], number[hit]
    n = around.last[span] - around.first[span] + 1
    start = np.repeat(around.first[span] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    number = np.repeat(number, n)
    mine, theirs = _matched(m.passages[start], number, phrases, s)
    start, file = start[mine], phrases.files[number[mine]]
    # those that start earlier elsewhere
    order = np.lexsort((start, file))
    start, file, theirs = start[order], file[order], theirs[order]
    owner = _owners(run, start)
    doc, own = s.passages.take("d", file, theirs), _doc_ids(run)[owner]
    place = s.passages.take("s", file, theirs)
    earlier = (doc < own) | ((doc == own) & (place < start - run.starts[owner]))
    start, file, theirs = start[earlier], file[earlier], theirs[earlier]
    begin, length = s.passages.take("t", file, theirs), s.passages.take("l", file, theirs)
    start = start[_same_words(run, start, file, begin, length, s, p)]
    depth = np.zeros(len(run.tokens.begin) + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + p.window, -1)
    return np.cumsum(depth)[:-1] > 0


def _matched(keys: np.ndarray, number: np.ndarray, phrases: Phrases, s: Store) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of (place in ``keys``, place of a passage in its file) with the same hash, among the passages of the phrase that ``number`` names."""
    used, number = np.unique(number, return_inverse=True)
    n = phrases.end[used] - phrases.first[used]
    of = np.repeat(np.arange(len(used)), n)
    place = np.repeat(phrases.first[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    stored = s.passages.take("w", phrases.files[used][of], place, "<u8")
    both = lambda key, phrase: key + phrase.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    have = both(stored, of)
    order = np.argsort(have, kind="stable")
    have, want = have[order], both(keys, number)
    low, high = np.searchsorted(have, want), np.searchsorted(have, want, "right")
    n = high - low
    mine = np.repeat(np.arange(len(keys)), n)
    theirs = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    right = of[theirs] == number[mine]
    return mine[right], place[theirs[right]]


def _same_words(run: Run, start: np.ndarray, file: np.ndarray, begin: np.ndarray, length: np.ndarray, s: Store, p: Passages) -> np.ndarray:
    """Whether the run's passages at ``start`` have the words of the stored ones; neighbours that follow each other in both are compared at once."""
    ok = np.zeros(len(start), bool)
    if not len(start):
        return ok
    t = run.tokens
    follows = (start[1:] == start[:-1] + 1) & (file[1:] == file[:-1]) & (begin[1:] - begin[:-1] == t.begin[start[1:]] - t.begin[start[:-1]])
    edges = [*np.flatnonzero(np.concatenate([[True], ~follows])).tolist(), len(start)]
    x, y = t.begin[start].tolist(), (t.begin + t.size)[start + p.window - 1].tolist()
    begin, last, file = begin.tolist(), (begin + length).tolist(), file.tolist()

    def same(a: int, b: int) -> bool:
        return run.raw[x[a] : y[b - 1]] == s.passages.array("y", file[a], "u1")[begin[a] : last[b - 1]].tobytes()

    for a, b in zip(edges, edges[1:]):
        ok[a:b] = same(a, b) or [same(i, i + 1) for i in range(a, b)]
    return ok


def left(run: Run, gone: np.ndarray) -> list[bytes]:
    """The words of each document that are not gone, joined by one space."""
    t = run.tokens
    kept = t.text[np.repeat(~gone, t.size + 1)].tobytes()
    ends = np.concatenate([[0], np.cumsum((t.size + 1) * ~gone)])[run.starts].tolist()
    return [kept[a : max(a, b - 1)] for a, b in zip(ends, ends[1:])]


def remove_repeats(docs: DataFrame, p: Passages = Passages()) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``: the words that stay, joined by one space.

    A word goes if a passage that covers it also starts earlier: in a smaller
    doc_id, or earlier in the same document. Null doc_ids come last; rows with
    the same doc_id and text are not earlier than each other. Texts that are
    null or shorter than a passage lose nothing. An empty table gives an empty
    table. Columns named like the new ones are replaced. Passages are compared by
    their words.
    """
    kept = docs.drop("n_words", "n_removed", "kept")
    found = confirm(kept.select("doc_id", "text"), p)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, p.run):
            gone = covered(run, found, p)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[run.starts])
            texts = left(run, gone)
            out = run.rows.append_column("n_words", pa.array(np.diff(run.starts))).append_column("n_removed", pa.array(removed.astype(np.int64))).append_column("kept", pa.array(texts, pa.binary()))
            yield from out.to_batches()

    names = [F.col(f"`{c}`") for c in kept.columns]
    ddl = kept.select(*names).schema.add("n_words", "long").add("n_removed", "long").add("kept", "binary")
    return kept.select(*names).mapInArrow(strip, ddl).withColumn("kept", F.col("kept").cast("string"))

def op9_phrase_automata(spark, sf_dir: str) -> DataFrame:
    """Words removed from every document, and the digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM texts, unnest(range(1, len(ws) - 18)) u(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM starts) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, unnest(range(0, 20)) v(k)),
words AS (SELECT doc_id, i, ws[i] AS word FROM texts, unnest(range(1, len(ws) + 1)) u(i)),
kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id),
counted AS (SELECT doc_id, COUNT(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_words, COALESCE(c.n, 0) AS n_removed, sha256(COALESCE(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id LEFT JOIN counted c ON c.doc_id = t.doc_id
"""
