"""SimHash near-duplicates by vantage-point trees.

Fingerprints are partitioned by their Hamming distance to vantage points. The
upper tree is built from a bounded sample and its leaves are shards. A pair
within the radius r that a vantage point's cut m separates has its near member
at a distance over m - r, by the triangle inequality; so only those boundary
members visit the far side, as queries, and every pair meets in one shard.
Within a shard the tree goes on. A shard returns a forest of links, one at most
for each fingerprint it has seen; a search over the links of all shards gives
the components. Copies share a fingerprint and are one member.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import graph, prefixes, samples, scratch, store
from leafmark.llm.words import Tokens, arrow_schema, chunks, mix, span_hashes, tokens


@dataclass(frozen=True)
class Search:
    """``radius`` in bits; ``shard``: fingerprints of a shard's own that the tree aims at; ``sample``: about how many fingerprints build it at most; ``per_shard``: of these for each shard.

    Shards go on as trees in memory; large ones need fewer levels above, each of
    which makes members visit a second shard.
    """

    words: int = 3
    radius: int = 2
    shard: int = 1 << 16
    sample: int = 1 << 17
    per_shard: int = 64
    brute: int = 512


def fingerprint(text: bytes, k: int = 3) -> int:
    """SimHash over the shingles of k words, repeats included; fewer words make one shingle, none give 0."""
    return int(fingerprints_of([text], k)[0])


def fingerprints_of(texts: list[bytes], k: int) -> np.ndarray:
    """``fingerprint`` of each text."""
    h, starts = xxh64_shingles(texts, k)
    worded, out = np.flatnonzero(np.diff(starts)), np.zeros(len(texts), np.uint64)
    out[worded] = majorities(h, np.append(starts[worded], len(h)))
    return out


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp) of documents (doc_id, text), fp as a signed long; a null text has no words."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in chunks(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fingerprints_of(texts, k).view(np.int64))], schema=arrow_schema("doc_id long, fp long"))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(apply, "doc_id long, fp long")


@dataclass
class Tree:
    """A vantage point and its cut, or a shard. ``low`` holds distances up to the cut."""

    shard: int = -1
    tiles: int = 1
    vantage: np.uint64 = np.uint64(0)
    cut: int = 0
    low: Tree | None = None
    high: Tree | None = None


def distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def choose(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """Of eight spread points and all cuts, the one that leaves least to do on both sides; None if none helps."""
    best, out, n = 0.95, None, len(points)
    for v in points[np.linspace(0, n - 1, 8).astype(int)]:
        at_most = np.cumsum(np.bincount(distance(points, v), minlength=65))
        for m in range(64):
            low, high = at_most[m], n - at_most[m]
            if not low or not high:
                continue
            visit = low - (at_most[m - radius] if m >= radius else 0)
            # pairs to compare on both sides, against pairs now; visitors compare with all of the far side
            left = (low * low / 2 + high * high / 2 + visit * high) / (n * n / 2)
            if left < best:
                best, out = left, (v, m)
    return out


def build(sample: np.ndarray, radius: int, leaf: int) -> tuple[Tree, int]:
    """The upper tree over a sample, and its number of shards; a shard that no cut helps is told how many tiles it takes."""
    count = 0

    def grow(points: np.ndarray) -> Tree:
        nonlocal count
        found = choose(points, radius) if len(points) > leaf else None
        if not found:
            count += 1
            return Tree(count - 1, max(1, round(len(points) / (4 * leaf))))
        near = distance(points, found[0]) <= found[1]
        return Tree(-1, 1, *found, grow(points[near]), grow(points[~near]))

    return grow(np.sort(sample)), count


def route(tree: Tree, points: np.ndarray, radius: int) -> Iterator[tuple[Tree, np.ndarray, np.ndarray]]:
    """Shards with the indexes of the points that live there and of those that visit."""
    stack = [(tree, np.arange(len(points)), np.empty(0, np.int64))]
    while stack:
        node, home, guests = stack.pop()
        if not len(home) and not len(guests):
            continue
        if node.low is None:
            yield node, home, guests
            continue
        d, g = distance(points[home], node.vantage).astype(np.int64), distance(points[guests], node.vantage).astype(np.int64)
        near = d <= node.cut
        stack.append((node.low, home[near], guests[g - radius <= node.cut]))
        stack.append((node.high, home[~near], np.concatenate([guests[g + radius > node.cut], home[near & (d > node.cut - radius)]])))


def pairs(points: np.ndarray, home: np.ndarray, guests: np.ndarray, radius: int, brute: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs within the radius, of home members and of guests with home members, by a tree in memory."""
    stack = [(home, guests)]
    while stack:
        home, guests = stack.pop()
        if not len(home):
            continue
        found = choose(np.sort(points[home]), radius) if len(home) > brute else None
        if found:
            v, m = found
            d, g = distance(points[home], v).astype(np.int64), distance(points[guests], v).astype(np.int64)
            near = d <= m
            stack.append((home[near], guests[g - radius <= m]))
            stack.append((home[~near], np.concatenate([guests[g + radius > m], home[near & (d > m - radius)]])))
            continue
        step = max(1, (1 << 19) // len(home))
        for at in range(0, len(home), step):
            i, j = np.nonzero(np.bitwise_count(points[home[at : at + step], None] ^ points[home][None, :]) <= radius)
            keep = i + at < j
            yield home[i[keep] + at], home[j[keep]]
        for at in range(0, len(guests), step):
            i, j = np.nonzero(np.bitwise_count(points[guests[at : at + step], None] ^ points[home][None, :]) <= radius)
            yield guests[i + at], home[j]


def block_mask(block: int, radius: int) -> np.uint32:
    """The bits of a block: 32 bits are cut into one block more than two fingerprints may differ in, so these share one."""
    width = -(-32 // (radius + 1))
    return np.uint32(((1 << width) - 1 << block * width) & 0xFFFFFFFF)


def block_value(points: np.ndarray, block: int, radius: int) -> np.ndarray:
    return ((points & block_mask(block, radius)) >> np.uint32(block * -(-32 // (radius + 1)))).astype(np.int64)


def dealt(values: np.ndarray, parts: np.ndarray, tiles: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of points with ``values`` of a block, the tiles that they go to, and whether as guests.

    Values go to one of ``groups`` tiles. One that has several ``tiles`` has them for itself: each takes
    its part of the members, told by ``parts``, and the members of earlier ones visit it.
    """
    many = np.where(values < len(tiles), tiles[np.minimum(values, len(tiles) - 1)], 1)
    mine = (parts % many.astype(np.uint64)).astype(np.int64)
    n = many - mine
    at = np.repeat(np.arange(len(values)), n)
    visit = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, np.where(many[at] > 1, groups + values[at] * tiles.max() + mine[at] + visit, values[at] % groups).astype(np.int32), visit > 0


def close_pairs(points: np.ndarray, homes: int, block: int, radius: int, live: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of 32-bit points within the radius that agree in ``block``, each pair once; the first ``homes`` points meet each other and the rest.

    Of ``radius + 2`` parts of the other bits such pairs agree in two at least. So
    for each two of them the points are sorted, and neighbours that agree are
    compared. Points that the caller strikes from ``live`` have no further pairs.
    """
    same = block_mask(block, radius)
    rest = [k for k in range(32) if not int(same) >> k & 1]
    parts = [np.uint32(sum(1 << k for k in rest[i :: radius + 2])) for i in range(radius + 2)]
    masks = [same | np.bitwise_or.reduce(x) for x in combinations(parts, 2)]
    for k, mask in enumerate(masks):
        order = np.argsort(points & mask)
        ordered, step = points[order], 0
        first = np.arange(len(order))
        while len(first):
            step += 1
            first = first[first < len(order) - step]
            first = first[live[order[first]]]
            unlike = ordered[first] ^ ordered[first + step]
            like = unlike & mask == 0
            first, unlike = first[like], unlike[like]
            i, j = order[first], order[first + step]
            close = np.flatnonzero((np.bitwise_count(unlike) <= radius) & (np.minimum(i, j) < homes))
            for earlier in masks[:k]:
                close = close[unlike[close] & earlier != 0]
            if len(close):
                yield i[close], j[close]


class Forest:
    """Union-find over fingerprints."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def join_all(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            self.join(x, y)

    def links(self) -> pd.DataFrame:
        """Members and their roots, as links (a, b)."""
        found = [(x, self.root(x)) for x in self.parent]
        return pd.DataFrame([x for x in found if x[0] != x[1]], columns=["a", "b"], dtype="int64")


def visits(tree: Tree, points: np.ndarray, radius: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(shard, tile, places of points, whether they are guests) for what lives in or visits a tile.

    Each tile of a shard takes its part of the members; the members of earlier
    tiles and all guests of the shard visit it.
    """
    for node, home, guests in route(tree, points, radius):
        mine = (points[home] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(node.tiles)
        for t in range(node.tiles):
            at = np.concatenate([home[mine == t], guests, home[mine < t]])
            if len(at):
                yield node.shard, t, at, np.arange(len(at)) >= np.count_nonzero(mine == t)


ROUTED = "shard long, tile int, fp long, guest boolean"


def links(fps: DataFrame, s: Search = Search()) -> DataFrame:
    """Links (a, b) between fingerprints of ``fps`` (fp, distinct) within the radius: a forest for each shard, so not every pair is a row but every pair is connected.

    The sample that shapes the shards is what has the least hashes, about
    ``s.sample`` at most; it decides where pairs meet, never whether. A shard that no
    cut makes smaller, such as a cluster tighter than the radius, is cut into
    tiles: each takes its part of the members, and all members visit the others'.
    """
    n = fps.count()
    spark = fps.sparkSession
    shards = max(1, -(-n // s.shard))
    drawn = samples.by_hash(fps.select("fp"), F.col("fp"), n, min(s.sample, shards * s.per_shard)).collect()
    sample = np.array([r[0] for r in drawn], np.int64).view(np.uint64)
    tree, _ = build(sample, s.radius, max(1, -(-len(sample) // shards)))
    sent = spark.sparkContext.broadcast(tree)  # two nodes for each shard

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, tile, at, guest in visits(sent.value, points, s.radius):
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.full(n, tile, np.int32)), pa.array(points[at].view(np.int64)), pa.array(guest)], schema=arrow_schema(ROUTED))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        points, guest = rows["fp"].to_numpy().view(np.uint64), rows["guest"].to_numpy(dtype=bool)
        forest = Forest()
        for i, j in pairs(points, np.flatnonzero(~guest), np.flatnonzero(guest), s.radius, s.brute):
            forest.join_all(points[i].view(np.int64), points[j].view(np.int64))
        return forest.links()

    routed = fps.select("fp").mapInArrow(deal, ROUTED)
    return routed.groupBy("shard", "tile").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, s: Search = Search()) -> DataFrame:
    """(doc_id, fp, component_id) of documents (doc_id, text): the smallest doc_id reachable over links.

    Null and empty texts and texts without words share fingerprint 0, and are
    linked by it like any other. A component whose doc_ids are all null has a
    null component_id. Rows that repeat stay; other columns are left out; an
    empty table gives an empty table.
    """
    marked = scratch.store(fingerprints(docs, s.words), "fingerprints")
    members = scratch.store(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "members")
    found = graph.components(links(members.select("fp"), s))
    rooted = members.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = scratch.store(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.store(rooted.join(least, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


@dataclass(frozen=True)
class Similar:
    """Documents whose sets of shingles of ``words`` words have a Jaccard similarity of ``least`` or more.

    Candidates have one of ``tables`` fingerprints of 32 bits within ``radius``
    bits. At a Jaccard similarity of 0.8 on five words, an edit for every 45
    words, a fingerprint over shingles of ``over`` words is found with a chance
    of about 0.28, so one of sixteen with 0.995. Sketches only reject candidates
    that lie ``margin`` standard errors below ``least``; the sets decide. Rows of
    one value of a block whose fingerprints propose more than ``crowded`` pairs a
    row, as documents of one template do, go by the prefixes of their sets, which
    propose every pair at ``least`` and few others. Values share tiles of about
    ``shard`` rows; ``per_shard`` rows for each, ``sample`` at most, tell which
    values need several. ``brute`` belonged to trees and changes nothing.
    """

    words: int = 5
    least: float = 0.8
    over: int = 3
    tables: int = 16
    radius: int = 2
    buckets: int = 128
    margin: float = 5.0
    shard: int = 16384
    sample: int = 1 << 17
    per_shard: int = 32
    brute: int = 512
    crowded: int = 4


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of the shingles of k words of a text in lower case; fewer words are one shingle."""
    return xxh64_shingles([text], k)[0]


def xxh64_shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_hashes`` of all texts, and where each text's begin."""
    t = tokens(texts, lower=True, hashed=False)
    n = np.diff(t.starts)
    count = np.where(n >= k, n - k + 1, n > 0)
    starts = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(t.starts[:-1] - starts[:-1], count) + np.arange(starts[-1])
    last = at + np.repeat(np.minimum(n, k), count) - 1
    return xxh64(t.text, t.begin[at], t.begin[last] + t.size[last]), starts


#: The primes of XXH64.
PRIMES = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def xxh64(text: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of stretches of ``text``, a few thousand at a time; of 32 bytes and more by the library."""
    out = np.empty(len(begin), np.uint64)
    for a in range(0, len(begin), 1 << 13):
        out[a : a + (1 << 13)] = _short_xxh64(text, begin[a : a + (1 << 13)], end[a : a + (1 << 13)], seed)
    for i in np.flatnonzero(end - begin >= 32).tolist():
        out[i] = xxhash.xxh64_intdigest(text[begin[i] : end[i]].tobytes(), seed)
    return out


def _short_xxh64(text: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of stretches below 32 bytes; of others anything."""
    p1, p2, p3, p4, p5 = PRIMES
    low = int(begin.min()) if len(begin) else 0
    near = np.concatenate([text[low : int(begin.max()) + 40 if len(begin) else 0], np.zeros(40, np.uint8)])
    words = np.ndarray(len(near) - 7, "<u8", near, strides=(1,)).astype(np.uint64)  # the eight bytes from each place
    n, at = np.minimum(end - begin, 31), begin - low
    h = n.astype(np.uint64) + (np.uint64(seed) + p5)
    for k in range(3):  # eight bytes at a time, then four, then one by one
        i = np.flatnonzero(n >= 8 * k + 8)
        h[i] = _turned(h[i] ^ _turned(words[at[i] + 8 * k] * p2, 31) * p1, 27) * p1 + p4
    i = np.flatnonzero(n & 4)
    h[i] = _turned(h[i] ^ (words[at[i] + (n[i] & 24)] & np.uint64(0xFFFFFFFF)) * p1, 23) * p2 + p3
    for k in range(3):
        i = np.flatnonzero(n & 3 > k)
        h[i] = _turned(h[i] ^ near[at[i] + (n[i] & 28) + k] * p5, 11) * p1
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def majority(h: np.ndarray) -> np.uint64:
    """The bits that over half of the hashes have."""
    return majorities(h, np.array([0, len(h)]))[0] if len(h) else np.uint64(0)


#: The lowest bit of each byte, and how many of them a byte can sum.
LANES, LANE = np.uint64(0x0101010101010101), 255


def majorities(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``majority`` of each stretch of ``h``, from ``starts[i]`` to ``starts[i + 1]``; none of them empty.

    The eight bytes of a sum count one bit of each byte of up to ``LANE`` hashes.
    """
    n = np.diff(starts)
    parts = -(-n // LANE)
    first = np.cumsum(parts) - parts
    at = np.append(np.repeat(starts[:-1] - LANE * first, parts) + LANE * np.arange(parts.sum()), starts[-1])
    sums = np.empty((len(at) - 1, 8, 8), np.uint8)
    for a in range(0, len(sums), 64):  # a few thousand hashes at a time
        b = min(a + 64, len(sums))
        own = h[at[a] : at[b]]
        for k in range(8):
            sums[a:b, :, k] = np.add.reduceat(own >> np.uint64(k) & LANES, at[a:b] - at[a]).astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.add.reduceat(sums.reshape(-1, 64), first, axis=0, dtype=np.int64) if len(n) else np.empty((0, 64), np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def shingles(t: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of k words of all documents, and where each document's begin; fewer words are one shingle, no words none."""
    n = np.diff(t.starts)
    first = t.starts[:-1]
    spans, short = span_hashes(t.hashes, k), np.flatnonzero((n > 0) & (n < k))
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(starts[-1], np.uint64)
    whole = np.flatnonzero(n >= k)
    where = np.repeat(first[whole] - starts[whole], count[whole])
    to = np.repeat(n >= k, count)
    out[to] = spans[np.flatnonzero(to) + where]
    for i in short.tolist():
        out[starts[i]] = span_hashes(t.hashes[first[i] : first[i] + n[i]], int(n[i]))[0]
    return out, starts


def sketch(h: np.ndarray, buckets: int) -> np.ndarray:
    """One-permutation minima: a byte for the least hash of each bucket, 0 for an empty one."""
    out = np.full(buckets, 1 << 40, np.int64)
    np.minimum.at(out, (h >> np.uint64(40)).astype(np.int64) % buckets, (h & np.uint64((1 << 40) - 1)).astype(np.int64))
    return np.where(out == 1 << 40, 0, 1 + out % 255).astype(np.uint8)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of sketches: equal buckets among those that one of both fills."""
    filled = (a | b) != 0
    return ((a == b) & filled).sum(axis=1) / np.maximum(1, filled.sum(axis=1))


def unlikely(a: np.ndarray, b: np.ndarray, least: float, margin: float) -> np.ndarray:
    """Whether rows of sketches agree so little that a similarity of ``least`` is out of question."""
    filled = ((a | b) != 0).sum(axis=1)
    return agreement(a, b) < least - margin * np.sqrt(least * (1 - least) / np.maximum(1, filled))


#: ``sketch`` is followed by the place of the shingles: file, first and number.
SIGNED = "doc_id long, prints binary, sketch binary"
CANDIDATES = "search int, tile int, doc_id long, print long, guest boolean"
#: Sketches of a cell of the store, bytes of the place that follows each, and proposals that are looked up together.
STORED, PLACE, HELD = 1 << 16, 32, 1 << 14


def signatures(docs: DataFrame, s: Similar, folder: str) -> DataFrame:
    """SIGNED of documents (doc_id, text) that have words: ``s.tables`` fingerprints of 32 bits, and a sketch.

    The sorted shingle hashes of all texts of a task are written to one file of
    ``folder``, under a name that no other attempt uses.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = uuid.uuid4()
        with store.Out(folder, name.hex) as out:
            for piece, texts in chunks(batches, limit=1 << 20):
                t = tokens(texts, lower=True)
                keys = piece.column(0).to_numpy(zero_copy_only=False)
                worded = np.flatnonzero((np.diff(t.starts) > 0) & ~np.isnan(keys)) if keys.dtype.kind == "f" else np.flatnonzero(np.diff(t.starts) > 0)
                h, starts = shingles(t, s.over)
                filled = starts[:-1][np.diff(starts) > 0]
                prints = np.empty((len(filled), 2 * -(-s.tables // 2)), "<u4")
                for k in range(0, s.tables, 2):
                    prints[:, k : k + 2] = majorities(h, np.append(filled, len(h))).astype("<u8").view("<u4").reshape(-1, 2)
                    h = mix(h + np.uint64(0xD6E8FEB86659FD93))
                row = np.cumsum(np.diff(starts) > 0) - 1
                wide, begin = shingles(t, s.words)
                wide, rows = mix(wide), []
                ids = piece.column(0).to_pylist()
                for i in worded.tolist():
                    own = np.unique(wide[begin[i] : begin[i + 1]])
                    place = name.bytes + np.array([out.size("h"), len(own)], "<i8").tobytes()
                    rows.append((ids[i], prints[row[i], : s.tables].tobytes(), sketch(own, s.buckets).tobytes() + place))
                    out.add("h", own)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 3, arrow_schema(SIGNED))], schema=arrow_schema(SIGNED))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(apply, SIGNED)


def store_sketches(signed: DataFrame, n: int) -> store.Layout:
    """Where the sketches and places of SIGNED rows are, sorted by a scramble of their doc_ids."""
    layout = store.Layout(scratch.fresh(signed.sparkSession, "sketches"), max(4, -(-n // STORED)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(layout.cell(keys)), pa.array(keys.view(np.int64)), batch.column(1)], names=["cell", "key", "sketch"])

    def merge(out: store.Out, cell: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(parts)
        keys = np.concatenate([part.column("key").to_numpy().view(np.uint64) for part in held])
        rows = np.frombuffer(b"".join(x for part in held for x in part.column("sketch").to_pylist()), np.uint8).reshape(len(keys), -1)
        order = np.argsort(keys, kind="stable")
        out.add("k", keys[order])
        out.add("s", rows[order])
        yield pa.RecordBatch.from_pydict({"cell": [cell]})

    placed = signed.select("doc_id", "sketch").mapInArrow(place, "cell long, key long, sketch binary")
    store.write(placed, layout, merge, "cell long").count()
    return layout


def load_sketches(layout: store.Layout, ids: np.ndarray, width: int) -> np.ndarray:
    """Sketches and places of doc_ids that are in the store."""
    keys, back = np.unique(mix(ids.view(np.uint64)), return_inverse=True)
    files, first, _ = layout.find("k", keys)
    return layout.take("s", files, first, "u1", width)[back]


def shingle_set(folder: str, place: np.ndarray) -> np.ndarray:
    """The sorted shingle hashes at a place."""
    first, n = place[16:].view("<i8").tolist()
    return store.load(folder, "h", place[:16].tobytes().hex())[first : first + n]


def set_sizes(places: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(places[:, 24:]).view("<i8")[:, 0]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets."""
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return common / max(1, len(a) + len(b) - common)


def join_similar(a: np.ndarray, b: np.ndarray, forest: Forest, layout: store.Layout, folder: str, s: Similar) -> None:
    """Join those pairs (a, b) of doc_ids that are similar."""
    width = s.buckets + PLACE
    for at in range(0, len(a), 1 << 14):
        one, other = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
        x, y = load_sketches(layout, one, width), load_sketches(layout, other, width)
        p, q = x[:, s.buckets :], y[:, s.buckets :]
        m, n = set_sizes(p), set_sizes(q)
        maybe = (np.minimum(m, n) >= s.least * np.maximum(m, n) - 1e-9) & ~unlikely(x[:, : s.buckets], y[:, : s.buckets], s.least, s.margin)
        for k in np.flatnonzero(maybe).tolist():
            u, v = int(one[k]), int(other[k])
            if forest.root(u) != forest.root(v) and jaccard(shingle_set(folder, p[k]), shingle_set(folder, q[k])) >= s.least - 1e-9:
                forest.join(u, v)


def join_by_prefixes(ids: np.ndarray, homes: int, forest: Forest, layout: store.Layout, folder: str, s: Similar) -> None:
    """Join all similar pairs of the first ``homes`` doc_ids with each other and with the rest."""
    step = 1 << 14
    places = np.concatenate([load_sketches(layout, ids[at : at + step], s.buckets + PLACE)[:, s.buckets :] for at in range(0, len(ids), step)])
    labels = lambda: np.fromiter(map(forest.root, ids.tolist()), np.int64, len(ids))
    for i, j in prefixes.proposals(lambda i: shingle_set(folder, places[i]), set_sizes(places), homes, s.least, labels):
        join_similar(ids[i], ids[j], forest, layout, folder, s)


def similar_links(docs: DataFrame, s: Similar = Similar()) -> DataFrame:
    """Links (a, b) between doc_ids of documents (doc_id, text) that are similar: a forest for each tile of each block of each table.

    Rows that repeat a doc_id count once. Fingerprints within the radius share a
    block of their bits, so each meets those with its value of a block, in as
    many copies as there are blocks at every size; trees over 32 bits would send
    each to ever more shards. Only doc_ids and the short fingerprints are dealt;
    sketches and shingles are mapped from the shared folder and looked up for
    candidates that are not connected yet. Texts without words and rows without
    doc_id have no links; an empty table has none.
    """
    folder = scratch.fresh(docs.sparkSession, "shingles")
    signed = scratch.store(signatures(docs, s, folder).dropDuplicates(["doc_id"]), "signatures")
    n = signed.count()
    groups = max(1, -(-n // s.shard))
    drawn = samples.by_hash(signed, F.col("doc_id"), n, min(s.sample, groups * s.per_shard)).select("prints").collect()
    prints = np.array([np.frombuffer(r[0], "<u4") for r in drawn], np.uint32).reshape(-1, s.tables)
    # a value that very many share takes several tiles
    share, blocks = n / max(1, len(prints)) / (4 * s.shard), range(s.radius + 1)
    tiles = {(t, b): np.maximum(1, np.rint(np.bincount(block_value(prints[:, t], b, s.radius)) * share)).astype(np.int64) for t in range(s.tables) for b in blocks}
    sent = docs.sparkSession.sparkContext.broadcast(tiles)
    layout = store_sketches(signed, n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([np.frombuffer(x, "<u4") for x in batch.column(1).to_pylist()], np.uint32).reshape(-1, s.tables)
            parts = mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            for t in range(s.tables):
                for b in blocks:
                    at, tile, guest = dealt(block_value(own[:, t], b, s.radius), parts, sent.value[t, b], groups)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t * len(blocks) + b, np.int32)), pa.array(tile), batch.column(0).take(pa.array(at)), pa.array(own[at, t].astype(np.int64)), pa.array(guest)], schema=arrow_schema(CANDIDATES))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("guest", kind="stable")
        points, ids, homes, forest = rows["print"].to_numpy().astype(np.uint32), rows["doc_id"].to_numpy(), int((~rows["guest"]).sum()), Forest()
        block = int(rows["search"].iloc[0]) % len(blocks)
        _, group, size = np.unique(block_value(points, block, s.radius), return_inverse=True, return_counts=True)
        proposed, live, held, n_held = np.zeros(len(size), np.int64), np.ones(len(points), bool), [], 0
        for i, j in close_pairs(points, homes, block, s.radius, live):
            proposed += np.bincount(group[i], minlength=len(size))
            crowded = proposed > s.crowded * size
            live &= ~crowded[group]
            held.append((i[live[i]], j[live[i]]))
            n_held += len(held[-1][0])
            if n_held >= HELD:
                join_similar(*(ids[np.concatenate(x)] for x in zip(*held)), forest, layout, folder, s)
                held, n_held = [], 0
        if held:
            join_similar(*(ids[np.concatenate(x)] for x in zip(*held)), forest, layout, folder, s)
        for k in np.flatnonzero(proposed > s.crowded * size).tolist():
            members = np.flatnonzero(group == k)
            join_by_prefixes(ids[members], int((members < homes).sum()), forest, layout, folder, s)
        return forest.links()

    return signed.select("doc_id", "prints").mapInArrow(deal, CANDIDATES).groupBy("search", "tile").applyInPandas(search, "a long, b long")


def op6_simhash_vantage(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
