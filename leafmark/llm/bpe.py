"""BPE encoding by an index of pair occurrences, and decoding.

White space parts a text into stretches that have no influence on each other, so
each different stretch of a block is normalised and cut into words once. All
words of the block lie in one array of symbols, and an index maps each rank of a
merge to all positions of its pair. Active ranks are applied in ascending order
to all their positions at once; the pairs that come about next to the merged
ones join the lists of their ranks, and positions that no longer hold a pair are
passed over when their rank's turn comes.

That gives what merging each word by itself gives, as long as no merge makes a
symbol that a merge of a lower rank needs, which ``Merges`` checks.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.store import stretches
from leafmark.llm.words import chunks, slices

#: Different stretches that a worker remembers, and the bytes that these may have, and ids that are decoded at a time.
KNOWN, KNOWN_BYTES, IDS = 1 << 18, 1 << 24, 1 << 18
#: Bytes of text whose words share an index.
BLOCK = 2 << 20


def default_vocabulary() -> str:
    """The BPE of 49,408 ids with word ends, in lower case."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """A BPE vocabulary of a tokenizers ``.json`` file with an end-of-word suffix, over the characters that its pre-tokeniser gives."""

    def __init__(self, vocabulary: str) -> None:
        import tokenizers

        with open(vocabulary, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.product = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.left, self.right = (np.array([ids[p[i]] for p in pairs], np.int32) for i in (0, 1))
        made = np.full(max(ids.values()) + 1, -1, np.int64)
        made[self.product] = np.arange(len(pairs))
        if len(np.unique(self.product)) < len(pairs) or np.any(np.maximum(made[self.left], made[self.right]) >= np.arange(len(pairs))):
            raise ValueError("a merge makes what a merge of a lower rank needs")
        keys = self._keys(self.left, self.right)
        self.ranks = np.argsort(keys)
        self.keys = keys[self.ranks]
        # the pre-tokeniser writes bytes as characters below 512
        self.inner, self.last = (np.array([ids.get(chr(c) + end, -1) for c in range(512)], np.int32) for end in ("", suffix))
        whole = tokenizers.Tokenizer.from_file(vocabulary)
        self.normalize, self.cut = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @staticmethod
    def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 for those that don't merge."""
        keys = self._keys(a, b)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word begins in them (and the last ends). Words are not empty."""
        if not words:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(w) for w in words])
        n = len(chars)
        symbols = np.append(self.inner[chars], np.int32(-1))
        symbols[ends - 1] = self.last[chars[ends - 1]]
        # the neighbours of a position: none before the first of a word, n behind the last
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[np.append(0, ends)] = n, -1
        places = np.flatnonzero(after[:n] < n)
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []
        self._note(lists, active, self.rank(symbols[places], symbols[places + 1]), places)
        while active:
            rank = heapq.heappop(active)
            at = np.unique(np.concatenate(lists.pop(rank)))
            at = at[(symbols[at] == self.left[rank]) & (symbols[after[at]] == self.right[rank])]
            if self.left[rank] == self.right[rank] and len(at) > 1:  # of overlapping pairs every other one, from the left
                first = np.flatnonzero(np.append(True, at[1:] != after[at[:-1]]))
                at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbols[at], symbols[gone] = self.product[rank], -1
            after[at] = behind = after[gone]
            before[behind] = at
            front = before[at]
            at, behind, front = at[behind < n], behind[behind < n], front[front >= 0]
            places = np.concatenate([front, at])
            found = self.rank(symbols[places], symbols[np.concatenate([after[front], behind])])
            self._note(lists, active, found, places)
        stay = symbols[:n] >= 0
        return symbols[:n][stay].astype("<u4"), np.append(0, np.cumsum(stay)[ends - 1])

    @staticmethod
    def _note(lists: dict[int, list[np.ndarray]], active: list[int], ranks: np.ndarray, places: np.ndarray) -> None:
        """Put places on the lists of the ranks of their pairs."""
        known = ranks >= 0
        ranks, places = ranks[known], places[known]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        for rank, a, b in stretches(ranks):
            if rank not in lists:
                lists[rank] = []
                heapq.heappush(active, rank)
            lists[rank].append(places[a:b])

    def _words(self, text: str) -> list[str | int]:
        """Words of one stretch, and the ids of special strings in it."""
        found: list[str | int] = []
        for i, piece in enumerate(self.specials.split(text) if self.specials else [text]):
            if i % 2:
                found.append(self.special[piece])
            elif piece:
                found += [w for w, _ in self.cut(self.normalize(piece))]
        return found

    def encode_stretches(self, parts: list[bytes]) -> list[bytes]:
        """Ids (unsigned 32-bit, little-endian) of texts without ASCII white space.

        They are normalised and cut in one string with spaces between them;
        those that hold special strings or other white space are cut alone.
        """
        texts = [part.decode("utf-8", "replace") for part in parts]
        special = self.specials if self.specials and self.specials.search(" ".join(texts)) else None
        alone = [i for i, t in enumerate(texts) if len(t.split()) != 1 or (special and special.search(t))]
        own = {i: self._words(texts[i]) for i in alone}
        shared = np.setdiff1d(np.arange(len(texts)), alone)
        line = self.normalize(" ".join([texts[i] for i in shared.tolist()]))
        cut = self.cut(line)
        words = [w for w, _ in cut]
        # the stretch of a word is the number of spaces before it
        spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 32)
        number = np.searchsorted(spaces, np.fromiter((at for _, (at, _) in cut), np.int64, len(cut)))
        firsts = np.append(0, np.cumsum(np.bincount(shared[number], minlength=len(texts))))
        extra = [w for i in alone for w in own[i] if isinstance(w, str)]
        ids, begin = self.encode(words + extra)
        flat, bounds = ids.tobytes(), (4 * begin[firsts]).tolist()
        out = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
        at = iter(zip((4 * begin[len(words) :]).tolist(), (4 * begin[len(words) + 1 :]).tolist()))
        for i in alone:
            out[i] = b"".join(np.uint32(w).astype("<u4").tobytes() if isinstance(w, int) else flat[slice(*next(at))] for w in own[i])
        return out


@lru_cache(maxsize=2)
def merges(vocabulary: str) -> Merges:
    return Merges(vocabulary)


@lru_cache(maxsize=2)
def token_texts(vocabulary: str) -> dict[int, bytes]:
    """The text of each id; decoding needs nothing else."""
    with open(vocabulary, encoding="utf-8") as f:
        told = json.load(f)
    return {i: t.encode() for t, i in told["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in told["added_tokens"]}


@lru_cache(maxsize=2)
def _known(vocabulary: str) -> dict[bytes, bytes]:
    """Ids of stretches that this worker has met."""
    return {}


def _encode_parts(parts: list[bytes], vocabulary: str) -> list[bytes]:
    known, cut = _known(vocabulary), [part.split() for part in parts]
    used = {x for row in cut for x in row}
    new = list(used - known.keys())
    if len(known) + len(new) > KNOWN or sum(map(len, known)) + sum(map(len, new)) > KNOWN_BYTES:
        still = {x: known[x] for x in used if x in known}
        known.clear()
        known.update(still)
    known.update(zip(new, merges(vocabulary).encode_stretches(new)))
    return [b"".join([known[x] for x in row]) for row in cut]


def encode_texts(texts: list[bytes], vocabulary: str) -> list[bytes]:
    """Ids of whole texts; one long text goes part by part."""
    if len(texts) == 1:
        return [b"".join(_encode_parts([part], vocabulary)[0] for part in slices(texts[0]))]
    return _encode_parts(texts, vocabulary)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encoder(vocabulary: str) -> Batches:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in chunks(batches, limit=BLOCK):
            ids = encode_texts(texts, vocabulary)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return apply


def _decoder(vocabulary: str) -> Batches:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = token_texts(vocabulary)
        for piece, rows in chunks(batches, "ids", BLOCK):
            out = []
            for row in rows:
                ids = np.frombuffer(row, "<u4")
                parts = (b" ".join([texts[i] for i in ids[a : a + IDS].tolist() if i in texts]) for a in range(0, len(ids), IDS))
                out.append(b" ".join(p for p in parts if p).decode())
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(out, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return apply


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def _ddl(rows: DataFrame) -> str:
    return f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary"


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens long, ids binary) of documents (doc_id, text): token ids as unsigned 32-bit integers, little-endian.

    Nothing is added; strings of special tokens have their ids. Null and empty
    texts, and texts of white space, have no ids. Rows that repeat are encoded
    each; other columns are left out; an empty table gives an empty table. A
    text of any length is cut at white space, a run without white space is one
    piece of work for one worker.
    """
    return _texts(docs).mapInArrow(_encoder(vocabulary or default_vocabulary()), _ddl(docs))


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ``encoded`` with the texts of its ids, joined by a space, as the vocabulary's file has no decoder of its own.

    No ids give an empty text; ids that the vocabulary lacks give nothing.
    """
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decoder(vocabulary or default_vocabulary()), f"{_ddl(encoded)}, decoded string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """What ``decode`` gives for what ``encode`` gives, in one worker instead of two."""
    vocabulary = vocabulary or default_vocabulary()
    there, back = _encoder(vocabulary), _decoder(vocabulary)
    return _texts(docs).mapInArrow(lambda batches: back(there(batches)), f"{_ddl(docs)}, decoded string")


def op12_pair_occurrence_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents, and of the texts that these decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return round_trip(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
