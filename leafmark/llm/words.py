"""Words and hashes shared by the operators that read whole texts.

A word is a run of characters other than space and U+0009 to U+000D. On UTF-8
bytes that is exactly what ``bytes.split`` and ``bytes.lower`` work with, so
the Python side never decodes a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters between words, as the content of a regular expression class.
SPACE = r"\x20\x09-\x0D"
#: Bytes of text that a worker turns into Python objects at a time.
CHUNK = 4 << 20
#: Which bytes part words, and bytes with A-Z in lower case.
WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
BREAK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of terms, A-Z in lower case; all others become spaces.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Powers of an odd number modulo 2**64; longer words take them in turn.
POWERS = np.cumprod(np.where(np.arange(4096) == 0, np.uint64(1), np.uint64(0x9E3779B97F4A7C15)))


def word_array(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+"), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words as a long; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string or binary column; null is empty."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts, each of about ``limit`` bytes or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.float64))
        part = (np.cumsum(sizes) // limit).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                piece = batch.slice(a, b - a)
                yield piece, as_bytes(piece.column(piece.schema.get_field_index(text)))


def slices(text: bytes, limit: int = CHUNK) -> Iterator[bytes]:
    """A text in parts of about ``limit`` bytes, cut at ASCII white space; a longer run without any stays whole."""
    at = 0
    while len(text) - at > limit:
        found = BREAK.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, part by part: runs of digits, letters and all that is not ASCII, with A-Z in lower case."""
    for part in slices(text):
        yield part.translate(TERMS).split()


@dataclass
class Tokens:
    """Words of some documents one after the other, as bytes.

    ``text`` holds each word and one byte behind it: a space, or a line break
    behind the last of a document. Word i begins at ``begin[i]`` and has
    ``size[i]`` bytes; document d has words ``starts[d]`` to ``starts[d + 1]``.
    """

    text: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray


def tokens(texts: list[bytes], lower: bool = False, hashed: bool = True) -> Tokens:
    """The words of documents and their 64-bit hashes, if ``hashed``, without an object for each word."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if lower:
        raw = LOWER[raw]
    white = WHITE[raw]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    if len(raw) and not white[0]:
        edges = np.concatenate([[0], edges])
    first, last = edges[::2], edges[1::2]
    size = last - first
    starts = np.searchsorted(first, np.cumsum([0] + [len(t) + 1 for t in texts]))
    keep = ~white
    keep[last] = True
    text = np.where(white, np.uint8(32), raw)[keep]
    begin = np.cumsum(size + 1) - size - 1
    ends = starts[1:][np.diff(starts) > 0] - 1
    text[begin[ends] + size[ends]] = 10
    return Tokens(text, begin, size, word_hashes(text, begin, size) if hashed else np.empty(0, np.uint64), starts)


def joined(parts: list[Tokens]) -> Tokens:
    """The tokens of several lists of documents in a row."""
    if len(parts) == 1:
        return parts[0]
    at = np.cumsum([0] + [len(t.text) for t in parts])
    words = np.cumsum([0] + [len(t.begin) for t in parts])
    starts = [t.starts[:-1] + w for t, w in zip(parts, words)] + [words[-1:]]
    whole = lambda name: np.concatenate([getattr(t, name) for t in parts])
    return Tokens(whole("text"), np.concatenate([t.begin + a for t, a in zip(parts, at)]), whole("size"), whole("hashes"), np.concatenate(starts))


def word_hashes(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Polynomials over the bytes of each word, modulo 2**64 and scrambled; about a megabyte at a time."""
    out = np.empty(len(begin), np.uint64)
    block = np.flatnonzero(np.diff(begin >> 20)) + 1 if len(begin) else []
    for a, b in zip([0, *block], [*block, len(begin)]):
        if a == b:
            continue
        at = begin[a:b] - begin[a]
        chars = text[begin[a] : begin[b - 1] + size[b - 1] + 1]
        inner = np.arange(len(chars)) - np.repeat(at, size[a:b] + 1)
        values = (chars.astype(np.uint64) + np.uint64(1)) * POWERS[inner & (len(POWERS) - 1)]
        values[at + size[a:b]] = 0
        out[a:b] = np.add.reduceat(values, at)
    return mix(out)


def span_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row."""
    out = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - k + 1 + j]
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string of longs, ints, doubles, booleans, strings and binaries."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(","))])
