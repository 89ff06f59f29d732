"""Packing documents into sequences: first-fit decreasing in randomised groups.

A document's tokens are cut into pieces of a full sequence and a rest. Pieces
are dealt into groups of about ``group`` by hash; a group sorts its pieces by
length and puts each into the first sequence with room, which a tournament tree
of free capacities finds in logarithmic time. Groups are independent, so the
work is spread evenly and a lost one is done again alone.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import scratch
from leafmark.llm.words import arrow_schema, chunks

#: Tokens of a sequence, pieces of a group, and the id that ends a document.
LENGTH, GROUP, END = 1024, 4096, 0


#: Special tokens of the byte-level BPE, which its ranks do not hold.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=4)
def encoder(vocabulary: str, special: bool = False) -> Callable[[str], np.ndarray]:
    """Token ids of a text by a vocabulary file: ``.json`` (tokenizers), ``.tiktoken`` (tiktoken), ``.model`` (sentencepiece).

    None are added. Texts that ``tiktoken`` cannot cut go to the ``.json`` of the
    same name. Strings of special tokens in the text are ordinary text, or
    with ``special`` the ids that a plain ``tokenizers.Tokenizer`` gives them.
    """
    if vocabulary.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        core = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL if special else {})
        allowed = set(SPECIAL) if special else set()
        named = vocabulary.removesuffix(".tiktoken") + ".json"

        def encode(text: str) -> np.ndarray:
            try:
                return core.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype("<u4")
            except ValueError:  # its pattern gives up at about a million characters of white space in a row
                if not os.path.exists(named):
                    raise
                return encoder(named, special)(text)

        return encode
    if vocabulary.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        return lambda text: np.asarray(piece.encode(text), "<u4")
    import tokenizers

    t = tokenizers.Tokenizer.from_file(vocabulary)
    t.encode_special_tokens = not special
    return lambda text: np.asarray(t.encode(text, add_special_tokens=False).ids, "<u4")


def default_vocabulary() -> str:
    """The byte-level BPE of 50,257 ids, as ranks: the same ids as its ``.json``, several times faster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt int"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """Cuts of the documents (doc_id, text): PIECES.

    ``doc_tokens`` counts the id that ends the document; a null or empty text
    has that one alone. Strings of special tokens get their ids. ``salt`` numbers rows of a batch that repeat a doc_id.
    """
    vocabulary = vocabulary or default_vocabulary()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, schema = encoder(vocabulary, special=True), arrow_schema(PIECES)
        for piece, texts in chunks(batches):
            rows, seen = [], {}
            for key, text in zip(piece.column(0).to_pylist(), texts):
                seen[key] = salt = seen.get(key, -1) + 1
                ids = np.append(encode(text.decode("utf-8", "replace")), np.uint32(END)).astype("<u4")
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    rows.append((key, at, len(part), zlib.crc32(part.tobytes()), len(ids), salt))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(apply, PIECES)


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, given longest first.

    Leaves of the tree are bins with their free space, inner nodes the larger
    of two; going left whenever the left side has room finds the first bin.
    """
    size = 1 << max(0, (len(lengths) - 1).bit_length())
    tree = [capacity] * (2 * size)
    bins, offsets = [], []
    for n in lengths:
        at = 1
        while at < size:
            at *= 2
            if tree[at] < n:
                at += 1
        bins.append(at - size)
        offsets.append(capacity - tree[at])
        tree[at] -= n
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
    return bins, offsets


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Every piece of the documents with its sequence and its offset there: PACKED.

    Null and empty texts are documents of one id. Rows that repeat are packed
    each; other columns are left out; an empty table gives an empty table. A
    text of any length is cut by one worker. Pieces of one length go by doc_id,
    place and checksum; which of equal pieces comes first makes no difference.
    """
    cut = scratch.store(pieces(docs, vocabulary, length), "pieces")
    groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(groups)))

    def place(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, p["offset"] = first_fit(p["length"].tolist(), length)
        p["sequence_id"] = p["_group"] * (1 << 24) + np.asarray(bins, np.int64)
        return p[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return dealt.groupBy("_group").applyInPandas(place, PACKED)


def op8_first_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1,024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
