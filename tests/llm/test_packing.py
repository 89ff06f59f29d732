import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from leafmark.llm import packing
from tests.llm.conftest import HARD


def check(rows, docs):
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for d, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((d, at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes()), len(ids)) for at in range(0, len(ids), 1024))
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_query(spark, hard, empty, sf):
    check(packing.op8_first_fit_packing(spark, hard).collect(), [(d, t) for d, t, _, _ in HARD])
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = packing.op8_first_fit_packing(spark, sf).collect()
    check(rows, docs)
    used = collections.Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in used.values())
    assert padding < 0.02 * sum(used.values())
    assert packing.op8_first_fit_packing(spark, empty).isEmpty()


def test_first_fit_equals_a_scan():
    r = random.Random(1)
    for n in (1, 2, 3, 64, 200):
        lengths = sorted((r.randint(1, 100) for _ in range(n)), reverse=True)
        free, want = [], []
        for x in lengths:
            b = next((i for i, f in enumerate(free) if f >= x), len(free))
            if b == len(free):
                free.append(100)
            want.append((b, 100 - free[b]))
            free[b] -= x
        assert list(zip(*packing.first_fit(lengths, 100))) == want


def test_repeated_rows_go_to_several_groups(spark):
    docs = spark.createDataFrame([(1, "the same")] * 50, "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, group=5).collect()
    assert len(rows) == 50 and len({r.sequence_id >> 24 for r in rows}) > 3


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_vocabularies(name):
    ids = packing.encoder(public_tokenizers.path(name))("Hello <|endoftext|> wörld\n\n  x")
    assert len(ids) > 5 and ids.dtype == np.dtype("<u4") and 50256 not in ids


def test_ranks_give_the_ids_of_the_tokenizer(spark, sf):
    a, b = (packing.encoder(public_tokenizers.path(f"byte_bpe_50k.{x}")) for x in ("json", "tiktoken"))
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [t or "" for _, t, _, _ in HARD] + ["  \n\n\t x", "don't 'S 123abc", "​　", "🙂" * 50]
    assert all(np.array_equal(a(t), b(t)) for t in texts)


def test_special_token_strings_have_the_ids_of_the_tokenizer(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y  <|endoftext|>  z", "<|endoftext|", "<|ENDOFTEXT|> <|endof<|endoftext|>text|>", "don't  <|endoftext|>'s " * 500]
    plain = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for x in ("json", "tiktoken"):
        encode = packing.encoder(public_tokenizers.path(f"byte_bpe_50k.{x}"), special=True)
        assert all(encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids for t in texts)
    check(packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), list(enumerate(texts)))


def test_megabytes_in_one_text(spark, make):
    docs = [(1, "some words of a long text " * 60_000, "en", "a"), (2, "a<|endoftext|>b", "en", "a")]
    rows = packing.op8_first_fit_packing(spark, make(docs)).collect()
    check(rows, [(d, t) for d, t, _, _ in docs])


def test_millions_of_white_space_characters(spark, make):
    """Longer than the pattern of the ranks can cut; ids are those of the tokenizer."""
    docs = [(1, "a" + " " * 2_000_000 + "b"), (2, "\n" * 2_000_000 + "<|endoftext|> x"), (3, "c" + " \n\t\u2003" * 400_000 + " d"), (4, "plain text")]
    rows = packing.op8_first_fit_packing(spark, make([(d, t, "en", "a") for d, t in docs])).collect()
    check(rows, docs)
