import hashlib
import json
import random

import numpy as np
import pytest
import tokenizers

from leafmark.llm import bpe
from tests.llm.conftest import HARD

TEXTS = [
    "a<|endoftext|>b <|STARTOFTEXT|> x<|startoftext|><|endoftext|>", "aaaa aaaaaaaaaaa abababab hahahaha", "Σας ΣΑΣ İstanbul ﬁ é Å  x y　z\u0085q", "don't I'LL we'd 123abc ½ ٣", "̈a ̈",
    "x" * 3000, "🙂" * 50, "'s's't 'S 'lls", "ß ẞ ǅ", "a​b﻿c\x1cx\x1fy", "  ", "a   b", "<|endoftext|", "<|endof text|>",
]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def check(rows, docs, library):
    want = []
    for d, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def test_query(spark, hard, empty, sf, library):
    check(bpe.op12_pair_occurrence_bpe(spark, hard).collect(), [(d, t) for d, t, _, _ in HARD], library)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(bpe.op12_pair_occurrence_bpe(spark, sf).collect(), docs, library)
    assert bpe.op12_pair_occurrence_bpe(spark, empty).isEmpty()


def test_special_strings_scripts_and_white_space(spark, make, library):
    docs = [(i, t, None, None) for i, t in enumerate(TEXTS)]
    check(bpe.op12_pair_occurrence_bpe(spark, make(docs)).collect(), [d[:2] for d in docs], library)


def test_random_letters(library):
    r = random.Random(3)
    words = ["".join(r.choices("aehnst" if r.random() < 0.7 else "aą'ʼé!.9🙂", k=r.randint(1, 40))) for _ in range(4000)]
    text = " ".join(words)
    got = bpe.encode_texts([text.encode(), b""], bpe.default_vocabulary())
    assert np.frombuffer(got[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids and got[1] == b""


def test_long_texts(spark, library):
    docs = [(1, "some Words of a LONG text, isn't it? " * 150_000), (2, "ab" * 300_000), (3, " \n" * 1_000_000 + "x"), (4, "éa!" * 100_000)]
    rows = bpe.decode(bpe.encode(spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, ids int, n_tokens int"))).collect()
    check([(r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in rows], docs, library)


def test_a_worker_forgets(monkeypatch, library):
    monkeypatch.setattr(bpe, "KNOWN", 3)
    for text in ("one two three four", "four five six", "one two"):
        ids = np.frombuffer(bpe.encode_texts([text.encode()], bpe.default_vocabulary())[0], "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_merges_out_of_order_are_refused(tmp_path):
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        told = json.load(f)
    merges = told["model"]["merges"]
    merges[0], merges[-1] = merges[-1], merges[0]
    (tmp_path / "v.json").write_text(json.dumps(told))
    with pytest.raises(ValueError):
        bpe.Merges(str(tmp_path / "v.json"))
