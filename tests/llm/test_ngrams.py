import collections
import math
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from leafmark.llm import ngrams, words
from tests.llm.conftest import HARD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]


def brute(docs):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base, score) by plain counting."""
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs]
    train = [tokens(t) for (_, t), h in zip(docs, held) if not h]
    c = collections.Counter(w for d in train for w in d)
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter(p for d in train for p in zip(["<s>", *d], d))
    hist = lambda x: np.array([sum(1 for y in x.values() if y == k) for k in (1, 2, 3, 4)])
    before = collections.Counter(w for _, w in pairs)
    top, low = ngrams.discounts(hist(pairs)), ngrams.discounts(hist(before))
    cut = lambda x, d: d[min(x, 3) - 1] if x else 0
    total, left = collections.Counter(), collections.Counter()
    for (a, _), x in pairs.items():
        total[a] += x
        left[a] += cut(x, top)
    spare = sum(cut(x, low) for x in before.values()) / max(1, len(pairs)) if pairs else 1.0
    lower = lambda w: max(before[w] - cut(before[w], low), 0) / max(1, len(pairs)) + spare / (v + 1)
    out = []
    for (d, t), h in zip(docs, held):
        own = tokens(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)
        score = sum(math.log10((max(pairs[a, w] - cut(pairs[a, w], top), 0) / total[a] if total[a] else 0) + (left[a] / total[a] if total[a] else 1) * lower(w)) for a, w in zip(["<s>", *own], own))
        out.append((d, h, len(own), sum(w in c for w in own), n, round(base, 6), round(score, 6)))
    return collections.Counter(out)


def tokens_of(own):
    """Hashes of words; a line break is the end."""
    return np.array([ngrams.END if w == b"\n" else words.tokens([w]).hashes[0] for w in own], np.uint64)


def rows(df):
    return collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())


def test_query_equals_counting(spark, sf, hard, empty):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(ngrams.op7_kneser_ney(spark, sf)) == brute(docs)
    assert rows(ngrams.op7_kneser_ney(spark, hard)) == brute([(d, t) for d, t, _, _ in HARD])
    assert ngrams.op7_kneser_ney(spark, empty).isEmpty()


def test_hot_words_and_many_cells(spark, make):
    r = np.random.default_rng(5)
    docs = [(i, " ".join("the" if r.random() < 0.4 else f"w{int(r.zipf(1.4)) % 300}" for _ in range(int(r.integers(0, 60)))), "en", "a") for i in range(200)]
    how = ngrams.Counting(run=300, cell=500, hot=100)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(200)]
    df = spark.createDataFrame([(d, h, t) for (d, t, _, _), h in zip(docs, held)], "doc_id long, held_out boolean, text string").repartition(3)
    m = ngrams.train(df.filter("not held_out"), how)
    assert m.vocabulary.cells > 8
    got = ngrams.score(df, m, how).withColumn("train_tokens", F.lit(m.tokens))
    assert rows(got) == brute([(d, t) for d, t, _, _ in docs])


def test_counts_beyond_32_bits():
    sums = ngrams.Sums()
    for _ in range(3):
        sums.add(np.array([1, 2], np.uint64), np.array([2**32 - 1, 1], np.uint32))
    keys, counts = sums.done()
    assert keys.tolist() == [1, 2] and counts.tolist() == [3 * (2**32 - 1), 3]


def test_megabytes_in_one_text(spark, make):
    r = np.random.default_rng(6)
    docs = [(1, " ".join(f"w{x}" for x in r.integers(0, 5000, 300_000)), "en", "a"), (2, "w1 w2 w3", "en", "a")]
    assert rows(ngrams.op7_kneser_ney(spark, make(docs))) == brute([(d, t) for d, t, _, _ in docs])


def test_probabilities_sum_to_one(spark, make):
    docs = [(i, t, "en", "a") for i, t in enumerate(["a b a b c", "b c", "a", "c c c a", "", "b a d e"])]
    folder = make(docs)
    m = ngrams.train(spark.read.parquet(f"{folder}/documents.parquet"))
    names = [b"a", b"b", b"c", b"d", b"e", b"\n", b"never"]
    for context in (b"a", b"c", b"never"):
        total = 0.0
        for w in names:
            run = tokens_of([context, w])
            total += 10 ** ngrams.word_scores(m, run, np.array([0]))[1][1]
        assert total == pytest.approx(1.0)


def test_discounts():
    assert ngrams.discounts(np.array([0, 0, 0, 0])) == (0.5, 0.5, 0.5)
    d = ngrams.discounts(np.array([100, 40, 20, 10]))
    y = 100 / 180
    assert d == pytest.approx((1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.5))
