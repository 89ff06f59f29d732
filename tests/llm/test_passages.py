import collections
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmark.llm import passages, words
from tests.llm.conftest import HARD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, size=20):
    words = [WORD.findall(t or "") for _, t in docs]
    key = lambda i: float("inf") if docs[i][0] is None else docs[i][0]
    first = {}
    for i, w in enumerate(words):
        for at in range(len(w) - size + 1):
            s = tuple(w[at : at + size])
            first[s] = min(first.get(s, (float("inf"), 1 << 60)), (key(i), at))
    out = collections.Counter()
    for i, w in enumerate(words):
        gone = {at + k for at in range(len(w) - size + 1) if first[tuple(w[at : at + size])] < (key(i), at) for k in range(size)}
        out[docs[i][0], len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    return out


def test_query(spark, hard, empty, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert collections.Counter(map(tuple, passages.op9_phrase_automata(spark, sf).collect())) == brute(docs)
    assert collections.Counter(map(tuple, passages.op9_phrase_automata(spark, hard).collect())) == brute([(d, t) for d, t, _, _ in HARD])
    assert passages.op9_phrase_automata(spark, empty).isEmpty()


def overlapping(n=80):
    """Documents of few words with passages in common, ties and repeats."""
    r = random.Random(2)
    common = [f"c{i}" for i in range(70)]
    docs = []
    for i in range(n):
        own = [r.choice("abcdé") for _ in range(r.randint(0, 40))]
        at, n = r.randint(0, 50), r.randint(10, 40)
        docs.append((i % 77, " ".join(own + common[at : at + n] + own[::-1] + common[at : at + n] * r.randint(0, 1)), "en", "a"))
    return docs + [(500, "z " * 100, "en", "a"), (501, "z " * 45, "en", "a"), (None, " ".join(common), "en", "a")]


@pytest.mark.parametrize("hot", [1 << 15, 3])
@pytest.mark.parametrize("bits", [64, 16, 4])
def test_words_decide_whatever_the_hashes(spark, make, hot, bits):
    """Small runs and cells, hot phrases, and hashes that stand for many words."""
    docs = overlapping()
    p = passages.Passages(run=150, cell=2000, hot=hot, gathered=20, bits=bits)
    done = passages.remove_repeats(spark.read.parquet(f"{make(docs)}/documents.parquet"), p)
    got = done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
    assert collections.Counter(map(tuple, got.collect())) == brute([(d, t) for d, t, _, _ in docs])


def test_nothing_goes_that_the_automaton_does_not_find(spark, make, monkeypatch):
    docs = [(1, " ".join(f"p{i}" for i in range(40)), "en", "a"), (2, " ".join(f"p{i}" for i in range(40)), "en", "a")]
    made = spark.read.parquet(f"{make(docs)}/documents.parquet")
    p = passages.Passages()
    found = passages.confirm(made, p)
    run = next(passages.runs(iter(made.filter("doc_id = 2").select("doc_id", F.col("text").cast("binary").alias("text")).toArrow().to_batches()), p.run))
    assert passages.covered(run, found, p).all()
    whole = passages.automaton
    monkeypatch.setattr(passages, "automaton", lambda phrases: whole([b"\0", *phrases[1:]]))
    assert not passages.covered(run, found, p).all()
    monkeypatch.setattr(passages, "automaton", lambda phrases: None)
    assert not passages.covered(run, found, p).any()


def test_kept_text_and_other_columns(spark):
    p = " ".join(f"p{i}" for i in range(30))
    df = spark.createDataFrame([(1, f"a {p} b", 5), (2, f"x\n{p}\ty", 6), (3, None, 7)], "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in passages.remove_repeats(df).collect()}
    assert got[2].kept == "x y" and got[2].n_removed == 30 and got[1].n_removed == 0 and got[1].kept == f"a {p} b" and got[3].kept == ""


def run_of(*texts):
    t = words.tokens([x.encode() for x in texts])
    return passages.Run(None, t, t.text.tobytes())


def test_automaton_finds_whole_words_only():
    run = run_of("aa bb aaa\tbb  aa bb aa", "", "bb aa", "xaa bb", "aa bbx")
    at, number = passages.occurrences(run, [b"aa bb", b"bb aa"])
    assert sorted(zip(at.tolist(), number.tolist())) == [(0, 0), (3, 1), (4, 0), (5, 1), (7, 1)]
    assert not len(passages.occurrences(run, [])[0]) and not len(passages.occurrences(run_of(), [b"a b"])[0])


@pytest.mark.parametrize("lower", [False, True])
def test_tokens(lower):
    texts = [t.encode() for _, t, _, _ in HARD if t] + [b"", b"a", b" a\x00b \x1c ", "Ä İ A".encode(), b"AB" * 9000 + b" " + b"ab" * 9000]
    t = words.joined([words.tokens(texts[:4], lower), words.tokens([], lower), words.tokens(texts[4:], lower)])
    own = [(x.lower() if lower else x).split() for x in texts]
    flat = [w for x in own for w in x]
    assert t.starts.tolist() == np.cumsum([0] + [len(x) for x in own]).tolist()
    raw = t.text.tobytes()
    assert [raw[a : a + n] for a, n in zip(t.begin.tolist(), t.size.tolist())] == flat
    assert words.POWERS[:3].tolist() == [1, 0x9E3779B97F4A7C15, 0x9E3779B97F4A7C15**2 % 2**64] and (words.POWERS % 2 == 1).all()
    assert len(set(t.hashes.tolist())) == len(set(flat)) == len(set(zip(t.hashes.tolist(), flat)))
    assert len(set(passages.numbered(t).tolist())) == len(set(flat))


def test_numbers_of_words_with_one_hash():
    t = words.tokens([b"a b a c bb a"])
    t.hashes[:] = 7
    assert passages.numbered(t).tolist() == [0, 1, 0, 2, 3, 0]


def test_megabytes_in_one_text(spark, make):
    r = random.Random(4)
    long = " ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(300_000))
    docs = [(1, long, "en", "a"), (2, "x " + long[700_000:720_000] + " y", "en", "a")]
    got = {row.doc_id: row for row in passages.op9_phrase_automata(spark, make(docs)).collect()}
    own = docs[1][1].split()
    assert got[1].n_removed == 0 and got[1].n_words == 300_000
    assert len(own) - got[2].n_removed <= 4 and got[2].n_words == len(own)


def test_query_equals_sql(spark, sf):
    path = f"{sf}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    assert sorted(map(tuple, passages.op9_phrase_automata(spark, sf).collect())) == sorted(con.execute(passages.OP9_SQL).fetchall())
