import collections
import math
import random
import re

import numpy as np
import pytest

from leafmark.llm import lexical
from tests.llm.conftest import HARD

ITEMS = [(1, "the same TEXT, text Ünï a w7"), (2, None), (3, ""), (4, "nothing-of-this qqq"), (5, "upper x y b"), (None, "lower a"), (1, "c c c w99")]


def own_terms(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, k=20):
    counted = [(d, collections.Counter(own_terms(t))) for d, t in docs]
    some, total = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * some + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        rows = []
        for d, c in counted:
            m = 75 + 25 * sum(c.values()) * some // max(1, total)
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in own_terms(text) if t in c)
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if unnamed else d, -s) for i, (s, unnamed, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_table(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, "text").collect()] for name, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    out = lexical.op13_threshold_search(spark, sf)
    assert dict(out.dtypes)["rank"] == "int" and dict(out.dtypes)["score"] == "bigint"
    assert found(out) == plain(docs, items)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_hard_rows(spark, hard, k):
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, rank int")
    assert found(lexical.search(spark.read.parquet(f"{hard}/documents.parquet"), items, k)) == plain([(d, t) for d, t, _, _ in HARD], ITEMS, k)


def test_empty_tables(spark, hard, empty):
    docs, none = (spark.read.parquet(f"{x}/documents.parquet") for x in (hard, empty))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(none, items).isEmpty() and lexical.search(docs, items.limit(0)).isEmpty()


def rows(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(r.choices(words, weights=[1 / (j + 1) for j in range(60)], k=r.randint(1, 60)))) for i in range(n)]


def test_many_blocks_ties_and_blocks_of_queries(spark, monkeypatch):
    docs = rows(700) + [(1000 + i, "w3 w9 w9") for i in range(60)]
    items = [(f"q{i}", t) for i, t in rows(30, seed=2)] + [("tied", "w9 w3")]
    monkeypatch.setattr(lexical, "QUERIES", 600)
    tables = spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id string, text string")
    assert found(lexical.search(*tables, k=5)) == plain(docs, items, 5)


def test_search_stops_before_the_end_of_the_lists():
    """Where one document stands out, a few entries of each list are enough."""
    n = 4000
    counts = np.concatenate([np.full(2, 30), np.ones(n - 2)]).astype("<i4")
    row = {"doc_ids": list(range(n)), "sizes": np.full(n, 40, "<i8").tobytes(), "starts": np.arange(0, 2 * n + 1, 2, dtype="<i8").tobytes(), "terms": np.tile([0, 1], n).astype("<i4").tobytes(), "counts": np.repeat(counts, 2).tobytes()}
    block, best = lexical.Block(row, np.array([500, 700]), n, 40 * n), lexical.Best(2)
    read = block.search(np.array([0, 1]), np.array([1, 1]), best)
    assert read <= 2 * lexical.TURN and best.ids.tolist() == [0, 1]
    again = block.search(np.array([0, 1]), np.array([1, 1]), best)
    assert again <= 2 * lexical.TURN


def test_long_text(spark):
    docs = [(1, "some Words of a long text, é7 " * 200_000), (2, "x" * 5_000_000 + " words"), (3, "words")]
    items = [(1, "words x é7"), (2, "long " * 500)]
    out = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert found(out) == plain(docs, items)
