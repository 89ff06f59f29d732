import collections

import numpy as np
import pandas as pd

from leafmark.llm import mixing
from tests.llm.conftest import HARD


def fill(sizes, share=1.5, most=2):
    """Targets by resharing the excess until none is above its limit; ``sizes`` in order of the sources."""
    weights, left, out = [5, 2, 1], share * sum(sizes), [None] * len(sizes)
    while True:
        open_ = [i for i, t in enumerate(out) if t is None]
        w = sum(weights[i % 3] for i in open_)
        over = [i for i in open_ if left * weights[i % 3] / w >= most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i % 3] / w
            return out
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)


def check(rows, docs):
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = collections.Counter()
    for _, t, s in docs:
        by[s] += size(t)
    order = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in by else [])
    want = dict(zip(order, fill([by[s] for s in order])))
    assert collections.Counter((r.doc_id, r.size) for r in rows) == collections.Counter((d, size(t)) for d, t, _ in docs)
    source = {(d, size(t)): s for d, t, s in docs}
    taken = collections.Counter()
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id, r.size]] += r.taken
    for r in rows:
        s = source[r.doc_id, r.size]
        assert r.source_size == by[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
    return {s: (taken[s], want[s]) for s in order}


def test_query(spark, sf, make, empty):
    sf = sf.replace("sf0.001", "sf0.01")  # fifty documents a source; with ten, none need come near
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = mixing.op10_entropy_mix(spark, sf).collect()
    for got, want in check(rows, docs).values():
        assert abs(got - want) <= 0.02 * want
    assert sorted(rows) == sorted(mixing.op10_entropy_mix(spark, sf).collect())
    assert mixing.op10_entropy_mix(spark, empty).isEmpty()
    unique = [x for i, x in enumerate(HARD) if x not in HARD[:i] and x[0] not in (1,)]
    check(mixing.op10_entropy_mix(spark, make(unique)).collect(), [(d, t, s) for d, t, _, s in unique])


def test_hot_source_of_copies(spark, make):
    docs = [(i, "one two three", "en", "b") for i in range(3000)] + [(5000 + i, "word " * (1 + i % 17), "en", "ca"[i % 2]) for i in range(600)]
    for got, want in check(mixing.op10_entropy_mix(spark, make(docs)).collect(), [(d, t, s) for d, t, _, s in docs]).values():
        assert abs(got - want) <= 0.005 * want + 3


def test_sources_without_words(spark, make):
    rows = mixing.op10_entropy_mix(spark, make([(1, None, "en", "a"), (2, "", "en", "b"), (3, "x y", "en", None)])).collect()
    assert {r.doc_id: (r.size, r.source_size, r.target) for r in rows} == {1: (0, 0, 0.0), 2: (0, 0, 0.0), 3: (2, 2, 3.0)}


def test_diffusion_error_is_below_the_smallest_sizes():
    r = np.random.default_rng(0)
    sizes = np.unique(r.integers(1, 2000, 300))
    cells = pd.DataFrame({"_key": "=", "size": sizes, "n": r.integers(1, 5, len(sizes)), "source_size": 0, "target": 0.0, "_r": r.random(len(sizes)) * 2})
    out = mixing.diffuse(cells).set_index("size")
    took = ((out["n"] * out["_base"] + out["_extra"]) * out.index).sum()
    assert abs(took - (cells["size"] * cells["n"] * cells["_r"]).sum()) < 20


def test_balance_meets_targets(spark):
    rows = [("=a", s, 1 + s % 3, 0, 0.0, 1.0 + s / 50) for s in range(1, 100)] + [("=b", 10, 4, 0, 0.0, 1.0)]
    df = pd.DataFrame(rows, columns=["_key", "size", "n", "source_size", "target", "_z"])
    df["source_size"] = (df["size"] * df["n"]).groupby(df["_key"]).transform("sum")
    for share in (0.1, 1.0, 1.9):
        df["target"] = df["source_size"] * share
        got = mixing.balance(spark.createDataFrame(df), 2).toPandas()
        total = (got["size"] * got["n"] * got["_r"]).groupby(got["_key"]).sum()
        want = df.groupby("_key")["target"].first()
        assert ((total - want).abs() < 1e-3 * want).all() and got["_r"].between(0, 2).all()


def tilted(sizes, target, most=2.0):
    """Rates by bisection on the one dual variable of a source."""
    z = np.round(np.log1p(sizes) / np.mean(np.log1p(sizes)), 9)
    low, high = -700.0, 700.0
    for _ in range(200):
        dual = (low + high) / 2
        r = most / (1 + np.exp(-dual * z))
        low, high = (dual, high) if (sizes * r).sum() < target else (low, dual)
    return r


def test_rates_and_copies_are_those_of_bisection(spark):
    r = np.random.default_rng(2)
    docs = [(i, "ab"[i % 2], int(r.integers(1, 60))) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, size long")).collect()
    for source in "ab":
        own = [x for x in got if x.source == source]
        sizes = np.array([x.size for x in own], float)
        target = own[0].target
        rates = np.full(len(own), 2.0) if target >= 2 * sizes.sum() else tilted(sizes, target)
        want = took = 0.0
        for size in sorted(set(sizes), reverse=True):  # long documents first, each size rounded with what is left over
            at = np.flatnonzero(sizes == size)
            want += rates[at].sum() * size
            copies = [own[i].copies for i in at]
            low = int(rates[at[0]])
            assert set(copies) <= {low, low + 1}
            assert sum(copies) == len(at) * low + min(len(at), max(0, round((want - took) / size) - len(at) * low))
            took += sum(copies) * size


def test_names_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a", 5, "x")] * 40 + [(None, None, 7, "y")] * 3, "doc_id long, source string, size long, copies string")
    got = mixing.mix(docs).collect()
    assert len(got) == 43 and sum(r.copies for r in got if r.doc_id == 1) in range(57, 64)


def test_megabytes_in_one_text(spark, make):
    rows = mixing.op10_entropy_mix(spark, make([(1, "ab " * 700_000, "en", "a"), (2, "x", "en", "a")])).collect()
    assert {r.doc_id: r.size for r in rows} == {1: 700_000, 2: 1} and {r.source_size for r in rows} == {700_001}
