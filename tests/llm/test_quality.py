import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmark.llm import joins, quality
from tests.llm.conftest import HARD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_counts_of_hard_texts(spark, hard, empty):
    got = quality.op4_robust_outliers(spark, hard).collect()
    want = collections.Counter((d, *base(t)) for d, t, _, _ in HARD)
    assert collections.Counter((r.doc_id, *counts(r)) for r in got) == want
    assert all(r.kept == (not r.base_failed) and (r.d2 is None) == r.base_failed for r in got)  # too few rows for one to be far from the others
    assert quality.op4_robust_outliers(spark, empty).isEmpty()


def test_counts_of_the_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = quality.op4_robust_outliers(spark, sf).collect()
    assert {r.doc_id: counts(r) for r in got} == {d: base(t) for d, t in texts.items()}


def test_judge_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", 3, "x")], "doc_id long, text string, lang string, source string, n_words int, note string")
    r = quality.judge(df).head()
    assert r.note == "x" and r.n_words == 2 and not r.kept


def samples(spark, n=3000, bad=300, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, "g", *map(float, r.normal(0, 1, 6).round(6))) for i in range(n)] + [(n + i, "g", *map(float, r.normal(30, 0.5, 6).round(6))) for i in range(bad)]
    return spark.createDataFrame(rows, "_id long, _g string, " + ", ".join(f"{s} double" for s in quality.STATS)), np.array([x[2:] for x in rows])


def concentrate(x, how):
    """The same steps with numpy and exact order statistics."""
    mean, cov = x.mean(0), np.cov(x.T, bias=True) + how.floor * np.eye(6)
    for _ in range(how.steps):
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        core = x[np.argsort(d)[: int(np.ceil(how.core * len(x)))]]
        mean, cov = core.mean(0), np.cov(core.T, bias=True) * quality.core_scale(how.core) + how.floor * np.eye(6)
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def test_estimates_ignore_a_cluster_of_outliers(spark):
    df, x = samples(spark)
    how = quality.Outliers()
    got = np.array([r._d2 for r in quality._distances(df, quality.estimates(df, how, 1), 1).orderBy("_id").collect()])
    want = concentrate(x, how)
    assert (got[3000:] > how.cut).all() and (got[:3000] < how.cut).all()
    assert np.median(np.abs(got / want - 1)) < 0.03  # the core's edge is a bin of distances
    assert np.array_equal(got, [r._d2 for r in quality._distances(df, quality.estimates(df.repartition(7), how, 1), 1).orderBy("_id").collect()])


def test_large_group_tables_are_joined_in_parts(spark, monkeypatch):
    rows = spark.range(1000).select(F.col("id").alias("_id"), (F.col("id") % 3).cast("string").alias("_g"))
    groups = spark.createDataFrame([("0", 1), ("1", 2), ("2", 3)], "_g string, x int")
    want = sorted(joins.with_groups(rows, groups, "_g", 3, "_id").collect())
    monkeypatch.setattr(joins, "SENT", 1)
    assert sorted(joins.with_groups(rows, groups, "_g", 3, "_id").select("_g", "_id", "x").collect()) == want


@pytest.mark.parametrize(("share", "sd"), [(0.15, 10), (0.24, 10), (0.24, 30)])
def test_estimates_withstand_a_tight_cluster(spark, share, sd):
    """Bad rows of up to a quarter, whose determinant numpy does not beat from 50 random starts."""
    n, r = 3000, np.random.default_rng(int(sd + 100 * share))
    bad = int(n * share / (1 - share))
    x = np.concatenate([r.normal(0, 1, (n, 6)), r.normal(sd, 0.5, (bad, 6))]).round(6)
    df = spark.createDataFrame([(i, "g", *row) for i, row in enumerate(x.tolist())], "_id long, _g string, " + ", ".join(f"{c} double" for c in quality.STATS))
    how = quality.Outliers()
    found = quality.estimates(df, how, 1)
    got = np.array([row._d2 for row in quality._distances(df, found, 1).orderBy("_id").collect()])
    assert (got[n:] > how.cut).all() and (got[:n] < how.cut).all()
    best = np.inf
    for _ in range(50):
        core = x[r.choice(len(x), 7, replace=False)]
        for _ in range(12):
            cov = np.cov(core.T, bias=True) + how.floor * np.eye(6)
            d = np.einsum("ij,jk,ik->i", x - core.mean(0), np.linalg.inv(cov), x - core.mean(0))
            core = x[np.argsort(d)[: int(np.ceil(how.core * len(x)))]]
        best = min(best, np.linalg.slogdet(np.cov(core.T, bias=True) * quality.core_scale(how.core) + how.floor * np.eye(6))[1])
    assert found.select(quality._log_det().alias("x")).head().x < best + 0.05


def test_core_scale():
    r = np.random.default_rng(0).normal(0, 1, (400_000, 6))
    d = (r**2).sum(1)
    assert abs(quality.core_scale(0.75) - 1.3616) < 0.0001 and quality.core_scale(1.0) == 1.0
    for core in (0.5, 0.6, 0.9):
        assert abs(quality.core_scale(core) * r[d <= np.quantile(d, core)].var(0).mean() - 1) < 0.01


def prose(r, n):
    return " ".join("".join(r.choice(list("abcdefghij"), int(r.integers(2, 9)))) for _ in range(n))


def test_small_groups_are_judged_by_their_own_rows_and_their_language(spark):
    """Junk in a group of few rows, and in one of a single row, is far; the good rows of these are not."""
    r = np.random.default_rng(7)
    rows = [(i, prose(r, int(r.integers(80, 300))), "en", f"s{i % 12}") for i in range(480)]
    rows += [(1000 + i, prose(r, 150), "en", "few") for i in range(9)] + [(1009, prose(r, 150), "xx", "alone")]
    bad = lambda k: " ".join(f"{'#$%' * 12}{k}-{j}" for j in range(120))
    rows += [(2000, bad(0), "en", "few"), (2001, bad(1), "en", "lonely"), (2002, bad(2), "yy", None)]
    got = {row.doc_id: row for row in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].d2 > 100 and not got[i].kept for i in (2000, 2001, 2002))
    assert all(got[i].kept for i in got if i < 2000)


NAMES = "_id _g _n _w _t _l _h _p _at _d2 _b _cut _size _k _lang d2 kept n_words t w l h p at rest row group text_ m0 l00 _group _best _row a.b".split()


def test_clashing_names(spark):
    first, second = (1, "one two", "en", "s", *NAMES), (2, prose(np.random.default_rng(1), 60), None, None, *[None] * len(NAMES))
    df = spark.createDataFrame([first, second], ", ".join(f"`{n}` string" for n in ["doc_id", "text", "lang", "source", *NAMES]).replace("`doc_id` string", "doc_id long"))
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert got[1].n_words == 2 and got[2].kept
    for name in NAMES:
        assert name in quality.JUDGED or (got[1][name], got[2][name]) == (name, None)


def test_places_of_windows_whatever_their_hashes(spark):
    """Upper bits that deceive: the packed sort agrees with plain counting."""
    r = np.random.default_rng(3)
    rows = [[int(x) << 24 | int(y) for x, y in zip(r.integers(0, 3, n), r.integers(0, 2, n))] for n in (0, 1, 2, 5, 30, 60)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(rows)], "i long, h array<bigint>")
    low = (1 << 24) - 1
    packed = F.sort_array(F.transform("h", lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    got = {x.i: x.at for x in df.select("i", "h", packed.alias("p")).select("i", quality.repeated_places(F.col("p"), F.col("h")).alias("at")).collect()}
    assert got == {i: [k for k, x in enumerate(h) if h.count(x) > 1] for i, h in enumerate(rows)}


def test_megabytes_in_one_text(spark, make):
    r = np.random.default_rng(9)
    text = " ".join(f"w{x}" for x in r.integers(0, 60, 200_000)) + "\n" + "A b#c\n" * 9
    got = {row.doc_id: counts(row) for row in quality.op4_robust_outliers(spark, make([(1, text, "en", "a"), (2, prose(r, 90), "en", "a")])).collect()}
    assert got[1] == base(text)
