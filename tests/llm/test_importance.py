import hashlib
import math
import re
import zlib

import pytest

from leafmark.llm import importance
from tests.llm.conftest import HARD

TARGETS = [(1, "same text of the UPPER lower ones"), (2, None), (3, ""), (4, "Ünï w7 w8 w9 same"), (4, "Ünï w7 w8 w9 same")]


def plain(docs, targets, run=1, least=20, percent=10, buckets=10_000):
    def features(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        return [b" ".join(words[i : i + k]) for k in range(1, run + 1) for i in range(len(words) - k + 1)], len(words)

    s, t = [0] * buckets, [0] * buckets
    for side, texts in ((s, [x for _, x in docs]), (t, targets)):
        for text in texts:
            for f in features(text)[0]:
                side[zlib.crc32(f) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for d, text in docs:
        own, n = features(text)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in own)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    may = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = i + 1
    return sorted((r[:5] for r in rows), key=repr)


def found(df):
    return sorted((list(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(TARGETS, "item_id long, text string")


@pytest.mark.parametrize("run,least,percent", [(1, 20, 10), (1, 0, 100), (3, 2, 50)])
def test_hard_rows_equal_plain_counting(spark, hard, target, run, least, percent):
    docs = [(d, t) for d, t, _, _ in HARD]
    out = importance.draw(spark.read.parquet(f"{hard}/documents.parquet"), target, run=run, least=least, percent=percent)
    assert found(out) == plain(docs, [t for _, t in TARGETS], run, least, percent)


def test_table(spark, sf):
    docs, targets = ([(r[0], r[1]) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, "text").collect()] for name, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    out = importance.op11_sort_count_resampling(spark, sf)
    assert out.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert found(out) == plain(docs, [t for _, t in targets])


def test_empty_tables(spark, empty, hard, target):
    none = spark.read.parquet(f"{empty}/documents.parquet")
    assert importance.draw(none, target).isEmpty()
    out = importance.draw(spark.read.parquet(f"{hard}/documents.parquet"), target.limit(0))
    assert found(out) == plain([(d, t) for d, t, _, _ in HARD], [])


def test_ties_repeats_and_columns_that_clash(spark, target):
    docs = [(7, "twice the same words " * 9)] * 5 + [(6, "other words here " * 9), (None, "no id at all " * 9)]
    rows = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id long, text string, _rank int, bucket int, _row int").repartition(3)
    out = importance.draw(rows, target, percent=100)
    assert found(out) == plain(docs, [t for _, t in TARGETS], percent=100)


def test_long_text_in_parts(spark, target, monkeypatch):
    text = ("some Words of a long text, é7 " * 90_000) + "x" * 5_000_000 + " end"
    for run in (1, 2):
        out = importance.draw(spark.createDataFrame([(1, text), (2, "short " * 30)], "doc_id long, text string"), target, run=run)
        assert found(out) == plain([(1, text), (2, "short " * 30)], [t for _, t in TARGETS], run)


def test_a_bucket_has_16_bits(spark, target):
    with pytest.raises(ValueError):
        importance.draw(target, target, buckets=1 << 17)
