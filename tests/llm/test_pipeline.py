import collections

from pyspark.sql import functions as F

import corpus_pipeline as P
from leafmark.llm import passages, quality
from tests.llm.conftest import HARD
from tests.llm.test_neardup import components, slow_fingerprint
from tests.llm.test_packing import check as check_packing


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stage = dict(P.STAGES)
    good = stage["quality rules"](spark, docs, sf).cache()
    kept = {r.doc_id for r in quality.op4_robust_outliers(spark, sf).collect() if r.kept}
    assert good.columns == columns and sorted(r.doc_id for r in good.collect()) == sorted(kept)

    unique = stage["SimHash near-dedup"](spark, good, sf).cache()
    rows = good.collect()
    least = {}
    for r, root in zip(rows, components([slow_fingerprint(r.text) for r in rows])):
        least[root] = min(r.doc_id, least.get(root, r.doc_id))
    assert unique.columns == columns and {r.doc_id for r in unique.collect()} <= set(least.values())

    cut = stage["substring dedup"](spark, unique, sf).cache()
    want = {r.doc_id: r for r in passages.remove_repeats(unique).collect() if r.n_removed == 0 or r.n_removed < r.n_words}
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns and got.keys() == want.keys()
    for d, r in got.items():
        assert r.text == (want[d].kept if want[d].n_removed else want[d].text) and r.n_chars == len(r.text)

    mixed = stage["mixing sources to target weights"](spark, cut, sf).cache()
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(copies.values()) <= {1, 2} and copies.keys() <= got.keys()
    words = lambda rs: sum(len(r.text.split()) for r in rs)
    assert abs(words(mixed.collect()) / words(got.values()) - 1.5) < 0.02

    packed = stage["packing"](spark, mixed, sf)
    check_packing(packed.collect(), [(r.doc_id, r.text) for r in mixed.collect()])


def test_run_applies_all(spark, sf):
    pieces = P.run(spark, sf)
    assert pieces.count() > 0 and pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_hard_and_empty_tables(spark, hard, empty, make):
    assert P.run(spark, hard).columns[0] == "doc_id" and P.run(spark, empty).isEmpty()
    text, other = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(70))
    named = make([(1, text, "en", "a"), (2, text.upper(), "en", "a"), (2, text.upper(), "en", "a"), (None, text + " more", "en", None), (None, other + " " + text, "en", None), (None, None, None, None)])
    docs = spark.read.parquet(f"{named}/documents.parquet")
    good = P.quality_rules(spark, docs, named)
    assert sorted((r.doc_id or 0) for r in good.collect()) == [0, 0, 1, 2, 2]
    unique = P.near_duplicates(spark, good, named)
    assert sorted((r.doc_id or 0) for r in unique.collect()) == [0, 1]
    cut = P.repeated_passages(spark, unique, named)
    assert sorted(((r.doc_id or 0), r.text) for r in cut.collect()) == [(0, other), (1, text)]
    assert len(HARD) == docs.sparkSession.read.parquet(f"{hard}/documents.parquet").count()


def test_rows_that_share_a_doc_id_and_equal_rows(spark):
    """Unlike texts of one doc_id stay both; of equal rows one stays, whichever files they are in."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(90)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, c, "en", "s", 1), (2, c, "en", "s", 1), (2, c, "de", "s", 1), (None, c, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, P.near_duplicates(spark, docs, "").collect()))
    assert len(got) == 3 and {x[1] for x in got} == {a, b, c} and all(x[0] for x in got)
    assert got == sorted(map(tuple, P.near_duplicates(spark, docs.repartition(5), "").collect()))
    cut = P.repeated_passages(spark, docs.limit(2), "")
    assert cut.count() == 2
    many = spark.createDataFrame([(7, a, "en", "s", 1)] * 10 + [(7, b, "en", "s", 1)] * 10, docs.schema)
    mixed = P.mixed_sources(spark, many, "").groupBy("text").count().collect()
    assert sum(r["count"] for r in mixed) == 30  # 150 % of 20 documents of one size


CLASHES = "row key copies copy size n n_words n_removed kept _doc _key _source _text text_key root first other0 d2 component_id fp a.b shard slot target".split()


def test_columns_with_names_of_their_own(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES))
    for name, stage in P.STAGES[:-1]:
        plain, out = stage(spark, docs, sf), stage(spark, wide, sf)
        assert out.columns == wide.columns, name
        found = out.collect()
        assert sorted(map(tuple, plain.collect())) == sorted(tuple(r[c] for c in docs.columns) for r in found), name
        assert all(r[c] == f"{c}{r.doc_id}" for r in found for c in CLASHES), name


def test_near_dedup_searches_components_over_all_texts(spark):
    """A text that is similar only to a dropped one of its group goes too."""
    base = [f"w{i}" for i in range(300)]

    def edited(spots):
        return [f"e{i}" if i in spots else w for i, w in enumerate(base)]

    # one edit that leaves the fingerprint within two bits, and six more: 0.82 from the second text, 0.79 from the first
    near = next(i for i in range(10, 290) if (slow_fingerprint(" ".join(edited({i}))) ^ slow_fingerprint(" ".join(base))).bit_count() <= 2)
    more = [i for i in range(5, 290, 9) if abs(i - near) > 5][:6]
    a, b, c = edited(set()), edited({near}), edited({near, *more})
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate([a, b, c])], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in P.near_duplicates(spark, docs, "").collect()] == [0]


def test_rows_that_differ_in_where_a_null_is_and_columns_of_any_kind(spark):
    text, other = (" ".join(f"{x}{i}" for i in range(90)) for x in "ab")
    at = "timestamp'2024-01-01 00:00:00"
    rows = spark.createDataFrame([(1, text, "en", None, 1), (1, text, None, "en", 1), (2, other, None, None, 1), (2, other, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    wide = rows.withColumn("more", F.map_from_arrays(F.array(F.lit("k")), F.array(F.col("doc_id")))).withColumn("at", F.expr(f"CASE WHEN lang IS NULL THEN {at}.000001' ELSE {at}.000002' END"))
    good = P.quality_rules(spark, wide, "").collect()
    assert len(good) == 4
    for docs in (rows, wide):
        out = P.mixed_sources(spark, docs, "")
        assert {(r.lang, r.source) for r in out.filter("doc_id = 1").collect()} == {("en", None), (None, "en")} and out.count() == 6  # 150 %
        assert len(P._rows(docs).select("key").distinct().collect()) == 3
        stay = P.near_duplicates(spark, docs, "").collect()
        assert sorted(r.doc_id for r in stay) == [1, 2]
    assert P.repeated_passages(spark, wide, "").columns == wide.columns


def test_texts_whose_hashes_collide_stay_apart(spark, sf):
    rows = P._rows(spark.read.parquet(f"{sf}/documents.parquet")).withColumn("digest", P._digest(F.col("row.text")))
    texts = rows.select("digest").distinct().cache()
    few = lambda digest: F.pmod(F.xxhash64(digest), F.lit(256))
    keyed, named = P._with_text_keys(spark, rows, texts, few)
    assert named.select("text_key").distinct().count() == texts.count() == named.count()
    assert keyed.count() == rows.count() and keyed.select("text_key", "digest").distinct().count() == texts.count()


def test_empty_table_of_each_stage(spark, empty):
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    for name, stage in P.STAGES:
        assert stage(spark, docs, empty).isEmpty(), name
