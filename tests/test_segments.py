"""The index that changes, against a page table that is built anew."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from leafmark.operators import search, segments
from leafmark.operators.filters import Filters
from leafmark.operators.segments import SearchIndex
from leafmark.sources import tables
from leafmark.sources.versions import Conflict, Versions

WORDS = "alpha beta gamma delta beta-max корпус the of and".split()
QUERIES = ["alpha", "alph*", '"alpha beta"', "alpha NOT beta", "(alpha OR beta) AND (gamma OR delta)", "beta-max", 'alpha AND ""', 'alpha beta NOT gam* OR delta AND "beta alph" OR корпус', "alpha alpha", '"the the"', "nowhere", '"beta alpha beta"']


def text(r):
    return "\n".join(" ".join(r.choices(WORDS, weights=range(1, len(WORDS) + 1), k=r.randint(0, 25))) for _ in range(r.randint(1, 4)))


def page_table(spark, docs):
    rows = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    return tables.index_pages(tables.page_lines(rows)), rows


def plain(df):
    return sorted((r.doc_id, r.page_number, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def changed(spark, tmp_path_factory):
    """An index after upserts and deletes, and the documents that it has."""
    r = random.Random(5)
    docs = {i: text(r) for i in range(60)}
    index = SearchIndex.open(spark, str(tmp_path_factory.mktemp("index"))).upsert(page_table(spark, docs)[0])
    for step in range(3):
        new = {i: text(r) for i in r.sample(range(80), 12)} | {step: ""}  # one loses all its pages
        docs |= new
        index = index.upsert(*page_table(spark, new))
        gone = r.sample(range(90), 5)
        docs = {i: t for i, t in docs.items() if i not in gone}
        index = index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    return index, docs


@pytest.mark.parametrize("query", QUERIES)
def test_scores_are_those_of_a_rebuild(spark, changed, query):
    index, docs = changed
    assert plain(index.matching(query)) == plain(search.matching_pages(page_table(spark, docs)[0], query))


def test_dictionary_and_totals(spark, changed):
    index, docs = changed
    pages = page_table(spark, docs)[0]
    want = pages.select("doc_id", "page_number", F.explode("tokens").alias("term")).groupBy("term").agg(F.countDistinct("doc_id", "page_number").alias("df"), F.count("*").alias("cf"))
    assert sorted(map(tuple, index.terms().collect())) == sorted(map(tuple, want.collect()))
    n, mean = search.corpus_stats(pages).head()
    assert index.totals()[0] == n and abs(index.totals()[1] - mean) < 1e-9
    assert {r.term for r in index.terms("be").collect()} == {"beta"}
    assert index.pages().count() == pages.count()


@pytest.mark.parametrize("fan", [2, 3])
def test_merging_changes_nothing(spark, changed, fan, tmp_path):
    index, docs = changed
    shutil.copytree(index.at.path, tmp_path / "copy")
    copy = SearchIndex.open(spark, str(tmp_path / "copy"))
    merged, files = copy.merge(fan)
    assert files > 0 and len(merged.at.parts) < len(index.at.parts)
    for query in ("alpha", '"alpha beta" OR gam*', "the NOT of"):
        assert plain(merged.matching(query)) == plain(index.matching(query))
    assert sorted(map(tuple, merged.terms().collect())) == sorted(map(tuple, index.terms().collect()))
    with pytest.raises(Conflict):  # another writer has made the version
        copy.merge(fan)


def test_changes_after_a_merge(spark, tmp_path):
    r = random.Random(6)
    docs, index = {}, SearchIndex.open(spark, str(tmp_path))
    for step in range(5):
        new = {i: text(r) for i in r.sample(range(20), 8)}
        docs |= new
        index, _ = index.upsert(*page_table(spark, new)).merge(fan=2)
    assert index.merge(fan=9) == (index, 0)
    for query in ("alpha", '"alpha beta"', "the OR del*"):
        assert plain(index.matching(query)) == plain(search.matching_pages(page_table(spark, docs)[0], query))


@pytest.mark.parametrize("query", ["alpha", "alpha OR корпус", "alpha AND the", "the NOT of", "alpha alpha OR beta", "(alpha OR gamma) AND (of NOT and*)"])
def test_top_k_is_the_slice(spark, changed, query):
    index, docs = changed
    documents = page_table(spark, docs)[1].select("doc_id", F.concat(F.lit("f"), "doc_id").alias("file_path"))
    full = search.ranked_documents(index, documents, query).orderBy("score", "doc_id").collect()
    for limit, offset in ((3, 0), (5, 4), (500, 0)):
        top = index.top(documents, query, limit=limit, offset=offset, small=0)
        got = [(r.doc_id, round(r.score, 9), r.n_pages) for r in top.rows.collect()]
        assert got == [(r.doc_id, round(r.score, 9), r.n_pages) for r in full[offset : offset + limit]] and top.read <= top.of


def test_top_k_reads_few_postings(spark, tmp_path):
    docs = {i: "alpha " * (30 if i < 5 else 1) + "filler " * (i % 7 + 3) for i in range(1500)}
    index = SearchIndex.open(spark, str(tmp_path)).upsert(page_table(spark, docs)[0])
    documents = page_table(spark, docs)[1].select("doc_id", F.lit("f").alias("file_path"))
    top = index.top(documents, "alpha", limit=3, small=0)
    assert top.of == 1500 and top.read < 900
    assert [r.doc_id for r in top.rows.collect()] == [r.doc_id for r in search.ranked_documents(index, documents, "alpha").orderBy("score", "doc_id").limit(3).collect()]
    few = index.top(documents, "alpha", Filters(file_path="g%"), limit=3, small=0)  # no document passes the filter
    assert few is None or few.rows.isEmpty()
    assert index.top(documents, "alph*", limit=3, small=0) is None and index.top(documents, "alpha", limit=3) is None


def test_top_k_of_too_many_to_look_up(spark, changed, monkeypatch):
    monkeypatch.setattr(segments, "LOOKED_UP", 1)
    index, docs = changed
    documents = page_table(spark, docs)[1].select("doc_id", F.concat(F.lit("f"), "doc_id").alias("file_path"))
    top = index.top(documents, "alpha OR the NOT and*", limit=3, offset=1, small=0)
    full = search.ranked_documents(index, documents, "alpha OR the NOT and*").orderBy("score", "doc_id").collect()
    assert [r.doc_id for r in top.rows.collect()] == [r.doc_id for r in full[1:4]] and len(full) > 1 and top.read == top.of


def test_search_through_an_index(spark, changed):
    index, docs = changed
    pages, rows = page_table(spark, docs)
    documents = rows.select("doc_id", F.concat(F.lit("f"), "doc_id").alias("file_path"))
    for query in ("alpha OR beta", "the", '"of and"'):
        a, b = ([(r.doc_id, round(r.score, 9), [tuple(p) for p in r.pages]) for r in search.search_with_pages(source, documents, query, limit=7).collect()] for source in (index, pages))
        assert a == b and search.count(index, documents, query).head() == search.count(pages, documents, query).head()


def test_versions_are_whole_and_stay_readable(spark, tmp_path):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    empty = Versions.open(spark, str(tmp_path))
    assert empty.version == 0 and empty.table("documents") is None
    one = empty.add({"documents": ids(1, 2, 3), "pages": ids(1, 1, 2)})
    broken = one.write({"documents": ids(9)})  # a crash before the pages are written and the list is renamed
    assert Versions.open(spark, str(tmp_path)).version == 1 and broken.order == 2
    two = one.add({"documents": ids(4)}, gone=ids(1, 2))
    with pytest.raises(Conflict):
        one.add({"documents": ids(5)})
    found = lambda v, t: sorted(r.doc_id for r in Versions.open(spark, str(tmp_path), v).table(t).collect())
    assert found(1, "documents") == [1, 2, 3] and found(2, "documents") == [3, 4] and found(2, "pages") == [] and found(1, "pages") == [1, 1, 2]
    assert two.add({"documents": ids(1)}).version == 3 and found(3, "documents") == [1, 3, 4]  # an id may come back
    with pytest.raises(KeyError):
        Versions.open(spark, str(tmp_path), 7)
