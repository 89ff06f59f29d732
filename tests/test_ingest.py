import pytest
from pyspark.sql import functions as F

from leafmark import schemas
from leafmark.operators import ingest

FILES = "file_path string, file_size long, last_modified string, file_hash string"
INDEX = "doc_id string, file_path string, file_hash string, cached_size long, cached_mtime string"


def test_change_detection(spark):
    index = spark.createDataFrame([("i1", "a", "h1", 1, "t"), ("i2", "b", "h2", 2, "t"), ("i3", "c", "h3", 3, "t")], INDEX)
    files = spark.createDataFrame(
        [("a", 1, "t", "h1"), ("b", 2, "new", "h2"), ("c", 9, "t", "h9"), ("moved", 3, "t", "h3"), ("x", 5, "t", "h5"), ("y", 5, "t", "h5"), ("empty", 0, "t", "h0"), ("broken", 4, "t", None)], FILES
    )
    got = {r.file_path: (r.outcome, r.known_id, r.duplicate_of) for r in ingest.detect_changes(files, index).collect()}
    assert got == {
        "a": ("skipped", "i1", None), "b": ("duplicate", "i2", "i2"), "c": ("to_index", "i3", None), "moved": ("duplicate", None, "i3"),
        "x": ("to_index", None, None), "y": ("duplicate", None, "x"), "empty": ("error", None, None), "broken": ("error", None, None),
    }
    c = ingest.scan_counters(ingest.detect_changes(files, index)).head()
    assert (c.total, c.to_index, c.duplicate, c.skipped, c.error, c.processed, c.percent) == (8, 2, 3, 1, 2, 8, 100.0)
    nothing = ingest.scan_counters(ingest.detect_changes(files.limit(0), index)).head()
    assert (nothing.total, nothing.error, nothing.percent) == (0, 0, 0.0)


def test_index_status(spark):
    index = spark.createDataFrame([("i1", "a", "h1", 1, "t"), ("i2", "b", "h2", 2, "t"), ("i3", "c", "h3", 3, "t"), ("i4", "d", "h4", 4, "t")], INDEX)
    files = spark.createDataFrame([("a", 1, "t", None), ("b", 2, "new", "h2"), ("c", 9, "t", "h9"), ("d", 9, "t", None), ("e", 3, "t", "h3"), ("f", 5, "t", "h5"), ("g", 5, "t", None)], FILES)
    got = {r.file_path: r.status for r in ingest.index_status(files, index).collect()}
    assert got == {"a": "indexed", "b": "indexed", "c": "modified", "d": "modified", "e": "duplicate", "f": "new", "g": "new"}


@pytest.mark.parametrize(
    "statuses, state",
    [
        ([], "no_source_files"), (["new", "modified"], "empty"), (["indexed", "duplicate"], "fully_indexed"), (["duplicate"], "needs_update"), (["indexed", "new"], "partially_indexed"), (["duplicate", "new"], "needs_update"),
    ],
)
def test_index_state(spark, statuses, state):
    df = spark.createDataFrame([(s,) for s in statuses], "status string")
    assert ingest.index_state(df).head().state == state


def test_pages_have_gaps_but_counts_do_not(spark):
    docs = spark.createDataFrame([(1, "A\n\n  \n Б"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ingest.page_plan(docs).collect()}
    assert got[1].page_count == 4 and [(p.page_number, p.text, p.normalized_text) for p in got[1].pages] == [(0, "A", "a"), (3, "Б", "б")]
    assert got[2].page_count == 1 and got[2].pages == []
    assert len(ingest.page_plan(docs, keep_empty=True).filter("doc_id = 1").head().pages) == 4


def test_upsert_delete_lookup(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, x string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "doc_id long, x string")
    assert sorted(ingest.upsert(old, new).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    again = ingest.upsert(ingest.upsert(old, new), new)
    assert sorted(again.collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert ingest.delete(old, new).collect() == [(1, "a")]
    assert ingest.lookup(old, "doc_id", 9).isEmpty()
    with pytest.raises(ValueError):
        ingest.lookup(old, "x", "a")


def test_quarantine_is_by_document(spark):
    plans = spark.sql("SELECT * FROM VALUES (1, array(named_struct('page_number', 0))), (2, array(named_struct('page_number', 0), named_struct('page_number', null))), (null, array()) AS t(doc_id, pages)")
    good, bad = ingest.split_plans(plans)
    assert [r.doc_id for r in good.collect()] == [1] and bad.count() == 2


def test_page_texts(spark):
    pages = spark.createDataFrame([("a", 0, "zero"), ("a", 2, "two")], "doc_id string, page_number int, text string")
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    assert ingest.page_text(pages, "a", 2).head()[0] == "two" and ingest.page_text(pages, "a", 1).head()[0] == ""
    got = sorted(tuple(r) for r in ingest.page_texts(pages, docs, ["a", "b", "c", "a"], 0).collect())
    assert got == [("a", "zero", "ok"), ("b", "", "no_page"), ("c", "", "no_document")]
    with pytest.raises(ValueError):
        ingest.page_texts(pages, docs, [], 0)


def test_migration_and_scans(spark):
    v2 = spark.createDataFrame([("a",)], "doc_id string")
    assert ingest.migrate(v2, schemas.MIGRATIONS, 2).columns == ["doc_id", "cached_size", "cached_mtime", "object_code", "discipline_code", "document_type_code", "unmatched_flag"]
    assert ingest.migrate(v2, schemas.MIGRATIONS, 6).columns == ["doc_id"]
    scans = spark.createDataFrame([(1, "done"), (3, "running"), (2, "running")], "scan_id long, status string")
    assert ingest.latest_scan(scans).collect() == [(3, "running")] and ingest.latest_scan(scans.limit(0)).isEmpty()
    assert ingest.interrupt_stale(scans).filter(F.col("status") == "interrupted").count() == 2


def test_batched_write_replaces_documents_whole(spark, tmp_path):
    page = "array<struct<page_number: int, text: string, normalized_text: string>>"
    plans = spark.createDataFrame(
        [(1, 2, [(0, "a", "a"), (1, "b", "b")]), (2, 1, [(None, "x", "x")]), (None, 1, [(0, "y", "y")]), (3, 1, [(0, "p", "p"), (0, "q", "q")]), (1, 3, [(0, "late", "late")]), (4, 0, [])],
        f"doc_id long, page_count int, pages {page}",
    )
    tables = {"documents": spark.createDataFrame([(1, 9), (5, 1)], "doc_id long, page_count int"), "pages": spark.createDataFrame([(1, 7, "old", "old"), (5, 0, "five", "five"), (2, 0, "two", "two")], "doc_id long, page_number int, text string, normalized_text string")}
    new, counts = ingest.write_all(plans, tables, str(tmp_path / "next"))
    assert counts == {"success": 2, "failed": 4}
    assert sorted(map(tuple, new["documents"].collect())) == [(1, 3), (4, 0), (5, 1)]  # of two plans for 1 the one with fewer pages
    assert sorted((r.doc_id, r.text) for r in new["pages"].collect()) == [(1, "late"), (2, "two"), (5, "five")]
    left = ingest.delete_cascade(new, spark.createDataFrame([(1,)], "doc_id long"))
    assert {name: sorted(r.doc_id for r in t.collect()) for name, t in left.items()} == {"documents": [4, 5], "pages": [2, 5]}
    assert ingest.exists(new["documents"], "doc_id", 4) and not ingest.exists(new["documents"], "doc_id", 99)


def test_versions(spark):
    assert ingest.max_version(spark.createDataFrame([(2,), (6,)], "version int")).head().version == 6
    assert ingest.max_version(spark.createDataFrame([], "version int")).head().version == 0


def test_refresh_decides_and_does_it_in_one_step(spark, tmp_path):
    from leafmark.sources.versions import Versions

    texts = {"a": "x\ny", "b": "p", "c": "p", "d": ""}
    asked = []

    def files(texts, times):
        rows = [(p, len(t), times.get(p, "t0"), str(hash(t)) if t else None) for p, t in texts.items()]
        return spark.createDataFrame(rows, "file_path string, file_size long, last_modified string, file_hash string")

    def pages_of(ids, broken=False):
        found = [(r.doc_id, n, line) for r in ids.collect() for n, line in enumerate(texts[r.file_path].split("\n"))]
        asked.append(sorted(r.file_path for r in ids.collect()))
        if broken:
            raise RuntimeError("the extractor fails")
        return spark.createDataFrame(found, "doc_id string, page_number int, text string")

    state = lambda at: sorted((r.file_path, r.page_count) for r in at.table("documents").collect())
    last = lambda at: {r.file_path: r.outcome for r in at.raw("outcomes").filter(f"run = {at.version}").collect()}
    at = ingest.refresh(Versions.open(spark, str(tmp_path)), files(texts, {}), pages_of)
    assert state(at) == [("a", 2), ("b", 1)] and last(at) == {"a": "to_index", "b": "to_index", "c": "duplicate", "d": "error"}
    before = {r.file_path: r.doc_id for r in at.table("documents").collect()}

    texts |= {"a": "x\ny\nz", "e": "new"}
    with pytest.raises(RuntimeError):
        ingest.refresh(at, files(texts, {"a": "t1"}), lambda ids: pages_of(ids, broken=True))
    assert Versions.open(spark, str(tmp_path)).version == 1 and state(at) == [("a", 2), ("b", 1)]

    again = ingest.refresh(at, files(texts, {"a": "t1"}), pages_of)
    assert asked[-1] == ["a", "e"] and state(again) == [("a", 3), ("b", 1), ("e", 1)] and state(at) == [("a", 2), ("b", 1)]
    assert last(again) == {"a": "to_index", "b": "skipped", "c": "duplicate", "d": "error", "e": "to_index"}
    after = {r.file_path: r.doc_id for r in again.table("documents").collect()}
    assert after["a"] == before["a"] and again.table("pages").count() == 5
    idle = ingest.refresh(again, files(texts, {"a": "t1"}), pages_of)
    assert state(idle) == state(again) and asked[-1] == [] and idle.table("pages").count() == 5


def test_upsert_of_rows_that_repeat(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, x string")
    new = spark.createDataFrame([(2, None), (2, "c"), (3, "d"), (3, "d")], "doc_id long, x string")
    assert sorted(map(tuple, ingest.upsert(old, new).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_refresh_query_where_files_share_a_path(spark, sf, tmp_path):
    import duckdb

    from leafmark import oracle, queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    again = docs.filter("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 3000).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 4 > 0, "\nmore").otherwise("")))
    docs.unionByName(again).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT file_path, outcome, duplicate_of, n_pages FROM ({oracle.oracle_sql()['ingest_refresh']})").fetchall()
    got = queries.queries()["ingest_refresh"](spark, str(tmp_path)).select("file_path", "outcome", "duplicate_of", "n_pages").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) > docs.count() + again.count()
