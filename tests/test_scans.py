import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmark import schemas
from leafmark.operators import metadata, scans
from leafmark.sources import files, tables
from leafmark.streaming import events
from tests import dimensions


def test_scan_records(spark):
    first = scans.start_scan(scans.empty_scans(spark), "primary")
    both = scans.start_scan(first, "secondary")
    counters = spark.createDataFrame([(5, 4, 1)], "total long, processed long, error long")
    done = {r.scan_id: r for r in scans.complete_scan(both, 1, counters).collect()}
    assert (done[1].status, done[1].total_files, done[1].processed_files, done[1].errors) == ("completed", 5, 4, 1) and done[1].completed_at
    assert (done[2].phase, done[2].status, done[2].completed_at) == ("secondary", "running", None)


def test_module_registry(spark):
    rows = [("m", "1", "1", "m:M", "secondary", "", ["t"], 1), ("n", "1", "1", "n:N", "secondary", "", [], 0)]
    manifest = spark.createDataFrame(rows, files.MANIFEST)
    reg = scans.register_modules(spark.createDataFrame([], schemas.MODULE), manifest)
    reg = scans.register_modules(reg, manifest.filter("module_name = 'm'").withColumn("version", F.lit("2")))
    reg = scans.set_module_status(reg, "n", "error", "broken")
    got = {r.module_name: (r.version, r.status, r.managed_tables, r.error_message) for r in reg.collect()}
    assert got == {"m": ("2", "loaded", '["t"]', None), "n": ("1", "error", "[]", "broken")}


def test_settings_and_catalog(spark):
    df = spark.createDataFrame([(" Yes ", "7", "x")], "a string, b string, c string")
    assert df.select(scans.setting(F.col("a"), "boolean"), scans.setting(F.col("b"), "int"), scans.setting(F.col("c"), "int"), scans.setting(F.col("c"), "boolean"), scans.setting(F.col("c"), "string")).head()[:] == (True, 7, None, None, "x")
    df.createOrReplaceTempView("is_there")
    assert scans.table_exists(spark, "is_there") and not scans.table_exists(spark, "is_not")


def test_status_cache():
    now, made = [0.0], []
    cache = scans.StatusCache(lambda: made.append(1) or len(made), lambda: now[0])
    assert [cache.get(), cache.get(refresh=True), cache.get(force=True)] == [1, 1, 2]
    now[0] = 40
    assert [cache.get(), cache.get(refresh=True)] == [2, 3]
    now[0] = 400
    assert cache.get() == 4


def test_time_limit_and_slow_queries(spark):
    assert scans.within(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(TimeoutError):
        scans.within(spark, 0.5, lambda: spark.range(0, 10**13, 1, 2).selectExpr("sum(sqrt(id))").collect())
    said = []
    assert scans.watch(spark.range(3), lambda d: d.count(), said.append, slow_ms=0) == 3
    assert said[0]["event_type"] == "db.query_slow" and "Range" in said[0]["plan"]
    with pytest.raises(Exception):
        scans.watch(spark.range(3), lambda d: d.select("nothing"), said.append)
    assert said[1]["event_type"] == "db.error"


def test_sheets_and_export(spark, tmp_path):
    rows = spark.createDataFrame([("A", "x", "и"), ("B", " ", "к"), (" ", "q", "q"), ("A", "y", None)], "code string, en string, ru string")
    codes, aliases = metadata.sheet_references(rows, "objects")
    assert {r.code for r in codes.collect()} == {"A", "B"} and {(r.alias, r.code, r.lang) for r in aliases.collect()} == {("x", "A", "en"), ("y", "A", "en"), ("и", "A", "ru"), ("к", "B", "ru")}
    with pytest.raises(ValueError):
        metadata.sheet_references(rows.unionAll(spark.createDataFrame([("B", "x", None)], rows.schema)), "objects")
    path = tmp_path / "references.json"
    for _ in range(2):
        metadata.export(metadata.payload(dimensions.codes(spark), dimensions.aliases(spark)), str(path))
    whole = json.loads(path.read_text())
    assert list(whole) == sorted(whole) and whole["objects"]["codes"] == ["EN", "FR"] and {"alias": "english", "code": "EN"} in whole["objects"]["aliases_en"]
    codes, aliases = files.references(spark, str(path))
    assert codes.count() == dimensions.codes(spark).count() and aliases.count() == metadata.first_aliases(dimensions.aliases(spark), dimensions.codes(spark)).count()


def test_request_durations_and_sessions(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    start = spark.createDataFrame([("a", t), ("b", t)], "correlation_id string, ts timestamp")
    end = spark.createDataFrame([("a", t + dt.timedelta(milliseconds=1500)), ("b", t + dt.timedelta(hours=1)), ("c", t)], "correlation_id string, ts timestamp")
    assert [(r.correlation_id, r.ms) for r in events.durations(start, end).collect()] == [("a", 1500.0)]
    start.write.parquet(f"{tmp_path}/s"), end.write.parquet(f"{tmp_path}/e")
    read = lambda x: spark.readStream.schema(start.schema).parquet(f"{tmp_path}/{x}")
    assert [(r.correlation_id, r.ms) for r in events.drain(events.durations(read("s"), read("e")), "d").collect()] == [("a", 1500.0)]
    seen = spark.createDataFrame([("old", t), ("new", t + dt.timedelta(hours=5))], "id string, last_seen timestamp")
    assert [r.id for r in events.expired(seen, F.lit(t + dt.timedelta(hours=9))).collect()] == ["old"]


def sheet(rows):
    cells = lambda i, row: "".join(f'<c r="{c}{i}" t="s"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{c}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in zip("ABC", row) if v is not None)
    return '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(f'<row r="{i}">{cells(i, r)}</row>' for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>"


def test_workbook(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = ("wbs", "type", "discipline")

    def book(path, names):
        with zipfile.ZipFile(path, "w") as z:
            listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>E</t></si><si><r><t>два</t></r><r><t> слова</t></r></si></sst>')
            for i in range(1, len(names) + 1):
                z.writestr(f"xl/worksheets/s{i}.xml", sheet([(0, "e", 1), ("F", None, None), (None, "x", "y")] if i == 1 else []))
        return str(path)

    found = files.workbook(spark, book(tmp_path / "a.xlsx", names))
    assert found["objects"].collect() == [("E", "e", "два слова"), ("F", None, None), (None, "x", "y")] and found["disciplines"].count() == 0
    codes, aliases = metadata.sheet_references(found["objects"], "objects")
    assert {r.code for r in codes.collect()} == {"E", "F"} and aliases.count() == 2
    with pytest.raises(ValueError, match="discipline"):
        files.workbook(spark, book(tmp_path / "b.xlsx", names[:2]))


def test_only_new_files_are_extracted(spark, tmp_path):
    box, path, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    box.mkdir()
    (box / "a.txt").write_text("one\ftwo")
    (box / "b.txt").write_bytes(b"\xff")
    (box / "c.bin").write_text("no")
    seen = []
    for new in (None, "d.TXT"):
        if new:
            (box / new).write_text("three")
        query = files.ingest_new(spark, str(box), path, state, "txt")
        query.awaitTermination()
        seen.append(events.statistics(query)["rows"])
    rows = sorted((r.page_number, r.text) for r in spark.read.parquet(path).collect())
    assert rows == [(0, "one"), (0, "three"), (0, "�"), (1, "two")] and seen == [2, 1]
    listed = files.listing(files.scan(spark, str(box), "txt"), 2, 1).collect()
    assert [r.file_name for r in listed] == ["b.txt", "d.TXT"]


def test_limits_of_operations(spark, monkeypatch):
    said = []
    monkeypatch.setitem(scans.LIMITS, "search.query", 0.5)
    with pytest.raises(TimeoutError):
        scans.within(spark, None, lambda: spark.range(0, 10**13, 1, 2).selectExpr("sum(sqrt(id))").collect(), publish=said.append)
    assert said == [{"event_type": "operation.timed_out", "operation": "search.query", "timeout_seconds": 0.5}]


def test_snapshots(spark):
    running = scans.start_scan(scans.start_scan(scans.empty_scans(spark), "primary"), "secondary")
    assert events.snapshot(running).head()[:] == (2, "secondary", "running", 0, 0, 0.0)
    assert events.snapshot(scans.empty_scans(spark)).head()[:] == (0, "idle", "idle", 0, 0, 0.0)
