import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from leafmark import schemas
from leafmark.operators import modules
from leafmark.sources import files, tables
from leafmark.streaming import events
from tests import dimensions


def test_load_order_and_checks(spark):
    m, d = dimensions.modules(spark), dimensions.dependencies(spark)
    order = [r.module_name for r in modules.load_order(m, d).orderBy("position").collect()]
    assert order == ["audit", "core", "stamps", "tables", "drawings", "export"]
    assert modules.missing(m, d).collect() == [("export", "missing")]
    bad = {(r.module_name, r.needs) for r in modules.version_checks(m, d).filter("NOT compatible").collect()}
    assert bad == {("drawings", "core"), ("stamps", "core")}
    cycle = spark.createDataFrame([("core", "export", "")], d.schema).unionAll(d)
    with pytest.raises(ValueError):
        modules.load_order(m, cycle)


def test_load_order_of_many(spark):
    n = 4000
    m = spark.range(n).selectExpr("lpad(id, 5, '0') AS module_name", "'1' AS version", "'1' AS api_version")
    d = spark.range(n).selectExpr("lpad(id, 5, '0') AS module_name", f"lpad({n - 1} - (id * 7) % {n}, 5, '0') AS needs", "'' AS constraint").filter("module_name > needs")
    began = time.monotonic()
    order = [r.module_name for r in modules.load_order(m, d).orderBy("position").collect()]
    assert time.monotonic() - began < 30 and len(order) == n
    needs, placed = {}, set()
    for r in d.collect():
        needs.setdefault(r.module_name, set()).add(r.needs)
    for name in order[:300]:
        assert name == min(x for x in map("{:05d}".format, range(n)) if x not in placed and needs.get(x, set()) <= placed)
        placed.add(name)


def test_processors_become_views(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    reg = modules.Modules()
    reg.register(modules.Processor("lengths", F.col("doc_id") > 1, lambda it: (f[["doc_id"]].assign(n=f.text.str.len()) for f in it), "doc_id long, n long"))
    assert reg.run(docs)["lengths"].collect() == [(2, 1)] and spark.table("lengths").count() == 1
    with pytest.raises(ValueError):
        reg.register(modules.Processor("not a name", F.lit(True), lambda it: it, "x int"))


def test_manifests(spark, tmp_path):
    for name, data in {"a": {"module_name": "m", "version": "1", "api_version": "1", "entry_point": "m:M"}, "b": {"module_name": "m", "version": "2", "api_version": "1", "entry_point": "m:M"}, "c": {"module_name": "n"}, "d": {"module_name": "t", "version": "1", "api_version": "1", "entry_point": "t:T", "managed_tables": ["x"]}}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(json.dumps(data))
    assert [(r.module_name, r.version) for r in modules.first_manifests(files.manifests(spark, str(tmp_path))).collect()] == [("m", "1")]


@pytest.fixture
def some(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(i, t(s), 1, kind, float(i), None) for i, (s, kind) in enumerate([(0, "db.error"), (0.4, "db.error"), (1, "scan.progress"), (2, "db.error"), (3, "scan.completed"), (4, "db.error"), (5, "nothing")])]
    return spark.createDataFrame(rows, schemas.EVENTS)


def test_filters_and_levels(some):
    ids = lambda df: sorted(r.event_id for r in df.collect())
    assert ids(events.subscribe(some, ["scan.progress"])) == [2] and ids(events.subscribe(some, prefix="scan.")) == [2, 4] and ids(events.subscribe(some)) == list(range(7))
    assert ids(events.at_level(some, 20)) == [0, 1, 3, 4, 5, 6] and ids(events.at_level(some, 10)) == list(range(7))  # 6 is of an unknown type: INFO
    assert ids(events.until_last(some)) == [0, 1, 2, 3, 4] and ids(events.slow(some, 4)) == [5, 6]


def test_throttle_runs_and_latest(some):
    assert sorted((r.event_id, r.n) for r in events.throttled(some).filter("event_type = 'db.error'").collect()) == [(1, 2), (3, 1), (5, 1)]
    assert events.longest_runs(some, "db.error").collect() == [(1, 2)]
    assert events.latest(some).collect() == [(1, 6, "nothing")]


def test_streams_equal_batches(spark, some, tmp_path):
    folder = str(tmp_path / "feed")
    some.filter("event_id < 3").coalesce(1).write.parquet(f"{folder}/events1.parquet")
    some.filter("event_id >= 3").coalesce(1).write.parquet(f"{folder}/events2.parquet")
    read = lambda: spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    assert sorted(r.event_type for r in events.drain(events.dedup(read(), ["event_type"]), "d").collect()) == ["db.error", "nothing", "scan.completed", "scan.progress"]
    assert events.drain(read().groupBy("event_type").agg(F.count("*").alias("n")), "c", "complete").filter("event_type = 'db.error'").collect() == [("db.error", 4)]
    query = events.log_sink(read(), str(tmp_path / "log"), str(tmp_path / "state"), 40)
    query.awaitTermination()
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert len(lines) == 4 and {x["level"] for x in lines} == {40}
    counts = events.drain(events.counts(read(), "1 minute"), "w")
    assert counts.columns == ["start", "event_type", "n"]


def test_feed_beats_and_ends(spark, some, tmp_path):
    folder = str(tmp_path / "feed")
    some.coalesce(1).write.parquet(f"{folder}/events1.parquet")
    read = lambda: spark.readStream.schema(schemas.EVENTS).option("recursiveFileLookup", True).parquet(folder)
    got = sorted((r.event_id, r.event_type) for r in events.drain(events.feed(read()), "f").collect())
    assert got == [(2, "scan.progress"), (4, "scan.completed")]
    quiet = events.feed(read(), types=("scan.progress",), beat=1.0)  # never ends, so it beats
    query = quiet.writeStream.format("memory").queryName("beats").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            if spark.table("beats").filter("event_type = 'heartbeat' AND event_id IS NULL").count():
                break
            time.sleep(0.5)
        assert spark.table("beats").filter("event_type = 'heartbeat'").count() and spark.table("beats").filter("event_id = 2").count() == 1
        stats = events.statistics(query)
        assert stats["rows"] == 7 and stats["batches"] >= 1 and stats["held"] == 1 and stats["dropped"] == 0
    finally:
        query.stop()


def test_forced_progress_is_not_throttled(some):
    got = sorted((r.event_id, r.n) for r in events.throttled(some, forced=F.col("event_id") == 0).filter("event_type = 'db.error'").collect())
    assert got == [(0, 1), (1, 1), (3, 1), (5, 1)]


def test_a_secondary_scan_refreshes_first_and_stops(spark):
    docs, said = spark.createDataFrame([(1, "a")], "doc_id long, text string"), []
    reg = modules.Modules()
    for name in ("one_view", "two_view"):
        reg.register(modules.Processor(name, F.lit(True), lambda it: (f[["doc_id"]] for f in it), "doc_id long"))
    out = reg.run(docs, lambda d: d.withColumn("doc_id", F.col("doc_id") + 1), lambda e: (said.append(e["event_type"]), reg.shutdown()))
    assert list(out) == [] and said == ["scan.secondary.started", "scan.secondary.completed"]
    reg.ended = False
    assert reg.run(docs, lambda d: d.withColumn("doc_id", F.col("doc_id") + 1), lambda e: said.append(e["event_type"]))["two_view"].collect() == [(2,)]
    assert said[2:] == ["scan.secondary.started", "scan.secondary.progress", "scan.secondary.progress", "scan.secondary.completed"]
