import pytest
from pyspark.sql import functions as F

from leafmark import schemas
from leafmark.operators import backend, loading, scans
from leafmark.operators.filters import Filters
from leafmark.sources import tables
from tests import dimensions


class Fake:
    """A module that fails in a chosen way."""

    tables = ("fake_table",)
    runs = 0

    def __init__(self, fail="", makes=True, cleans=True, steps=None):
        self.fail, self.makes, self.cleans, self.steps, self.stopped = fail, makes, cleans, steps or {}, False

    def initialize(self, spark):
        Fake.runs += 1
        if self.makes:
            spark.range(1).createOrReplaceTempView("fake_table")
        if self.fail:
            raise RuntimeError(self.fail)

    def cleanup(self):
        if not self.cleans:
            raise RuntimeError("no cleaning")

    def shutdown(self):
        self.stopped = True
        raise RuntimeError("won't stop")

    def migrations(self):
        return self.steps


@pytest.fixture
def parts(spark):
    Fake.runs = 0
    loading.drop(spark, Fake.tables)
    return dimensions.manifests(spark).filter("module_name = 'audit'"), dimensions.dependencies(spark).limit(0)


def status(loader, name="audit"):
    r = loader.registry.filter(F.col("module_name") == name).head()
    return r and (r["status"], r["error_message"])


def registered(spark, manifest, version=0):
    return scans.register_modules(spark.createDataFrame([], schemas.MODULE), manifest.withColumn("data_version", F.lit(version)))


def test_problems_keep_all_from_loading(spark):
    with pytest.raises(ValueError) as error:
        loading.checked_order(dimensions.manifests(spark), dimensions.dependencies(spark), "1.4", ("numpy",))
    assert str(error.value) == "drawings: library nowhere; drawings: version core; export: missing missing; stamps: core >=2"
    names = ("core", "tables", "audit")
    fine, own = dimensions.manifests(spark).filter(F.col("module_name").isin(*names)), dimensions.dependencies(spark).filter(F.col("module_name").isin(*names))
    assert loading.checked_order(fine, own, "1.4", ("numpy",)) == ["audit", "core", "tables"]
    with pytest.raises(ValueError, match="depend on each other"):
        loading.checked_order(fine, own.unionAll(spark.createDataFrame([("core", "tables", "")], own.schema)), "1.4", ("numpy",))
    assert loading.problems(fine.limit(0), own, "1.4").isEmpty()


def test_load_migrate_unload(spark, parts):
    manifest, deps = parts
    steps = {2: "CREATE OR REPLACE TEMP VIEW fake_two AS SELECT * FROM fake_one", 1: "CREATE OR REPLACE TEMP VIEW fake_one AS SELECT 1 AS x", 0: "not SQL"}
    loader = loading.Loader(spark, registered(spark, manifest))
    assert loader.load_all({"audit": lambda: Fake(steps=steps)}, manifest, deps, "1.4") == {}
    assert status(loader) == ("active", None) and spark.table("fake_two").collect() == [(1,)]
    loader.unload("audit")
    assert status(loader) == ("shutdown", None) and not loader.loaded


def test_attempts_and_rollback(spark, parts):
    manifest, deps = parts
    slept = []
    loader = loading.Loader(spark, registered(spark, manifest), slept.append)
    assert loader.load_all({"audit": lambda: Fake("broken", cleans=False)}, manifest, deps, "1.4") == {"audit": "broken"}
    assert Fake.runs == 3 and slept == [5.0, 5.0] and status(loader) == ("error", "broken") and not spark.catalog.tableExists("fake_table")
    assert "no table fake_table" in loader.load_all({"audit": lambda: Fake(makes=False)}, manifest, deps, "1.4")["audit"]
    assert "migration to 1 failed" in loader.load_all({"audit": lambda: Fake(steps={1: "not SQL"})}, manifest, deps, "1.4")["audit"]
    assert status(loader) == ("migration_error", "migration to 1")


def test_backend(spark, sf):
    docs = tables.registry(spark, sf).withColumn("object_code", F.lit("EN"))
    engine = backend.PageBackend(tables.pages(spark, sf), docs)
    hits = engine.search("the", limit=3).collect()
    assert len(hits) == 3 and all("[[MATCH_START]]" in h["pages"][0]["snippet"] for h in hits) and "relevance" in engine.capabilities
    assert engine.count("the", Filters(object_code="EN")) == engine.count("the") > 3
    assert engine.search("", limit=2).count() == 2
