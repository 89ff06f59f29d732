"""Loading add-on modules: validation, attempts, rollback, migrations, statuses, shutdown."""

from __future__ import annotations

import time
from collections.abc import Callable, Collection, Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions.text import version_fits
from leafmark.operators import modules as M
from leafmark.operators.scans import register_modules, set_module_status

#: Attempts to load a module, and seconds between two.
TRIES, PAUSE = 3, 5.0


class Module(Protocol):
    """What a loaded module offers; ``migrations`` are SQL statements by the data version that they lead to."""

    tables: tuple[str, ...]

    def initialize(self, spark: SparkSession) -> None: ...

    def cleanup(self) -> None: ...

    def shutdown(self) -> None: ...

    def migrations(self) -> dict[int, str]: ...


def problems(manifests: DataFrame, dependencies: DataFrame, core: str, libraries: Collection[str] = ()) -> DataFrame:
    """(module_name, problem, about) of what keeps modules from loading.

    ``manifests`` hold module_name, api_version, core_constraint and libraries.
    ``core``: the constraint on the version of this engine fails; such modules
    are left out of all other checks, so those that need them miss them.
    ``library``: one that is not among ``libraries``. ``missing``: a module that
    isn't there. ``version``: one whose api_version doesn't meet the constraint.
    """
    wants = F.coalesce("core_constraint", F.lit(""))
    fits = version_fits(F.lit(core), wants)
    fit = manifests.filter(fits)
    own = dependencies.join(fit.select("module_name"), "module_name", "left_semi")
    row = lambda df, kind, about: df.select("module_name", F.lit(kind).alias("problem"), F.col(about).alias("about"))
    unsuited = row(manifests.filter(~fits), "core", "core_constraint")
    lacking = row(fit.select("module_name", F.explode("libraries").alias("about")).filter(~F.col("about").isin(*libraries) if libraries else F.lit(True)), "library", "about")
    clash = row(M.version_checks(fit, own).filter("NOT compatible"), "version", "needs")
    return unsuited.unionAll(lacking).unionAll(row(M.missing(fit, own), "missing", "needs")).unionAll(clash)


def checked_order(manifests: DataFrame, dependencies: DataFrame, core: str, libraries: Collection[str] = ()) -> list[str]:
    """Names in load order; ValueError that lists all problems, a cycle included, if there are any. Modules are few."""
    found = [f"{r['module_name']}: {r['problem']} {r['about']}" for r in problems(manifests, dependencies, core, libraries).orderBy("module_name", "problem", "about").collect()]
    order: list[str] = []
    try:
        order = [r["module_name"] for r in M.load_order(manifests, dependencies).orderBy("position").collect()]
    except ValueError as cycle:
        found.append(str(cycle))
    if found:
        raise ValueError("; ".join(found))
    return order


class Loader:
    """Modules that are loaded, and their registry."""

    def __init__(self, spark: SparkSession, registry: DataFrame, sleep: Callable[[float], None] = time.sleep) -> None:
        self.spark, self.registry, self.sleep = spark, registry, sleep
        self.loaded: dict[str, Module] = {}

    def load_all(self, makers: dict[str, Callable[[], Module]], manifests: DataFrame, dependencies: DataFrame, core: str, libraries: Collection[str] = ()) -> dict[str, str]:
        """Load modules in order. Problems keep all from loading; a module that fails ``TRIES`` times gets the status error and keeps no other from loading. Returns what failed."""
        failed = {}
        for name in checked_order(manifests, dependencies, core, libraries):
            for attempt in range(1, TRIES + 1):
                try:
                    self.load(name, makers[name], manifests.filter(F.col("module_name") == name))
                    break
                except Exception as error:
                    if attempt == TRIES:
                        failed[name] = str(error)
                        if not self._has_status(name, "migration_error"):
                            self._mark(name, "error", str(error))
                    else:
                        self.sleep(PAUSE)
        return failed

    def load(self, name: str, make: Callable[[], Module], manifest: DataFrame) -> Module:
        """One attempt. A module that can't be initialised, or lacks its tables, is rolled back."""
        before = self.registry.filter(F.col("module_name") == name).select("data_version").head()
        self._mark(name, "loading")
        module = make()
        try:
            module.initialize(self.spark)
            gone = [t for t in module.tables if not self.spark.catalog.tableExists(t)]
            if gone:
                raise RuntimeError(f"{name}: no table {', '.join(gone)}")
        except Exception:
            self._roll_back(module)
            raise
        self._migrate(name, module, before["data_version"] or 0 if before else 0)
        self.registry = register_modules(self.registry, manifest, "active")
        self.loaded[name] = module
        return module

    def unload(self, name: str, status: str = "shutdown") -> None:
        """Shut a module down; its errors don't keep it loaded."""
        module = self.loaded.pop(name, None)
        try:
            if module:
                module.shutdown()
        except Exception:  # a module that fails to stop is unloaded all the same
            pass
        self._mark(name, status)

    def _roll_back(self, module: Module) -> None:
        try:
            module.cleanup()
        except Exception:  # the tables go without the module's help
            drop(self.spark, module.tables)

    def _migrate(self, name: str, module: Module, version: int) -> None:
        """Statements of versions above the registered one, in order; only for modules with tables."""
        for target, statement in sorted(module.migrations().items()) if module.tables else ():
            if target > version:
                try:
                    self.spark.sql(statement)
                except Exception as error:
                    self._mark(name, "migration_error", f"migration to {target}")
                    raise RuntimeError(f"{name}: migration to {target} failed") from error

    def _mark(self, name: str, status: str, error: str | None = None) -> None:
        self.registry = set_module_status(self.registry, name, status, error)

    def _has_status(self, name: str, status: str) -> bool:
        return not self.registry.filter((F.col("module_name") == name) & (F.col("status") == status)).isEmpty()


def drop(spark: SparkSession, tables: Iterable[str]) -> None:
    """Drop tables or views, whichever there are."""
    for table in tables:
        spark.catalog.dropTempView(table)
        spark.sql(f"DROP TABLE IF EXISTS `{table}`")
