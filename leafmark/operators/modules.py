"""Add-on modules: dependency checks, load order, registry, processors."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.text import version_fits


def missing(modules: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(module_name, needs) of dependencies on modules that aren't there."""
    there = modules.select(F.col("module_name").alias("needs"))
    return dependencies.join(there, "needs", "left_anti").select("module_name", "needs")


def version_checks(modules: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(module_name, needs, constraint, found, compatible) for dependencies with a constraint on modules that are there."""
    found = modules.select(F.col("module_name").alias("needs"), F.col("api_version").alias("found"))
    d = dependencies.filter("constraint != ''").join(found, "needs")
    return d.select("module_name", "needs", "constraint", "found", version_fits(F.col("found"), F.col("constraint")).alias("compatible"))


def load_order(modules: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(position, module_name): dependencies first, else alphabetically among the ready; ValueError for a cycle.

    Each place depends on all before it, so the order is found on the driver, from
    names and links alone; a heap holds the ready.
    """
    names = sorted({r[0] for r in modules.select("module_name").collect()})
    needs: dict[str, set[str]] = {n: set() for n in names}
    for name, need in dependencies.select("module_name", "needs").collect():
        if name in needs and need in needs:
            needs[name].add(need)
    wanted_by: dict[str, list[str]] = {n: [] for n in names}
    for name, own in needs.items():
        for need in own:
            wanted_by[need].append(name)
    open_needs = {n: len(own) for n, own in needs.items()}
    ready, order = [n for n in names if not open_needs[n]], []
    while ready:
        order.append(heapq.heappop(ready))
        for name in wanted_by[order[-1]]:
            open_needs[name] -= 1
            if not open_needs[name]:
                heapq.heappush(ready, name)
    if len(order) < len(names):
        placed = set(order)
        raise ValueError("modules depend on each other: " + ", ".join(n for n in names if n not in placed))
    return modules.sparkSession.createDataFrame(list(enumerate(order)), "position int, module_name string")


def first_manifests(manifests: DataFrame) -> DataFrame:
    """The first manifest by path of each name, of those that are complete; managed tables need a data version."""
    needed = ["module_name", "version", "api_version", "entry_point"]
    complete = manifests.filter(" AND ".join(f"{c} IS NOT NULL" for c in needed))
    complete = complete.filter((F.coalesce(F.size("managed_tables"), F.lit(0)) <= 0) | (F.coalesce("data_version", F.lit(0)) != 0))
    order = Window.partitionBy("module_name").orderBy("path")
    return complete.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


@dataclass
class Processor:
    """A secondary processor: which documents it takes, and what it makes of their rows in pandas batches."""

    name: str
    wants: Column
    process: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
    schema: str


class Modules:
    """Processors that run over documents and become views by their names."""

    def __init__(self) -> None:
        self.processors: dict[str, Processor] = {}
        self.ended = False

    def register(self, processor: Processor) -> None:
        if not processor.name.isidentifier():
            raise ValueError(f"{processor.name!r} is no valid name")
        self.processors.setdefault(processor.name, processor)

    def run(self, documents: DataFrame, refresh: Callable[[DataFrame], DataFrame] | None = None, publish: Callable[[dict], None] = lambda event: None) -> dict[str, DataFrame]:
        """Views of all processors over ``documents``, whose metadata ``refresh`` brings up to date before.

        The work itself is done when a view is read. Events tell how far it is;
        ``shutdown`` leaves out the processors to come.
        """
        publish({"event_type": "scan.secondary.started", "total": len(self.processors)})
        documents = refresh(documents) if refresh else documents
        out = {}
        for name, p in self.processors.items():
            if self.ended:
                break
            out[name] = documents.filter(p.wants).mapInPandas(p.process, p.schema)
            out[name].createOrReplaceTempView(name)
            publish({"event_type": "scan.secondary.progress", "module": name, "processed": len(out), "total": len(self.processors)})
        publish({"event_type": "scan.secondary.completed", "processed": len(out), "total": len(self.processors)})
        return out

    def shutdown(self) -> None:
        self.ended = True
