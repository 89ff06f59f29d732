"""Mixing sources to target weights by entropy balancing.

Each source gets a token target. The rates ``r`` of its documents minimise
``sum(size / z * D(r))`` under ``sum(size * r) = target``, where ``D`` is the
entropy relative to rate 1 inside the limits 0 and ``most`` and ``z`` grows
with the logarithm of the size. The solution is the exponential tilt
``r = most / (1 + exp(-dual * z))`` with one dual variable a source, found by
safeguarded Newton steps. Documents of one source and size are alike, so the
sums run over the table of (source, size, count), which is small beside the
documents; every step is one aggregation of it.

Rates become copies by error diffusion over the sizes of a source, long
documents first, so that short ones make up for what the long ones leave;
which documents of a size get the extra copy is decided by hash rank.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm import scratch
from leafmark.llm.ranks import ranked
from leafmark.llm.words import word_count

#: Documents of a cell that one window ranks, on average at most.
CELL_ROWS = 512
#: Newton steps at most, and the relative error at which they end.
STEPS, NEAR = 25, 1e-7


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: shares by weight, filled like water up to ``most`` times a source's size.

    Sources sort by code point, null last; weights repeat. The windows run over
    one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    by = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    capped = F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("_level", (F.sum("source_size").over(whole) * F.lit(float(share)) - capped) / open_weight)
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(whole)["_level"]
    return s.select("source", "source_size", F.coalesce(F.least("_cap", F.col("_weight") * level), F.col("_cap")).alias("target"))


def _rate(dual: Column, most: float) -> Column:
    tilt = F.lit(float(most)) / (1 + F.exp(-dual * F.col("_z")))
    return F.when(F.col("target") >= F.col("source_size") * F.lit(float(most)), F.lit(float(most))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(tilt)


def balance(cells: DataFrame, most: float) -> DataFrame:
    """``cells`` (_key, size, n, source_size, target, _z) with ``_r``, the rate of a document.

    Sums are taken over fixed-point values, so their order does not matter and
    reruns agree to the bit.
    """
    m = float(most)
    duals = cells.filter((F.col("target") > 0) & (F.col("target") < F.col("source_size") * m)).groupBy("_key").agg(F.first("target").alias("_t"), F.first("source_size").alias("_s"))
    duals = scratch.store(duals.select("_key", F.log(F.col("_t") / (F.col("_s") * m - F.col("_t"))).alias("_dual"), F.lit(-700.0).alias("_lo"), F.lit(700.0).alias("_hi")), "duals")
    for _ in range(STEPS):
        c = cells.join(duals, "_key")
        r = F.lit(m) / (1 + F.exp(-F.col("_dual") * F.col("_z")))
        words = F.col("n") * F.col("size")
        fixed = lambda x: F.sum(F.round(x * 1024).cast("decimal(38,0)")).cast("double") / 1024
        sums = c.groupBy("_key").agg(F.first("_dual").alias("_dual"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("target").alias("_t"), fixed(words * r).alias("_f"), fixed(words * F.col("_z") * r * (1 - r / m)).alias("_d"))
        sums = sums.withColumn("_lo", F.when(F.col("_f") <= F.col("_t"), F.col("_dual")).otherwise(F.col("_lo"))).withColumn("_hi", F.when(F.col("_f") >= F.col("_t"), F.col("_dual")).otherwise(F.col("_hi")))
        step = F.col("_dual") + (F.col("_t") - F.col("_f")) / F.col("_d")
        safe = F.when((F.col("_d") > 0) & (step > F.col("_lo")) & (step < F.col("_hi")), step).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        duals = scratch.store(sums.select("_key", safe.alias("_dual"), "_lo", "_hi", (F.abs(F.col("_f") - F.col("_t")) / F.col("_t")).alias("_error")), "duals")
        worst = duals.agg(F.max("_error")).head()[0]
        if worst is None or worst < NEAR:
            break
        duals = duals.drop("_error")
    return cells.join(duals.select("_key", "_dual"), "_key", "left").withColumn("_r", _rate(F.col("_dual"), m)).drop("_dual")


def diffuse(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies for the sizes of one source: ``_base`` for each document and one more for ``_extra`` of them."""
    cells = cells.sort_values("size", ascending=False, kind="stable")
    want = took = 0.0
    base, extra = [], []
    for size, n, r in zip(cells["size"], cells["n"], cells["_r"]):
        want += size * n * r
        low = int(r)
        more = 0 if not size or low == r else min(n, max(0, round((want - took) / size) - n * low))
        took += float(size) * (n * low + more)
        base.append(low)
        extra.append(int(more))
    return pd.DataFrame({"_key": cells["_key"], "size": cells["size"], "n": cells["n"], "source_size": cells["source_size"], "target": cells["target"], "_base": base, "_extra": extra})


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2, by: str = "doc_id") -> DataFrame:
    """Copies for ``docs`` (doc_id, source, size): adds source_size, target and copies.

    ``share`` times all sizes go to the sources by weight. Documents of size 0
    and of sources with target 0 get no copies. A null source is a source of
    its own. Rows that repeat count as separate documents. Of documents of one
    size the hash of the column ``by`` chooses which get one copy more, then
    doc_id; other columns are left out. An empty table gives an empty table.
    """
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    docs = scratch.store(docs.select("doc_id", "source", "size", F.col(by).alias("_by"), key.alias("_key"), F.monotonically_increasing_id().alias("_row")), "sizes")
    cells = scratch.store(docs.groupBy("_key", "source", "size").agg(F.count("*").alias("n")), "cells")
    sizes = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goals = targets(sizes, weights, share, most).withColumn("_key", key)
    means = cells.groupBy("_key").agg((F.sum(F.col("n") * F.log1p("size")) / F.sum("n")).alias("_mean"))
    z = F.when(F.col("_mean") > 0, F.round(F.log1p("size") / F.col("_mean"), 9)).otherwise(F.lit(1.0))
    cells = cells.drop("source").join(goals.drop("source"), "_key").join(means, "_key").withColumn("_z", z).drop("_mean")
    cells = balance(scratch.store(cells, "goals"), most)
    cells = cells.groupBy("_key").applyInPandas(diffuse, "_key string, size long, n long, source_size long, target double, _base int, _extra long")
    cells = scratch.store(cells, "copies")

    # a size with many documents is ranked in parts, so that no window holds a large group of copies
    parts = F.ceil(F.col("n") / CELL_ROWS)
    d = docs.join(cells, ["_key", "size"]).withColumn("_u", F.xxhash64(F.lit("mix"), "_by")).withColumn("_sub", F.floor(F.shiftrightunsigned("_u", 32) * parts / 2**32))
    # written, so that the ranks are dealt by part and not by the join's keys
    d = ranked(scratch.store(d, "dealt"), ["_key", "size"], "_sub", ["_u", "doc_id"], "_row")
    copies = (F.col("_base") + (F.col("_rank") < F.col("_extra")).cast("int")).alias("copies")
    return d.select("doc_id", "source", "size", "source_size", "target", copies)


def op10_entropy_mix(spark, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
