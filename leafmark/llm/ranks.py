"""Ranks within groups of any size, without a window over a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm import scratch
from leafmark.llm.joins import SENT

#: Rows of a cell from which it is split, and the rows of a part.
LARGE, PART = 1 << 15, 1 << 12


def ranked(rows: DataFrame, group: list[str], cell: str, order: list[str], row: str) -> DataFrame:
    """``rows`` with ``_rank``: from 0 without gaps in each group, by cell and then by ``order``.

    ``cell`` divides a group by hash, so only rows within a cell are sorted
    together; cells are counted first and their counts summed up. A cell can
    still be large where rows repeat the hashed key. Such a cell is split by the
    hash of the ``order`` columns, so that the ranks follow from these whatever
    the files are. Rows that agree in all of them and are many are split once
    more by ``row``, a column of different values that was written before; which
    of them gets which rank makes no difference. Nulls in the key columns are not
    allowed.
    """
    keys = [*group, cell]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    large = scratch.store(counted.filter(F.col("_n") > LARGE).select(*keys, F.ceil(F.col("_n") / PART).alias("_parts")), "large")
    n = large.count()
    content, parts = F.xxhash64(*order), [*keys, "_bucket", "_same", "_part"]
    if n:
        sent = lambda x, size: F.broadcast(x) if size <= SENT else x
        rows = rows.join(sent(large, n), keys, "left").withColumn("_bucket", F.coalesce(F.pmod(content, F.col("_parts")), F.lit(0)))
        alike = rows.filter(F.col("_parts").isNotNull()).groupBy(*keys, "_bucket", content.alias("_content")).agg(F.count("*").alias("_n"))
        alike = scratch.store(alike.filter(F.col("_n") > LARGE).select(*keys, "_content", F.ceil(F.col("_n") / PART).alias("_pieces")), "alike")
        rows = rows.withColumn("_content", content).join(sent(alike, alike.count()), [*keys, "_content"], "left")
        rows = rows.withColumn("_same", F.when(F.col("_pieces").isNotNull(), F.col("_content")).otherwise(F.lit(0)).cast("long"))
        rows = rows.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(row), F.col("_pieces")), F.lit(0))).drop("_parts", "_content", "_pieces")
    else:
        rows = rows.withColumns({c: F.lit(0).cast("long") for c in ("_bucket", "_same", "_part")})
    within = F.row_number().over(Window.partitionBy(*parts).orderBy(*order)).cast("long") - 1
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy(*parts[len(group):]).rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy(*parts).agg(F.count("*").alias("_n")).select(*parts, F.coalesce(before, F.lit(0)).alias("_before"))
    out = rows.withColumn("_in", within).join(sizes, parts)
    return out.withColumn("_rank", F.col("_before") + F.col("_in")).drop("_before", "_in", "_bucket", "_same", "_part")


def in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``_rank``: from 0 without gaps over the whole table by ``order``.

    Rows are dealt by range, sorted there and written, so a task has about as
    many as any other; how many each range has is summed up from one row a
    range. Rows that agree in ``order`` are dealt by their place in the input.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*order, F.asc("_row")]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_row")
    # an id of this kind is the number of a partition and, in its lower 33 bits, the place of the row there
    sorted_rows = scratch.store(dealt.withColumn("_place", F.monotonically_increasing_id()), "ordered").withColumn("_range", F.shiftright("_place", 33))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = sorted_rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_rows.join(F.broadcast(counts), "_range").withColumn("_rank", rank).drop("_range", "_place", "_before")  # a row for each range
