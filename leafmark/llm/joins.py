"""Joining many rows with one row a group, where one group may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups up to which the table of groups is sent to all executors, and the parts of each group beyond.
SENT, PARTS = 50_000, 32


def with_groups(rows: DataFrame, groups: DataFrame, key: str, n_groups: int, spread: str) -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row for each ``key``, ``n_groups`` in all).

    Up to ``SENT`` groups are broadcast. More of them meet the rows by key and
    one of ``PARTS`` parts, which ``spread``, a column of different values,
    chooses; so a large group is many tasks.
    """
    if n_groups <= SENT:
        return rows.join(F.broadcast(groups), key)
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part")
    return rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(PARTS)).cast("int")).join(groups.select("*", parts), [key, "_part"]).drop("_part")
