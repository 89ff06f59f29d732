"""Samples of a bounded size, chosen by hash, so that they agree between runs and no task sends more than its part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_hash(rows: DataFrame, key: Column, of: int, size: float) -> DataFrame:
    """Rows whose keys have the least hashes: about ``size`` of ``of`` different keys, all where these are no more.

    The threshold follows from the counts, so each task keeps its share and
    nothing is sorted or gathered to find it.
    """
    if of <= size:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40)) < int((1 << 40) * size / of))
