"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import scratch


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): longs, ``root`` the least node that is reachable.

    Contraction: each round every node hooks onto its least neighbour, moves on
    to that one's choice, and the links between what is left go to the next
    round. Minima are aggregated before they are shuffled, and joins on nodes
    with many links are split by adaptive execution. Rounds are written to the
    shared folder, so plans stay short. Links to itself and null ends are ignored.
    """
    links = scratch.store(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
        hooked = scratch.store(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "hooked")
        onto = hooked.select(F.col("node").alias("to"), F.col("to").alias("root"))
        moved = scratch.store(hooked.join(onto, "to").select("node", "root"), "moved")
        if nodes is None:
            nodes = moved
        else:
            nodes = nodes.withColumnRenamed("root", "old").join(moved.select(F.col("node").alias("old"), "root"), "old", "left")
            nodes = scratch.store(nodes.select("node", F.coalesce("root", "old").alias("root")), "nodes")
        a, b = (moved.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in "ab")
        links = links.join(a, "a").join(b, "b").filter("_a != _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        links = scratch.store(links.distinct(), "links")
    return nodes if nodes is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
