"""Consistent-hash sharding with virtual nodes and bounded loads.

The ring has 65,536 positions. A shard owns ``vnodes`` of them, drawn by hash,
and a key belongs to the first owned position at or after its own: its *arc*.
All keys of an arc meet the shards in the same clockwise order, so what goes
where follows from the number of keys of each arc alone. That list has
``shards * vnodes`` entries whatever the size of the table; a few lines on the
driver let full shards pass keys on and return *pieces*: intervals of ring
ranks of an arc, their shard and their first slot. Keys find their rank on the
ring by counts of fine cells and a window within a cell, never by a window over
a shard.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import scratch
from leafmark.llm.ranks import ranked
from leafmark.llm.words import arrow_schema

#: Positions of the ring, and the keys that a cell holds on average at most.
RING_BITS, CELL_ROWS = 16, 256


@dataclass(frozen=True)
class Piece:
    """Keys ``first`` to ``first + n - 1`` of an arc, by ring order; they take slots of ``shard`` from ``slot`` on."""

    arc: int
    first: int
    n: int
    shard: int
    slot: int


def ring(shards: int, vnodes: int, seed: int = 0) -> list[tuple[int, int]]:
    """Owned positions in ring order with their shards; a taken position moves its node on to the next free one."""
    size, owner = 1 << RING_BITS, {}
    if shards * vnodes > size // 4:
        raise ValueError("the ring is too small for so many virtual nodes")
    for shard in range(shards):
        for node in range(vnodes):
            at = int.from_bytes(hashlib.sha256(f"{seed}/{shard}/{node}".encode()).digest()[:4], "big") % size
            while at in owner:
                at = (at + 1) % size
            owner[at] = shard
    return sorted(owner.items())


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Most keys of each shard: its share times 1 + slack; without slack the shares differ by one at most."""
    base, extra = divmod(total, shards)
    return [max(base + (s < extra), int(-(-total * (1 + slack) // shards)) if slack else 0) for s in range(shards)]


def place(counts: list[int], owners: list[int], caps: list[int]) -> list[Piece]:
    """Bounded loads: arcs fill their own shards first; then what is left over walks clockwise, a node each round, into shards with room."""
    room, used, out = list(caps), [0] * len(caps), []
    waiting = [(arc, 0, n) for arc, n in enumerate(counts) if n]
    for step in range(len(owners)):
        left = []
        for arc, first, n in waiting:
            shard = owners[(arc + step) % len(owners)]
            took = min(n, room[shard])
            if took:
                out.append(Piece(arc, first, took, shard, used[shard]))
                room[shard] -= took
                used[shard] += took
            if took < n:
                left.append((arc, first + took, n - took))
        waiting = left
        if not waiting:
            return out
    raise ValueError("the capacities are smaller than the number of keys")


def assign(keys: DataFrame, key: str, shards: int, vnodes: int = 64, slack: float = 0.0, seed: int = 0) -> DataFrame:
    """``keys`` with ``shard`` and ``slot`` (from 0 without gaps in a shard); other columns stay.

    Loads are rows. With ``slack`` 0 the shards' counts differ by one at most;
    with more, no shard holds over ``1 + slack`` times its share and fewer
    keys leave their arc. Null keys are placed by the hash of null, repeated
    keys side by side in the order of all their columns; an empty table gives an
    empty table. Columns of ``keys`` named ``shard`` or ``slot``, in any case, are
    replaced; others keep their names whatever these are.
    """
    spark = keys.sparkSession
    nodes = ring(shards, vnodes, seed)
    arcs, arc = [], 0
    for at in range(1 << RING_BITS):
        while arc < len(nodes) and nodes[arc][0] < at:
            arc += 1
        arcs.append((at, arc % len(nodes)))  # behind the last node the ring starts again
    # 65,536 rows at any size of the input: safe to broadcast
    lookup = F.broadcast(spark.createDataFrame(_table("_at int, _arc int", arcs)))
    rest = [c for c in keys.columns if c.lower() not in ("shard", "slot")]
    hashed = keys.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.xxhash64(F.lit(seed), F.col(f"`{key}`")).alias("_u"))
    placed = scratch.store(hashed.withColumn("_at", F.shiftrightunsigned("_u", 64 - RING_BITS).cast("int")).join(lookup, "_at").withColumn("_row", F.monotonically_increasing_id()), "ring")
    found = {r["_arc"]: r["n"] for r in placed.groupBy("_arc").agg(F.count("*").alias("n")).collect()}  # shards * vnodes rows
    total = sum(found.values())
    pieces = place([found.get(a, 0) for a in range(len(nodes))], [s for _, s in nodes], capacities(total, shards, slack))

    # behind the last node come positions that belong to arc 0: they are first in its order, as on the ring
    bits = max(0, (total // ((1 << RING_BITS) * CELL_ROWS)).bit_length())
    last = nodes[-1][0]
    lap = F.when(F.col("_at") > last, F.col("_at") - (1 << RING_BITS)).otherwise(F.col("_at")).cast("long")
    sub = F.shiftrightunsigned(F.shiftleft("_u", RING_BITS), 64 - bits) if bits else F.lit(0).cast("long")
    ranked_rows = ranked(placed.withColumn("_cell", lap * (1 << bits) + sub), ["_arc"], "_cell", ["_u", "row"], "_row")
    # at most one piece for each arc and one more for each split, that is shards * (vnodes + rounds): safe to broadcast
    table = spark.createDataFrame(_table("_arc int, _lo long, _hi long, _shard int, _slot long", [(p.arc, p.first, p.first + p.n, p.shard, p.slot) for p in pieces]))
    r = ranked_rows.alias("r").join(F.broadcast(table).alias("p"), (F.col("r._arc") == F.col("p._arc")) & (F.col("r._rank") >= F.col("p._lo")) & (F.col("r._rank") < F.col("p._hi")))
    return r.select(*(F.col("r.row").getField(c).alias(c) for c in rest), F.col("p._shard").alias("shard"), (F.col("p._slot") + F.col("r._rank") - F.col("p._lo")).alias("slot"))


def _table(ddl: str, rows: list[tuple]) -> pa.Table:
    """An Arrow table, which Spark takes without Python workers."""
    schema = arrow_schema(ddl)
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def op5_consistent_ring(spark, sf_dir: str) -> DataFrame:
    """Documents in 24 shards whose row counts differ by one at most (law ``rows``).

    A null text counts as empty. ``slot`` numbers the rows of a shard from 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign(docs, "doc_id", shards=24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
