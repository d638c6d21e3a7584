"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

Rows stand on a ring by a hash of their key; each shard owns ``vnodes`` points and with each
the arc before it.  A shard takes as many rows as its capacity, which is the even share
(floor or ceiling of rows / shards); rows that overflow a full shard continue clockwise to the
next shard with room.  All capacities together equal the rows, so counts are at most one
apart, and a changed shard count moves the rows of the changed arcs and the overflow alone.

The ring is dealt into 65,536 cells.  Rows are ranked within a cell (a window over 1/65,536 of
the ring); counts per cell are the only thing gathered: at most 65,536 + shards * vnodes rows,
whatever the input, from which the driver derives at most that many stretches of the ring with
their shard.  Rows find their stretch by an array kept per cell, in a broadcast of that bound.

Edge cases: null keys hash like any key; copies of a key are spread by a hash of the text, so
a key of a third of all rows fills no single window unless the whole rows are equal; an empty
table gives an empty result; null text has no bytes; a row's slot is its place in its shard.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrel.llm.common import written

CELL_BITS = 16


def _mix(x: int) -> int:
    """A fixed 64-bit mixing of vnode numbers (splitmix64), for their places on the ring."""
    x = (x + 0x9E3779B97F4A7C15) & (1 << 64) - 1
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & (1 << 64) - 1
    return x ^ x >> 31


def vnode_cells(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(last cell of the arc, shard) of each virtual node, around the ring."""
    return sorted((_mix(shard * 1_000_003 + i) >> 64 - CELL_BITS, shard) for shard in range(shards) for i in range(vnodes))


def plan(counts: dict[int, int], shards: int, vnodes: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, from, to, shard, slot of the first) stretches of the ring: rows of a cell with
    ranks [from, to) go to the shard, from that slot on.

    ``counts`` has the rows of each cell.  Rows are offered to the shards in ring order.
    """
    rows = sum(counts.values())
    ring = vnode_cells(shards, vnodes)
    last = [cell for cell, _ in ring]
    room = [rows // shards + (s < rows % shards) for s in range(shards)]
    taken = [0] * shards
    out: list[tuple[int, int, int, int, int]] = []

    def take(shard: int, cell: int, first: int, left: int) -> int:
        got = min(left, room[shard] - taken[shard])
        if got:
            out.append((cell, first, first + got, shard, taken[shard]))
            taken[shard] += got
        return got

    over: list[tuple[int, int, int, int]] = []  # rows for which their own shard had no room
    for cell in sorted(counts):
        at = bisect_left(last, cell) % len(ring)
        got = take(ring[at][1], cell, 0, counts[cell])
        if got < counts[cell]:
            over.append((at, cell, got, counts[cell] - got))
    for at, cell, first, left in over:
        step = 1
        while left:
            got = take(ring[(at + step) % len(ring)][1], cell, first, left)
            first, left, step = first + got, left - got, step + 1
    return sorted(out)


def assign(docs: DataFrame, *, shards: int = 8, vnodes: int = 64, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: the key, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    size: UTF-8 bytes of the text and one.  ``keep`` names columns to return besides.
    """
    spark = docs.sparkSession
    names = list(dict.fromkeys([key, *(keep or [])]))
    raw = F.col(f"`{text}`")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in names],
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(raw, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("ring", F.xxhash64(F.col(f"`{key}`"), F.col("text_crc32")))
    rows = written(rows.withColumn("cell", F.shiftrightunsigned("ring", 64 - CELL_BITS).cast("int")), "ring")
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 65,536
    by_cell: dict[int, list[tuple[int, int, int, int]]] = {}
    for cell, first, to, shard, slot in plan(counts, shards, vnodes):
        by_cell.setdefault(cell, []).append((first, to, shard, slot))
    kind = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("stretches", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("to", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])))])
    where = spark.createDataFrame(list(by_cell.items()), kind)
    order = Window.partitionBy("cell").orderBy("ring", f"`{key}`", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("bigint") - 1)
    placed = ranked.join(F.broadcast(where), "cell").withColumn("place", F.filter("stretches", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["to"]))[0])
    return placed.select(
        *[F.col(f"`{c}`") for c in names], "size", "text_crc32", F.lit("rows").alias("law"), F.col("place.shard").alias("shard"),
        (F.col("place.slot") + F.col("rank") - F.col("place.first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
