"""Op 3: consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring; a row stands at the point its key hashes to and belongs to
the first shard clockwise that still has room. Rows are presented in ring order. What decides is only
how many rows each arc between two points holds, so the overflow walk runs over one small table
(shards x vnodes counts, whatever the input's size), and rows then find their shard by their rank
inside their arc. Ranks are counted in `cells` per arc, so no task orders more than a sliver of an arc.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RING_BITS = 32


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise. Shard names decide, so more shards leave points in place."""
    points = {}
    for shard in range(shards):
        for v in range(vnodes):
            h = hashlib.md5(f"shard-{shard}/node-{v}".encode()).digest()
            points.setdefault(int.from_bytes(h[:4], "big"), shard)
    return sorted(points.items())


def fill(counts: dict[int, int], owners: list[int], shards: int, load: float | None) -> list[tuple[int, int, int, int, int]]:
    """Walk the arcs clockwise; rows beyond a shard's room continue to the next shard with room.

    load None: rooms differ by one row at most and sum up to all rows. Otherwise a shard takes
    ceil(load * mean) rows (load >= 1). Returns (arc, first rank, end rank, shard, slot of first rank).
    """
    total = sum(counts.values())
    if load is None:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    else:
        if load < 1:
            raise ValueError("load must be at least 1")
        room = [-int(-load * total // shards)] * shards
    used, out = [0] * shards, []
    for arc, first in enumerate(owners):
        left, start, at, shard = counts.get(arc, 0), 0, arc, first
        while left:
            if take := min(left, room[shard] - used[shard]):
                out.append((arc, start, start + take, shard, used[shard]))
                used[shard] += take
                start, left = start + take, left - take
            if left:
                at = (at + 1) % len(owners)
                shard = owners[at]
    return out


def assign(df: DataFrame, key: str, tie_by: list[str], shards: int = 16, vnodes: int = 64, cells: int = 32, load: float | None = None) -> DataFrame:
    """df with `shard` (int) and `slot` (long, gapless from 0 in each shard).

    Null keys stand at one point of the ring; rows with equal keys stand together and are told apart by
    tie_by, which also spreads a hot key over cells. An empty table gives an empty result. Columns called
    shard and slot are replaced, unless they are the key or in tie_by; names that begin with __ are reserved.
    """
    df = df.drop(*{"shard", "slot"} - {key, *tie_by})
    points = ring(shards, vnodes)
    owners = [s for _, s in points]
    # The arc of a hash is the number of points below it: arcs end at their owner's point, the last wraps to the first.
    ends = F.expr(f"array({', '.join(f'{p}L' for p, _ in points)})")
    position = F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << RING_BITS))
    spot = df.withColumn("__pos", position)
    coarse = 1 << 12
    # Points below the start of each of 4096 equal slices of the ring, then at most a few compares within the slice.
    width = (1 << RING_BITS) // coarse
    below, at = [], 0
    for c in range(coarse + 1):
        while at < len(points) and points[at][0] < c * width:
            at += 1
        below.append(at)
    most = max(below[c + 1] - below[c] for c in range(coarse))
    base = F.element_at(F.expr(f"array({', '.join(map(str, below))})"), (F.shiftrightunsigned("__pos", RING_BITS - 12) + 1).cast("int"))
    arc = F.col("__base")
    for k in range(most):
        arc = arc + F.coalesce((F.try_element_at(ends, F.col("__base") + F.lit(k + 1)) < F.col("__pos")).cast("int"), F.lit(0))
    spot = spot.withColumn("__base", base).withColumn("__arc", F.pmod(arc, F.lit(len(points))).cast("int"))
    spot = spot.withColumn("__cell", F.pmod(F.xxhash64(F.lit(29), F.col(key), *tie_by), F.lit(cells)).cast("int")).drop("__base")

    counts = spot.groupBy("__arc", "__cell").agg(F.count("*").alias("__n"))
    per_cell = [(r["__arc"], r["__cell"], r["__n"]) for r in counts.collect()]  # at most shards x vnodes x cells rows
    per_arc: dict[int, int] = {}
    before: list[tuple[int, int, int]] = []
    for a, c, n in sorted(per_cell):
        before.append((a, c, per_arc.get(a, 0)))
        per_arc[a] = per_arc.get(a, 0) + n
    parts = fill(per_arc, owners, shards, load)
    spark = df.sparkSession
    starts = spark.createDataFrame(before, "__arc int, __cell int, __before long")
    pieces = spark.createDataFrame(parts, "__arc int, __from long, __to long, shard int, __slot long")
    w = Window.partitionBy("__arc", "__cell").orderBy("__pos", F.col(key), *tie_by)
    ranked = spot.withColumn("__in", F.row_number().over(w) - 1).join(F.broadcast(starts), ["__arc", "__cell"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__in"))
    placed = ranked.join(F.broadcast(pieces), "__arc").where("__rank >= __from and __rank < __to")
    return placed.withColumn("slot", F.col("__slot") + F.col("__rank") - F.col("__from")).drop("__pos", "__arc", "__cell", "__before", "__in", "__rank", "__from", "__to", "__slot")


def shard_documents(docs: DataFrame, shards: int = 16, **ring_options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document.

    law is `rows`: the rooms of the ring are the even shares, so counts differ by one at most.
    size: UTF-8 bytes plus 1; a null text has none and the checksum of the empty text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = assign(rows, "doc_id", ["text_crc32", "size"], shards, **ring_options)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
