"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every row has a place on a ring of ``CELLS`` cells, from a hash of its key; every
shard has ``VNODES`` virtual nodes there, and a cell belongs to the next virtual
node clockwise. A shard takes the rows of its cells in ring order until its bound
is reached; what a full shard can't take goes on clockwise to the next virtual
node whose shard has room. The bounds are floor and ceiling of rows / shards and
add up to the number of rows, so counts differ by one at most (law ``rows``) while
all rows but the overflow lie where plain consistent hashing puts them.

Only counts per cell reach the driver (``CELLS`` numbers, whatever the input), and
only the resulting segments (cells plus one for each filled shard at most) are
broadcast. Rows are ranked within their cell, so no task holds more than a cell's
share. The text is read once for its size and checksum, and shuffled only if it is
to be returned.

Null keys are placed by the checksum of their text. Null texts have no bytes and
checksum 0. Rows that are equal in all of key, size and checksum get ranks in any
order among themselves; the shards and slots as a whole are the same in each run.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4096
VNODES = 32


def ring(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % cells
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def segments(counts: dict[int, int], shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple]:
    """(cell, first rank, end rank, shard, first slot, moved) for the rows of each cell."""
    nodes, total = ring(shards, vnodes, cells), sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, out, left = [0] * shards, [], []

    def give(cell: int, rank: int, n: int, shard: int, moved: bool) -> int:
        n = min(n, room[shard] - filled[shard])
        if n > 0:
            out.append((cell, rank, rank + n, shard, filled[shard], moved))
            filled[shard] += n
        return rank + max(n, 0)

    at = 0
    for cell in range(cells):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        n = counts.get(cell, 0)
        if n and (rank := give(cell, 0, n, nodes[at % len(nodes)][1], False)) < n:
            left.append((cell, rank, n, at))
    for cell, rank, n, at in left:
        step = 1
        while rank < n:
            rank, step = give(cell, rank, n - rank, nodes[(at + step) % len(nodes)][1], True), step + 1
    return out


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``docs`` (its text only if asked for) with ring_cell, size, text_crc32, shard, slot and moved (those of ``docs`` by these names give way)."""
    spark = docs.sparkSession
    made = ["ring_cell", "size", "text_crc32", "shard", "slot", "moved"]
    crc = F.coalesce(F.crc32(F.col(text)), F.lit(0).cast("long"))
    place = F.when(F.col(key).isNull(), F.xxhash64(F.lit("null key"), crc)).otherwise(F.xxhash64(F.col(key)))
    cell = F.pmod(place, F.lit(CELLS)).cast("int")
    counts = {r["c"]: r["n"] for r in docs.select(cell.alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        segments(counts, shards), "seg_cell int, seg_from long, seg_end long, shard int, seg_slot long, moved boolean"
    )
    rest = [c for c in docs.columns if (with_text or c != text) and c not in made]
    rows = docs.select(*rest, cell.alias("ring_cell"), text_size(F.col(text)).alias("size"), crc.alias("text_crc32"), place.alias("__place"))
    order = Window.partitionBy("ring_cell").orderBy("__place", key, "size", "text_crc32")
    ranked = rows.withColumn("__rank", F.row_number().over(order) - 1)
    hit = (F.col("ring_cell") == F.col("seg_cell")) & (F.col("__rank") >= F.col("seg_from")) & (F.col("__rank") < F.col("seg_end"))
    return ranked.join(F.broadcast(plan), hit).select(
        *rest, "ring_cell", "size", "text_crc32", "shard", (F.col("seg_slot") + F.col("__rank") - F.col("seg_from")).alias("slot"), "moved"
    )
