"""Sharding on a consistent-hash ring with bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, values

#: Cells of the ring; also the largest number of rows the driver sees and of segments that are broadcast, at any input size.
RING = 1 << 15


def ring(n_shards: int, virtual_nodes: int, seed: int = 0) -> list[int]:
    """The shard of the first virtual node at or after each cell, clockwise."""
    at: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(virtual_nodes):
            digest = hashlib.sha256(f"{seed}:{shard}:{v}".encode()).digest()
            cell = int.from_bytes(digest[:8], "big") % RING
            while cell in at:
                cell = (cell + 1) % RING
            at[cell] = shard
    nxt, owner = at[min(at)], [0] * RING
    for cell in range(RING - 1, -1, -1):
        nxt = at.get(cell, nxt)
        owner[cell] = nxt
    return owner


def bounded_loads(counts: dict[int, int], owners: list[int], quotas: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Walks the ring once: rows that a full shard can't take go on to the next shard with room.

    Returns segments ``(cell, first rank, end rank, shard, first slot)``; the
    ranks are places in the cell's order.
    """
    load, out = [0] * len(quotas), []
    n = len(owners)
    clockwise: dict[int, int] = {}

    def following(cell: int) -> int:
        """The next cell whose owner differs, so that a walk visits arcs, not cells."""
        if cell not in clockwise:
            at = cell
            while owners[at] == owners[cell] and (at + 1) % n != cell:
                at = (at + 1) % n
            clockwise[cell] = at
        return clockwise[cell]

    for cell in sorted(counts):
        rank, at = 0, cell
        while rank < counts[cell]:
            shard = owners[at]
            if room := min(quotas[shard] - load[shard], counts[cell] - rank):
                out.append((cell, rank, rank + room, shard, load[shard]))
                load[shard] += room
                rank += room
            at = following(at)
    return out


def shard_rows(
    docs: DataFrame,
    n_shards: int = 24,
    text: str = "text",
    doc_id: str = "doc_id",
    virtual_nodes: int = 128,
    capacity: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """Deals rows to shards on a ring of virtual nodes with bounded loads.

    A row's place on the ring is the hash of its ``doc_id``; where that is null
    it is the hash of its text, so that many nulls spread. The first virtual
    node clockwise names its shard. A shard takes at most its quota: with
    ``capacity`` 1 the quotas are floor or ceil of rows / shards and add up to
    the rows, so counts differ by one at most (law ``rows``); above 1 each
    quota is ceil(capacity * rows / shards) and a new shard moves fewer rows.
    Rows beyond the quota go on clockwise to the next shard with room, in the
    order of the ring and, within a cell, of a 64-bit hash.

    Returns ``doc_id, size, text_crc32, shard, slot``. Size is the UTF-8
    bytes of the text plus 8; null text has no bytes and the CRC 0. Repeated
    rows are placed apart, each with its own slot. An empty table gives an
    empty result. Other columns are left out.

    The driver sees one count per ring cell (32,768 at any input size), and the
    same number of segments, about 1 MB, is broadcast. Only id, size and CRC
    are shuffled, once.
    """
    spark = docs.sparkSession
    body = text_of(text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.when(F.col(doc_id).isNull(), F.xxhash64(F.lit(seed), F.lit("text"), body))
        .otherwise(F.xxhash64(F.lit(seed), F.col(doc_id)))
        .alias("_sw_h"),
    ).withColumn("_sw_cell", F.pmod("_sw_h", F.lit(RING)).cast("int"))
    counts = {r["_sw_cell"]: r["count"] for r in rows.groupBy("_sw_cell").count().collect()}
    total = sum(counts.values())
    if capacity <= 1:
        quotas = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    else:
        quotas = [-int(-capacity * total // n_shards)] * n_shards
    plan = bounded_loads(counts, ring(n_shards, virtual_nodes, seed), quotas)
    segments = values(spark, "cell int,lo long,hi long,shard int,slot0 long", plan)
    order = Window.partitionBy("_sw_cell").orderBy("_sw_h", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("_sw_rank", F.row_number().over(order).cast("long") - 1)
    inside = (F.col("_sw_cell") == F.col("cell")) & (F.col("_sw_rank") >= F.col("lo")) & (F.col("_sw_rank") < F.col("hi"))
    return ranked.join(F.broadcast(segments), inside).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("_sw_rank") - F.col("lo")).alias("slot")
    )
