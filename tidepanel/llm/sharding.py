"""Consistent-hash ring with virtual nodes and bounded loads.

A key's digest falls in one of ``2**bits`` equal arcs of the ring. Every shard owns virtual nodes at
arc borders; a key belongs to the next virtual node clockwise. Shards have a capacity: arcs are taken
clockwise, and keys that find the shard full go on to the next virtual node whose shard has room. Only the
row count (or bytes) of each arc reaches the driver, a table whose size is fixed by the ring; the plan made
from it says which ranks within an arc go to which shard. Rows are ranked inside their arc, so nothing is
ordered globally and no task holds more than one arc.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least arcs of the ring: 4096. They grow with the virtual nodes, and so does the plan, but never with the rows.
RING_BITS = 12
ARCS_PER_NODE = 8
VIRTUAL_NODES = 64


def ring_owners(shards: int, virtual_nodes: int = VIRTUAL_NODES, bits: int = RING_BITS) -> list[int]:
    """Shard of the next virtual node clockwise from each arc; ties at a border go to the lower digest."""
    nodes: dict[int, tuple[bytes, int]] = {}
    for shard in range(shards):
        for v in range(virtual_nodes):
            digest = hashlib.sha256(f"{shard}/{v}".encode()).digest()
            at = int.from_bytes(digest[:8], "big") >> (64 - bits)
            nodes[at] = min(nodes.get(at, (digest, shard)), (digest, shard))
    owners, owner = [0] * (1 << bits), nodes[min(nodes)][1]
    for at in range((1 << bits) - 1, -1, -1):
        owner = nodes[at][1] if at in nodes else owner
        owners[at] = owner
    return owners


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[int, list[int]]:
    """(bits, owners) of the smallest ring of enough arcs on which every shard owns one."""
    bits = max(RING_BITS, (shards * virtual_nodes * ARCS_PER_NODE - 1).bit_length())
    owners = ring_owners(shards, virtual_nodes, bits)
    while len(set(owners)) < shards:
        bits += 1
        owners = ring_owners(shards, virtual_nodes, bits)
    return bits, owners


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard; with no slack the counts differ by one at most."""
    if slack:
        return [-int(-total * (1 + slack) // shards)] * shards
    return [total // shards + (i < total % shards) for i in range(shards)]


def plan_arcs(counts: dict[int, int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, slot of the first rank) for all keys, taken clockwise."""
    room, used, plan = list(room), [0] * len(room), []
    waiting: list[tuple[int, int, int]] = []  # arc, first rank, end rank
    arcs = len(owners)
    for turn in range(2 * arcs):  # the second turn serves what overflowed past the end of the first
        arc = turn % arcs
        if turn < arcs and counts.get(arc):
            waiting.append((arc, 0, counts[arc]))
        shard = owners[arc]
        while waiting and room[shard]:
            at, lo, hi = waiting.pop(0)
            take = min(hi - lo, room[shard])
            plan.append((at, lo, lo + take, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
            if lo + take < hi:
                waiting.insert(0, (at, lo + take, hi))
        if turn >= arcs and not waiting:
            break
    if waiting:
        raise ValueError("some shard with room owns no arc of the ring")
    return plan


def ring_position(key: Column) -> Column:
    """Unsigned 48-bit digest of a key; a null key hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def ring_shards(
    docs: DataFrame,
    shards: int = 8,
    key: str = "doc_id",
    text: str = "text",
    slack: float = 0.0,
    virtual_nodes: int = VIRTUAL_NODES,
) -> DataFrame:
    """``key``, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row.

    ``slack`` 0 gives counts that differ by one at most; a positive one lets a shard hold that share more
    than the mean, with fewer keys moved when shards are added. Size: UTF-8 bytes of the text plus 1; a null
    text counts none and has the checksum of an empty one. Rows with equal or null keys share an arc and are
    ranked by checksum and size; equal rows are interchangeable. An empty table gives an empty result.
    """
    spark, (bits, owners) = docs.sparkSession, ring(shards, virtual_nodes)
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    arc = F.shiftrightunsigned("__at", 48 - bits).cast("int")
    placed = docs.select(F.col(f"`{key}`").alias("__key"), raw.alias("__text")).withColumn("__at", ring_position(F.col("__key")))
    counted = placed.groupBy(arc.alias("arc")).count().collect()  # at most 2**bits rows
    counts = {r["arc"]: r["count"] for r in counted}
    plan = plan_arcs(counts, owners, capacities(sum(counts.values()), shards, slack))
    by_arc: dict[int, list] = {}
    for at, lo, hi, shard, slot in plan:
        by_arc.setdefault(at, []).append((lo, hi, shard, slot))
    table = spark.createDataFrame(
        [(at, parts) for at, parts in by_arc.items()],
        "arc int, parts array<struct<lo: long, hi: long, shard: int, slot: long>>",
    )
    size, crc = (F.octet_length("__text") + F.lit(1)).cast("long"), F.crc32(F.encode("__text", "UTF-8"))
    rows = placed.select("__key", "__at", size.alias("size"), crc.alias("text_crc32"), arc.alias("arc"))
    order = Window.partitionBy("arc").orderBy("__at", "__key", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    part = F.filter("parts", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"]))[0]
    # The plan has one row per arc of the fixed ring.
    joined = ranked.join(F.broadcast(table), "arc").withColumn("part", part)
    slot = F.col("part.slot") + F.col("rank") - F.col("part.lo")
    return joined.select(F.col("__key").alias(key), "size", "text_crc32", F.col("part.shard").alias("shard"), slot.alias("slot"))
