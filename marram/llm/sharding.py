"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

A key's hash puts it on an arc of the ring; the arc's virtual node names its shard. Keys arrive in a hashed
order; one that finds its shard full continues clockwise to the next shard with room. With the capacities
N // shards, one more for the first N % shards, all shards end within one row of each other.

Arrival goes by cells (a slice of the order, then an arc), whose counts decide everything: the driver sees
``SLICES`` x arcs numbers however many rows there are, and only rows of the few cells in which a shard fills
up are told apart by their rank.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared

SHARDS, VIRTUAL_NODES, SLICES = 8, 16, 1024
_PLACES = 1 << 14  # places on the ring

PLAN = "cell long, rank_from long, rank_to long, shard int, slot_from long"


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[list[int], list[list[int]]]:
    """The arc of each place on the ring, and each arc's shards in clockwise order, its own first."""
    nodes: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            at = int.from_bytes(hashlib.md5(f"{shard}/{node}".encode()).digest()[:8], "big") % _PLACES
            while at in nodes:
                at = (at + 1) % _PLACES
            nodes[at] = shard
    places = sorted(nodes)
    arc_of, arc = [], 0
    for place in range(_PLACES):
        while arc < len(places) and places[arc] < place:
            arc += 1
        arc_of.append(arc % len(places))
    owners = [nodes[p] for p in places]
    return arc_of, [list(dict.fromkeys(owners[a:] + owners[:a])) for a in range(len(owners))]


def plan(counts: dict[int, int], shards: int, preferences: list[list[int]]) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of each cell go: (cell, rank_from, rank_to, shard, slot_from)."""
    total, rows = sum(counts.values()), []
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slots = [0] * shards
    for cell in sorted(counts):
        n, rank = counts[cell], 0
        for shard in preferences[cell % len(preferences)]:
            if k := min(n, room[shard]):
                rows.append((cell, rank, rank + k, shard, slots[shard]))
                rank, n, room[shard], slots[shard] = rank + k, n - k, room[shard] - k, slots[shard] + k
            if not n:
                break
    return rows


def assign(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, shard, and its slot in the shard, gapless from 0.

    Null text has size 1 and the crc32 of no bytes; a null doc_id is a key like any other. Repeated rows are
    rows of their own; which of two equal rows takes which slot makes no difference. Other columns are ignored.
    """
    spark = docs.sparkSession
    arc_of, preferences = ring(shards, virtual_nodes)
    key = F.col("doc_id").cast("long")
    place = F.pmod(F.xxhash64(key, F.lit("place")), F.lit(_PLACES)).cast("int")
    arc = F.element_at(F.lit(arc_of), place + 1)
    cell = F.pmod(F.xxhash64(key, F.lit("arrival")), F.lit(SLICES)) * len(preferences) + arc
    counts = {r[0]: r[1] for r in docs.select(cell.alias("cell")).groupBy("cell").count().collect()}
    plan_rows = spark.createDataFrame(plan(counts, shards, preferences), PLAN)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(key.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), cell.alias("cell"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "size", "text_crc32")) - 1)
    placed = rows.join(plan_rows, "cell").where((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("slot_from") + F.col("rank") - F.col("rank_from")).alias("slot"))


def op4_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(_shared.read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
