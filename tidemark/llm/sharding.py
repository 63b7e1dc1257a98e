"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The circle has RING_CELLS cells. Each shard owns VIRTUAL_NODES of them, and a
row belongs to the first virtual node clockwise of its key's cell. No shard
takes more than its bound; rows that find their shard full continue clockwise
to the next virtual node. With the bounds floor(n/S) and, for the first n mod S
shards, one more, the shards' row counts are at most one apart: law `rows`.

Rows are only counted by cell. The walk around the ring runs on these counts,
of which there are at most RING_CELLS at any input size, and yields for each
cell the ranges of ranks that go to each shard. A row's rank within its cell
and an equi-join on the cell do the rest, in SQL functions alone.

Defined results: a null text counts as empty; a row without an id is placed by
its text's checksum; rows equal in id and text are interchangeable; an empty
table gives an empty one. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.llm.common import read

RING_CELLS = 1 << 14
VIRTUAL_NODES = 64


def ring(shards: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise; on a shared cell the first digest stays."""
    at: dict[int, tuple[str, int]] = {}
    for shard in range(shards):
        for v in range(VIRTUAL_NODES):
            digest = hashlib.md5(f"{shard}:{v}".encode()).hexdigest()
            cell = int(digest[:8], 16) % RING_CELLS
            at[cell] = min(at.get(cell, (digest, shard)), (digest, shard))
    return [(cell, shard) for cell, (_, shard) in sorted(at.items())]


def walk(counts: Mapping[int, int], shards: int) -> list[dict]:
    """Ranges of ranks within each cell, with their shard and first slot.

    counts: rows by cell. In each round the rows still on their way stand before
    one virtual node each; its shard takes them, nearest cell first, up to its
    bound, and the rest go on to the next node.
    """
    nodes, total = ring(shards), sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    cells = sorted(counts)
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
    k = 0
    for cell in cells:
        while k < len(nodes) and nodes[k][0] < cell:
            k += 1
        waiting[k % len(nodes)].append((cell, 0, counts[cell]))
    found = []
    while any(waiting):
        going: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
        for i, (own, shard) in enumerate(nodes):
            for cell, low, high in sorted(waiting[i], key=lambda x: (own - x[0]) % RING_CELLS):
                take = min(high - low, room[shard] - used[shard])
                if take:
                    found.append({"cell": cell, "low": low, "high": low + take, "shard": shard, "slot": used[shard]})
                    used[shard] += take
                if low + take < high:
                    going[(i + 1) % len(nodes)].append((cell, low + take, high))
        waiting = going
    return found


def cell_of(doc_id: str, checksum: str) -> Column:
    """A row's cell: by its id, or without one by its text."""
    hashed = F.when(F.col(doc_id).isNull(), F.xxhash64(checksum)).otherwise(F.xxhash64(doc_id))
    return F.pmod(hashed, F.lit(RING_CELLS)).cast("int")


def shard_rows(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumn("cell", cell_of("doc_id", "text_crc32"))
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(walk(counts, shards))), "array<struct<cell:int,low:long,high:long,shard:int,slot:long>>")))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("cell").orderBy("doc_id", "text_crc32", "size")).cast("long") - 1)
    return ranked.join(plan, "cell").where("rank >= low and rank < high").select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("rank") - F.col("low")).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    """Every document in one of 16 shards whose row counts are at most one apart."""
    return shard_rows(read(spark, sf_dir, "documents"), shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
