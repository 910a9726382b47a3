"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every key has a place on a ring of ``SLOTS`` slots; every shard has ``virtual_nodes`` slots. A key belongs to the first virtual
node clockwise. A shard that is full passes what overflows on to the next shard clockwise that has room, so loads are bounded
and only overflowing keys move. All keys of a slot meet the shards in the same order, so the driver decides from ``SLOTS``
counts alone, whatever the number of rows, how many keys of each slot go where; the rows find their place by their rank in the
slot. With no slack (the default) the shards' counts are at most one apart. DataFrame and SQL functions only.

Ranks are taken within cells: finer pieces of a slot whose number grows with the input. A cell that one repeated key has made
large is split further by row number, so no key, however frequent, is sorted in one task.

Defined cases: null keys share the ring place of the empty string; a null text has no bytes; repeated rows and repeated keys
are placed each; equal keys are ordered by size, checksum, then position in the input; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from probity.llm.common import checkpointed, table, text_of

SLOT_BITS, RING_BITS = 10, 60
SLOTS = 1 << SLOT_BITS
CELL_ROWS = 20_000


def ring(shards: int, virtual_nodes: int) -> list[list[int]]:
    """For each slot the shards in the order in which its keys meet them, clockwise. A taken slot passes a node on to the next."""
    if not 0 < shards * virtual_nodes <= SLOTS:
        raise ValueError(f"shards times virtual_nodes must be between 1 and {SLOTS}")
    owner: dict[int, int] = {}
    for v in range(virtual_nodes):
        for s in range(shards):
            at = int(hashlib.md5(f"shard-{s}-{v}".encode()).hexdigest()[:8], 16) % SLOTS
            while at in owner:
                at = (at + 1) % SLOTS
            owner[at] = s
    return [list(dict.fromkeys(owner[k % SLOTS] for k in range(slot, slot + SLOTS) if k % SLOTS in owner)) for slot in range(SLOTS)]


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """What each shard may hold. Without slack the counts are at most one apart."""
    if slack > 0:
        return [math.ceil(rows * (1 + slack) / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def allot(counts: dict[int, int], order: list[list[int]], room: list[int]) -> list[dict[str, int]]:
    """Intervals of ranks: all slots fill their first shard as far as there is room, then the next clockwise, and so on."""
    left, room, taken = dict(counts), list(room), [0] * len(room)
    done = dict.fromkeys(left, 0)
    intervals = []
    for step in range(len(room)):
        for slot in sorted(left):
            s = order[slot][step]
            if n := min(left[slot], room[s]):
                intervals.append({"slot": slot, "lo": done[slot], "hi": done[slot] + n, "shard": s, "base": taken[s]})
                left[slot] -= n
                done[slot] += n
                room[s] -= n
                taken[s] += n
    return intervals


def shard(docs: DataFrame, shards: int = 8, *, virtual_nodes: int = 32, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard and slot (its number within the shard, without gaps)."""
    text = text_of(text_col)
    place = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, RING_BITS // 4), 16, 10).cast("long")
    keyed = checkpointed(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), place.alias("place"), F.monotonically_increasing_id().alias("row"))
    )
    rows = keyed.count()
    bits = SLOT_BITS + max(0, math.ceil(math.log2(max(1, rows / SLOTS / CELL_ROWS))))
    per_cell = max(1, rows >> bits)
    keyed = keyed.select("*", F.shiftright("place", RING_BITS - SLOT_BITS).cast("int").alias("slot"), F.shiftright("place", RING_BITS - bits).alias("cell"))
    cells = keyed.groupBy("slot", "cell").count()
    hot = cells.where(F.col("count") > max(4 * per_cell, 1000)).select("cell", F.ceil(F.col("count") / max(per_cell, 250)).cast("int").alias("pieces"))
    pieces = keyed.join(hot, "cell", "left").withColumn("piece", F.coalesce(F.pmod("row", "pieces"), F.lit(0)).cast("int")).drop("pieces")
    sizes = pieces.groupBy("slot", "cell", "piece").count()
    starts = sizes.select("cell", "piece", (F.sum("count").over(W.partitionBy("slot").orderBy("cell", "piece")) - F.col("count")).alias("start"))
    number = F.row_number().over(W.partitionBy("cell", "piece").orderBy("place", "doc_id", "size", "text_crc32", "row"))
    ranked = pieces.withColumn("number", number).join(starts, ["cell", "piece"]).withColumn("rank", F.col("start") + F.col("number") - 1)
    counts = {r["slot"]: r["n"] for r in cells.groupBy("slot").agg(F.sum("count").alias("n")).collect()}  # at most SLOTS rows
    found = allot(counts, ring(shards, virtual_nodes), capacities(rows, shards, slack))
    intervals = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(found)), "array<struct<slot:int,lo:long,hi:long,shard:int,base:long>>")))
    placed = ranked.join(F.broadcast(intervals), "slot").where("rank >= lo and rank < hi")  # at most SLOTS times shards rows
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))


def op4_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
