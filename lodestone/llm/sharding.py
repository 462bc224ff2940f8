"""Sharding by fixed virtual slots (operator 1), with DataFrame functions only.

A record's key is hashed into one of thousands of slots, for good. A versioned map says which shard holds each slot; it is a small table (one row for each slot)
under ``path/version=N``, written anew when it is edited. ``balance`` deals the slots by their bytes, the largest first to the
emptiest shard. ``rebalance`` edits a map after growth or for another number of shards: it moves slots out of overfull shards only, and as few as it takes.
A record's place in its shard is the count of records in the slots before its own plus its place within the slot, so that no
window spans more than a slot.

Hot keys: rows of equal key go to one slot; where keys repeat or are null, ``salt`` columns (the text's checksum, say) part them.

Defined results: null keys are hashed as null with their salt; null texts count no bytes; an empty table gives a map of empty slots and no rows;
only the named columns are read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, packed, unpacked

SLOTS = 8192


def slot_of(*columns: str | Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame) -> DataFrame:
    """(slot, bytes, rows) of records (vslot, size): as many rows as slots at most, summed in each task first."""
    return records.groupBy(F.col("vslot").alias("slot")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _deal(loads: dict[int, int], shards: int, fixed: dict[int, int]) -> dict[int, int]:
    """The free slots, largest first, each to the shard with the fewest bytes."""
    total = [0] * shards
    for slot, shard in fixed.items():
        total[shard] += loads.get(slot, 0)
    heap = [(b, s) for s, b in enumerate(total)]
    heapq.heapify(heap)
    out = dict(fixed)
    for slot in sorted((s for s in loads if s not in fixed), key=lambda s: (-loads[s], s)):
        b, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (b + loads[slot], shard))
    return out


def _loads(measured: DataFrame, slots: int) -> dict[int, int]:
    """Bytes of each slot on the driver: bounded by the number of slots."""
    found = {r["slot"]: r["bytes"] for r in measured.limit(slots).collect()}
    return {s: found.get(s, 0) for s in range(slots)}


def _write(spark, path: str, version: int, owners: dict[int, int]) -> DataFrame:
    rows = spark.createDataFrame(sorted(owners.items()), "slot int, shard int")
    rows.coalesce(1).write.parquet(f"{path}/version={version}")
    return load(spark, path, version)


def load(spark, path: str, version: int) -> DataFrame:
    """The map of a version: (slot, shard)."""
    return spark.read.schema("slot int, shard int").parquet(f"{path}/version={version}")


def balance(measured: DataFrame, path: str, shards: int, slots: int = SLOTS, version: int = 0) -> DataFrame:
    """A first map for measured slots."""
    return _write(measured.sparkSession, path, version, _deal(_loads(measured, slots), shards, {}))


def rebalance(measured: DataFrame, path: str, version: int, shards: int, slots: int = SLOTS, tolerance: float = 0.02) -> DataFrame:
    """The next version of a map: slots of shards that are gone, and enough of the slots of overfull shards, move; all others stay."""
    spark = measured.sparkSession
    loads = _loads(measured, slots)
    owners = {r["slot"]: r["shard"] for r in load(spark, path, version).collect()}
    most = sum(loads.values()) / shards * (1 + tolerance)
    total = [0] * shards
    kept: dict[int, int] = {}
    for slot in sorted(owners, key=lambda s: (-loads.get(s, 0), s)):
        shard = owners[slot]
        if shard < shards and total[shard] + loads.get(slot, 0) <= most:
            total[shard] += loads.get(slot, 0)
            kept[slot] = shard
    return _write(spark, path, version + 1, _deal(loads, shards, kept))


def place(records: DataFrame, measured: DataFrame, owners: DataFrame, order: list[str]) -> DataFrame:
    """records (vslot, size, ...) with shard and slot, the place in the shard, gapless from 0; these replace columns of their names.

    The sides that are broadcast have one row for each virtual slot.
    """
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    starts = owners.withColumnRenamed("slot", "vslot").join(F.broadcast(measured.withColumnRenamed("slot", "vslot").select("vslot", "rows")), "vslot").select("vslot", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("vslot").orderBy(*(F.col("row").getField(c) for c in order))) - 1
    placed = packed(records, col("vslot").alias("vslot")).withColumn("within", within).join(F.broadcast(starts), "vslot")
    kept = [c for c in records.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*unpacked(kept), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"))
