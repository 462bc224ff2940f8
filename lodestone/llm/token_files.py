"""Token-ID files with keyed access (operator 2).

``write_token_files`` encodes whole texts, appends an end id and writes the ids in ascending key order as a Parquet table of
shards: ``payload`` holds the raw ids of some thousand documents, little-endian, 2 bytes wide where the vocabulary allows it,
``keys``, ``offsets`` and ``lengths`` say what lies where. Beside it stands a minimal perfect hash index: keys are dealt to
buckets by hash, and each bucket stores bit levels that send its n keys to 0..n-1 without gap or clash, a 32-bit fingerprint for each
(a foreign key passes it once in 4 billion times) and the shard, offset, length and global start of its ids. A lookup is one hash, one
bucket, one slot. ``TokenFiles.locate`` and ``TokenFiles.read`` do this for any number of keys: they are dealt to the buckets,
then to the shards. The shards are a table bucketed by shard, so that reading them moves the keys and not the payload. Of up to ``FEW`` keys
the buckets, and then the shards, are named to the scans, which read no others; more keys are dealt to all of them.

Defined results: a null text counts as empty and yields the end id alone; null keys and repeated keys keep all their rows (they
stand side by side, told apart by an ordinal from 0); an empty table gives empty files; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, col, mix, scratch, table
from .tokens import library_encoder

#: Bytes of ids in a shard (a longer document has a shard of its own), and keys in a bucket.
SHARD_BYTES, BUCKET_KEYS = 8 << 20, 50_000
#: Most keys of a lookup whose buckets and shards are named to the scans.
FEW = 1000

_SHARDS = "shard long, n_tokens long, payload binary, keys array<long>, offsets array<long>, lengths array<long>"
_INDEX = "bucket long, sizes array<int>, bits binary, fingerprints binary, shard binary, offset binary, n_tokens binary, start binary"
_PLACE = "key long, ordinal long, shard long, offset long, n_tokens long, start long"


def _write(file: str, end_id: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, dtype = library_encoder(file)
        end = np.array([end_id], dtype=dtype).tobytes()
        shard = TaskContext.get().partitionId() << 24
        keys, parts, size = [], [], 0

        def out() -> pa.RecordBatch:
            n = np.array([len(p) for p in parts], dtype=np.int64) // dtype.itemsize
            row = [shard, int(n.sum()), b"".join(parts), keys, (np.cumsum(n) - n).tolist(), n.tolist()]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[f.split()[0] for f in _SHARDS.split(", ")])

        for batch in batches:
            for rows, data, bounds, _ in chunks(batch):
                for key, ids in zip(rows.column("key").to_pylist(), encoder.chunk(data, bounds), strict=True):
                    if parts and size + len(ids) > shard_bytes:
                        yield out()
                        shard, keys, parts, size = shard + 1, [], [], 0
                    keys.append(key)
                    parts.append(ids + end)
                    size += len(parts[-1])
        if parts:
            yield out()

    return run


def _slots(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(a + np.uint64(level) * (b | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def _build(_, rows: pd.DataFrame) -> pd.DataFrame:
    """The index of a bucket: levels of bits; keys that meet another at one level go on to the next."""
    a, b = rows["h1"].to_numpy().view(np.uint64), rows["h2"].to_numpy().view(np.uint64)
    left, levels, slot, before = np.arange(len(rows)), [], np.empty(len(rows), dtype=np.int64), 0
    while len(left):
        size = 2 * len(left) + 1
        at = _slots(a[left], b[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(alone) - 1
        slot[left[alone[at]]] = before + rank[at[alone[at]]]
        before += int(alone.sum())
        levels.append(alone)
        left = left[~alone[at]]
        if len(levels) > 200:
            raise ValueError("two keys have equal hashes of 128 bits")
    order = np.argsort(slot)
    column = lambda name, kind: rows[name].to_numpy()[order].astype(kind).tobytes()
    return pd.DataFrame({"bucket": [int(rows["bucket"].iloc[0])], "sizes": [[len(x) for x in levels]], "bits": [b"".join(np.packbits(x).tobytes() for x in levels)], "fingerprints": [column("fp", "<i4")], **{c: [column(c, "<i8")] for c in ("shard", "offset", "n_tokens", "start")}})


def _find(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    names = [f.split()[0] for f in _PLACE.split(", ")]
    if not len(keys) or not len(index):
        return pd.DataFrame({n: pd.Series(dtype="Int64" if n == "key" else "int64") for n in names})
    row = index.iloc[0]
    a, b = keys["h1"].to_numpy().view(np.uint64), keys["h2"].to_numpy().view(np.uint64)
    slot, left, at, before = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0, 0
    for level, size in enumerate(row["sizes"]):
        n = (size + 7) // 8
        bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8)[at : at + n])[:size].astype(bool)
        place = _slots(a[left], b[left], level, size)
        hit = bits[place]
        slot[left[hit]] = before + (np.cumsum(bits) - 1)[place[hit]]
        before, at, left = before + int(bits.sum()), at + n, left[~hit]
    good = slot >= 0
    good[good] = np.frombuffer(row["fingerprints"], dtype="<i4")[slot[good]] == keys["fp"].to_numpy()[good]
    slot = slot[good]
    return pd.DataFrame({"key": keys["key"].astype("Int64")[good].array, "ordinal": keys["ordinal"].to_numpy()[good], **{c: np.frombuffer(row[c], dtype="<i8")[slot] for c in ("shard", "offset", "n_tokens", "start")}})


def _fetch(width: int):
    dtype = np.dtype(f"<u{width}")

    def run(places: pa.Table, shards: pa.Table) -> pa.Table:
        out = places.select(["key", "ordinal", "n_tokens", "start"])
        ids: list[bytes] = []
        if len(places):
            payload = np.frombuffer(shards.column("payload")[0].as_buffer(), dtype=dtype)
            ids = [payload[a : a + n].astype("<u4").tobytes() for a, n in zip(places.column("offset").to_pylist(), places.column("n_tokens").to_pylist(), strict=True)]
        return out.append_column("ids", pa.array(ids, pa.binary()))

    return run


def _hashed(df: DataFrame, buckets: int) -> DataFrame:
    null = F.col("key").isNull()
    h = lambda seed: F.xxhash64(F.lit(seed), null, "key", "ordinal")
    return df.select("*", h(1).alias("h1"), h(2).alias("h2"), F.hash(null, "key", "ordinal").alias("fp")).withColumn("bucket", F.pmod(F.col("h1"), F.lit(buckets)))


@dataclass
class TokenFiles:
    """Files of ids and their index. table: the shards, bucketed by shard; index: a path; width: bytes of an id."""

    spark: SparkSession
    table: str
    index: str
    buckets: int
    width: int

    def locate(self, keys: DataFrame) -> DataFrame:
        """(key, ordinal, shard, offset, n_tokens, start) of the (key, ordinal) rows that the files hold."""
        return self._located(keys)[0]

    def read(self, keys: DataFrame) -> DataFrame:
        """(key, ordinal, n_tokens, start, ids) of these rows; ids: little-endian unsigned 32-bit integers."""
        shards = self.spark.table(self.table).select("shard", "payload")
        places, few = self._located(keys)
        if few:
            places = table(places, "places")
            shards = _only(shards, "shard", places)
        return places.groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(_fetch(self.width), "key long, ordinal long, n_tokens long, start long, ids binary")

    def _located(self, keys: DataFrame) -> tuple[DataFrame, bool]:
        """The places, and whether so few were asked for that the scans are told where."""
        index = self.spark.read.schema(_INDEX).parquet(self.index)
        asked = _hashed(keys.select(F.col("key").cast("long").alias("key"), F.col("ordinal").cast("long").alias("ordinal")), self.buckets)
        first = table(asked.limit(FEW + 1), "asked")
        few = first.count() <= FEW
        if few:
            asked, index = first, _only(index, "bucket", first)
        return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_find, _PLACE), few


def _only(df: DataFrame, column: str, places: DataFrame) -> DataFrame:
    """The rows of df whose column is one of those of the FEW places."""
    return df.where(F.col(column).isin([r[0] for r in places.select(column).distinct().collect()]))


def write_token_files(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text", end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> TokenFiles:
    """Encodes, writes and indexes all rows of docs; see the module's docstring."""
    spark = docs.sparkSession
    rows = docs.select(col(key).cast("long").alias("key"), F.coalesce(col(text), F.lit("")).alias("text"))
    parts = max(1, rows.rdd.getNumPartitions())  # as many as the table is read in
    name = f"token_ids_{uuid.uuid4().hex}"
    ranged = rows.repartitionByRange(parts, "key").sortWithinPartitions("key")
    ranged.mapInArrow(_write(file, end_id, shard_bytes), _SHARDS).write.format("parquet").option("path", scratch(spark, "token-ids")).option("compression", "zstd").bucketBy(parts, "shard").saveAsTable(name)
    shards = spark.table(name)

    # Tokens before each shard: sums over the shards of a task, and over the tasks, whose number is bounded.
    task = F.shiftright("shard", 24)
    tasks = shards.groupBy(task.alias("task")).agg(F.sum("n_tokens").alias("n")).select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    inside = shards.select("shard", task.alias("task"), (F.sum("n_tokens").over(Window.partitionBy(task).orderBy("shard")) - F.col("n_tokens")).alias("inside"))
    base = inside.join(tasks, "task").select("shard", (F.col("before") + F.col("inside")).alias("base"))

    entries = shards.select("shard", F.explode(F.arrays_zip("keys", "offsets", "lengths")).alias("e")).select("shard", F.col("e.keys").alias("key"), F.col("e.offsets").alias("offset"), F.col("e.lengths").alias("n_tokens"))
    numbered = entries.withColumn("ordinal", (F.row_number().over(Window.partitionBy("key").orderBy("shard", "offset")) - 1).cast("long"))
    placed = numbered.join(base, "shard").withColumn("start", F.col("base") + F.col("offset"))
    count = shards.agg(F.sum(F.size("keys"))).first()[0] or 0
    buckets = max(1, math.ceil(count / BUCKET_KEYS))
    index = scratch(spark, "token-index")
    _hashed(placed, buckets).groupBy("bucket").applyInPandas(_build, _INDEX).write.parquet(index)
    return TokenFiles(spark, name, index, buckets, library_encoder(file)[1].itemsize)


def all_keys(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every (key, ordinal) of a table."""
    counted = docs.groupBy(col(key).cast("long").alias("key")).count()
    return counted.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("ordinal"))
