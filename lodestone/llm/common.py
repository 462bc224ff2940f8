"""What the operators of this subpackage share: scratch tables, checked broadcasts, word and shingle hashes.

Words are the maximal runs of bytes outside ``\\x20 \\x09-\\x0D`` in the UTF-8 text, so the kernels work on
Arrow's text buffers directly, a few megabytes at a time, without a Python object for each word.
"""

from __future__ import annotations

import hashlib
import secrets
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Most bytes of a side that is broadcast; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that a kernel takes at once (or one document, if that is longer).
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``. Where it is unset, one in /tmp if all of Spark runs on this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file:///tmp/spark-shared-{spark.sparkContext.applicationId}"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and no lost executor takes it away."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if rows * row_bytes is within the limit, else df as it is, for a shuffled join.

    df is a table() already, so that the count is read from Parquet's footers.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def small_by(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """small() for rows whose bytes differ: size is summed."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df


# ---- rows with columns of any names ----------------------------------------------------------------------------------


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """All columns as one struct named row, and more beside it: no column of df can clash with what an operator adds."""
    return df.select(F.struct(*map(col, df.columns)).alias("row"), *more)


def unpacked(columns: list[str], **changed: Column) -> list[Column]:
    """The columns out of row again; those in changed are replaced."""
    return [changed.get(c, F.col("row").getField(c)).alias(c) for c in columns]


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as it takes for df to have no such column."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def with_row(df: DataFrame, fields: str) -> StructType:
    """The schema of df's column row and of further fields."""
    return StructType([StructField("row", df.schema["row"].dataType), *StructType.fromDDL(fields).fields])


# ---- words -----------------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes from which on a word is hashed alone, by BLAKE2.
LONG_WORD = 256
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
#: Masks of the first n bytes of a little-endian block of 8.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def fresh_seed() -> int:
    """A seed of the hashes of one run: texts can't be made to collide beforehand."""
    return secrets.randbits(63)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    return mix(left * _C1 + (right ^ _C2))


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k neighbours, joined from runs of 1, 2, 4, ... of them."""
    n, at, size, level = len(hashes) - k + 1, 0, 1, hashes
    out = None
    while size <= k:
        if k & size:
            part = level[at : at + n]
            out = part if out is None else join(out, part)
            at += size
        if 2 * size <= k:
            level = join(level[:-size], level[size:])
        size *= 2
    return mix(out + np.uint64(k))


class Words:
    """The words of some documents. first[i]:first[i + 1] are those of document i; start and end are byte places."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        space = _SPACE[data]
        edge = np.empty(len(data) + 1, dtype=bool)
        edge[1:-1] = space[1:] != space[:-1]
        edge[0] = edge[-1] = True
        edge[bounds] = True  # a word ends where its document ends
        cuts = np.flatnonzero(edge) if len(data) else np.empty(0, dtype=np.int64)
        start, end = cuts[:-1], cuts[1:]
        keep = ~space[start] if len(start) else np.empty(0, dtype=bool)
        self.data, self.start, self.end = data, start[keep], end[keep]
        self.first = np.searchsorted(self.start, bounds)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word, of all its bytes in blocks of 8; long words by BLAKE2."""
        first, later = mix(np.array([seed, seed ^ 0x5851F42D4C957F2D], dtype=np.uint64))
        size = self.end - self.start
        out = np.full(len(size), first, dtype=np.uint64)
        blocks = np.ndarray(len(self.data) + 1, "<u8", np.append(self.data, np.zeros(8, dtype=np.uint8)), strides=(1,))
        left = np.flatnonzero(size < LONG_WORD)
        at = 0
        while len(left):
            rest = size[left] - at
            block = blocks[self.start[left] + at] & _FIRST[np.minimum(rest, 8)]
            out[left] = mix(out[left] ^ block) if at == 0 else join(out[left], block ^ later)
            left, at = left[rest > 8], at + 8
        for i in np.flatnonzero(size >= LONG_WORD).tolist():
            word = self.data[self.start[i] : self.end[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=int(first).to_bytes(8, "little")).digest(), "little")
        return mix(out + size.astype(np.uint64) * _C3)


def grams(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all runs of k words that lie within one document."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return at, run_hashes(hashes, k)[at]


def chunks(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a batch of at most CHUNK_BYTES of text: the rows, their bytes, the bounds in these, and which texts aren't null."""
    column = batch.column(batch.schema.get_field_index(text))
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    valid = np.ones(len(column), dtype=bool) if column.null_count == 0 else np.asarray(column.is_valid())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        to = min(to, len(column))
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], valid[at:to]
        at = to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)


# ---- components ------------------------------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) of every id in the edges (a long, b long): the smallest id that can be reached.

    Alternating large-star and small-star steps over the shuffled edges until every edge leads to a root; every step is
    written to the shared folder. Raises if that takes more than the given rounds.
    """
    now = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    for _ in range(rounds):
        # done when nothing has two parents or a parent that has one
        parents = now.groupBy("a").agg(F.count("*").alias("c"))
        if parents.join(now.select(F.col("b").alias("a"), F.lit(1).alias("p")).distinct(), "a", "left").where("c > 1 or p is not null").isEmpty():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = small(table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc"), 40)
        # large star: every larger neighbour of a links to the least id around a
        large = table(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc")
        # small star: every smaller neighbour of a, and a itself, link to the least of them
        least = table(large.groupBy("a").agg(F.min("b").alias("m")), "cc")
        moved = large.join(small(least, 40), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = table(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc")
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
