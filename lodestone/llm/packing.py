"""Packing of documents into sequences of bounded length by a grouping genetic algorithm (operator 6).

``cut_documents`` turns each document into pieces: ids with an end id; one longer than the sequence is cut into full pieces,
with the shorter one first. Full pieces are sequences of their own. ``pack`` deals all others by hash to blocks of bounded size, and
several islands evolve packings of each block: an individual is a list of bins; crossover injects the other parent's best-filled
bins whole, drops the bins that hold any of the same pieces, and puts the displaced pieces back by best fit; mutation empties
the worst bins and does the same. After each epoch every island also gets its neighbour's elite, through a shuffle of
one row for each island. An island rests as soon as no packing can have fewer bins. The first individuals come from best fit over
sizes in falling and in shaken order. What part-filled bins the blocks leave is dealt and packed once more.

Defined results: a null text counts as empty (one piece: the end id); pieces of no length are allowed; equal rows are separate pieces;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, col, packed, table, unpacked
from .tokens import library_encoder

#: Pieces in a block, islands of a block, epochs, generations in an epoch, individuals of an island.
BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4096, 2, 2, 6, 4

Bins = list[list[int]]


def cut_documents(docs: DataFrame, file: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every piece; ids: little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, dtype = library_encoder(file)
        end = np.array([end_id], dtype=dtype).tobytes()
        for batch in batches:
            for rows, data, bounds, _ in chunks(batch):
                keys, columns, parts = rows.column("key").to_pylist(), [[], [], [], [], []], []
                for k, ids in zip(keys, encoder.chunk(data, bounds), strict=True):
                    wide = np.frombuffer(ids + end, dtype=dtype).astype("<u4")
                    at = len(wide) % capacity or min(capacity, len(wide))
                    for i, (a, b) in enumerate([(0, at), *((x, x + capacity) for x in range(at, len(wide), capacity))]):
                        piece = wide[a:b].tobytes()
                        for column, v in zip(columns, (k, i, a, b - a, zlib.crc32(piece)), strict=True):
                            column.append(v)
                        if keep_ids:
                            parts.append(piece)
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(parts, pa.binary())] * keep_ids)], names=[key, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    rows = docs.select(col(key).cast("long").alias("key"), F.coalesce(col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{key}` long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


# ---- a block's packings ----------------------------------------------------------------------------------------------


class Packing:
    """Bins, the fullest first, and the room that is left in each. Bins are shared between packings and never changed."""

    def __init__(self, bins: Bins, rooms: list[int], capacity: int):
        self.bins, self.rooms = bins, rooms
        # Fewer bins first; then fuller ones, by the mean square of the filling.
        self.fitness = -len(bins), sum(((capacity - r) / capacity) ** 2 for r in rooms) / max(1, len(bins))


def _fitness(packing: Packing) -> tuple[int, float]:
    return packing.fitness


class Block:
    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.least = max(math.ceil(sum(lengths) / capacity), sum(2 * x > capacity for x in lengths))
        self.falling = sorted(range(len(lengths)), key=lambda p: -lengths[p])
        self.rank = [0] * len(lengths)
        for i, p in enumerate(self.falling):
            self.rank[p] = i

    def packing(self, bins: Bins) -> Packing:
        return self.best_fit(bins, [self.capacity - sum(map(self.lengths.__getitem__, one)) for one in bins], [])

    def best_fit(self, bins: Bins, rooms: list[int], pieces: list[int]) -> Packing:
        """Puts each piece into the fullest bin that takes it. Bit r of the mask is set if a bin has room r."""
        by_room: dict[int, Bins] = {}
        mask, lengths, capacity = 0, self.lengths, self.capacity
        for r, one in zip(rooms, bins, strict=True):
            if r in by_room:
                by_room[r].append(one)
            else:
                by_room[r] = [one]
                mask |= 1 << r
        for p in pieces:
            size = lengths[p]
            above = mask >> size
            if above:
                r = size + (above & -above).bit_length() - 1
                same = by_room[r]
                one = [*same.pop(), p]
                if not same:
                    del by_room[r]
                    mask ^= 1 << r
            else:
                r, one = capacity, [p]
            r -= size
            if r in by_room:
                by_room[r].append(one)
            else:
                by_room[r] = [one]
                mask |= 1 << r
        out: Bins = []
        left: list[int] = []
        for r in sorted(by_room):
            out += by_room[r]
            left += [r] * len(by_room[r])
        return Packing(out, left, capacity)

    def cross(self, mother: Packing, father: Packing, rng: random.Random) -> Packing:
        chosen = [i for i in range(max(1, len(father.bins) // 2)) if rng.random() < 0.5]
        bins, rooms = [father.bins[i] for i in chosen], [father.rooms[i] for i in chosen]
        taken = {p for b in bins for p in b}
        displaced: list[int] = []
        for b, r in zip(mother.bins, mother.rooms, strict=True):
            if taken.isdisjoint(b):
                bins.append(b)
                rooms.append(r)
            else:
                displaced += [p for p in b if p not in taken]
        return self.best_fit(bins, rooms, sorted(displaced, key=self.rank.__getitem__))

    def mutate(self, packing: Packing, rng: random.Random) -> Packing:
        cut = max(0, len(packing.bins) - max(2, len(packing.bins) // 20))
        loose = [p for b in packing.bins[cut:] for p in b]
        rng.shuffle(loose)
        return self.best_fit(packing.bins[:cut], packing.rooms[:cut], loose)

    def evolve(self, population: list[Packing], rng: random.Random, generations: int, size: int) -> list[Packing]:
        while len(population) < size and (not population or len(population[0].bins) > self.least):
            order = self.falling
            if population:
                order = sorted(order, key=lambda p: -self.lengths[p] * rng.uniform(0.9, 1.1))
            population = sorted([*population, self.best_fit([], [], order)], key=_fitness, reverse=True)
        population = sorted(population, key=_fitness, reverse=True)
        for _ in range(generations):
            if len(population[0].bins) <= self.least:
                break
            born = []
            for _ in range(size):
                mother, father = (min(rng.randrange(len(population)), rng.randrange(len(population))) for _ in range(2))
                child = self.cross(population[mother], population[father], rng)
                born.append(self.mutate(child, rng) if rng.random() < 0.3 else child)
            population = sorted([*population, *born], key=_fitness, reverse=True)[:size]
        return population


def _genome(bins: Bins, n: int) -> bytes:
    of = np.empty(n, dtype="<i4")
    for i, b in enumerate(bins):
        of[b] = i
    return of.tobytes()


def _bins(genome: bytes) -> Bins:
    of = np.frombuffer(genome, dtype="<i4")
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)] if len(of) else []


def _epoch(capacity: int, epoch: int):
    def run(key: tuple, items: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        if not len(items):
            return pd.DataFrame({"block": [], "island": [], "bins": [], "genome": []})
        items = items.sort_values("uid")
        block = Block(items["length"].astype(int).tolist(), capacity)
        rng = random.Random(f"{key[0]} {key[1]} {epoch}")
        best = block.evolve([block.packing(_bins(g)) for g in elites["genome"]], rng, GENERATIONS, POPULATION)[0].bins
        return pd.DataFrame({"block": [key[0]], "island": [key[1]], "bins": [len(best)], "genome": [_genome(best, len(items))]})

    return run


def _place(capacity: int):
    def run(key: tuple, items: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("uid").reset_index(drop=True)
        best = elites.sort_values(["bins", "island"]).iloc[0]["genome"] if len(elites) else b""
        items["bin"] = np.frombuffer(best, dtype="<i4").astype("int64")
        items["offset"] = items.groupby("bin")["length"].cumsum() - items["length"]
        items["fill"] = items.groupby("bin")["length"].transform("sum")
        return items[["uid", "length", "block", "bin", "offset", "fill"]]

    return run


def _evolved(items: DataFrame, capacity: int, block: int, epochs: int) -> DataFrame:
    """(uid, length, block, bin, offset, fill) of items (uid, length)."""
    blocks = max(1, math.ceil(items.count() / block))
    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"))
    everywhere = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    spark = items.sparkSession
    shape = "block long, island int, bins int, genome binary"
    elites = spark.createDataFrame([], shape)
    for epoch in range(epochs):
        # own elite and that of the island before
        moved = elites.withColumn("island", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))))
        elites = table(everywhere.groupBy("block", "island").cogroup(moved.groupBy("block", "island")).applyInPandas(_epoch(capacity, epoch), shape), "elites")
    return dealt.groupBy("block").cogroup(elites.groupBy("block")).applyInPandas(_place(capacity), "uid long, length long, block long, bin long, offset long, fill long")


def pack(pieces: DataFrame, capacity: int = 1024, block: int = BLOCK, epochs: int = EPOCHS) -> DataFrame:
    """The pieces (with a column length, at most the capacity) with sequence_id and offset, which replace columns of these names."""
    named = table(packed(pieces, col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("uid")), "pieces")
    full = named.where(F.col("length") >= capacity).select("uid", (F.col("uid") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = table(_evolved(named.where(F.col("length") < capacity).select("uid", "length"), capacity, block, epochs), "packed")
    number = lambda kind: ((F.col("block") * (1 << 20) + F.col("bin")) * 4 + kind).alias("sequence_id")
    # The worst bins of each block, about one in a hundred: together they pack better than alone.
    loose = first.where(F.col("fill") < capacity * 0.97)
    again = _evolved(loose.select("uid", "length"), capacity, block, epochs)
    placed = full.unionByName(first.where(F.col("fill") >= capacity * 0.97).select("uid", number(1), "offset")).unionByName(again.select("uid", number(2), "offset"))
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    return named.join(placed, "uid").select(*unpacked(kept), "sequence_id", "offset")


def assemble(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that have their ids: the sequences themselves; each is bounded by the capacity."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))
