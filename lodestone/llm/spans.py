"""Repeated spans and their removal by a compacted de Bruijn graph (operator 3).

Edges are runs of k words (windows), nodes the runs of k - 1 words at their ends. Only edges that stand in two documents matter:

1. Exact copies of a text are told by its digest. They are wholly repeated and stay out of the graph.
2. Each window has a minimizer, the least hash of m words in it; equal windows have equal minimizers. Minimizers that stand in
   one document only rule out their windows, about one row for each five words. This is exact: it never loses an edge.
3. The other windows become edges, told apart by the nodes at their two ends, 128 bits of hash. One aggregation (pre-aggregated in each task, so common edges cost little)
   gives each edge its source, the document with the least key that has it; the source's coordinates (row and place) stay with the edge.
4. A node with one edge in and one edge out is nonbranching. A join takes these nodes to the edges, and neighbouring edges of a source with such a
   node between them are compacted to a path: a window over the source's places, so no group is larger than a document.
5. A join takes the paths to the documents. Neighbouring places that walk along a path, or from one path of a source on to its next, are a span: words
   of the document, and the place where its source has them. Spans overlap by k - 1 words where a document goes on from one source to another, so of these
   as few are kept as cover the same words: in a group of near copies, where the source changes every few words, about one for each k words.
6. Each distinct stretch of a source that a span names is read there once and digested (BLAKE2, 64 bits, beside the 128 of each edge). ``remove_spans`` takes a span out only if the
   document's own words have that digest.

``repeated_spans`` gives the spans; ``remove_spans`` takes the covered words out.

Texts are shuffled once, into a table bucketed by key and text. Each later join with them (copies, ranges, stretches, cuts) ships the other side
to the buckets and leaves the texts where they are, whatever the size of either. A text that one key has so often that it would outgrow
a bucket is dealt over several (``HOT_BYTES``).

Defined results: null texts have no words; rows with a null key stay out and stay whole; rows that are equal in key and text
get equal results; rows that share a key but differ in text (told apart by 64 bits of hash) are each cut by what smaller keys have, not by each other; texts
with fewer than k words have no windows; other columns pass through ``remove_spans`` untouched, whatever their names (the names of the two added ones are the caller's to choose).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, chunks, col, fresh_seed, grams, mix, run_hashes, scratch, signed, small, small_by, table, unpacked, with_row

#: Words in a minimizer at least, and the part of a window it takes: longer ones repeat less by chance, and rule out more windows.
MINIMIZER, MINIMIZER_PART = 5, 4
#: A place in a document and the document's number, in one integer: bits of the place, and the largest place.
_BITS = 27
_PLACE = (1 << _BITS) - 1
_OTHER = np.uint64(0xA5A5A5A55A5A5A5A)
#: Bytes of rows equal in key and text from which on they are dealt over several buckets, so many bytes to each.
HOT_BYTES = 64 << 20
#: Parts of the rows without a key or text, which meet no other table.
_EMPTY_PARTS = 1024
_PLACED = ["__key", "__row", "__part"]


class Bucketed:
    """docs as a table bucketed by key, text and part: the other columns as ``others``, and ``text``, ``digest``, ``__key``, ``__row``, ``__part``."""

    def __init__(self, docs: DataFrame, key: str, text: str):
        spark = docs.sparkSession
        rows = docs.select(
            F.struct(*(col(c) for c in docs.columns if c != text)).alias("others"),
            col(text).alias("text"),
            F.unhex(F.md5(F.encode(col(text), "utf-8"))).alias("digest"),
            col(key).cast("long").alias("__key"),
            F.xxhash64(col(text)).alias("__row"),
        )
        there = F.col("__key").isNotNull() & F.col("text").isNotNull()
        size = rows.where(there).groupBy("__key", "__row").agg(F.sum(F.octet_length("text") + F.lit(64).cast("long")).alias("size"))
        self.hot = table(size.where(F.col("size") > HOT_BYTES).select("__key", "__row", F.ceil(F.col("size") / HOT_BYTES).alias("parts")), "hot")
        deal = F.monotonically_increasing_id()
        part = F.when(there, deal % F.coalesce("parts", F.lit(1))).otherwise(deal % _EMPTY_PARTS).cast("int")
        rows = rows.join(small(self.hot, 48), ["__key", "__row"], "left").select("others", "text", "digest", "__key", "__row", part.alias("__part"))
        n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"texts_{uuid.uuid4().hex}"
        writer = rows.repartition(n, *_PLACED).write.format("parquet").option("path", scratch(spark, "texts")).option("compression", "zstd")
        writer.bucketBy(n, *_PLACED).sortBy(*_PLACED).saveAsTable(name)
        self.rows = spark.table(name)

    def join(self, side: DataFrame, how: str, size: Column | int) -> DataFrame:
        """The rows with a side that has __key and __row, shuffled to the buckets or, if its bytes are few, broadcast. size: bytes of a row of the side."""
        return self.beside(self.rows, side, how, size)

    def beside(self, rows: DataFrame, side: DataFrame, how: str, size: Column | int) -> DataFrame:
        """join() for rows that a join with another side gave."""
        dealt = side.join(small(self.hot, 48), ["__key", "__row"], "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)).cast("int") - 1))).drop("parts")
        hint = small(side, size) if isinstance(size, int) else small_by(side, size)
        return rows.join(F.broadcast(dealt) if hint is not side else dealt, _PLACED, how)


def _once(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.RecordBatch]:
    """The batches without rows that have the same values as the row before: of equal rows side by side in a bucket one stays."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        values = np.column_stack([batch.column(n).to_numpy() for n in names])
        new = np.r_[last is None or bool((values[0] != last).any()), (values[1:] != values[:-1]).any(axis=1)]
        last = values[-1].copy()
        if not new.all():
            batch = batch.filter(pa.array(new))
        if len(batch):
            yield batch


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, size = x, 1
    while size < width:
        step = min(size, width - size)
        out = np.minimum(out[: len(out) - step], out[step:])
        size += step
    return out


def _minimizers(k: int, m: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _once(batches, "__key", "__row"):
            for rows, data, bounds, _ in chunks(batch):
                words = Words(data, bounds)
                h, n = words.hashes(seed), len(words.start)
                if n < k:
                    continue
                windows = np.flatnonzero(words.doc[: n - k + 1] == words.doc[k - 1 :])
                short = np.full(n - m + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
                at, g = grams(h, words.doc, m)
                short[at] = g
                least = _sliding_min(short, k - m + 1)[windows]
                doc = words.doc[windows]
                new = np.ones(len(windows), dtype=bool)
                new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                keys, row = (rows.column(c).to_numpy()[doc[first]] for c in ("__key", "__row"))
                place = (windows - words.first[doc])[first]
                yield pa.RecordBatch.from_arrays([pa.array(signed(least[first])), pa.array(keys), pa.array(row), pa.array(place, pa.int32()), pa.array(np.diff(np.append(first, len(windows))), pa.int32())], names=["h", "key", "row", "at", "n"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges [from, to) of a row's windows, sorted and joined, as one flat list."""
    for batch in batches:
        out = []
        for row in batch.column("r"):
            start, n = (row.values.field(i).to_numpy().astype(np.int64) for i in range(2))
            at = np.column_stack([start, start + n])[np.argsort(start, kind="stable")]
            top = np.maximum.accumulate(at[:, 1])
            new = np.r_[True, at[1:, 0] > top[:-1]]
            start = at[new, 0]
            end = np.r_[top[np.flatnonzero(new)[1:] - 1], top[-1]]
            out.append(np.column_stack([start, end]).ravel().tolist())
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("row"), pa.array(out, pa.list_(pa.int32()))], names=["key", "row", "ranges"])


def _edges(k: int, seed: int):
    """Edges by the nodes at their ends, which share all words but the first and the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _once(batches, "number"):
            for rows, data, bounds, _ in chunks(batch):
                words = Words(data, bounds)
                h, n = words.hashes(seed), len(words.start)
                if n < k:
                    continue
                if words.n.max() > _PLACE:
                    raise ValueError(f"a text has more than {_PLACE} words")
                ranges = rows.column("ranges")
                flat = ranges.flatten().to_numpy()
                doc = np.repeat(np.arange(len(rows)), np.diff(ranges.offsets.to_numpy()))[::2]
                step = np.zeros(n + 1, dtype=np.int64)
                np.add.at(step, words.first[doc] + flat[::2], 1)
                np.add.at(step, words.first[doc] + flat[1::2], -1)
                at = np.flatnonzero(np.cumsum(step)[: n - k + 1] > 0)
                at = at[words.doc[at] == words.doc[at + k - 1]]
                if k > 1:
                    nodes = run_hashes(h, k - 1)
                    before, behind = nodes[at], nodes[at + 1]
                else:  # all nodes are the empty run; as no two of these are equal, none counts as nonbranching
                    before, behind = run_hashes(h, 1)[at], run_hashes(mix(h ^ _OTHER), 1)[at]
                doc = words.doc[at]
                pos = (rows.column("number").to_numpy()[doc] << _BITS) | (at - words.first[doc])
                yield pa.RecordBatch.from_arrays([pa.array(signed(before)), pa.array(signed(behind)), pa.array(pos)], names=["before", "behind", "pos"])

    return run


def _walks(k: int):
    """Neighbouring places that are neighbours in one source too become a span, along one path or from path to path. A step is (path, place here and place in the source in one integer).

    A row is cut by smaller keys only: by sources before lowest, the first number of its own key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            taken = []
            for lowest, steps in zip(batch.column("lowest").to_pylist(), batch.column("steps"), strict=True):
                path, places = (x.to_numpy() for x in steps.values.flatten())
                order = np.argsort(places, kind="stable")
                path, at, source_at = path[order], places[order] >> 32, places[order] & 0xFFFFFFFF
                keep = np.r_[True, at[1:] != at[:-1]]  # rows equal in key and text bring each place twice
                path, at, source_at = path[keep], at[keep], source_at[keep]
                source = path >> _BITS
                first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (source_at[1:] != source_at[:-1] + 1) | (source[1:] != source[:-1])])
                n = np.diff(np.append(first, len(at))) + k - 1
                smaller = source[first] < lowest
                first, n = first[smaller], n[smaller]
                cover = _cover(at[first], at[first] + n)
                first, n = first[cover], n[cover]
                taken.append(len(first))
                for column, x in zip(out, (at[first], n, source[first], source_at[first]), strict=True):
                    column.append(x)
            own = pa.array(np.repeat(np.arange(len(batch)), taken))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32())
            spans = [pa.array(np.concatenate([np.empty(0, dtype=np.int64), *x]), t) for x, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(own), batch.column("row").take(own), *spans], names=["key", "row", "start", "n_words", "from", "source_at"])

    return run


def _cover(start: np.ndarray, end: np.ndarray) -> list[int]:
    """The numbers of as few stretches [start, end) as cover what all of them do. Both starts and ends ascend."""
    further = np.maximum(np.searchsorted(start, end, side="right") - 1, np.arange(1, len(start) + 1)).tolist()
    at, out = 0, []
    while at < len(further):
        out.append(at)
        at = further[at]
    return out


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=8).digest()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of stretches of sources."""
    for batch in _once(batches, "number"):
        for i in range(len(batch)):
            words = batch.column("text")[i].as_buffer().to_pybytes().split()
            at, n = (x.to_numpy() for x in batch.column("stretches")[i].values.flatten())
            digests = [_digest(words[a : a + m]) for a, m in zip(at.tolist(), n.tolist(), strict=True)]
            number, key, row = (pa.array(np.full(len(at), batch.column(c)[i].as_py())) for c in ("number", "__key", "__row"))
            yield pa.RecordBatch.from_arrays([number, pa.array(at), pa.array(n), pa.array(digests, pa.binary()), key, row], names=["from", "source_at", "n_words", "digest", "source", "source_row"])


class Repeats:
    """What repeats in a table: copies (key, row, digest, source) of whole texts, and spans (key, row, start, n_words, source, source_row, source_at, digest).

    row, source_row: hash of the text; digest: of the source's words.
    """

    def __init__(self, copies: DataFrame, spans: DataFrame, k: int, of: tuple[DataFrame, str, str] | None = None, texts: Bucketed | None = None):
        self.copies, self.spans, self.k = copies, spans, k
        self.of, self.texts = of, texts  # the table, key and text they were found in, and its buckets


def repeated_spans(docs: DataFrame, k: int = 13, key: str = "doc_id", text: str = "text") -> Repeats:
    """Spans of k words and more that start in a document with a smaller key too; of overlapping ones as few as cover their words."""
    m, seed = min(max(MINIMIZER, k // MINIMIZER_PART), k), fresh_seed()
    texts = Bucketed(docs, key, text)

    digests = texts.rows.where("__key is not null and text is not null").select(F.col("__key").alias("key"), F.col("__row").alias("row"), "digest")
    several = table(digests.groupBy("digest").agg(F.min("key").alias("source"), F.max("key").alias("last")).where("source < last").drop("last"), "several")
    copies = table(digests.join(small(several, 64), "digest").where("key > source").select("key", "row", "digest", "source").distinct(), "copies")

    whole = table(copies.select(F.col("key").alias("__key"), F.col("row").alias("__row")).distinct(), "whole")
    single = texts.join(whole, "left_anti", 48).where("__key is not null and text is not null").select("__key", "__row", "text")

    places = single.mapInArrow(_minimizers(k, m, seed), "h long, key long, row long, at int, n int")
    repeated = places.select("h", "key").groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("h")
    found = places.join(repeated, "h", "left_semi").groupBy("key", "row").agg(F.collect_list(F.struct("at", "n")).alias("r"))
    ranges = _numbered(found.mapInArrow(_merged, "key long, row long, ranges array<int>"))
    known_as = ranges.select(F.col("key").alias("__key"), F.col("row").alias("__row"), "number")

    # Copies have no ranges, so they need not be taken out again
    wanted = ranges.withColumnsRenamed({"key": "__key", "row": "__row"})
    edges = texts.join(wanted, "inner", F.size("ranges") * 4 + 56).select("number", "text", "ranges").mapInArrow(_edges(k, seed), "before long, behind long, pos long")
    number = lambda x: F.shiftright(x, _BITS)
    known = edges.groupBy("before", "behind").agg(F.min("pos").alias("source"), F.max("pos").alias("last")).where(number("source") < number("last")).drop("last")

    # The graph: a row for each edge, at its source
    graph = table(known, "edges")
    one = lambda end: graph.groupBy(F.col(end).alias("node")).count().where("count = 1").select("node")
    plain = table(one("before").join(one("behind"), "node").select(F.col("node").alias("before"), F.lit(True).alias("plain")), "nonbranching")
    along = Window.partitionBy(number("source")).orderBy("source")
    linked = graph.join(small(plain, 32), "before", "left")
    begins = F.when(F.col("plain") & (F.lag("source").over(along) == F.col("source") - 1), F.lit(None)).otherwise(F.col("source"))
    paths = linked.withColumn("begins", begins).withColumn("path", F.last("begins", True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    paths = table(paths.select("before", "behind", "source", "path"), "paths")

    # Walks along the paths. As a table the small side is broadcast, or the join is a plain shuffled one whose common edges Spark can split.
    later = edges.join(small(paths, 64), ["before", "behind"]).where(number("pos") > number("source"))
    places = F.shiftleft(F.col("pos").bitwiseAND(_PLACE), 32).bitwiseOR(F.col("source").bitwiseAND(_PLACE))
    steps = later.groupBy(number("pos").alias("number")).agg(F.collect_list(F.struct("path", places.alias("places"))).alias("steps"))
    firsts = table(ranges.groupBy("key").agg(F.min("number").alias("lowest")), "firsts")
    own = table(ranges.select("number", "key", "row").join(small(firsts, 40), "key"), "own")
    walks = table(steps.join(small(own, 56), "number").mapInArrow(_walks(k), "key long, row long, start int, n_words int, from long, source_at int"), "walks")

    # What their sources have there
    asked = walks.groupBy(F.col("from").alias("number")).agg(F.collect_set(F.struct("source_at", "n_words")).alias("stretches"))
    asked = table(asked.join(small(known_as, 48), "number"), "stretches")
    digests = texts.join(asked, "inner", F.size("stretches") * 24 + 64).select("number", "__key", "__row", "text", "stretches").mapInArrow(_read, "from long, source_at int, n_words int, digest binary, source long, source_row long")
    digests = table(digests.dropDuplicates(["from", "source_at", "n_words"]), "digests")
    found = walks.join(small(digests, 112), ["from", "source_at", "n_words"]).drop("from")
    return Repeats(copies, table(found, "spans"), k, (docs, key, text), texts)


def _numbered(ranges: DataFrame) -> DataFrame:
    """Rows numbered from 0 by key and row, in the order of a range partitioning: a place in its part, and the counts of the parts before."""
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = table(ranges.repartitionByRange("key", "row").sortWithinPartitions("key", "row").select("*", F.spark_partition_id().alias("part"), inside.alias("inside")), "ranges")
    parts = rows.groupBy("part").count()  # a row for each part
    before = parts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    return table(rows.join(F.broadcast(before), "part").select("key", "row", "ranges", (F.col("before") + F.col("inside")).alias("number")), "numbered")


def remove_spans(docs: DataFrame, repeats: Repeats, key: str = "doc_id", text: str = "text", joined: bool = False, added: tuple[str, str] = ("__n_words", "__n_removed")) -> DataFrame:
    """docs without the words in the spans, and two longs of the added names: a text's words, and how many of them are removed.

    joined: the kept words with one space between them. Else the rest of the text keeps its white space: a removed run goes with the white space
    behind it, and texts of which nothing is removed stay as they are.
    """
    k = repeats.k
    cuts = repeats.spans.groupBy(F.col("key").alias("__key"), F.col("row").alias("__row")).agg(F.collect_list(F.struct("start", "n_words", "digest")).alias("cuts"))
    cuts = table(cuts.mapInArrow(_dense, "__key long, __row long, cuts binary"), "cuts")
    copied = table(repeats.copies.select(F.col("key").alias("__key"), F.col("row").alias("__row")).distinct().withColumn("copy", F.lit(True)), "copied")

    texts = repeats.texts if repeats.of == (docs, key, text) else Bucketed(docs, key, text)
    out = texts.join(cuts, "left", F.octet_length("cuts") + 40)
    out = texts.beside(out, copied, "left", 48).select(F.col("others").alias("row"), "text", "cuts", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds, valid in chunks(batch):
                raw, kept, n_words, n_removed = data.tobytes(), [], [], []
                for a, b, cuts, copy, there in zip(bounds[:-1].tolist(), bounds[1:].tolist(), rows.column("cuts"), rows.column("copy").to_pylist(), valid.tolist(), strict=True):
                    value = raw[a:b]
                    words = value.split()
                    n = len(words)
                    cut = [0, n] if copy and n >= k else _cut(words, cuts.as_py()) if cuts.is_valid else None
                    gone = sum(cut[1::2]) - sum(cut[::2]) if cut else 0
                    if joined:
                        value = b" ".join(words) if not gone else b" ".join([w for x, y in zip([0, *cut[1::2]], [*cut[::2], n], strict=True) for w in words[x:y]])
                    elif gone:
                        value = _without(value, cut)
                    n_words.append(n)
                    n_removed.append(gone)
                    kept.append(value if there or joined else None)
                yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["row", "kept", "n_words", "n_removed"])

    done = out.mapInArrow(run, with_row(out, "kept string, n_words long, n_removed long"))
    return done.select(*unpacked(docs.columns, **{text: F.col("kept")}), F.col("n_words").alias(added[0]), F.col("n_removed").alias(added[1]))


#: A span in a row's cuts.
_SPAN = np.dtype([("start", "<i4"), ("n_words", "<i4"), ("digest", "V8")])


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of each row as bytes, by their start."""
    for batch in batches:
        out = []
        for spans in batch.column("cuts"):
            start, n_words, digest = spans.values.flatten()
            dense = np.empty(len(start), dtype=_SPAN)
            dense["start"], dense["n_words"] = start.to_numpy(), n_words.to_numpy()
            dense["digest"] = np.frombuffer(b"".join(digest.to_pylist()), dtype="V8")
            out.append(dense[np.argsort(dense["start"], kind="stable")].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("__row"), pa.array(out, pa.binary())], names=["__key", "__row", "cuts"])


def _cut(words: list[bytes], spans: bytes) -> list[int]:
    """Begin and end of what the spans cover, joined where they touch. A span counts if its words are those of its source."""
    out: list[int] = []
    for a, n, digest in np.frombuffer(spans, dtype=_SPAN).tolist():
        if _digest(words[a : a + n]) != digest:
            continue
        if out and a <= out[-1]:
            out[-1] = max(out[-1], a + n)
        else:
            out += [a, a + n]
    return out


def _without(value: bytes, cut: list[int]) -> bytes:
    """The text without the words in [cut[0], cut[1]), [cut[2], cut[3]), ... and the white space behind each run."""
    words = Words(np.frombuffer(value, dtype=np.uint8), np.array([0, len(value)]))
    start = [*words.start.tolist(), len(value)]
    at, out = 0, []
    for a, b in zip(cut[::2], cut[1::2], strict=True):
        out.append(value[at : start[a]])
        at = start[b]
    return b"".join([*out, value[at:]])
