"""Exact Jaccard self-join of documents on word n-grams by T-occurrence search with DivideSkip (operator 4).

A document is the set of its n-grams of k words (all its words, if these are fewer). Two sets x, y link when
100 * |x and y| >= percent * |x or y|, so they share at least T(x) = ceil(percent * |x| / 100) n-grams. The steps:

1. Equal sets are one class, told by count and BLAKE2 over the words of their n-grams; its least key stands for it.
2. Each set lists its least p = |x| - T(x) + g(|x|) hashes. A partner's list must share r(x) = g(T(x)) or more of them. The lists are shuffled once,
   by hash; a count there finds the hashes that two sets list, and the sets with fewer than r(x) such hashes drop out.
3. The rest list all their hashes. A set must share T(x) of them with others that are left, which chance and common lines seldom give, however
   large the input. It then skips its T(x) - 1 longest lists; a link's two sets still meet in one of the others. Sets that meet, with the
   least key in each list as the hub, form blocks: no link leaves a block.
4. In a block all sets are compared with its pivot. Those linked to it are in one component and need not be compared with each
   other. By the triangle inequality of the Jaccard distance, of these only the ones in reach of an unlinked set are
   looked at again.
5. The unlinked ones search: each query merges its short inverted lists, probes
   the long ones by binary search for what the merge left, and keeps the sets that reach the required overlap.
   A task gives the edges of a forest, not all pairs, and sets of the tree that holds the linked ones don't search: of a link between two trees one side does.
   A block of at most one chunk takes steps 4 and 5 in one task, to which its sets are shuffled once. In larger blocks the pivot is joined to the sets,
   and chunks of them meet in pairs of bounded size.
6. Components over the edges are found by alternating star steps.

N-grams are told apart by 64 bits of a hash of all their words, seeded anew in each run.

Defined results: null and wordless texts have no n-grams and no links (component: own key); null keys have no component; rows
that share a key are one node, linked by any of its texts; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, chunks, col, components, fresh_seed, grams, lower_ascii, run_hashes, signed, small, small_by, table

#: Sets in a chunk of a block; share of a set, in percent, by which the lists of step 2 are longer than they must.
CHUNK, MARGIN = 500, 15
#: Sets in a list up to which it is merged, not probed.
SHORT = 64


def _need(n, percent: int):
    """The least overlap of a set of n with a partner."""
    return -(-percent * n // 100)


def _margin(n):
    return n * MARGIN // 100 + 1


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int, seed: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    for own, _, _ in _placed_sets(Words(lower_ascii(data), bounds), k, seed):
        yield own


def _placed_sets(words: Words, k: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of each text the sorted distinct n-gram hashes, a place where each stands, and how many words it has."""
    h = words.hashes(seed)
    at, g = grams(h, words.doc, k)
    cut = np.searchsorted(at, words.first)
    short: dict[int, np.uint64] = {}
    for n in range(1, k):
        docs = np.flatnonzero(words.n == n)
        if len(docs):
            short |= dict(zip(docs.tolist(), run_hashes(h, n)[words.first[docs]], strict=True))
    for i in range(len(words.n)):
        own = g[cut[i] : cut[i + 1]]
        if len(own):
            order = np.argsort(own, kind="stable")
            own = own[order]
            new = np.r_[True, own[1:] != own[:-1]]
            yield own[new], at[cut[i] : cut[i + 1]][order[new]], k
        elif i in short:
            yield np.array([short[i]], dtype=np.uint64), words.first[i : i + 1], int(words.n[i])
        else:
            yield own, at[:0], k


def _signatures(k: int, seed: int):
    """The count of n-grams, and BLAKE2 over their words in the order of their hashes: equal for equal sets only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds, _ in chunks(batch, "__text"):
                words = Words(lower_ascii(data), bounds)
                plain = words.data.tobytes()
                joined = b" ".join([plain[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)])
                ends = np.append(0, np.cumsum(words.end - words.start + 1))
                n, marks = [], []
                for own, at, size in _placed_sets(words, k, seed):
                    n.append(len(own))
                    marks.append(hashlib.blake2b(b"\n".join([joined[a:b] for a, b in zip(ends[at].tolist(), (ends[at + size] - 1).tolist(), strict=True)]), digest_size=16).digest())
                yield pa.RecordBatch.from_arrays([rows.column("__key"), pa.array(n, pa.int64()), pa.array(marks, pa.binary())], names=["key", "n", "mark"])

    return run


def _listed(k: int, seed: int, most: Callable[[np.ndarray], np.ndarray]):
    """Of each set its least hashes; most gives how many, by the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds, _ in chunks(batch, "__text"):
                sets = list(shingle_sets(data, bounds, k, seed))
                n = np.array([len(s) for s in sets], dtype=np.int64)
                p = most(n)
                tokens = np.concatenate([s[:q] for s, q in zip(sets, p.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(signed(tokens)), pa.array(np.repeat(rows.column("__key").to_numpy(), p)), pa.array(np.repeat(n, p), pa.int32())], names=["t", "key", "n"])

    return run


def _lists(k: int, percent: int, seed: int):
    return _listed(k, seed, lambda n: np.minimum(n, n - _need(n, percent) + _margin(n)))


def _shared_lists(lists: DataFrame) -> DataFrame:
    """The listed hashes that another key lists too, with the length of their lists."""
    same = Window.partitionBy("t")
    return lists.select("t", "key", "n", F.min("key").over(same).alias("a"), F.max("key").over(same).alias("b"), F.count("*").over(same).alias("df")).where("a < b")


def _sets(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds, _ in chunks(batch, "__text"):
                sets = [s.tobytes() for s in shingle_sets(data, bounds, k, seed)]
                yield pa.RecordBatch.from_arrays([rows.column("__key"), rows.column("block"), pa.array(sets, pa.binary())], names=["key", "block", "tokens"])

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """The overlap of two sorted sets."""
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The overlap of each set with its pivot."""
    for batch in batches:
        shared = [_shared(np.frombuffer(own.as_buffer(), dtype=np.uint64), np.frombuffer(pivot.as_buffer(), dtype=np.uint64)) for own, pivot in zip(batch.column("tokens"), batch.column("pivot"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), batch.column("tokens"), pa.array(np.array(shared, dtype=np.int64)), pa.array(np.array([len(x.as_buffer()) // 8 for x in batch.column("pivot")], dtype=np.int64))], names=["key", "block", "tokens", "shared", "pivot_n"])


def divide_skip(query: np.ndarray, vocabulary: np.ndarray, starts: np.ndarray, postings: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sets hold at least need of the query's tokens, and how many.

    vocabulary: sorted tokens; postings[starts[i]:starts[i + 1]]: the sorted numbers of the sets that hold token i.
    """
    at = np.searchsorted(vocabulary, query)
    at[at == len(vocabulary)] = 0
    at = at[vocabulary[at] == query] if len(vocabulary) else at[:0]
    if len(at) < need:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    length = starts[at + 1] - starts[at]
    order = np.argsort(length, kind="stable")
    at, length = at[order], length[order]
    # The longest lists are probed. As many as the threshold leaves, less where the lists are short anyway; a short list costs less to merge.
    long = min(need - 1, int(need / (0.0085 * np.log2(max(2, int(length[-1]))) + 1)), int(np.count_nonzero(length > SHORT)))
    short, far = at[: len(at) - long], at[len(at) - long :]
    length = length[: len(short)]
    ends = np.cumsum(length)
    count = np.bincount(postings[np.repeat(starts[short] - ends + length, length) + np.arange(ends[-1])])
    ids = np.flatnonzero(count >= need - long)
    count = count[ids]
    for left, i in zip(range(long, 0, -1), far.tolist(), strict=True):
        keep = count + left >= need
        ids, count = ids[keep], count[keep]
        if not len(ids):
            break
        own = postings[starts[i] : starts[i + 1]]
        place = np.searchsorted(own, ids)
        place[place == len(own)] = 0
        count = count + (own[place] == ids)
    keep = count >= need
    return ids[keep], count[keep]


def _links(keys: np.ndarray, outer: np.ndarray, far: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Links between outer sets and others as the edges of a forest. The inner ones are linked by the pivot."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    numbers = np.repeat(np.arange(len(sets)), n)
    tokens = np.concatenate(sets)
    sort = np.argsort(tokens, kind="stable")
    tokens, postings = tokens[sort], numbers[sort]
    first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    vocabulary, starts = tokens[first], np.append(first, len(tokens))
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    inner = [i for i in range(len(sets)) if not outer[i]]
    for i in inner[1:]:
        root[find(i)] = find(inner[0])
    trunk = inner[0] if inner else 0
    out: tuple[list, list] = ([], [])
    for i in np.flatnonzero(outer).tolist():
        # Of two sets that link, one searches, or both are of the trunk's tree already.
        if find(i) == find(trunk):
            continue
        ids, shared = divide_skip(sets[i], vocabulary, starts, postings, int(_need(n[i], percent)))
        good = (100 * shared >= percent * (n[i] + n[ids] - shared)) & (ids != i) & (np.abs(far[ids] - far[i]) <= 1 - percent / 100 + 1e-9)
        for j in ids[good].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                out[0].append(int(keys[i]))
                out[1].append(int(keys[j]))
    return out


def _edges(a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _search(percent: int):
    """The links of two chunks of a large block."""

    def run(part: pa.Table) -> pa.Table:
        part = part.take(pa.array(np.argsort(part.column("key").to_numpy(), kind="stable")))
        keys, outer, far = (part.column(c).to_numpy() for c in ("key", "outer", "far"))
        return _edges(*_links(keys, outer, far, [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in part.column("tokens")], percent))

    return run


def _block(percent: int):
    """The links of a block that is one task: of all with the pivot, then of the unlinked ones with those in their reach."""

    def run(part: pa.Table) -> pa.Table:
        part = part.take(pa.array(np.argsort(part.column("key").to_numpy(), kind="stable")))
        keys, block = part.column("key").to_numpy(), part.column("block").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in part.column("tokens")]
        n = np.array([len(s) for s in sets], dtype=np.int64)
        pivot = sets[0]  # the block is named by its least key
        shared = np.array([_shared(s, pivot) for s in sets], dtype=np.int64)
        union = n + len(pivot) - shared
        outer, far = 100 * shared < percent * union, 1 - shared / np.maximum(union, 1)
        direct = np.flatnonzero(~outer & (keys != block))
        out = keys[direct].tolist(), block[direct].tolist()
        if outer.any():
            taken = np.flatnonzero(outer | (far >= far[outer].min() - (1 - percent / 100) - 1e-9))
            found = _links(keys[taken], outer[taken], far[taken], [sets[i] for i in taken.tolist()], percent)
            out = out[0] + found[0], out[1] + found[1]
        return _edges(*out)

    return run


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(key, n_shingles, class_id, component_id) of every row. class_id: the least key with an equal set."""
    rows = docs.select(col(key).cast("long").alias("__key"), F.coalesce(col(text), F.lit("")).alias("__text"))
    seed = fresh_seed()
    # 1. classes of equal sets
    marks = table(rows.mapInArrow(_signatures(k, seed), "key long, n long, mark binary"), "sets")
    several = table(marks.where("n > 0 and key is not null").groupBy("n", "mark").agg(F.min("key").alias("cls"), F.count("*").alias("c")).where("c > 1").drop("c"), "several")
    classes = table(marks.join(small(several, 64), ["n", "mark"], "left").select("key", "n", F.coalesce("cls", "key").alias("cls")), "classes")
    mixed = classes.groupBy("key").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.min("n").alias("m"), F.max("n").alias("o")).where("a <> b or m <> o").select("key")
    copies = table(classes.where("key > cls").select("key").distinct().join(mixed, "key", "left_anti"), "copies")
    single = rows.where("__key is not null").join(small(copies, 32).withColumnRenamed("key", "__key"), "__key", "left_anti")

    # 2. lists, and the sets that share enough of theirs
    lists = single.mapInArrow(_lists(k, percent, seed), "t long, key long, n int")
    need = f"(({percent} * n + 99) div 100)"
    least = f"least({need} * {MARGIN} div 100 + 1, {need})"
    met = table(_shared_lists(lists).groupBy("key", "n").count().where(f"count >= {least}").select("key").distinct(), "met")

    # 3. all hashes of those, and blocks
    whole = single.join(small(met, 32).withColumnRenamed("key", "__key"), "__key").mapInArrow(_listed(k, seed, lambda n: n), "t long, key long, n int")
    kept = _shared_lists(whole).groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("lists")).where(f"size(lists) >= {need}")
    meets = table(kept.selectExpr("key", f"explode(transform(slice(lists, 1, cast(size(lists) - {need} + 1 as int)), x -> x.t)) as t"), "meets")
    hubs = meets.select(F.col("key").alias("a"), F.min("key").over(Window.partitionBy("t")).alias("b")).where("a > b")
    blocks = table(components(hubs), "blocks").select(F.col("id").alias("__key"), F.col("component").alias("block"))
    # Empty sets, of a key with other texts too, link with nothing
    sets = table(rows.join(small(blocks, 40), "__key").mapInArrow(_sets(k, seed), "key long, block long, tokens binary").where("octet_length(tokens) > 0"), "tokens")
    large = table(sets.groupBy("block").count().where(F.col("count") > chunk).select("block"), "large")
    near = sets.join(small(large, 32), "block", "left_anti").groupBy("block").applyInArrow(_block(percent), "a long, b long")

    # 4. all of a large block against the pivot
    sets = sets.join(small(large, 32), "block", "left_semi")
    pivots = table(sets.where("key = block").select("block", F.col("tokens").alias("pivot")), "pivots")
    measured = table(sets.join(small_by(pivots, F.octet_length("pivot") + 40), "block").mapInArrow(_overlaps, "key long, block long, tokens binary, shared long, pivot_n long").withColumn("n", F.expr("octet_length(tokens) div 8")).selectExpr("key", "block", "tokens", f"not (100 * shared >= {percent} * (n + pivot_n - shared)) as outer", "1 - shared / (n + pivot_n - shared) as far"), "measured")
    direct = measured.where("not outer and key <> block").select(F.col("key").alias("a"), F.col("block").alias("b"))

    # 5. the others search
    # reach and parts have a row for each block that searches. As tables they are broadcast, or joined so that Spark can split a large block.
    reach = table(measured.where("outer").groupBy("block").agg(F.min("far").alias("nearest")), "reach")
    taking = measured.join(small(reach, 40), "block").where(f"outer or far >= nearest - (1 - {percent} / 100) - 1e-9").drop("nearest")
    parts = table(taking.groupBy("block").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts")), "parts")
    dealt = taking.join(small(parts, 40), "block").withColumn("side", F.pmod(F.hash("key"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "key", "outer", "far", "tokens")
    # Dealt by the pair of chunks; else the joins' partitioning by block would keep a block's pairs in one task.
    found = dealt.repartition("block", "i", "j").groupBy("block", "i", "j").applyInArrow(_search(percent), "a long, b long")

    # 6. components
    own = classes.join(mixed, "key").where("key <> cls").select(F.col("key").alias("a"), F.col("cls").alias("b"))
    linked = components(near.unionByName(direct).unionByName(found).unionByName(own))
    return classes.join(linked.select(F.col("id").alias("cls"), "component"), "cls", "left").select("key", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), F.coalesce("component", "cls").alias("component_id"))
