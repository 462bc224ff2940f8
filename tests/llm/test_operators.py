"""The operators of lodestone.llm on small hard tables, against brute force."""

import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import audio, classifier, common, near_join, packing, pii, prefix_bpe, queries, rules, sharding, spans, token_files

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, `key` string, `t` string"


def _texts() -> list:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [word() for _ in range(300)]
    near = [" ".join(base[:i] + [word()] + base[i + 1 :]) for i in range(0, 300, 30)]
    passage = " ".join(word() for _ in range(60))
    mixed = [" ".join(word() for _ in range(40)) + " " + passage + "\n" + " ".join(word() for _ in range(30)) for _ in range(6)]
    odd = [None, "", " ", "a", "a b", "Aa  b\t\n c", " x 　 y", "x\x1cy", "Ünï 'sß it's 12 34", "  lead", "trail \n", "w " * 3000, "<|endoftext|> <|startoftext|> z", "é İ Σ"]
    return [*odd, " ".join(base), *near, *mixed, mixed[0], " ".join(base), *["same text here again"] * 5]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables as the queries read them; documents with repeated texts, a null key, and columns whose names clash."""
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "s", None, "k", "t") for i, t in enumerate(_texts())]
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 30, 2)] + [(3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SHAPE).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def _thue_morse(a: str, b: str, order: int) -> tuple[str, str]:
    for _ in range(order):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse(spark):
    """A polynomial modulo a power of two has the same hash for both texts of Thue and Morse, whatever its odd base."""
    for order in (9, 11):
        x, y = _thue_morse("a", "b", order)
        words = " ".join(f"w{i}" for i in range(12))
        docs = spark.createDataFrame([(1, f"{words} {x}"), (2, f"{words} {y}"), (3, f"{words} {x}")], "doc_id long, text string")
        assert {r.doc_id: r["__n_removed"] for r in spans.remove_spans(docs, spans.repeated_spans(docs, k=13)).collect()} == {1: 0, 2: 0, 3: 13}
        alone = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")
        assert {r.key: r.component_id for r in near_join.near_components(alone, 4, 85).collect()} == {1: 1, 2: 2, 3: 1}
    p, q = (" ".join(t) for t in _thue_morse("a", "b", 7))
    docs = spark.createDataFrame([(1, p), (2, q)], "doc_id long, text string")
    assert {r["__n_removed"] for r in spans.remove_spans(docs, spans.repeated_spans(docs, k=128)).collect()} == {0}


def test_hashes_of_words(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab\0") for _ in range(n)) for n in [*range(1, 40), 255, 256, 257, 600] for _ in range(20)})
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    one = common.Words(data, np.array([0, len(data)]))
    assert len(set(one.hashes().tolist())) == len(one.start) == len(words)
    shifted = np.frombuffer(("xy " + " ".join(words)).encode(), dtype=np.uint8)
    assert common.Words(shifted, np.array([0, len(shifted)])).hashes().tolist()[1:] == one.hashes().tolist()
    assert common.Words(data, np.array([0, len(data)])).hashes(2).tolist() != one.hashes().tolist()


CLASHING = ("a.b", "row", "__row", "__key", "__cuts", "__found", "__text", "__score", "__n_words", "n_words", "words", "text_", "quality", "key", "uid", "length", "sequence", "score_", "parts", "fresh", "id")


@pytest.fixture(scope="module")
def clashing(spark, folder):
    """The documents with a null key, a key of two texts, and columns of every name that an operator could add."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(_texts())] + [(None, "x y z w " * 20), (None, None), (3, "other text under a key"), (20, " ".join("mnopq" for _ in range(90)))], "doc_id long, text string")
    for i, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return docs


def _others(df) -> list:
    """Rows by what the operators must not touch."""
    return sorted(tuple(str(r[c]) for c in ("doc_id", *CLASHING)) for r in df.collect())


def test_clashing_names(spark, folder, clashing):
    import corpus_pipeline as p

    same = _others(clashing)
    names = clashing.columns
    cut = spans.remove_spans(clashing, spans.repeated_spans(clashing, k=13), added=("n1", "n2"))
    found = pii.pseudonymize(clashing, "k", added="n1")
    machine = classifier.fit(clashing, spark.read.parquet(f"{folder}/labels.parquet"), F.lit(True))
    scored = classifier.score(clashing, machine, name="n1")
    judged = rules.judged(clashing, rules.order_rules(clashing), added="n1")
    for out in (cut, found, scored, judged):
        assert out.columns[: len(names)] == names and _others(out) == same
    keep = tuple(c for c in names if c != "text")
    assert _others(prefix_bpe.encode(clashing, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=keep)) == same
    rows = sorted(str(r.doc_id) for r in clashing.select("doc_id").collect())
    pieces = packing.cut_documents(clashing, public_tokenizers.path("byte_bpe_50k.json")).withColumn("uid", F.lit("u")).withColumn("a.b", F.lit(1))
    packed = packing.pack(pieces)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"] and sorted({str(r.doc_id) for r in packed.collect()}) == sorted(set(rows))
    assert sorted(str(r.key) for r in near_join.near_components(clashing, 4, 85).collect()) == rows
    files = token_files.write_token_files(clashing, public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(str(r.key) for r in files.read(token_files.all_keys(clashing)).collect()) == rows
    records = clashing.select("*", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), sharding.slot_of("doc_id", "text").alias("vslot"))
    measured = sharding.slot_bytes(records)
    owners = spark.createDataFrame([(i, i % 3) for i in range(sharding.SLOTS)], "slot int, shard int")
    assert _others(sharding.place(records, measured, owners, ["doc_id", "text"])) == same
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, clashing, folder)
        assert out.columns == names, name
        assert set(_others(out)) <= set(same), name
    assert p.STAGES[-1][1](spark, clashing, folder).select("doc_id").distinct().count() == len(set(rows))


def test_texts_over_a_chunk(spark):
    """Texts of more than the bytes that a kernel takes at once, alone and among short ones."""
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(160_000))
    assert len(long) > common.CHUNK_BYTES
    rows = [(1, long), (2, "short one"), (3, long[: len(long) // 2]), (4, "x " + long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = {r.doc_id: (r["__n_words"], r["__n_removed"]) for r in spans.remove_spans(docs, spans.repeated_spans(docs, k=13)).collect()}
    half = len(rows[2][1].split())
    cut = half if long[len(long) // 2] == " " or long[len(long) // 2 - 1] == " " else half - 1
    assert out == {1: (160_000, 0), 2: (2, 0), 3: (half, out[3][1]), 4: (160_001, 160_000)} and out[3][1] in (half, cut)
    assert {r.key: r.component_id for r in near_join.near_components(docs, 4, 85).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    scores = {r.doc_id: r.score for r in classifier.score(docs, classifier.Machine(0.0, np.zeros(classifier.SIZE), np.zeros((classifier.SIZE, 2)))).collect()}
    assert scores == dict.fromkeys(range(1, 5), 0.5)


def test_machine_against_explicit_pairs():
    rng = np.random.default_rng(3)
    machine = classifier.Machine(0.3, rng.normal(size=classifier.SIZE), rng.normal(size=(classifier.SIZE, 4)))
    texts = [b"", b"one two one", b"A bc! 12 |", " é x".encode()]
    data, bounds = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    doc, feature, value = classifier.features(data, bounds)
    for i, z in enumerate(machine.logit(doc, feature, value, len(texts))):
        own = [(f, v) for d, f, v in zip(doc, feature, value, strict=True) if d == i]
        want = machine.bias + sum(machine.weights[f] * v for f, v in own)
        want += sum(machine.factors[f] @ machine.factors[g] * v * w for n, (f, v) in enumerate(own) for g, w in own[:n])
        assert abs(z - want) < 1e-9


def _library(name: str) -> list:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [np.array([*e.ids, 2], dtype="<u4") for e in t.encode_batch([x or "" for x in _texts()], add_special_tokens=False)]


def test_shards(spark, folder):
    rows = queries.op1_virtual_slots(spark, folder).collect()
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    for r in rows:
        text = (_texts()[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text))


def test_shards_have_near_equal_bytes(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "x" * int(rng.paretovariate(1.3) * 20) if i % 3 else "the same text") for i in range(20_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    total: dict = {}
    for r in queries.op1_virtual_slots(spark, str(tmp_path)).collect():
        total[r.shard] = total.get(r.shard, 0) + r["size"]
    largest = max(len(t) for _, t in rows) + 8
    assert sorted(total) == list(range(24)) and max(total.values()) - min(total.values()) <= max(largest, 0.01 * sum(total.values()) / 24)


def test_rebalance(spark, tmp_path):
    measured = spark.createDataFrame([(i, 100 + i, 1) for i in range(64)], "slot int, bytes long, rows long")
    old = {r.slot: r.shard for r in sharding.balance(measured, str(tmp_path), 4, slots=64).collect()}
    new = {r.slot: r.shard for r in sharding.rebalance(measured, str(tmp_path), 0, 5, slots=64).collect()}
    moved = [s for s in old if old[s] != new[s]]
    assert len(moved) < 24 and sum(new[s] == 4 for s in moved) >= len(moved) - 4


def test_token_files(spark, folder):
    got, start = {r.doc_id: r for r in queries.op2_token_files(spark, folder).collect()}, 0
    for i, ids in enumerate(_library("word_bpe_49k.json")):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), _texts()[i]
        start += len(ids)


def test_token_files_repeated_and_foreign_keys(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b c"), (None, "d"), (7, None)], "doc_id long, text string")
    files = token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert files.read(token_files.all_keys(docs)).count() == 4
    assert files.locate(spark.createDataFrame([(5, 0), (1, 2)], "key long, ordinal long")).count() == 0


def test_token_files_few_and_many_keys(spark, monkeypatch):
    """A lookup of few keys reads their buckets and shards alone, and returns what a lookup dealt to all of them does."""
    docs = spark.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("row"), "id", F.lit("of some")).alias("text"))
    monkeypatch.setattr(token_files, "BUCKET_KEYS", 20)
    files = token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), shard_bytes=64)
    asked = spark.createDataFrame([(k, 0) for k in (3, 77, 1000)], "key long, ordinal long")
    few = files.read(asked)
    shards = {r.shard for r in files.locate(asked).collect()}
    read = re.search(r"SelectedBucketsCount: (\d+) out of 4", few._jdf.queryExecution().toString())
    assert len(shards) == 2 and read and int(read.group(1)) <= 2
    got = {r.key: tuple(r) for r in few.collect()}
    monkeypatch.setattr(token_files, "FEW", 0)
    every = {r.key: tuple(r) for r in files.read(token_files.all_keys(docs)).collect()}
    assert sorted(got) == [3, 77] and len(every) == 400
    assert all(every[k] == v for k, v in got.items())
    assert {r.key: tuple(r) for r in files.read(asked).collect()} == got


def test_spans(spark, folder):
    got = {r.doc_id: r for r in queries.op3_debruijn_spans(spark, folder).collect()}
    words, first = [(t or "").encode().split() for t in _texts()], {}
    for i, w in enumerate(words):
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())


def test_spans_name_their_sources(spark, folder):
    """The words at a span's coordinates in its source are the span's own; a span whose words aren't those stays."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = spans.repeated_spans(docs, k=13)
    words = [(t or "").split() for t in _texts()]
    rows = found.spans.collect()
    assert rows
    for r in rows:
        assert r.source < r.key and words[r.key][r.start : r.start + r.n_words] == words[r.source][r.source_at : r.source_at + r.n_words]
    wrong = spans.Repeats(found.copies, found.spans.withColumn("digest", F.substring(F.unhex(F.md5("digest")), 1, 8)), 13)
    kept = spans.remove_spans(docs, wrong)
    copies = {r.key for r in found.copies.collect()}
    assert all(not r["__n_removed"] for r in kept.collect() if r.doc_id not in copies)


def test_spans_in_place(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = spans.remove_spans(docs, spans.repeated_spans(docs, k=50))
    assert out.columns[:-2] == docs.columns
    for r in out.collect():
        if not r["__n_removed"]:
            assert r.text == _texts()[r.doc_id]


@pytest.mark.parametrize("chunk", [500, 3])
def test_near_join(spark, folder, chunk):
    got = {r.key: r for r in near_join.near_components(spark.read.parquet(f"{folder}/documents.parquet"), 4, 85, chunk=chunk).collect()}
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for t in _texts():
        w = (t or "").encode().translate(lower).split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(sets))] == [(len(s), r) for s, r in zip(sets, root, strict=True)]


def _measures(text: str) -> tuple:
    """What op5 gives for a text, in plain Python."""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    places: dict = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    symbols, dup = sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    failed = len(w) < 50 or 2 * len(covered) > len(w)
    chars = sum(map(len, w))
    bad = 5 * symbols > len(w) or chars > 14 * len(w) or chars < 2 * len(w) or 3 * dup > len(lines) or 2 * len([c for c in text if unicodedata.category(c) == "Lu"]) > chars or 3 * text.count("!") > len(w) or 5 * len(set(w)) < min(len(w), 1000)
    return len(w), chars, symbols, dup, len(covered), failed, not (failed or bad)


def test_rules(spark, folder):
    for r in queries.op5_rule_cascade(spark, folder).collect():
        assert tuple(r)[1:] == _measures(_texts()[r.doc_id] or "")


def test_rules_on_hard_texts(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(90)]
    base = " ".join(words)
    texts = ["f\nf", "\f\n\f", "\v\n\v\nx\nx", "a\fb\vc\rd", "x y z x y z x y", "a a a a a", base, base.upper(), base.replace(" ", "! "), base.replace(" ", " # "), base + "\n" + "same line\n" * 40, " ".join(rng.choice(words[:12]) for _ in range(400)), " ".join(["ab cd"] * 300), "é" * 900 + " " + base, *(" ".join(rng.choice("abc") for _ in range(n)) for n in range(3, 60, 7))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op5_rule_cascade(spark, str(tmp_path)).collect():
        assert tuple(r)[1:] == _measures(texts[r.doc_id]), texts[r.doc_id][:60]


def test_order_of_rules(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    a, b = (rules.judged(docs, list(order)).select("doc_id", "quality.failed").collect() for order in (rules.RULES, rules.RULES[::-1]))
    assert sorted((r.doc_id, r.failed is None) for r in a) == sorted((r.doc_id, r.failed is None) for r in b)
    assert rules.order_rules(docs) == rules.order_rules(docs)
    # both reject the same rows: once the cheap one has, nothing is left for the other, though it rejects more per work than the third
    some = (rules.Rule("dear", "n_words < 3", "50"), rules.Rule("cheap", "n_words < 4", "1"), rules.Rule("other", "n_words > 2000", "5"))
    assert [r.name for r in rules.order_rules(docs, rules=some)] == ["cheap", "other", "dear"]


def test_packing(spark, folder):
    rows, ids = queries.op6_genetic_packing(spark, folder).collect(), _library("byte_bpe_50k.json")
    for i, x in enumerate(ids):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.length for r in own[1:]] == [1024] * (len(own) - 1) and sum(r.length for r in own) == len(x) and len(own) == -(-len(x) // 1024)
        assert all(r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes()) for r in own)
    total = sum(map(len, ids))
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-total // 1024) + 2


def test_pseudonyms(spark):
    texts = ["mail bo.b1@example.com", "ip 42.144.35.254.", "card 4041894974608795, 4041 8949 7460 8795", "no card 4041894974608796", "on 1999-02-28 and 28/02/1999", "no 1999-02-29", "call +1 (988) 555-2485", None, "", "clean 12 3.5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in pii.pseudonymize(docs, "k").orderBy("doc_id").collect()]
    assert [got[i] for i in (3, 5, 7, 8, 9)] == [texts[i] for i in (3, 5, 7, 8, 9)]
    digits = re.findall(r"[0-9]{16}", re.sub(r"(?<=[0-9]) (?=[0-9])", "", got[2]))
    assert digits[0] == digits[1] != "4041894974608795"
    assert sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[0])) % 10 == 0
    a, b = re.findall(r"[0-9/-]{10}", got[4])
    assert a.split("-") == b.split("/")[::-1] and a != "1999-02-28"
    assert re.fullmatch(r"call \+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", got[6]) and got[6] != texts[6]
    assert re.fullmatch(r"mail [a-z]{2}\.[a-z][0-9]@example\.com", got[0]) and re.fullmatch(r"ip ([0-9]{1,3}\.){4}", got[1])


CARD = "4041 8949 7460 8795"


def _replaced(spark, texts: list) -> list:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymize(docs, "k").orderBy("doc_id").collect()]


def test_pseudonyms_of_cards_beside_numbers(spark):
    around = ["card #", "card # 12/27", "paid 20 #", "in 2024 #", "# 123", "# #", "12 988 555-2485 # 1999-02-28", "# 42.144.35.254", "2024 #/12", "# 28/02/1999 #", "+49 30 901820 #"]
    got = _replaced(spark, [a.replace("#", CARD) for a in around])
    fresh = got[0][5:]
    assert fresh != CARD and re.fullmatch("([0-9]{4} ?){4}", fresh)
    assert [got[i] for i in (1, 2, 3, 4, 5, 8)] == [around[i].replace("#", fresh) for i in (1, 2, 3, 4, 5, 8)]
    for a, g in zip(around, got, strict=True):
        assert g.count(fresh) == a.count("#") and not any(x in g for x in ("555-2485", "1999", "42.144.35.254", "901820"))
    assert _replaced(spark, ["1 2 3 4 5 6", "4041 8949 7460 8796", "1234567890123456789012345"]) == ["1 2 3 4 5 6", "4041 8949 7460 8796", "1234567890123456789012345"]


def test_pseudonyms_of_secrets_in_other_layouts(spark):
    value = "ab!cd-99"
    texts = [f"x password{b}{value}{a}" for b, a in (("=", ""), (": ", " y"), (" = ", "."), ('="', '" y'), (" = '", "'"), ('": "', '", "k": 1'))]
    got = _replaced(spark, [*texts, f'token="{value}"', f"API_KEY: {value}", f"secret = '{value}'", "no token here"])
    fresh = re.fullmatch("x password=(.*)", got[0])[1]
    assert re.fullmatch("[a-z]{2}![a-z]{2}-[0-9]{2}", fresh) and fresh != value
    assert got[:6] == [t.replace(value, fresh) for t in texts]
    assert got[6:] == [f'token="{fresh}"', f"API_KEY: {fresh}", f"secret = '{fresh}'", "no token here"]


def test_pseudonyms_of_telephones_and_dates_in_other_layouts(spark):
    phones = ["+49 30 901820", "+44 20 7946 0958", "+33 1 42 68 53 00", "+15551234567", "1-800-555-0199", "+1-988-555-2485", "0171 1234567", "030/901820"]
    for a, b in zip(phones, _replaced(spark, phones), strict=True):
        assert a != b and re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", b)
    got = _replaced(spark, ["1999-02-28", "1999/02/28", "1999.02.28", "28/02/1999", "28-02-1999", "02/28/1999", "28.2.1999", "2/28/1999", "31/31/1999"])
    year, month, day = got[0].split("-")
    assert got[0] != "1999-02-28" and got[1:6] == [f"{year}/{month}/{day}", f"{year}.{month}.{day}", f"{day}/{month}/{year}", f"{day}-{month}-{year}", f"{month}/{day}/{year}"]
    assert got[6:] == [f"{int(day)}.{int(month)}.{year}", f"{int(month)}/{int(day)}/{year}", "31/31/1999"]


def test_pseudonyms_are_a_permutation(spark):
    rows = spark.range(1000).selectExpr("id as doc_id", "concat('555-', lpad(id div 100, 3, '0'), '-', lpad(id % 100, 4, '0')) as text")
    assert pii.pseudonymize(rows, "k").select("text").distinct().count() == 1000


def _pcm(notes) -> bytes:
    x = np.sin(np.cumsum(np.repeat(2 * np.pi * 110 * 2 ** (np.asarray(notes) / 12) / audio.RATE, 256)))
    return (x * 16000).astype("<i2").tobytes()


def _aligned(prints, queries: str = "key % 50 = 0") -> tuple[dict, dict]:
    """The class of each key, and the matches of each query."""
    rows = audio.align(prints, queries).collect()
    matches: dict = {}
    for r in rows:
        if r.match_id is not None:
            matches.setdefault(r.key, []).append((r.match_id, r.offset, r.bit_errors, r.bits))
    return {r.key: (r.class_id, r.n_items) for r in rows}, {k: sorted(v) for k, v in matches.items()}


def test_audio(spark):
    rng = np.random.default_rng(1)
    melody = rng.integers(0, 36, 80)
    noisy = (0.9 * np.frombuffer(_pcm(melody[10:]), "<i2") + rng.normal(0, 300, 70 * 256)).astype("<i2").tobytes()
    rows = [(0, _pcm(melody)), (1, noisy), (2, _pcm(melody)), (3, _pcm(rng.integers(0, 36, 80))), (4, None), (5, b""), (6, b"\0")]
    classes, matches = _aligned(audio.fingerprints(spark.createDataFrame(rows, "key long, audio binary"), "key", "audio"))
    assert classes[2] == classes[0] and classes[3][0] == 3 and [m[:2] for m in matches.pop(0)] == [(1, -10)] and not matches
    assert classes[4][1] == classes[5][1] == classes[6][1] == 0


def _all_offsets(prints: list) -> dict:
    """The matches of each with each other by brute force."""
    out: dict = {}
    for i, x in enumerate(prints):
        for j, y in enumerate(prints):
            found = []
            for o in range(8 - len(x), len(y) - 7):
                a, b = x[max(0, -o) :], y[max(0, o) :]
                n = min(len(a), len(b))
                errors = int(np.bitwise_count(a[:n] ^ b[:n]).sum())
                if n >= 8 and 10 * errors <= 64 * n:
                    found.append((2 * errors - 32 * n, o, errors, 32 * n))
            if found and not np.array_equal(x, y):
                out.setdefault(i, []).append((j, *min(found)[1:]))
    return out


def test_audio_against_all_offsets(spark):
    """Evenly spread bit errors of up to 20%, repeated patterns, silence and short stretches: what is found is what brute force finds, of which 0.9 or more."""
    rng = np.random.default_rng(4)
    prints = []
    for _ in range(5):
        base = rng.integers(0, 1 << 32, 56, dtype=np.uint64).astype(np.uint32)
        flipped = lambda x, share: x ^ (np.packbits(rng.random((len(x), 32)) < share, axis=1).view("<u4")[:, 0])
        prints += [base, *(flipped(base[i:], share) for i in (0, 7, 40) for share in (0.05, 0.1, 0.15, 0.18, 0.25)), np.tile(base[:5], 8), np.tile(base[:5], 6), flipped(base[-8:], 0.15), base[-7:]]
    prints += [np.zeros(30, np.uint32), np.zeros(12, np.uint32), prints[0][:0]]
    got = _aligned(spark.createDataFrame([(i, x.view(np.int32).tolist()) for i, x in enumerate(prints)], "key long, items array<int>"), "true")[1]
    want = {(i, *m) for i, ms in _all_offsets(prints).items() for m in ms}
    found = {(i, *m) for i, ms in got.items() for m in ms}
    assert len(want) > 400 and found <= want and len(found) >= 0.97 * len(want)


def test_audio_with_silence_in_half_of_the_rows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        notes = _pcm(rng.integers(0, 36, 40))
        rows.append((i, b"\0" * 2 * 256 * 30 + notes + b"\0" * 2 * 256 * 25 if i % 2 else notes))
    prints = audio.fingerprints(spark.createDataFrame(rows, "key long, audio binary"), "key", "audio")
    items = {r.key: np.array(r["items"], np.int32).view(np.uint32) for r in prints.collect()}
    got = _aligned(prints, "true")[1]
    assert got == _all_offsets([items[i] for i in range(60)])


def test_audio_of_rows_that_share_a_key(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 36, 60), rng.integers(0, 36, 60)
    rows = [(0, _pcm(a[:50])), (7, _pcm(a)), (7, _pcm(b)), (100, _pcm(b[:50])), (None, _pcm(b[5:])), (None, None)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "key long, audio binary").repartition(3)
        found = audio.align(audio.fingerprints(docs, "key", "audio")).collect()
        assert sorted((r.key, r.match_id or -1) for r in found if r.key is not None and r.key % 50 == 0) == [(0, 7), (100, -1), (100, 7)]
        assert sum(r.key == 7 for r in found) == 2 and sum(r.key is None for r in found) == 2


def test_bpe(spark, folder):
    import tiktoken

    ranks = prefix_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op9_prefix_bpe(spark, folder).collect():
        text = _texts()[r.doc_id] or ""
        ids = np.array(reference.encode_ordinary(text), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), text


def test_bpe_edits():
    bpe, rng = prefix_bpe.PrefixBpe(prefix_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), random.Random(2)
    text = prefix_bpe.EditableText(bpe, b"the quick brown fox jumps over the lazy dog" * 9)
    for _ in range(20):
        at = rng.randrange(len(text.text) - 5)
        text.edit(at, rng.randrange(4), bytes(rng.choice(b"abc th") for _ in range(rng.randrange(4))))
        assert text.ids() == prefix_bpe.EditableText(bpe, text.text).ids() == bpe.merge(text.text)


def test_classifier(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() + ("###" if i % 3 == 0 else "") for _ in range(40)), int(i % 3 != 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(998, None), (999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 5], "doc_id long, quality int")
    machine = classifier.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in classifier.score(docs, machine).collect()}
    assert all((got[r[0]] >= 0.5) == bool(r[2]) for r in rows) and 0 <= got[998] == got[999] <= 1


def test_pipeline(spark, folder, empty):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
    assert p.run(spark, empty).count() == 0
    once = p.ngram_jaccard_join(spark, docs.unionByName(docs), folder)
    assert once.count() == once.select("doc_id").distinct().count()


def test_rows_that_share_a_key(spark, folder):
    """Texts under one doc_id are cut, and dropped as copies, each for itself."""
    import corpus_pipeline as p

    rng = random.Random(6)
    words = [["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)] for _ in range(4)]
    a, b, c, d = (" ".join(w) for w in words)
    near = " ".join([*words[1][:-1], "other"])
    rows = [(1, a), (1, b), (7, near), (8, c), (8, a), (9, d + " " + c), (9, b), (None, a), (1, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = p.ngram_jaccard_join(spark, docs, folder).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (1, b), (8, c), (9, d + " " + c), (None, a)], key=str)
    out = spans.remove_spans(docs, spans.repeated_spans(docs, k=13), joined=True).collect()
    cut = {(1, a): a, (1, b): b, (7, near): "other", (8, c): c, (8, a): "", (9, d + " " + c): d, (9, b): "", (None, a): a}
    assert sorted((r.doc_id or 0, r.text) for r in out) == sorted((i or 0, cut[i, t]) for i, t in rows)


def test_spans_of_a_text_dealt_over_buckets(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words))] * 30 + [(2, " ".join(["x", *words[5:30], "y"]))] * 30 + [(None, "a b")] * 5 + [(3, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(spans, "HOT_BYTES", 500)
    found = spans.repeated_spans(docs, k=13)
    assert found.texts.hot.count() == 2
    assert found.texts.rows.select("__key", "__part").distinct().where("__key = 1").count() > 1
    out = [(r.doc_id, r["__n_removed"]) for r in spans.remove_spans(docs, found).collect()]
    assert sorted(out, key=str) == sorted([(1, 0)] * 30 + [(2, 25)] * 30 + [(None, 0)] * 5 + [(3, 0)] * 5, key=str)


def test_lists_are_shuffled_once(spark, folder, monkeypatch):
    """One pass over the texts makes the lists of op 4; their count and the search for sets that share them take the same shuffle."""
    seen, plain = spark.sparkContext.accumulator(0), near_join._lists

    def counted(*args):
        run = plain(*args)

        def counting(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield from run([batch])

        return counting

    monkeypatch.setattr(near_join, "_lists", counted)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    classes = {r.class_id for r in near_join.near_components(docs, 4, 85).collect() if r.n_shingles}
    without = sum(not (t or "").encode().split() for t in _texts())
    assert seen.value == len(classes) + without


@pytest.mark.parametrize("chunk", [500, 1])
def test_near_join_of_keys_with_an_empty_text_too(spark, chunk):
    """Two texts that meet in a block but don't link, each beside an empty text of the same key."""
    rng = random.Random(4)
    a = [f"w{rng.random()}" for _ in range(1000)]
    b = [f"v{i}" if i % 40 == 0 else w for i, w in enumerate(a)]
    docs = spark.createDataFrame([(1, " ".join(a)), (1, ""), (2, " ".join(b)), (2, "")], "doc_id long, text string")
    assert {(r.key, r.component_id) for r in near_join.near_components(docs, 4, 85, chunk=chunk).collect()} == {(1, 1), (2, 2)}


@pytest.mark.parametrize("chunk", [500, 7])
def test_near_join_of_a_chain(spark, chunk):
    """Neighbours in a chain of texts link, its ends don't: one component, which the pivot alone doesn't give."""
    rng = random.Random(5)
    rows, words = [], [f"w{rng.random()}" for _ in range(500)]
    for i in range(30):
        words = [f"{i}v{rng.random()}" if j % 100 == i else w for j, w in enumerate(words)]
        rows.append((i, " ".join(words)))
    rows.append((99, " ".join([*words[:300], *(f"u{rng.random()}" for _ in range(200))])))
    got = {r.key: r.component_id for r in near_join.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, chunk=chunk).collect()}
    assert got == {**dict.fromkeys(range(30), 0), 99: 99}


def test_chance_makes_no_large_block(spark, monkeypatch):
    """Texts of few words share many n-grams with one another by chance, but not enough to link: they don't meet, however many they are."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(30, 60))) for _ in range(600)]
    texts += [f"{t} x" for t in texts[:20]]
    blocks, plain = [], near_join.table

    def kept(df, name):
        out = plain(df, name)
        if name == "blocks":
            blocks.extend(r["count"] for r in out.groupBy("component").count().collect())
        return out

    monkeypatch.setattr(near_join, "table", kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.key: r.component_id for r in near_join.near_components(docs, 4, 85).collect()}
    assert got == {i: i - 600 if i >= 600 else i for i in range(620)}
    assert sum(blocks) < 100


def test_chance_makes_no_large_block_in_the_pipeline(spark, monkeypatch):
    """Its second stage over texts that share n-grams of five words by chance: only the copies meet, and they go."""
    import corpus_pipeline as p

    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefghi") for _ in range(rng.randint(35, 60))) for _ in range(600)]
    texts += [f"{t} x" for t in texts[:20]]
    blocks, plain = [], near_join.table

    def kept(df, name):
        out = plain(df, name)
        if name == "blocks":
            blocks.append(out.count())
        return out

    monkeypatch.setattr(near_join, "table", kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in p.ngram_jaccard_join(spark, docs, "").collect()) == list(range(600))
    assert 40 <= sum(blocks) < 100


def test_few_sets_of_a_linked_group_search(monkeypatch):
    """Of a group whose sets all link few search, and each outlier."""
    rng = random.Random(9)
    base = [rng.getrandbits(63) for _ in range(400)]
    sets = [np.array(sorted([*rng.sample(base, 390), *(rng.getrandbits(63) for _ in range(5))]), dtype=np.uint64) for _ in range(200)]
    sets += [np.array(sorted([*base[:200], *(rng.getrandbits(63) for _ in range(200))]), dtype=np.uint64) for _ in range(10)]
    searches, plain = [], near_join.divide_skip
    monkeypatch.setattr(near_join, "divide_skip", lambda *args: searches.append(1) or plain(*args))
    part = pa.table({"key": pa.array(range(210), pa.int64()), "block": pa.array([0] * 210, pa.int64()), "side": pa.array([i % 2 for i in range(210)], pa.int32()), "outer": [True] * 210, "far": [0.5] * 210, "tokens": pa.array([x.tobytes() for x in sets], pa.binary())})
    edges = near_join._search(85)(part)
    root = list(range(210))
    for a, b in zip(edges.column("a").to_pylist(), edges.column("b").to_pylist(), strict=True):
        root = [root[a] if r == root[b] else r for r in root]
    assert len(set(root[:200])) == 1 and len(set(root)) == 11
    assert len(searches) <= 20


def test_divide_skip():
    """Lists of one to all sets, merged and probed, against brute force."""
    rng = random.Random(10)
    common = [rng.getrandbits(63) for _ in range(80)]
    sets = [np.unique(np.array([*rng.sample(common, rng.randint(1, 80)), *range(i % 7, 300, 7 + i % 3)], dtype=np.uint64)) for i in range(150)]
    tokens, numbers = np.concatenate(sets), np.repeat(np.arange(150), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    vocabulary, first = np.unique(tokens[order], return_index=True)
    for query in sets:
        shared = np.array([len(np.intersect1d(query, s)) for s in sets])
        for need in (1, len(query) // 2 + 1, len(query)):
            ids, count = near_join.divide_skip(query, vocabulary, np.append(first, len(tokens)), numbers[order], need)
            assert ids.tolist() == np.flatnonzero(shared >= need).tolist() and count.tolist() == shared[ids].tolist()


def test_cover_by_few_stretches():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(0, 12)
        start, end = (np.array(sorted(rng.sample(range(a, a + 60), n)), dtype=np.int64) for a in (0, 8))
        end = np.maximum(end, start + 1 + np.arange(n))
        taken = spans._cover(start, end)
        words = lambda picks: {w for i in picks for w in range(start[i], end[i])}  # noqa: E731, B023
        assert words(taken) == words(range(n))
        assert all(words(taken[:i] + taken[i + 1 :]) != words(range(n)) for i in range(len(taken)))


def test_spans_of_near_copies_are_few(spark):
    """Each copy differs at places of its own, so that neighbouring windows stand first in different documents: a span for each k words does, not one for each change."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        changed = set(rng.sample(range(400), 8))
        texts.append([f"x{rng.random()}" if i in changed else w for i, w in enumerate(base)])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = spans.repeated_spans(docs, k=20)
    first: dict = {}
    for i, w in enumerate(texts):
        for j in range(381):
            first.setdefault(tuple(w[j : j + 20]), i)
    gone = {}
    for i, w in enumerate(texts):
        gone[i] = len({x for j in range(381) if first[tuple(w[j : j + 20])] < i for x in range(j, j + 20)})
    assert {r.doc_id: r["__n_removed"] for r in spans.remove_spans(docs, found).collect()} == gone
    assert sum(gone.values()) > 10000
    assert all(r["count"] <= 2 * 400 // 20 for r in found.spans.groupBy("key").count().collect())
    assert found.spans.count() <= 1.5 * sum(gone.values()) / 20
    for key in gone:
        at = sorted((r.start, r.start + r.n_words) for r in found.spans.where(f"key = {key}").collect()) if key % 10 == 9 else []
        assert all(c[0] > a[1] for a, c in zip(at, at[2:], strict=False))  # none between two that touch
