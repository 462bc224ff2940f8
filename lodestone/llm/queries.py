"""The registered queries of the numbered operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, classifier, near_join, packing, pii, prefix_bpe, rules, sharding, spans, token_files
from .common import scratch, table
from .sql import SQL

#: The key of the pseudonyms in the registered query; in production it is a secret that the caller hands over.
PSEUDONYM_KEY = "lodestone-example-key"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    text = F.coalesce(F.encode("text", "utf-8"), F.lit(b""))
    records = docs.select("doc_id", (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")).withColumn("vslot", sharding.slot_of("doc_id", "text_crc32"))
    measured = table(sharding.slot_bytes(records), "slots")
    owners = sharding.balance(measured, scratch(spark, "slot-map"), shards=24)
    placed = sharding.place(records, measured, owners, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    files = token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return files.read(token_files.all_keys(docs)).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    kept = spans.remove_spans(docs, spans.repeated_spans(docs, k=13), joined=True)
    return kept.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def op4_divideskip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_join.near_components(_docs(spark, sf_dir), k=4, percent=85)
    return found.select(F.col("key").alias("doc_id"), "n_shingles", "component_id")


#: Rules that come before those whose order is found.
BASE = (rules.Rule("too_short", "n_words < 50"), rules.Rule("repetition", "100 * n_repeat_words > 50 * n_words"))


def op5_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    out = rules.judged(docs, rules.order_rules(docs, first=BASE))
    failed = F.coalesce(F.col("quality.failed").isin(*(r.name for r in BASE)), F.lit(False)).alias("base_failed")
    counts = [f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *counts, failed, F.col("quality.failed").isNull().alias("kept"))


def op6_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)
    return packing.pack(pieces, 1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(_docs(spark, sf_dir).select("doc_id", "text"), PSEUDONYM_KEY)
    return out.select("doc_id", "text", F.col("__n_found").alias("n_found"))


def op8_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    recordings = audio.render(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return audio.align(audio.fingerprints(recordings, "key", "audio")).withColumnRenamed("key", "vec_id")


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = prefix_bpe.encode(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0
    machine = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), ~held_out)
    return classifier.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_virtual_slots,
        op2_token_files,
        op3_debruijn_spans,
        op4_divideskip_join,
        op5_rule_cascade,
        op6_genetic_packing,
        op7_feistel_pseudonyms,
        op8_chroma_fingerprints,
        op9_prefix_bpe,
        op10_factorisation_machine,
    )
}
