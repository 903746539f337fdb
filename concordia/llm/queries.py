"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm import chat, decontam, licenses, lines, neardup, packing, quality, secrets, shards, simple8b

TOKENIZER = "byte_bpe_50k.json"
PROBE = "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).selectExpr(
        "-7L as conv_id", "explode(array(struct(0L as turn, 'user' as role), struct(1L as turn, 'assistant' as role))) as t"
    )
    probe = probe.selectExpr("conv_id", "t.turn as turn", "t.role as role", f"r'{PROBE}' as text")
    return chat.digests(chat.format_chats(rows.unionByName(probe)))


def op2_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).drop("rejected_by")


def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.interleave(_table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), percent=75)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op6_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), size=1024, end_id=2)


def op8_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_templates(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_dropped")).select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.char_length("text").cast("long").alias("text_chars"),
        F.md5("text").alias("text_md5"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_windows": op1_chat_windows,
    "op2_quality_cascade": op2_quality_cascade,
    "op3_stratified_shards": op3_stratified_shards,
    "op4_minhash_neardup": op4_minhash_neardup,
    "op5_license_scan": op5_license_scan,
    "op6_simple8b_ids": op6_simple8b_ids,
    "op7_sum_of_squares_packing": op7_sum_of_squares_packing,
    "op8_bm25_decontamination": op8_bm25_decontamination,
    "op9_template_line_dedup": op9_template_line_dedup,
    "op10_secret_scan": op10_secret_scan,
}
