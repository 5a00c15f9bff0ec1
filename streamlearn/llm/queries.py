"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, langid, linededup, minhash, oracles, pii, quality, secrets, sharding
from .common import read, staged


def vocabulary() -> str:
    """Path of the vocabulary that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(read(spark, sf_dir, "documents")).drop("node")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(read(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = staged(quality.features(read(spark, sf_dir, "documents")), "quality-features")
    cutoffs = staged(quality.fit_cutoffs(feats, read(spark, sf_dir, "labels")), "quality-cutoffs")
    out = quality.judge(feats, cutoffs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), vocabulary())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_dedup(read(spark, sf_dir, "documents"), min_chars=1, min_docs=10)
    runs = F.array_join("keep_runs", ",")  # lengths of kept and dropped runs in turn, the first kept
    return out.select("doc_id", "n_lines", "n_dropped", runs.alias("keep_runs"), F.sha2(linededup.kept_text(F.col("text"), F.col("keep_runs")), 256).alias("kept_sha256"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_pii, op3_sharding, op4_quality_rules, op5_bpe, op6_decontamination, op7_language, op8_chat, op9_line_dedup, op10_secrets)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
