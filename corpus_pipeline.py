"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet into the shared
folder and reads it back for the next stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlearn.llm import bpe, decontam, linededup, minhash, quality
from streamlearn.llm.common import read, staged
from streamlearn.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents rejected by the base rules or by a certified cutoff go."""
    feats = staged(quality.features(docs), "quality-features")
    cutoffs = staged(quality.fit_cutoffs(feats, read(spark, sf_dir, "labels")), "quality-cutoffs")
    return quality.apply_rules(docs, quality.judge(feats, cutoffs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose key stands in ten documents or more go from every text; n_chars follows."""
    found = linededup.line_dedup(docs, min_chars=1, min_docs=10, names=("__lines", "__dropped_lines", "__keep"))
    text = F.when(F.col("text").isNotNull(), linededup.kept_text(F.col("text"), F.col("__keep"))).alias("text")
    new = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("__dropped_lines") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return new.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return minhash.keep_one(docs, minhash.classes(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_contaminated(docs, decontam.contaminated(docs, read(spark, sf_dir, "benchmark")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    return bpe.encode_documents(docs, vocabulary(), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

#: BPE, near-duplicate classes and the certified cutoffs have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
