"""The corpus pipeline: each stage reads what the one before it wrote, decides, and hands on what it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, decontam, langid, line_dedup, simhash
from spindrift.llm.common import scratch

#: A document whose nearest language prototype is no closer than this is in none of the languages.
MIN_COSINE = 0.05


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or near no language, go."""
    found = langid.identify(docs, langid.train(docs), keep=tuple(docs.columns), prediction=("__lang", "__cosine"))
    kept = found.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__cosine") >= MIN_COSINE))
    return kept.drop("__lang", "__cosine")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; n_chars follows the text; every document stays."""
    cleaned = line_dedup.line_dedup(docs, host="source", text="text").drop("n_lines", "n_dropped")
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of ``benchmark`` go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.bpe_documents(docs, keep=("ids",))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", token_stage),
]

#: Learned prototypes and the merge automaton have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
