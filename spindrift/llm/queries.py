"""The opN_ queries: each operator with its production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, exact_dedup, html_extract, langid, line_dedup, quality, simhash, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark, sf_dir):
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontamination(spark, sf_dir):
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark, sf_dir):
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    cleaned = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cleaned.select("doc_id", "text", "n_lines", "n_dropped")


def op6_language_id(spark, sf_dir):
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op9_bpe(spark, sf_dir):
    return bpe.bpe_documents(_table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    read = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality, op2_decontamination, op3_html_extraction, op4_exact_dedup, op5_line_dedup,
        op6_language_id, op7_simhash, op8_token_counts, op9_bpe, op10_warc,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontam.ORACLE_SQL,
        "op4_exact_dedup": exact_dedup.ORACLE_SQL,
        "op5_line_dedup": line_dedup.ORACLE_SQL,
        "op10_warc": warc.ORACLE_SQL,
    }
