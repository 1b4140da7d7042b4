"""File listings, counts and incremental-evaluation operators on the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import matches_glob

EXAMPLES = 5


def file_mtimes(chunks: DataFrame) -> DataFrame:
    """(file_path, mtime): the latest of each file."""
    return chunks.groupBy("file_path").agg(F.max("mtime").alias("mtime"))


def list_files(chunks: DataFrame, glob: str | None = None) -> DataFrame:
    """Distinct paths that match the glob, in byte order."""
    return chunks.select("file_path").where(matches_glob(F.col("file_path"), glob)).distinct().orderBy("file_path")


def counts(chunks: DataFrame) -> DataFrame:
    """One row: files, chunks."""
    return chunks.agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("chunks"))


def changed_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files that are not in the table, or newer than there."""
    stored = file_mtimes(chunks).select("file_path", F.col("mtime").alias("_stored"))
    joined = files.join(stored, "file_path", "left")
    return joined.where(F.col("_stored").isNull() | (F.col("mtime") > F.col("_stored"))).drop("_stored")


def vanished_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Paths in the table that the listing no longer has."""
    return chunks.select("file_path").distinct().join(files.select("file_path"), "file_path", "left_anti")


def delete_files(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """The table without the rows of some paths."""
    return chunks.join(paths.select("file_path"), "file_path", "left_anti")


def replace_files(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """The table with all rows of the new rows' paths replaced by them."""
    return delete_files(chunks, new.select("file_path").distinct()).unionByName(new)


def chunking_stats(units: DataFrame) -> DataFrame:
    """Rows (file_path, origin) with origin unit, merged or line -> per file the method and how many chunks of each."""
    count = lambda of: F.sum(F.when(F.col("origin") == of, 1).otherwise(0)).alias(f"{of}_chunks")
    found = units.groupBy("file_path").agg(count("unit"), count("merged"), count("line"))
    method = F.when(F.col("line_chunks") == 0, "ast").when(F.col("unit_chunks") + F.col("merged_chunks") == 0, "line_based")
    return found.withColumn("method", method.otherwise("mixed"))


def error_report(errors: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """errors (path, stage, error) -> (stage, n, path, error): each stage's count and first examples by path."""
    first = Window.partitionBy("stage").orderBy("path", "error")
    numbered = errors.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= examples)
    totals = errors.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return numbered.join(F.broadcast(totals), "stage").select("stage", "n", "path", "error")


def merged_stats(stats: DataFrame) -> DataFrame:
    """Sums of all counters."""
    return stats.agg(*(F.sum(c).alias(c) for c in stats.columns))
