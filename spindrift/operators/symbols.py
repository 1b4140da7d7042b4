"""Symbol lookup over the chunk table: find, list and reference queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import matches_glob, same_text
from ..shared import broadcast_if_small

FIND_LIMIT, REFERENCE_LIMIT, MAX_EDITS = 20, 50, 3


def symbols(chunks: DataFrame) -> DataFrame:
    """The chunks that have a symbol, in the shape of the symbol queries."""
    return chunks.where("symbol_name is not null").select(
        F.col("id").alias("chunk_id"), F.col("symbol_name").alias("name"), F.coalesce("semantic_kind", F.lit("unknown")).alias("kind"),
        "file_path", "start_line", "end_line", "signature", "parent", "visibility",
        *(["language"] if "language" in chunks.columns else []),
    )


def find_symbol(
    table: DataFrame, query: str, mode: str = "fuzzy", kind: str | None = None, file_glob: str | None = None,
    language: str | None = None, limit: int | None = FIND_LIMIT, max_edits: int = MAX_EDITS,
) -> DataFrame:
    """Symbols with a score, best first, ties by name, file and line; total_matches counts before the limit.

    exact: the name, case counts, score 1. prefix: the beginning, any case, 0.9. contains: any place, any case, 0.8.
    Everything else is fuzzy: at most ``max_edits`` edits between lower-cased names, score 1 / (1 + edits).
    """
    name, wanted = F.col("name"), F.lit(query)
    if mode == "exact":
        found = table.where(name == wanted).withColumn("score", F.lit(1.0))
    elif mode == "prefix":
        found = table.where(F.startswith(F.lower(name), F.lower(wanted))).withColumn("score", F.lit(0.9))
    elif mode == "contains":
        found = table.where(F.contains(F.lower(name), F.lower(wanted))).withColumn("score", F.lit(0.8))
    else:
        edits = F.levenshtein(F.lower(name), F.lower(wanted), max_edits)
        found = table.withColumn("score", edits).where("score >= 0").withColumn("score", 1 / (1 + F.col("score")))
    if kind is not None:
        found = found.where(same_text(F.col("kind"), F.lit(kind)))
    if file_glob is not None:
        found = found.where(matches_glob(F.col("file_path"), file_glob))
    if language is not None:
        found = found.where(same_text(F.col("language"), F.lit(language)))
    ordered = found.orderBy(F.desc("score"), "name", "file_path", "start_line")
    return ordered if limit is None else ordered.limit(limit)


def list_symbols(table: DataFrame, file_path: str | None = None, kinds: list[str] | None = None, visibility: str | None = None) -> DataFrame:
    """Symbols of one file or all, by line, then file and name. A null visibility matches none."""
    found = table if file_path is None else table.where(F.col("file_path") == file_path)
    if kinds:
        found = found.where(F.lower("kind").isin([k.lower() for k in kinds]))
    if visibility is not None:
        found = found.where(same_text(F.col("visibility"), F.lit(visibility)))
    return found.orderBy("start_line", "file_path", "name")


def by_kind(listed: DataFrame) -> DataFrame:
    """The listed symbols by kind and line, each with the number of its kind. Groups stay rows: a kind may have any number of symbols."""
    totals = listed.groupBy("kind").agg(F.count(F.lit(1)).alias("of_kind"))
    return listed.join(broadcast_if_small(totals), "kind").orderBy("kind", "start_line", "name", "file_path")


def count(table: DataFrame) -> DataFrame:
    """One row: how many symbols, of how many names."""
    return table.agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("name").alias("names"))


def references_text(chunks: DataFrame, name: str, exclude_file: str | None = None, limit: int = REFERENCE_LIMIT) -> DataFrame:
    """Chunks whose text has the name as a word, by file and line; the definition's file is left out after the limit."""
    word = r"(?<![\p{L}\p{N}_])\Q" + name.replace("\\E", "") + r"\E(?![\p{L}\p{N}_])"
    hits = chunks.where(F.contains("content", F.lit(name)) & F.col("content").rlike(word))
    return _references(hits.orderBy("file_path", "start_line").limit(limit), exclude_file)


def references_vector(ranked: DataFrame, exclude_file: str | None = None) -> DataFrame:
    """The hits of a vector search for the name, without the definition's file."""
    return _references(ranked, exclude_file)


def _references(hits: DataFrame, exclude_file: str | None) -> DataFrame:
    kept = hits if exclude_file is None else hits.where(F.col("file_path") != exclude_file)
    return kept.withColumn("line_content", F.substring_index("content", "\n", 1))


def files_affected(references: DataFrame) -> DataFrame:
    return references.agg(F.countDistinct("file_path").alias("files_affected"), F.count(F.lit(1)).alias("total_references"))


def kinds(table: DataFrame) -> DataFrame:
    return table.select("kind").distinct()


def first_definition(table: DataFrame) -> DataFrame:
    """For every name its first place by file and line."""
    first = Window.partitionBy("name").orderBy("file_path", "start_line")
    return table.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
