"""Line deduplication by site-relative frequency, with DataFrame expressions only.

A line is boilerplate on its host if the share of the host's pages that contain it exceeds ``ratio``
(and at least ``min_pages`` pages contain it, so that a host of few pages proves nothing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

RATIO = 0.05
MIN_PAGES = 5
#: Most boilerplate lines, over all hosts, whose keys are broadcast (32 characters each).
BROADCAST_KEYS = 1_000_000


def line_key(line):
    """128-bit key of a line without its outer spaces, as text (array functions hash texts, but compare binaries one by one)."""
    return F.md5(F.trim(line))


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(docs: DataFrame, host, text, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, keys): the keys of each host's boilerplate lines; hosts without any are absent.

    A page counts once for a line however often it repeats it. Lines of one host spread over all
    tasks, counted map-side first, so a hot host or a hot line is no hot task.
    """
    pages = docs.select(F.coalesce(host, F.lit("")).alias("host"), _lines(text).alias("lines"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    worded = F.filter("lines", lambda x: F.trim(x) != "")
    seen = pages.select("host", F.explode(F.array_distinct(F.transform(worded, line_key))).alias("key"))
    counts = seen.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    frequent = counts.join(totals, "host").where(F.col("n") / F.col("pages") > ratio)
    return materialize(frequent.groupBy("host").agg(F.collect_set("key").alias("keys")), "boilerplate")


def line_dedup(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """The input's columns with ``text`` cleaned, and n_lines and n_dropped (replaced if the input has them).

    Defined cases: a null host is the host ""; a null text stays null and counts as one page without
    lines; blank lines are never dropped; lines equal but for outer spaces are one line; of a line
    repeated in a page all occurrences go; a page that is boilerplate only becomes empty but stays;
    repeated rows are pages of their own; a carriage return at a line's end is part of the line; an empty table gives no rows.
    """
    found = boilerplate(docs, F.col(host), F.col(text), ratio, min_pages)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    size = found.agg(F.sum(F.size("keys"))).first()[0] or 0
    joined = inner.withColumn("host", F.coalesce(F.col("row")[host], F.lit(""))).join(
        F.broadcast(found) if size <= BROADCAST_KEYS else found, "host", "left"
    )
    # the page's own boilerplate by hashing, then its few keys are compared with its lines
    lines = _lines(F.col("row")[text])
    held = joined.select("row", lines.alias("lines"), F.array_intersect(F.transform(lines, line_key), "keys").alias("own"))
    kept = F.filter("lines", lambda x: ~F.array_contains("own", line_key(x)) | (F.trim(x) == ""))
    cleaned = held.select("row", F.size("lines").alias("n"), F.when(F.size("own") > 0, kept).alias("kept"))
    new_text = F.when(F.col("kept").isNull() | F.col("row")[text].isNull(), F.col("row")[text]).otherwise(
        F.array_join("kept", "\n")
    )
    return cleaned.select(
        *((new_text if c == text else F.col("row")[c]).alias(c) for c in names),
        F.when(F.col("row")[text].isNull(), 0).otherwise(F.col("n")).alias("n_lines"),
        F.when(F.col("kept").isNull() | F.col("row")[text].isNull(), 0)
        .otherwise(F.col("n") - F.size("kept"))
        .alias("n_dropped"),
    )


ORACLE_SQL = f"""
WITH pages AS (SELECT coalesce(source, '') AS host, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
totals AS (SELECT host, count(*) AS pages FROM pages GROUP BY 1),
seen AS (SELECT host, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ')))) AS line FROM pages),
frequent AS (
  SELECT host, line FROM (SELECT host, line, count(*) AS n FROM seen WHERE line <> '' GROUP BY 1, 2) JOIN totals USING (host)
  WHERE n >= {MIN_PAGES} AND n / pages > {RATIO}),
found AS (SELECT host, list(line) AS keys FROM frequent GROUP BY 1),
cut AS (
  SELECT doc_id, source, lang, text, string_split(text, chr(10)) AS lines, coalesce(keys, []) AS keys
  FROM documents LEFT JOIN found ON host = coalesce(source, '')),
kept AS (
  SELECT *, list_filter(lines, lambda x: trim(x, ' ') = '' OR NOT list_contains(keys, trim(x, ' '))) AS kept FROM cut)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END AS text,
  CASE WHEN text IS NULL THEN 0 ELSE len(lines) END::INTEGER AS n_lines,
  CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(kept) END::INTEGER AS n_dropped
FROM kept
"""
