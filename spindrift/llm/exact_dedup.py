"""Exact deduplication with a heavy-hitter split.

Digests of whole normalised texts are written once as thin rows. A Misra-Gries summary of
every partition finds the digests that may be frequent; their exact counts are taken
(verified winners, at most ``counters`` + 1 rows) and broadcast, so that the copies of hot texts are
resolved map-side and never meet in one task. All other digests are grouped by one shuffle; none of
them has more than 2 / (``counters`` + 1) of the rows, and even these are aggregated map-side and joined back, so that no task holds a group.
"""

from __future__ import annotations

import string

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

COUNTERS = 1023


def normalised_digest(text):
    """SHA-256 (binary) of the UTF-8 text with A-Z lower-cased; null counts as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.sha2(lowered, 256))


def shrink(counts: dict, counters: int) -> dict:
    """Misra-Gries reduction of a mergeable summary to at most ``counters`` entries."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: v - cut for k, v in counts.items() if v > cut}


def misra_gries(counters: int):
    """A mapInArrow function: the summary of one partition as (digest, at_least)."""

    def summarise(batches):
        counts: dict = {}
        for batch in batches:
            for entry in pc.value_counts(batch.column(0)).to_pylist():
                counts[entry["values"]] = counts.get(entry["values"], 0) + entry["counts"]
            if len(counts) > 8 * counters:
                counts = shrink(counts, counters)
        counts = shrink(counts, counters)
        if counts:
            yield pa.record_batch(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                names=["digest", "at_least"],
            )

    return summarise


def frequent(digests: DataFrame, rows: int, counters: int = COUNTERS) -> DataFrame:
    """Digests that may be on more than 2 / (counters + 1) of the rows: at most counters + 1 of them.

    A partition's summary is short by at most its rows / (counters + 1), so the sums of all are short
    by rows / (counters + 1); and at most counters + 1 sums can exceed that same bound.
    """
    summary = map_arrow(digests.select("digest"), misra_gries(counters), "digest binary, at_least long")
    total = summary.groupBy("digest").agg(F.sum("at_least").alias("at_least"))
    return total.where(F.col("at_least") > F.lit(rows / (counters + 1))).select("digest")


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z only. Of equal texts the row with the
    largest doc_id is kept. Defined cases: a null text equals an empty one; a null doc_id is below all
    others; of repeated rows (same id, same text) exactly one is kept; an empty table gives no rows;
    further columns of the input are ignored.
    """
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            normalised_digest(F.col("text")).alias("digest"),
        ),
        "digests",
    )
    best, size = F.max(F.struct("doc_id", "row")), F.count(F.lit(1))
    candidates = frequent(rows, rows.count(), counters)
    verified = materialize(
        rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(best.alias("best"), size.alias("group_size")),
        "winners",
    )
    hot = rows.join(F.broadcast(verified), "digest")
    rest = rows.join(F.broadcast(verified.select("digest")), "digest", "left_anti")
    cold = rest.join(rest.groupBy("digest").agg(best.alias("best"), size.alias("group_size")), "digest")
    return hot.unionByName(cold).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE_SQL = f"""
WITH digests AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS text_sha256
  FROM documents),
groups AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM digests GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM digests JOIN groups USING (text_sha256)
"""
