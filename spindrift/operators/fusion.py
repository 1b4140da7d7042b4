"""Reciprocal rank fusion and hybrid search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import checkpointed

RRF_K, VECTOR_WEIGHT, KEYWORD_WEIGHT = 60, 0.7, 0.3
OVERFETCH = 3


def rrf_score(ranks, k: int = RRF_K) -> Column:
    """Sum of weight / (k + rank) over an array of structs (rank, weight)."""
    return F.aggregate(ranks, F.lit(0.0), lambda acc, x: acc + x["weight"] / (k + x["rank"]))


def ranked_whole(results: DataFrame, order: list) -> DataFrame:
    """Results of any number with a 1-based rank in a total order.

    Rows are range-partitioned and sorted by all tasks; a row's rank is its place in its partition and the sizes of the partitions before.
    """
    held = checkpointed(results.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33).alias("_part")
    sizes = held.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))  # one row for each partition
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = held.select("*", part).join(F.broadcast(starts), "_part")
    return placed.withColumn("rank", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "_part", "_before")


def ranked(results: DataFrame, order: list, by: list[str] | None = None) -> DataFrame:
    """Results with a 1-based rank in a total order, for each value of ``by`` if given; else a cut list of hits (one task ranks it)."""
    place = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    return results.withColumn("rank", F.row_number().over(place).cast("long"))


def rrf_fuse(lists: list[tuple[DataFrame, float]], key: list[str], limit: int, k: int = RRF_K, by: list[str] | None = None, digits: int = 9) -> DataFrame:
    """Fuse ranked lists (rank is a column) by ``key``; a key's other columns come from the first list that has it.

    A key that a list holds twice counts twice. Ties go by key. Fusing is one aggregation, partial before the shuffle.
    """
    by = by or []
    shared = [c for c in lists[0][0].columns if c not in (*by, *key, "rank", "score") and all(c in df.columns for df, _ in lists)]
    parts = [
        df.select(*by, *key, *shared, "rank", F.lit(i).alias("_list"), F.lit(float(w)).alias("_weight"))
        for i, (df, w) in enumerate(lists)
    ]
    first = F.struct("_list", "rank")
    fused = reduce(DataFrame.unionByName, parts).groupBy(*by, *key).agg(
        F.round(F.sum(F.col("_weight") / (k + F.col("rank"))), digits).alias("score"),
        *(F.min_by(c, first).alias(c) for c in shared),
    )
    if not by:
        return fused.orderBy(F.desc("score"), *key).limit(limit)
    return ranked(fused, [F.desc("score"), *key], by).where(F.col("rank") <= limit).drop("rank")


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, key: list[str], limit: int, weights=(VECTOR_WEIGHT, KEYWORD_WEIGHT), k: int = RRF_K, by: list[str] | None = None) -> DataFrame:
    """Fuse two searches that were asked for ``OVERFETCH`` times the limit."""
    return rrf_fuse([(vector_hits, weights[0]), (keyword_hits, weights[1])], key, limit, k, by)
