"""Exact nearest-neighbour search over a column of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distance_score

OVERFETCH = 3
#: Queries of a batch that travel to every task at once; larger batches go in several passes.
QUERY_BLOCK = 4096
#: Digits by which distances are ordered, if not told otherwise.
ORDER_DIGITS = 12


def distance(a, b, metric: str = "l2") -> Column:
    """Squared Euclidean, cosine or (negated) dot-product distance in double precision."""
    a, b = a.cast("array<double>"), b.cast("array<double>")

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, z: acc + z)

    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, z: acc + z)
    if metric == "cosine":
        return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    if metric == "dot":
        return -dot(a, b)
    raise ValueError(f"unknown metric: {metric}")


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def vector_topk(
    rows: DataFrame, vector, k: int, key: str = "id", column: str = "vector", metric: str = "l2", digits: int = 6, order_digits: int = ORDER_DIGITS
) -> DataFrame:
    """The k rows nearest to one vector with distance and score, nearest first by the distance of ``order_digits``, ties by key.

    One scan with a bounded heap in each task; nothing is shuffled but the k best of each. All columns are computed below the sort,
    as projections above it would make Spark sort the whole table.
    """
    found = rows.withColumn("distance", distance(F.col(column), literal(vector), metric))
    shown = found.withColumn("_order", F.round("distance", order_digits)).withColumn("distance", F.round("distance", digits))
    scored = shown.withColumn("score", F.round(distance_score(F.col("distance")), digits))
    return scored.orderBy("_order", key).limit(k).drop("_order")


def vector_topk_batch(
    rows: DataFrame, queries: DataFrame, k: int, key: str = "id", column: str = "vector", digits: int = 6, order_digits: int = ORDER_DIGITS
) -> DataFrame:
    """queries (query_id, vector) -> (query_id, key, distance, score, rank), squared Euclidean, ranked as in ``vector_topk``.

    The query set is dealt in blocks of a fixed size, each broadcast; every task keeps its k best for each query,
    so what is shuffled is bounded by tasks x queries x k, not by pairs. Null vectors are skipped.
    """
    found = None
    numbered = queries.where("vector is not null").select("query_id", "vector")
    total = numbered.count()
    # blocks by hash, filled to four fifths on average: no block of more than QUERY_BLOCK distinct ids is to be expected
    blocks = 1 if total <= QUERY_BLOCK else -(-total * 5 // (QUERY_BLOCK * 4))
    for block in range(blocks):
        some = numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        part = _topk_block(rows, some, k, key, column, order_digits)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy("ordered", "key")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
    rounded = ranked.drop("ordered").withColumn("distance", F.round("distance", digits))
    return rounded.withColumn("score", F.round(distance_score(F.col("distance")), digits))


def _topk_block(rows: DataFrame, queries: DataFrame, k: int, key: str, column: str, order_digits: int) -> DataFrame:
    got = queries.collect()  # one block of the stated query set
    ids = [r["query_id"] for r in got]
    matrix = np.array([r["vector"] for r in got], np.float64)
    shared = rows.sparkSession.sparkContext.broadcast((ids, matrix))

    def nearest(batches):
        names, q = shared.value
        held_keys = [np.empty(0, np.int64)] * len(names)
        held = [np.empty(0)] * len(names)  # distances, not rounded
        for batch in batches:
            valid = batch.filter(batch.column("v").is_valid())
            if not len(names) or not valid.num_rows:
                continue
            keys = valid.column("k").to_numpy(zero_copy_only=False)
            size = q.shape[1]
            m = valid.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            norms = (m * m).sum(axis=1)
            for lo in range(0, len(names), 64):
                some = q[lo : lo + 64]
                d = _squared_distances(m, norms, some)
                # the product only tells what may enter a query's k best: rows beyond its error and a rounding step are left out
                edge = np.partition(d, k - 1, axis=0)[k - 1] if len(m) > k else np.full(d.shape[1], np.inf)
                error = (size + 8) * 2.0**-50 * (norms.max() + (some * some).sum(axis=1))
                for j in range(d.shape[1]):
                    near = np.flatnonzero(~(d[:, j] > edge[j] + 10.0**-order_digits + error[j]))
                    dist, own = np.concatenate([held[lo + j], _summed(m[near], some[j])]), np.concatenate([held_keys[lo + j], keys[near]])
                    order = np.lexsort((own, np.round(dist, order_digits)))[:k]
                    held[lo + j], held_keys[lo + j] = dist[order], own[order]
        sizes = [len(h) for h in held]
        yield pa.record_batch(
            [
                pa.array(np.repeat(np.array(names, np.int64), sizes), pa.int64()),
                pa.array(np.concatenate(held_keys) if held else [], pa.int64()),
                pa.array(np.concatenate(held) if held else [], pa.float64()),
                pa.array(np.round(np.concatenate(held), order_digits) if held else [], pa.float64()),
            ],
            names=["query_id", "key", "distance", "ordered"],
        )

    thin = rows.select(F.col(key).cast("long").alias("k"), F.col(column).cast("array<double>").alias("v"))
    return thin.mapInArrow(nearest, "query_id long, key long, distance double, ordered double")


def _squared_distances(m: np.ndarray, norms: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(rows, queries) by one matrix product in double precision; its last bits depend on where a row stands."""
    return np.maximum(norms[:, None] + (q * q).sum(axis=1)[None, :] - 2 * (m @ q.T), 0.0)


def _summed(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances summed from the first coordinate to the last, as ``distance`` does."""
    return np.add.accumulate((m - q) ** 2, axis=1)[:, -1] if m.shape[1] else np.zeros(len(m))


def unique_files(ranked: DataFrame, k: int, file: str = "file_path", score: str = "score", key: str = "id") -> DataFrame:
    """Of results cut at 3k, the best of each file, then k."""
    cut = ranked.orderBy(F.desc(score), key).limit(OVERFETCH * k)
    first = Window.partitionBy(file).orderBy(F.desc(score), key)
    best = cut.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return best.orderBy(F.desc(score), key).limit(k)
