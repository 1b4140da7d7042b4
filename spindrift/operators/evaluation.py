"""Search-quality measures for many queries at once.

``results`` has (query_id, rank, item), ``expected`` has (query_id, item), one row for each expected item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(results: DataFrame, expected: DataFrame, digits: int = 6) -> DataFrame:
    """query_id, precision, recall, f1, mrr, ndcg.

    Precision counts relevant rows, recall distinct expected items (1 if none is expected), mrr the first relevant
    row. ndcg gains 1 at rank 1 and 1 / log2(rank) below, over the same of min(expected, results) ideal rows. Queries without
    results have 0 but for recall.
    """
    wanted = expected.select("query_id", "item").distinct().withColumn("hit", F.lit(1))
    totals = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"))
    return measures(results.select("query_id", "rank", "item").join(wanted, ["query_id", "item"], "left"), totals, digits)


def measures(judged: DataFrame, totals: DataFrame, digits: int = 6) -> DataFrame:
    """The same from results that are judged already (query_id, rank, item, hit: 1 or null) and (query_id, n_expected).

    Where what is expected follows from a rule, such as a shared label, the expected items need not be listed.
    """
    gain = F.when(F.col("rank") == 1, 1.0).otherwise(1 / F.log2(F.col("rank")))
    per_query = judged.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_results"),
        F.count("hit").alias("n_relevant"),
        F.countDistinct(F.when(F.col("hit") == 1, F.col("item"))).alias("n_found"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("hit") == 1, gain).otherwise(0.0)).alias("dcg"),
    )
    both = per_query.join(totals, "query_id", "full").fillna(0, ["n_results", "n_relevant", "n_found", "dcg", "n_expected"])
    ideal_rows = F.least("n_expected", "n_results")
    ideal = F.aggregate(
        F.when(ideal_rows > 0, F.sequence(F.lit(1), ideal_rows.cast("int"))).otherwise(F.array().cast("array<int>")),
        F.lit(0.0), lambda acc, i: acc + F.when(i == 1, 1.0).otherwise(1 / F.log2(i)),
    )
    share = lambda a, b, empty: F.when(b > 0, a / b).otherwise(F.lit(empty))
    measured = both.select(
        "query_id",
        share(F.col("n_relevant"), F.col("n_results"), 0.0).alias("precision"),
        share(F.col("n_found"), F.col("n_expected"), 1.0).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        share(F.col("dcg"), ideal, 0.0).alias("ndcg"),
    )
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return measured.select("query_id", *(F.round(c, digits).alias(n) for c, n in ((p, "precision"), (r, "recall"), (f1, "f1"), (F.col("mrr"), "mrr"), (F.col("ndcg"), "ndcg"))))


def below_threshold(measures: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Queries whose precision or recall is less than (query_id, min_precision, min_recall) ask for."""
    joined = measures.join(thresholds, "query_id")
    return joined.where((F.col("precision") < F.col("min_precision")) | (F.col("recall") < F.col("min_recall")))


def ranks(results: DataFrame, *order) -> DataFrame:
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))
