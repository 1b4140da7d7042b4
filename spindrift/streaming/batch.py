"""Operators on a table of changes (path, change_type, from_path, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD_FILES, THRESHOLD_RATE, WINDOW_SECONDS = 50, 20.0, 10
COLLECTION_DELAY_MS = 3000
DEBOUNCE_MS = 500

#: Fixed values, in the order that they are tested: what a path inside .git tells, and how long to wait.
GIT_SIGNS = (
    ((".git/HEAD", ".git/refs/heads"), "checkout"),
    ((".git/MERGE_HEAD", ".git/MERGE_MSG"), "merge"),
    ((".git/rebase-merge", ".git/rebase-apply"), "rebase"),
    ((".git/FETCH_HEAD",), "pull"),
    ((".git/ORIG_HEAD",), "reset"),
    ((".git/refs/stash",), "stash"),
)
GIT_DELAYS_MS = {"checkout": 5000, "merge": 4000, "rebase": 6000, "pull": 5000, "reset": 3000, "stash": 2000}


def last_per_path(changes: DataFrame, order: str = "ts", tie: str | None = None) -> DataFrame:
    """The latest change of each path; a path that was renamed away later is gone. Sorted by path.

    One aggregation keeps the latest change, another the latest rename away from each path.
    """
    place = F.struct(order, tie) if tie else F.struct(order)
    numbered = changes.withColumn("_at", place)
    payload = [c for c in changes.columns if c != "path"]
    latest = numbered.groupBy("path").agg(F.max_by(F.struct(*payload), "_at").alias("_row"), F.max("_at").alias("_at"))
    away = numbered.where((F.col("change_type") == "renamed") & F.col("from_path").isNotNull()).groupBy(
        F.col("from_path").alias("path")
    ).agg(F.max("_at").alias("_away"))
    kept = latest.join(away, "path", "left").where(F.col("_away").isNull() | (F.col("_away") <= F.col("_at")))
    return kept.select("path", *(F.col("_row")[c].alias(c) for c in payload)).orderBy("path")


def debounced(changes: DataFrame, quiet: str = "500 milliseconds") -> DataFrame:
    """One row per path and burst (changes closer than ``quiet``): the last change and how many there were."""
    return (
        changes.groupBy("path", F.session_window("ts", quiet).alias("burst"))
        .agg(F.max_by("change_type", "ts").alias("change_type"), F.count(F.lit(1)).alias("n"))
        .select("path", F.col("burst.start").alias("burst_start"), F.col("burst.end").alias("burst_end"), "change_type", "n")
    )


def rates(changes: DataFrame, seconds: int = WINDOW_SECONDS, by: list[str] | None = None) -> DataFrame:
    """For every second with changes the number in the ``seconds`` up to it, and that number a second.

    Counts are summed by second before the window, which then sees at most one row for each second.
    """
    keys = by or []
    return _rates(_by_second(changes, keys).withColumn("_counts", F.col("n")), seconds, keys)


def _by_second(changes: DataFrame, keys: list[str]) -> DataFrame:
    return changes.groupBy(*keys, F.unix_seconds("ts").alias("second")).agg(F.count(F.lit(1)).alias("n"))


def _rates(second: DataFrame, seconds: int, keys: list[str]) -> DataFrame:
    """(second, n, _counts) -> (second, n, recent, rate): sums of ``_counts`` over the seconds before."""
    # stretches of at least one window are dealt out; each also gets the seconds of the stretch before that its windows reach back to
    size = max(3600, seconds)
    stretch = F.floor(F.col("second") / size)
    own = second.select("*", stretch.alias("_stretch"), F.lit(True).alias("_own"))
    reach = second.where(F.pmod("second", F.lit(size)) >= size - seconds).select("*", (stretch + 1).alias("_stretch"), F.lit(False).alias("_own"))
    back = Window.partitionBy(*keys, "_stretch").orderBy("second").rangeBetween(-seconds, 0)
    counted = own.unionByName(reach).withColumn("recent", F.sum("_counts").over(back)).where("_own")
    return counted.select(*keys, "second", "n", "recent", (F.col("recent") / float(seconds)).alias("rate"))


def mass_changes(changes: DataFrame, files: int = THRESHOLD_FILES, rate: float = THRESHOLD_RATE, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Seconds (batches) with a mass change: a batch of ``files`` or more, or ``rate`` a second over the window.

    As in the live detector, batches over the first threshold do not count into rates.
    """
    batches = _by_second(changes, []).withColumn("_counts", F.when(F.col("n") >= files, 0).otherwise(F.col("n")))
    found = _rates(batches, seconds, [])
    reason = F.when(F.col("n") >= files, "threshold").when(F.col("rate") >= rate, "rate")
    return found.withColumn("reason", reason).where("reason is not null")


def is_git_path(path) -> Column:
    return F.array_contains(F.split(path, "/"), ".git")


def git_operation(path) -> Column:
    """The operation that one path tells of; null if none."""
    found = F.lit(None).cast("string")
    for signs, name in reversed(GIT_SIGNS):
        test = F.lit(False)
        for s in signs:
            test = test | F.contains(path, F.lit(s))
        found = F.when(test, name).otherwise(found)
    return F.when(is_git_path(path), found)


def git_batches(changes: DataFrame, by: list[str], order: str = "ts") -> DataFrame:
    """For each batch: is_git, operation, delay_ms. The first path that tells decides; an index alone is a checkout."""
    marked = changes.withColumn("_op", git_operation(F.col("path")))
    found = marked.groupBy(*by).agg(
        F.bool_or(is_git_path(F.col("path"))).alias("is_git"),
        F.min_by("_op", F.when(F.col("_op").isNotNull(), F.struct(order, "path"))).alias("_first"),
        F.bool_or(is_git_path(F.col("path")) & F.contains("path", F.lit(".git/index"))).alias("_index"),
    )
    named = found.withColumn("operation", F.coalesce("_first", F.when(F.col("_index"), "checkout")))
    delay = F.create_map(*(F.lit(x) for pair in GIT_DELAYS_MS.items() for x in pair))[F.col("operation")]
    return named.select(*by, "is_git", "operation", F.coalesce(delay, F.lit(COLLECTION_DELAY_MS)).alias("delay_ms"))


def watched(changes: DataFrame, extensions=(), ignored=()) -> DataFrame:
    """Changes of files with a watched extension (all if none is given) outside ignored paths."""
    from ..functions.paths import has_extension, is_ignored

    return changes.where(has_extension(F.col("path"), extensions) & ~is_ignored(F.col("path"), ignored))
