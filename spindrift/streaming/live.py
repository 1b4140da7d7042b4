"""The change stream as Structured Streaming: stateful accumulation and incremental merges."""

from __future__ import annotations

import logging
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.chunking import chunk_files
from ..operators.embedding import embed
from ..plans.store import scratch
from .batch import COLLECTION_DELAY_MS, GIT_DELAYS_MS, GIT_SIGNS, THRESHOLD_FILES, THRESHOLD_RATE, WINDOW_SECONDS, last_per_path, watched

log = logging.getLogger(__name__)

_STATE = "change_type string, from_path string, ts timestamp"


class Accumulator:
    """Latest change by path; a rename also drops what was held of the old path. The clock is a parameter."""

    def __init__(self, clock):
        self.clock, self.held, self.started, self.received = clock, {}, None, 0

    def add(self, path: str, change_type: str, from_path: str | None = None) -> None:
        self.received += 1
        if self.started is None:
            self.started = self.clock()
        if change_type == "renamed" and from_path is not None:
            self.held.pop(from_path, None)
        self.held[path] = (path, change_type, from_path)

    def due(self, delay: float) -> bool:
        return self.started is not None and self.clock() - self.started >= delay

    def flush(self) -> list[tuple]:
        out = sorted(self.held.values())
        self.held, self.started, self.received = {}, None, 0
        return out


class MassDetector:
    """True for a batch of many files, or many changes in the last seconds; large batches leave the rate alone."""

    def __init__(self, clock, files: int = THRESHOLD_FILES, rate: float = THRESHOLD_RATE, seconds: int = WINDOW_SECONDS):
        self.clock, self.files, self.limit, self.seconds = clock, files, rate, seconds
        self.recent: deque = deque()

    def detect(self, changes: int) -> bool:
        if changes >= self.files:
            return True
        self.recent.append((self.clock(), changes))
        return self.rate() >= self.limit

    def rate(self) -> float:
        oldest = self.clock() - self.seconds
        while self.recent and self.recent[0][0] < oldest:
            self.recent.popleft()
        return sum(n for _, n in self.recent) / float(self.seconds)


class ChangeProcessor(StatefulProcessor):
    """State of one project: a map from path to its latest change, emitted in path order when the timer ends.

    With ``eager`` changes are handed on at once, as long as they are few and none is git's: a mass change (many in one
    batch, or a high rate over the last seconds) or a path inside .git starts a collection, with the delay of what git does, and
    whatever comes until its end is collected too.
    """

    def __init__(self, delay_ms: int = COLLECTION_DELAY_MS, eager: bool = False, files: int = THRESHOLD_FILES, rate: float = THRESHOLD_RATE, seconds: int = WINDOW_SECONDS):
        self.delay_ms, self.eager, self.files, self.rate, self.seconds = delay_ms, eager, files, rate, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.changes = handle.getMapState("changes", "path string", _STATE)
        self.started = handle.getValueState("started", "at long")
        self.recent = handle.getMapState("recent", "at long", "n long")

    def _mass(self, n: int, now: int) -> bool:
        if n >= self.files:
            return True
        for (at,) in [k for k, _ in self.recent.iterator()]:
            if at < now - 1000 * self.seconds:
                self.recent.removeKey((at,))
        held = self.recent.getValue((now,))
        self.recent.updateValue((now,), (n + (held[0] if held else 0),))
        return sum(v[0] for _, v in self.recent.iterator()) >= self.rate * self.seconds

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, came, operation, git = timerValues.getCurrentProcessingTimeInMs(), [], None, False
        for frame in rows:
            for r in frame.sort_values("ts", kind="stable").itertuples():
                old = r.from_path if isinstance(r.from_path, str) else None
                came.append((r.path, r.change_type, old, r.ts.to_pydatetime()))
                git = git or ".git" in r.path.split("/")
                operation = operation or operation_of(r.path)
        held = self.started.exists()
        if came and self.eager and not held and not git and not self._mass(len(came), now):
            yield _changes([(key[0], *c) for c in came])
            return
        for path, kind, old, ts in came:
            if kind == "renamed" and old and self.changes.containsKey((old,)):
                self.changes.removeKey((old,))
            self.changes.updateValue((path,), (kind, old, ts))
        if came and not held:
            self.started.update((now,))
            self.handle.registerTimer(now + GIT_DELAYS_MS.get(operation, self.delay_ms))
        yield _changes([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [(key[0], k[0], *v) for k, v in self.changes.iterator()]
        self.changes.clear()
        self.started.clear()
        yield _changes(sorted(rows))

    def close(self) -> None:
        pass


def _changes(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["project", "path", "change_type", "from_path", "ts"])


def operation_of(path: str) -> str | None:
    """What one path tells of git's work; an index alone is a checkout. The same signs as ``batch.git_operation``."""
    if ".git" not in path.split("/"):
        return None
    return next((name for signs, name in GIT_SIGNS if any(s in path for s in signs)), "checkout" if ".git/index" in path else None)


def accumulated(stream: DataFrame, delay_ms: int = COLLECTION_DELAY_MS, **options) -> DataFrame:
    """A stream of (project, path, change_type, from_path, ts), each path once for each collection."""
    return stream.groupBy("project").transformWithStateInPandas(
        statefulProcessor=ChangeProcessor(delay_ms, **options),
        outputStructType="project string, path string, change_type string, from_path string, ts timestamp",
        outputMode="Append", timeMode="ProcessingTime",
    )


def windowed_rates(stream: DataFrame, late: str = "10 seconds", window: str = "10 seconds", slide: str = "1 second") -> DataFrame:
    """Changes a second over sliding windows of event time."""
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", window, slide)).agg(F.count(F.lit(1)).alias("n"))
    seconds = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", (F.col("n") / seconds).alias("rate"))


def apply_changes(store, changes: DataFrame, read, provider, strategy: str = "ast", extensions=(), ignored=()) -> dict[str, int]:
    """Merge a batch of changes into a chunk store and count what happened.

    ``read(paths)`` gives (file_path, content, mtime) of paths that exist. All changes of the batch become one new
    version: files that changed lose their chunks and get new ones, deleted and renamed-away files lose theirs, as do
    files that are empty now. The batch's last changes and its chunks are written below the store's root once, and read
    from there; counts come from the rows that really go and come.
    """
    with scratch(store.paths) as held:
        last = held(watched(last_per_path(changes), extensions, ignored), "changes")
        kinds = {r["change_type"]: r["n"] for r in last.groupBy("change_type").agg(F.count(F.lit(1)).alias("n")).collect()}
        away = last.where("change_type = 'renamed' and from_path is not null").select(F.col("from_path").alias("file_path"))
        gone = last.select(F.col("path").alias("file_path")).union(away).distinct()
        live = last.where("change_type <> 'deleted'").select(F.col("path").alias("file_path"))
        chunks = held(chunk_files(read(live).where(F.trim("content") != ""), strategy), "chunks")
        counted = store.merge(embed(chunks.where("error is null").drop("origin", "error"), provider), gone)
        errors = chunks.where("error is not null").count()
    return {
        "files_added": kinds.get("created", 0) + kinds.get("renamed", 0), "files_modified": kinds.get("modified", 0),
        "files_deleted": kinds.get("deleted", 0), "chunks_created": counted["created"], "chunks_removed": counted["removed"], "errors": errors,
    }


def watch(stream: DataFrame, store, read, provider, checkpoint: str, interval: str = "500 milliseconds", report=None, keywords=None, metrics=None, collect: dict | None = None, **options):
    """Start the query that keeps a store, and its keyword index if given, fresh; restarted from its checkpoint.

    Every micro-batch is one merge. With ``collect`` (options of ``accumulated``) mass changes and git's work are collected first.
    """

    def merge(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        stats = apply_changes(store, batch.select("path", "change_type", "from_path", "ts"), read, provider, **options)
        if keywords is not None:
            keywords.refresh(store)
        store.vacuum()
        if metrics is not None:
            changed = stats["files_added"] + stats["files_modified"] + stats["files_deleted"]
            metrics.observe("batched_files_count", changed)
            metrics.count("mass_changes_total", by=int(changed >= THRESHOLD_FILES))
        log.info("changes applied: %s", stats)
        if report is not None:
            report(stats)

    if collect is not None:
        stream = accumulated(stream.withColumn("project", F.lit("")), eager=True, **collect)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
