import time
from datetime import datetime, timedelta

from spindrift.operators.embedding import HashProvider
from spindrift.plans.store import ChunkStore
from spindrift.schemas import CHANGES
from spindrift.sources.changes import ChangeSource, differences, listing
from spindrift.streaming import batch
from spindrift.streaming.live import Accumulator, MassDetector, accumulated, apply_changes, watch, windowed_rates

T0 = datetime(2024, 1, 1)


def changes(spark, *rows):
    return spark.createDataFrame([(p, k, f, T0 + timedelta(seconds=s)) for p, k, f, s in rows], CHANGES)


def test_last_per_path(spark):
    got = batch.last_per_path(changes(spark, ("a", "created", None, 0), ("a", "modified", None, 5), ("b", "deleted", None, 1), ("c", "renamed", "a", 9), ("d", "renamed", "b", 0)))
    assert [(r.path, r.change_type, r.from_path) for r in got.collect()] == [("b", "deleted", None), ("c", "renamed", "a"), ("d", "renamed", "b")]


def test_rates_and_mass_changes(spark):
    rows = changes(spark, *[(f"f{i}", "modified", None, 3599) for i in range(30)], *[(f"g{i}", "modified", None, 3605) for i in range(175)], ("h", "modified", None, 3700))
    got = {r.second - int(T0.timestamp()) % 10**12: r for r in batch.rates(rows).collect()}
    assert sorted((r.n, r.recent) for r in got.values()) == [(1, 1), (30, 30), (175, 205)]
    assert [(r.n, r.reason) for r in batch.mass_changes(rows, files=500).collect()] == [(175, "rate")]
    assert [r.reason for r in batch.mass_changes(rows).collect()] == ["threshold"]


def test_git(spark):
    rows = [(1, "a/.git/HEAD", 0), (2, "x/.git/MERGE_HEAD", 0), (2, ".git/HEAD", 1), (3, ".git/rebase-merge/done", 0), (4, "src/a.rs", 0), (5, ".git/index", 0), (6, "my.git/HEAD", 0)]
    got = {r.b: (r.is_git, r.operation, r.delay_ms) for r in batch.git_batches(spark.createDataFrame(rows, "b int, path string, ts int"), ["b"]).collect()}
    assert got == {1: (True, "checkout", 5000), 2: (True, "merge", 4000), 3: (True, "rebase", 6000), 4: (False, None, 3000), 5: (True, "checkout", 5000), 6: (False, None, 3000)}


def test_accumulator_and_detector():
    now = [0.0]
    a = Accumulator(lambda: now[0])
    assert not a.due(1)
    for path, kind, old in (("b", "created", None), ("a", "created", None), ("a", "modified", None), ("c", "renamed", "b")):
        a.add(path, kind, old)
    assert (len(a.held), a.received, a.due(1)) == (2, 4, False)
    now[0] = 1.5
    assert a.due(1) and [x[:2] for x in a.flush()] == [("a", "modified"), ("c", "renamed")] and not a.held and not a.due(0)
    d = MassDetector(lambda: now[0])
    assert [d.detect(n) for n in (30, 49, 50, 100)] == [False, False, True, True] and d.rate() == 7.9
    now[0] = 30
    assert d.rate() == 0 and not d.detect(2)


def test_listing_differences(tmp_path):
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("2")
    before = listing(str(tmp_path))
    (tmp_path / "a").rename(tmp_path / "z")
    (tmp_path / "b").unlink()
    (tmp_path / "c").mkdir()
    (tmp_path / "c/d").write_text("new")
    got = sorted(differences(before, listing(str(tmp_path))))
    assert ("z", "renamed", "a") in got or ("c/d", "renamed", "b") in got
    assert {p for p, *_ in got} >= {"z", "c/d"}


def test_stateful_stream(spark, tmp_path):
    src = tmp_path / "in"
    first = [("p", "a", "created", None, 0), ("p", "b", "created", None, 1), ("p", "a", "modified", None, 2), ("p", "c", "renamed", "b", 3), ("q", "a", "deleted", None, 0)]
    schema = "project string, path string, change_type string, from_path string, ts timestamp"
    spark.createDataFrame([(*r[:4], T0 + timedelta(seconds=r[4])) for r in first], schema).coalesce(1).write.parquet(str(src))
    q = accumulated(spark.readStream.schema(schema).parquet(str(src)), 200).writeStream.format("memory").queryName("acc").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(80):
            if spark.table("acc").count() >= 3:
                break
            time.sleep(0.5)
        got = sorted((r.project, r.path, r.change_type) for r in spark.table("acc").collect())
    finally:
        q.stop()
    assert got == [("p", "a", "modified"), ("p", "c", "renamed"), ("q", "a", "deleted")]


def test_windowed_rates(spark, tmp_path):
    changes(spark, ("a", "modified", None, 0), ("b", "modified", None, 1), ("c", "modified", None, 60)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHANGES).parquet(str(tmp_path / "in"))
    q = windowed_rates(stream, slide="10 seconds").writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert [(r.n, r.rate) for r in spark.table("rates").where("n > 1").collect()] == [(2, 0.2)]
    finally:
        q.stop()


def reader(spark, root):
    def read(paths):
        rows = [(r.file_path, (root / r.file_path).read_text(), 1) for r in paths.collect() if (root / r.file_path).exists()]
        return spark.createDataFrame(rows, "file_path string, content string, mtime long")

    return read


def test_apply_changes(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for n, t in (("a.py", "def a(): pass\n"), ("b.py", "def b(): pass\n"), ("e.py", " ")):
        (tmp_path / "t" / n).write_text(t)
    store = ChunkStore(spark, f"file://{tmp_path}/s", 8)
    run = lambda *rows: apply_changes(store, changes(spark, *rows), reader(spark, tmp_path / "t"), HashProvider(8))
    assert run(("a.py", "created", None, 0), ("b.py", "created", None, 0), ("e.py", "created", None, 0)) == {
        "files_added": 3, "files_modified": 0, "files_deleted": 0, "chunks_created": 2, "chunks_removed": 0, "errors": 0,
    }
    (tmp_path / "t/a.py").write_text("def a2(): pass\n")
    (tmp_path / "t/b.py").rename(tmp_path / "t/c.py")
    got = run(("a.py", "modified", None, 0), ("c.py", "renamed", "b.py", 1))
    assert (got["chunks_created"], got["chunks_removed"]) == (2, 2)
    assert sorted((r.file_path, r.symbol_name) for r in store.read().collect()) == [("a.py", "a2"), ("c.py", "b")]
    assert run(("a.py", "deleted", None, 0))["chunks_removed"] == 1 and store.count() == 1


def test_watch_a_folder(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    (root / "a.py").write_text("def a(): pass\n")
    spark.dataSource.register(ChangeSource)
    store, seen = ChunkStore(spark, f"file://{tmp_path}/s", 8), []
    stream = spark.readStream.format("file_changes").option("path", str(root)).option("existing", "true").load()
    q = watch(stream, store, reader(spark, root), HashProvider(8), str(tmp_path / "cp"), report=seen.append)
    try:
        deadline = time.time() + 60
        while time.time() < deadline and store.count() < 1:
            time.sleep(0.5)
        (root / "b.py").write_text("def b(): pass\n")
        (root / "a.py").unlink()
        while time.time() < deadline and [r.file_path for r in store.read().collect()] != ["b.py"]:
            time.sleep(0.5)
        assert [r.symbol_name for r in store.read().collect()] == ["b"]
    finally:
        q.stop()
    assert seen and seen[0]["files_added"] == 1
