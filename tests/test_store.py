"""The table in buckets, the keyword index beside it, files, ignore rules, providers and the change stream's collections."""

import json
import threading
import time
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions.units import doc_comment, extract_units
from spindrift.operators import bm25, embedding, fusion, vector
from spindrift.plans.engine import Engine
from spindrift.plans.samples import SAMPLES
from spindrift.plans.store import BUCKETS, CROWDED, ChunkStore, ConcurrentChange, KeywordIndex
from spindrift.schemas import CHUNKS
from spindrift.sources.changes import ChangeReader, differences, listing
from spindrift.sources.files import get_file, gitignore_rules, ignore_rules, is_path_ignored, list_tree, read_tree, without_ignored
from spindrift.streaming import batch
from spindrift.streaming.live import MassDetector, accumulated, operation_of

T0 = datetime(2024, 1, 1)


def rows(spark, *pairs):
    full = [(f"{p}#{i}", t, p, 1, 2, "rust", [1.0, 0.0], 0, None, None, None, None, None, None) for i, (p, t) in enumerate(pairs)]
    return spark.createDataFrame(full, CHUNKS)


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/t", 2)
    store.append(rows(spark, *((f"f{i}.rs", f"text {i}") for i in range(200))))
    before = store.state()["parts"]
    assert len(before) > BUCKETS // 2
    counts = store.merge(rows(spark, ("f7.rs", "new")), spark.createDataFrame([("f9.rs",), ("none.rs",)], "file_path string"))
    after = store.state()["parts"]
    assert counts == {"created": 1, "removed": 2} and store.count() == 199
    changed = {b for b in before if after.get(b) != before[b]}
    assert 1 <= len(changed) <= 3
    touched = store.table.read(store.state(), {int(b) for b in changed})
    files = touched.inputFiles()
    assert files and all(any(f"bucket={b}/" in f for b in changed) for f in files)
    assert touched.count() < 40


def test_of_two_writers_the_second_fails(spark, tmp_path):
    one, other = (ChunkStore(spark, f"file://{tmp_path}/t", 2) for _ in range(2))
    one.append(rows(spark, ("a.rs", "x")))
    held = other.state()
    one.append(rows(spark, ("b.rs", "x")))
    with pytest.raises(ConcurrentChange):
        other.table.publish(held, parts={})
    assert other.count() == 2
    other.append(rows(spark, ("c.rs", "x")))
    assert one.count() == 3


def test_many_small_changes_stay_in_few_parts(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/t", 2, buckets=1)
    for i in range(CROWDED + 3):
        store.merge(rows(spark, (f"n{i}.rs", "x")), spark.createDataFrame([], "file_path string"))
    assert store.count() == CROWDED + 3 and len(store.state()["parts"]["0"]) <= CROWDED + 1
    store.vacuum()
    assert store.count() == CROWDED + 3 and len(store.paths.children("versions")) == 4


def test_keyword_index_follows_the_table(spark, tmp_path):
    store, keywords = ChunkStore(spark, f"file://{tmp_path}/t", 2), KeywordIndex(spark, f"file://{tmp_path}/k")
    assert not keywords.exists() and keywords.tables()[0].count() == 0
    store.append(rows(spark, *((f"f{i}.rs", f"common word{i}") for i in range(100))))
    assert len(keywords.refresh(store)) == len(store.state()["parts"]) and keywords.refresh(store) == []
    store.merge(rows(spark, ("f3.rs", "fresh word3")), spark.createDataFrame([("f4.rs",)], "file_path string"))
    assert 1 <= len(keywords.refresh(store)) <= 2
    posted, lengths = keywords.tables()
    want = bm25.postings(store.read(False), ["id", "file_path"])
    order = lambda df: sorted(map(tuple, df.select("term", "id", "file_path", "tf").collect()))
    assert order(posted) == order(want) and lengths.count() == 99
    hits = bm25.bm25_search_index(posted, lengths, spark.createDataFrame([(0, "fresh word9")], "query_id long, query string"), 5, ["id", "file_path"])
    assert {r.file_path for r in hits.collect()} == {"f3.rs", "f9.rs"}
    store.clear()
    keywords.refresh(store)
    assert keywords.tables()[0].count() == 0


def test_ranks_come_before_rounding(spark):
    near = [(i, [0.1 + i * 1e-8, 0.0]) for i in (3, 1, 2)]
    table = spark.createDataFrame(near, "id long, vector array<double>")
    assert [r.id for r in vector.vector_topk(table, [0.1, 0.0], 3).collect()] == [1, 2, 3]
    asked = spark.createDataFrame([(0, [0.0, 0.0])], "query_id long, vector array<double>")
    assert [r.key for r in vector.vector_topk_batch(table, asked, 3).orderBy("rank").collect()] == [1, 2, 3]


def test_batch_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 8)
    table = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(50)], "id long, vector array<double>")
    asked = table.select(F.col("id").alias("query_id"), "vector")
    found = vector.vector_topk_batch(table, asked, 1).collect()
    assert sorted((r.query_id, r.key) for r in found) == [(i, i) for i in range(50)]


def test_whole_ranks(spark):
    table = spark.range(0, 1000, 1, 7).select("id", (F.col("id") * 37 % 101).alias("x"))
    got = {r.id: r["rank"] for r in fusion.ranked_whole(table, [F.desc("x"), "id"]).collect()}
    order = sorted(range(1000), key=lambda i: (-(i * 37 % 101), i))
    assert got == {i: n for n, i in enumerate(order, 1)}
    assert fusion.ranked_whole(table.limit(0), ["id"]).collect() == []


def test_bm25_from_texts_reads_them_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    asked = spark.createDataFrame([(0, "the of")], "query_id long, query string")
    found = bm25.bm25_search(docs, asked, 5, "doc_id", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and found.count() == 5
    assert bm25.bm25_search(docs, spark.createDataFrame([(0, "?!")], "query_id long, query string"), 5, "doc_id", "text").collect() == []


def test_rates_over_long_windows(spark):
    changes = spark.createDataFrame([("a", T0 + timedelta(seconds=s)) for s in (100, 3500, 7300, 20_000)], "path string, ts timestamp")
    got = {r.second - int(T0.timestamp()): r.recent for r in batch.rates(changes, 7200).collect()}
    assert sorted(got.values()) == [1, 2, 2, 3] or sorted(got.values()) == [1, 1, 2, 3]
    times = [100, 3500, 7300, 20_000]
    assert sorted(got.values()) == sorted(sum(1 for t in times if s - 7200 <= t <= s) for s in times)


def test_mass_changes_as_the_detector_has_it(spark):
    counts = {0: 3, 4: 60, 6: 8, 12: 9, 40: 1}
    changes = spark.createDataFrame([(f"p{i}", T0 + timedelta(seconds=s)) for s, n in counts.items() for i in range(n)], "path string, ts timestamp")
    got = {r.second: r.reason for r in batch.mass_changes(changes, 50, 1.5, 10).collect()}
    now = [0.0]
    detector = MassDetector(lambda: now[0], 50, 1.5, 10)
    want = set()
    for s, n in counts.items():
        now[0] = float(s)
        if detector.detect(n):
            want.add(s)
    base = min(got) - 4
    assert {s - base for s in got} == want == {4, 12}


# --- files


def tree(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def test_ignore_rules_of_every_folder(spark, tmp_path):
    tree(tmp_path / "t", {
        ".gitignore": "*.log.py\nbuild/\n!keep.log.py\n", ".git/info/exclude": "local.py\n", "a.log.py": "x", "keep.log.py": "x", "local.py": "x",
        "build/x.py": "x", "build/keep.log.py": "x", "sub/.gitignore": "/own.py\n!a.log.py\n", "sub/own.py": "x", "sub/deep/own.py": "x", "sub/a.log.py": "x", "everywhere.py": "x",
    })
    (tmp_path / "global").write_text("everywhere.py\n")
    root = f"file://{tmp_path}/t"
    rules = ignore_rules(spark, root, f"{tmp_path}/global")
    left = without_ignored(list_tree(spark, root, ("py",), ()), rules)
    assert sorted(r.file_path for r in left.collect()) == ["keep.log.py", "sub/a.log.py", "sub/deep/own.py"]
    assert ignore_rules(spark, f"{root}/none") == []


@pytest.mark.parametrize(
    ("rule", "path", "want"),
    [
        ("a b", "a b", True), ("a\\ ", "a ", True), ("*.x", "d/e.x", True), ("/x", "d/x", False), ("d/", "d", False), ("d/", "d/e/f", True), ("**/q", "a/b/q", True),
        ("a/**", "a/b/c", True), ("a/**/z", "a/z", True), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("\\#c", "#c", True), ("\\!c", "!c", True), ("?", "/", False),
    ],
)
def test_ignore_rule(rule, path, want):
    import re

    assert is_path_ignored(path, [(i, f, re.compile(p)) for i, f, p in gitignore_rules(rule)]) is want


def test_reading_by_name_opens_nothing_else(spark, tmp_path):
    tree(tmp_path / "t", {"a%20b.py": "one", "a b.py": "two", "c.py": "three", "sub/d.py": "four", "x[1].py": "five"})
    root = f"file://{tmp_path}/t"
    asked = lambda *p: spark.createDataFrame([(x,) for x in p], "file_path string")
    files, errors = read_tree(spark, root, asked("a%20b.py", "a b.py", "gone.py", "sub"))
    assert sorted((r.file_path, r.content) for r in files.collect()) == [("a b.py", "two"), ("a%20b.py", "one")] and errors.count() == 0
    assert [r.content for r in read_tree(spark, root, asked("x[1].py"))[0].collect()] == ["five"]
    assert len(read_tree(spark, root, asked("c.py"))[0].inputFiles()) == 1
    assert read_tree(spark, root, asked())[0].count() == 0 and read_tree(spark, root)[0].count() == 5
    assert get_file(f"file://{tmp_path}/t", "c.py") == "three"


def test_listings_outside_the_offset(tmp_path):
    tree(tmp_path / "t", {"a": "1", "b/c": "2"})
    reader = ChangeReader(f"file://{tmp_path}/t", False, str(tmp_path / "state"))
    start = reader.initialOffset()
    assert len(start["files"]) == 32 and len(list((tmp_path / "state").iterdir())) == 1
    tree(tmp_path / "t", {"d": "3"})
    found, end = reader.read(start)
    assert [r[:2] for r in found] == [("d", "created")]
    again = ChangeReader(f"file://{tmp_path}/t", False, str(tmp_path / "state"))
    assert [r[:2] for r in again.readBetweenOffsets(start, end)] == [("d", "created")]
    for _ in range(3):
        tree(tmp_path / "t", {"d": str(time.time_ns())})
        _, end = reader.read(end)
        reader.commit(end)
    assert len(list((tmp_path / "state").iterdir())) <= 4
    assert differences({"a": [1, 2, 0]}, {"b": [1, 2, 0]}) == [("b", "created", None), ("a", "deleted", None)]
    assert listing(str(tmp_path / "t")).keys() == listing(f"file://{tmp_path}/t").keys()


# --- units


@pytest.mark.parametrize("sample", SAMPLES, ids=[s[0] for s in SAMPLES])
def test_samples(sample):
    language, _, text, want = sample
    fill = lambda x: x.replace("{k}", "7").replace("{s}", "3") if isinstance(x, str) else x
    got = [(u.kind, u.name, u.start_line, u.end_line, u.signature, u.parent, u.visibility, u.doc) for u in extract_units(fill(text), language)]
    assert got == [tuple(map(fill, u)) for u in want]


def test_doc_comments():
    doc = lambda text, language: doc_comment(text.split("\n"), text.count("\n") + 1, language)
    assert doc("/// One.\n///  two\n#[inline]\nfn f() {}", "rust") == "One.\n two"
    assert doc("//// no\nfn f() {}", "rust") is None and doc("// no\nfn f() {}", "rust") is None and doc("fn f() {}", "rust") is None
    assert doc("/**\n * A.\n *\n * B.\n */\n@Override\nvoid f() {}", "java") == "A.\n\nB."
    assert doc("/* no */\nvoid f() {}", "java") is None and doc("/** one */\nfunction f() {}", "typescript") == "one"
    assert doc("// A does.\n// More.\nfunc A() {}", "go") == "A does.\nMore."


# --- providers


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _onnx(vectors):
    """A model with one node: it looks the vectors of its input ids up."""
    shape = lambda *names: _field(2, b"".join(_field(1, _field(2, n) if isinstance(n, str) else _field(1, n)) for n in names))
    value = lambda name, kind, *dims: _field(1, name) + _field(2, _field(1, _field(1, kind) + shape(*dims)))
    weights = b"".join(_field(1, d) for d in vectors.shape) + _field(2, 1) + _field(8, "w") + _field(9, vectors.astype("<f4").tobytes())
    node = _field(1, "w") + _field(1, "input_ids") + _field(2, "states") + _field(4, "Gather")
    graph = _field(1, node) + _field(2, "g") + _field(5, weights) + _field(11, value("input_ids", 7, "n", "t")) + _field(12, value("states", 1, "n", "t", vectors.shape[1]))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(2, 13))


def test_local_model(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    tokenizers = pytest.importorskip("tokenizers")
    words = {"[UNK]": 0, "a": 1, "b": 2}
    tokenizer = tokenizers.Tokenizer(tokenizers.models.WordLevel(words, "[UNK]"))
    tokenizer.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "t.json"))
    vectors = np.array([[1, 0, 0], [0, 2, 0], [0, 0, 2]], np.float32)
    (tmp_path / "m.onnx").write_bytes(_onnx(vectors))
    model = embedding.LocalModelProvider(str(tmp_path / "m.onnx"), str(tmp_path / "t.json"), 3, max_batch=2)
    half = float(np.sqrt(0.5))
    texts = {"a": [0, 1, 0], "a b": [0, half, half], "": [1, 0, 0], "zz": [1, 0, 0], "b b b": [0, 0, 1]}
    assert np.allclose(model.embed(list(texts)), list(texts.values()), atol=1e-6)
    table = spark.createDataFrame([(t,) for t in texts], "content string").repartition(2)
    for r in embedding.embed(table, model).collect():
        assert np.allclose(r.vector, texts[r.content], atol=1e-6)
    assert model.healthy() and model.capabilities() == {"name": "local", "dimension": 3, "max_batch": 2, "local": True, "batches": True}
    assert not embedding.LocalModelProvider("/none", "/none", 3).healthy() and isinstance(model, embedding.Provider)


def test_json_service():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            data = [{"index": i, "embedding": [float(len(t)), float(self.headers["Authorization"] == "Bearer k")]} for i, t in enumerate(asked["input"])]
            body = json.dumps({"data": data[::-1]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            return

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    call = embedding.json_service(f"http://127.0.0.1:{server.server_port}/v1/embeddings", "m", "k")
    remote = embedding.RemoteProvider(call, "r", 2, max_batch=2, workers=4)
    assert remote.embed(["a", "bb", "ccc"]) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]] and remote.per_minute == 875
    assert remote.healthy() and not remote.capabilities()["local"]
    server.shutdown()
    chain = embedding.FallbackProvider([embedding.RemoteProvider(call, "gone", 2, retries=0), embedding.HashProvider(2)])
    assert len(chain.embed_query("x")) == 2


# --- collections of changes


def test_operation_of_a_path(spark):
    paths = [".git/HEAD", "a/.git/refs/heads/x", ".git/MERGE_MSG", ".git/rebase-apply/1", ".git/FETCH_HEAD", ".git/ORIG_HEAD", ".git/refs/stash", ".git/index", "src/a.rs", "x.git/HEAD"]
    table = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "ts long, path string")
    want = {r.ts: r.operation for r in batch.git_batches(table, ["ts"], "ts").collect()}
    assert [operation_of(p) for p in paths] == [want[i] for i in range(len(paths))]


def test_few_changes_pass_and_many_are_collected(spark, tmp_path):
    schema = "project string, path string, change_type string, from_path string, ts timestamp"
    put = lambda name, *found: spark.createDataFrame([("p", p, k, None, T0) for p, k in found], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in") or name
    put("few", ("a", "modified"), ("b", "modified"))
    seen = []
    stream = accumulated(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 1500, eager=True, files=5)
    q = stream.writeStream.foreachBatch(lambda df, _: seen.append(sorted((r.path, r.change_type) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()

    def until(n):
        deadline = time.time() + 60
        while time.time() < deadline and sum(map(bool, seen)) < n:
            time.sleep(0.2)
        return [s for s in seen if s]

    try:
        assert until(1) == [[("a", "modified"), ("b", "modified")]]
        put("many", *((f"m{i}", "created") for i in range(6)))
        time.sleep(0.5)
        put("more", ("m1", "deleted"), ("late", "created"))
        got = until(2)
        rest = until(3)[2:] if not any(p == "late" for p, _ in got[1]) else []
        together = [x for s in [*got[1:], *rest] for x in s]
        assert ("late", "created") in together and ("m1", "deleted") in together and len({p for p, _ in together}) == 7
        put("git", (".git/refs/stash", "modified"))
        assert [(".git/refs/stash", "modified")] in until(len(until(2)) + 1)
    finally:
        q.stop()


def test_watching_keeps_the_keyword_index(spark, tmp_path):
    tree(tmp_path / "t", {"a.py": "def alpha(): pass\n"})
    engine = Engine(spark, str(tmp_path / "t"), f"file://{tmp_path}/base", None, embedding.HashProvider(8))
    engine.index()
    assert engine.search("alpha", mode="bm25").count() == 1
    q = engine.watch(f"file://{tmp_path}/cp")
    try:
        deadline = time.time() + 90
        time.sleep(3)
        tree(tmp_path / "t", {"b.py": "def beta(): pass\n"})
        (tmp_path / "t/a.py").unlink()
        while time.time() < deadline and [r.file_path for r in engine.list_files().collect()] != ["b.py"]:
            time.sleep(0.5)
        while time.time() < deadline and engine.search("beta", mode="bm25").count() != 1:
            time.sleep(0.5)
        assert engine.search("alpha", mode="bm25").collect() == [] and engine.search("beta", mode="bm25").first()["file_path"] == "b.py"
    finally:
        q.stop()
    assert engine.metrics.counters["mass_changes_total"] == 0 and "batched_files_count" in engine.metrics.samples
