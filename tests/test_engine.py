import os
import time

import pytest
from pyspark.sql import functions as F

from spindrift.operators import embedding as E
from spindrift.operators import evaluation, fusion, metrics, symbols, tables, vector
from spindrift.operators.chunking import chunk_files
from spindrift.plans.config import Config, parse
from spindrift.plans.engine import Engine
from spindrift.plans.projects import Registry, detect, needs_index, project_id, remove_index, resolve, shared_indexes
from spindrift.plans.store import ChunkStore
from spindrift.schemas import CHUNKS, FILES
from spindrift.sources.files import get_file


def chunk(id_="c1", path="src/a.rs", vector=(1.0, 0.0), mtime=0, name=None, kind=None, content="fn a() {}", line=1, visibility=None):
    return (id_, content, path, line, line + 9, "rust", list(vector), mtime, None, kind, name, None, None, visibility)


@pytest.fixture
def table(spark):
    return lambda *rows: spark.createDataFrame(list(rows), CHUNKS)


def test_store(spark, tmp_path, table):
    store = ChunkStore(spark, f"file://{tmp_path}/t", 2)
    assert store.count() == 0
    store.append(table())
    store.append(table(chunk("a"), chunk("a"), chunk("b", "o'brien's \"x\".rs")))
    assert store.count() == 3
    store.replace(table(chunk("n", "src/a.rs", mtime=5), chunk("m", "new.rs")))
    assert sorted(r.id for r in store.read().collect()) == ["b", "m", "n"]
    store.delete(["o'brien's \"x\".rs"])
    assert sorted(r.file_path for r in tables.list_files(store.read(False)).collect()) == ["new.rs", "src/a.rs"]
    with pytest.raises(Exception, match="vector length"):
        store.append(table(chunk(vector=(1.0, 2.0, 3.0))))
    assert store.count() == 2
    with pytest.raises(ValueError):
        ChunkStore(spark, f"file://{tmp_path}/t", 3)
    with pytest.raises(ValueError):
        ChunkStore(spark, f"file://{tmp_path}/z", 0)
    store.replace(table(chunk("n", "src/a.rs", mtime=6)))
    assert store.vacuum() and store.count() == 2
    moved = store.migrate(f"file://{tmp_path}/u")
    assert moved.count() == 2 and store.size() > 0
    with pytest.raises(FileExistsError):
        store.migrate(f"file://{tmp_path}/u")
    store.clear()
    assert store.count() == 0 and moved.count() == 2


def test_incremental(spark, table):
    stored = table(chunk(path="a", mtime=5), chunk(path="a", mtime=9), chunk(path="b", mtime=5), chunk(path="gone", mtime=1))
    files = spark.createDataFrame([("a", "", 9), ("b", "", 6), ("c", "", 0)], FILES)
    assert sorted(r.file_path for r in tables.changed_files(files, stored).collect()) == ["b", "c"]
    assert [r.file_path for r in tables.vanished_files(files, stored).collect()] == ["gone"]
    assert {r.file_path: r.mtime for r in tables.file_mtimes(stored).collect()} == {"a": 9, "b": 5, "gone": 1}


def test_vector_order(spark, table):
    rows = table(*(chunk(i, vector=(v, 1.0, 1.0)) for i, v in (("x", 0.5), ("y", 0.9), ("z", 0.1))))
    found = vector.vector_topk(rows, [1.0, 1.0, 1.0], 3)
    assert [r.id for r in found.collect()] == ["y", "x", "z"]
    assert found.first()["score"] == pytest.approx(1 / 1.01, abs=1e-6)
    same = table(*(chunk(i, f"f{n}", (1.0,)) for n, i in enumerate("dcba")))
    assert [r.id for r in vector.vector_topk(same, [1.0], 2).collect()] == ["a", "b"]


def test_vector_batch_equals_single(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(500)] + [(900, None)], "id long, vector array<float>").repartition(5)
    asked = rows.where("id < 70").select(F.col("id").alias("query_id"), "vector")
    found = vector.vector_topk_batch(rows, asked, 4).collect()
    assert len(found) == 280
    for q in (0, 33, 69):
        v = rows.where(f"id = {q}").first()["vector"]
        want = [(r.id, r.distance) for r in vector.vector_topk(rows.where("vector is not null"), v, 4).collect()]
        assert sorted(((r.key, r.distance) for r in found if r.query_id == q), key=lambda x: x[::-1]) == want


def test_unique_files_cuts_before_it_dedups(spark):
    rows = spark.createDataFrame([(i, "a" if i < 6 else "b", 1.0 - i / 100) for i in range(10)], "id long, file_path string, score double")
    assert [r.file_path for r in vector.unique_files(rows, 2).collect()] == ["a"]


def test_fusion(spark):
    a = spark.createDataFrame([("f1", 1, "x"), ("f2", 2, "x")], "key string, rank long, content string")
    b = spark.createDataFrame([("f2", 1, "y"), ("f3", 2, "y")], "key string, rank long, content string")
    rows = fusion.rrf_fuse([(a, 0.7), (b, 0.3)], ["key"], 10).collect()
    assert [(r.key, r.content) for r in rows] == [("f2", "x"), ("f1", "x"), ("f3", "y")]
    assert rows[0].score == pytest.approx(0.7 / 62 + 0.3 / 61, abs=1e-9)
    assert len(fusion.rrf_fuse([(a, 0.7), (b, 0.3)], ["key"], 2).collect()) == 2
    gap = lambda k: (lambda r: r[0].score - r[1].score)(fusion.rrf_fuse([(a, 0.7), (b, 0.3)], ["key"], 3, k).collect())
    assert gap(10) > gap(60) > gap(100)


def test_symbols(spark, table):
    rows = table(
        chunk("1", name="hello_world", kind="function", visibility="public"), chunk("2", "src/b.rs", name="Hello", kind="struct"),
        chunk("3", name="other", kind=None, line=3), chunk("4", name=None), chunk("5", "lib/c.py", name="test_method", kind="method"),
    )
    s = symbols.symbols(rows)
    names = lambda df: [r.name for r in df.collect()]
    assert s.count() == 4 and s.where("name = 'other'").first()["kind"] == "unknown"
    assert names(symbols.find_symbol(s, "hello", "exact")) == [] and names(symbols.find_symbol(s, "hello", "prefix")) == ["Hello", "hello_world"]
    fuzzy = symbols.find_symbol(s, "helo_world").collect()
    assert [(r.name, r.score) for r in fuzzy] == [("hello_world", 0.5)]
    assert names(symbols.find_symbol(s, "h", "prefix", kind="STRUCT")) == ["Hello"]
    assert names(symbols.find_symbol(s, "h", "prefix", file_glob="src/a*")) == ["hello_world"]
    assert names(symbols.find_symbol(s, "h", "prefix", language="go")) == []
    assert names(symbols.list_symbols(s, kinds=["Function", "METHOD"])) == ["test_method", "hello_world"]
    assert names(symbols.list_symbols(s, visibility="Public")) == ["hello_world"]
    assert names(symbols.list_symbols(s, "src/a.rs")) == ["hello_world", "other"]


def test_references(spark, table):
    rows = table(chunk("1", content="use foo;\nx"), chunk("2", "b", content="foobar"), chunk("3", "c", content="call(foo)"))
    found = symbols.references_text(rows, "foo")
    assert [(r.file_path, r.line_content) for r in found.collect()] == [("c", "call(foo)"), ("src/a.rs", "use foo;")]
    assert [r.file_path for r in symbols.references_text(rows, "foo", "c").collect()] == ["src/a.rs"]
    assert symbols.files_affected(found).first()["files_affected"] == 2


def test_evaluation(spark):
    results = spark.createDataFrame([(1, 1, "a"), (1, 2, "x"), (1, 3, "a"), (1, 4, "b"), (2, 1, "z")], "query_id long, rank long, item string")
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (3, "q")], "query_id long, item string")
    got = {r.query_id: r for r in evaluation.evaluate(results, expected).collect()}
    assert (got[1].precision, got[1].mrr) == (0.75, 1.0) and got[1].recall == pytest.approx(2 / 3, abs=1e-6)
    assert (got[2].precision, got[2].recall) == (0.0, 1.0) and (got[3].precision, got[3].recall, got[3].ndcg) == (0.0, 0.0, 0.0)
    low = spark.createDataFrame([(1, 0.8, 0.1), (2, 0.0, 0.0)], "query_id long, min_precision double, min_recall double")
    assert [r.query_id for r in evaluation.below_threshold(evaluation.evaluate(results, expected), low).collect()] == [1]


def test_metrics(spark):
    rows = spark.createDataFrame([(0.02,), (0.3,), (9.0,)], "v double")
    found = metrics.histogram(rows, "v", (0.01, 0.5, 5.0))
    assert [(r.le, r.n) for r in found.orderBy("le").collect()] == [(0.01, 0), (0.5, 2), (5.0, 2), (float("inf"), 3)]
    assert 'x_bucket{le="+Inf"} 3' in metrics.exposition("x", "help", found)
    assert metrics.histogram(rows.limit(0), "v", (1,)).first()["average"] == 0
    m = metrics.Metrics()
    m.observe("search_latency_seconds", 0.02)
    m.count("search_requests_total")
    assert m.average("search_latency_seconds") == 0.02 and 'le="0.05"} 1' in m.text()


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "a")], "id long, content string").coalesce(1)

    class Some(E.HashProvider):
        def embed(self, texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return super().embed(texts)

    got = {r.id: r for r in E.embed(rows, Some(16), batch=1, error="error").collect()}
    assert got[1].vector == got[4].vector and sum(x * x for x in got[1].vector) == pytest.approx(1, abs=1e-5)
    assert set(got[2].vector) == {0.0} and "no" in got[2].error and got[1].error is None
    assert E.zero_vectors(E.embed(rows, Some(16), batch=1)).count() == 1
    assert E.FallbackProvider([Some(16), E.HashProvider(16)]).embed(["bad"])
    with pytest.raises(ValueError):
        E.FallbackProvider([E.HashProvider(8), E.HashProvider(16)])
    assert (E.model_name("whatever"), E.model_dimension("bge-large")) == ("nomic-embed-text-v1.5", 1024)
    calls, slept = [], []
    remote = E.RemoteProvider(lambda t: calls.append(len(t)) or [[0.0]] * len(t), "r", 1, 2)
    assert len(remote.embed(["x"] * 5)) == 5 and calls == [2, 2, 1]
    bucket = E.TokenBucket(60, lambda: 0.0, slept.append)
    for _ in range(62):
        bucket.wait()
    assert len(slept) == 2


def test_chunk_files(spark):
    rows = [("a.py", "def f():\n    return 1\n", 1), ("b.txt", "one\ntwo", 2), ("c.rs", None, 3), ("d.py", "", 4), ("e.cpp", "int f() { return 1; }\n", 5)]
    found = chunk_files(spark.createDataFrame(rows, FILES)).collect()
    assert {(r.file_path, r.origin, r.symbol_name, r.language) for r in found} == {
        ("a.py", "merged", "f", "python"), ("b.txt", "line", None, "txt"), ("e.cpp", "merged", "f", "cpp"),
    }
    assert len({r.id for r in found}) == 3
    assert {r.origin for r in chunk_files(spark.createDataFrame(rows, FILES), c_family=False).where("file_path = 'e.cpp'").collect()} == {"line"}
    stats = {r.file_path: r.method for r in tables.chunking_stats(chunk_files(spark.createDataFrame(rows, FILES))).collect()}
    assert stats == {"a.py": "ast", "b.txt": "line_based", "e.cpp": "ast"}


def test_engine(spark, tmp_path):
    root = tmp_path / "tree"
    for path, text in (("src/auth.py", "def login(user):\n    return check(user)\n" * 20), ("src/db.py", "class Database:\n    def connect(self):\n        pass\n"), ("target/x.py", "def no(): pass"), (".hidden/y.py", "x"), ("notes.md", "x"), ("skip.py", "def s(): pass"), (".gitignore", "skip.py\n")):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "src/bad.py").write_bytes(b"\xff\xfe\x00")
    config = parse('[indexer]\nignore_patterns = ["target/"]\n[search]\nmode = "hybrid"')
    engine = Engine(spark, str(root), f"file://{tmp_path}/base", config, E.HashProvider(32))
    assert engine.search("login").collect() == []
    report = engine.index()
    assert report["files"] == 3 and report["errors"] == 1 and report["chunks"] >= 2
    assert [r.file_path for r in engine.list_files().collect()] == ["src/auth.py", "src/db.py"]
    assert engine.search("login", 3, "bm25").first()["file_path"] == "src/auth.py"
    assert engine.search("Database", 1, "hybrid").count() == 1 and engine.search("Database", 5, "vector", unique=True).count() == 2
    assert engine.find_symbol("Databse").first()["name"] == "Database"
    assert [r.file_path for r in engine.find_references("check", mode="text").collect()][:1] == ["src/auth.py"]
    assert engine.find_references("login").count() >= 1
    assert engine.index()["changed_files"] == 1  # the unreadable file is tried again
    time.sleep(1.1)
    (root / "src/db.py").write_text("class Store:\n    pass\n")
    os.remove(root / "src/auth.py")
    assert engine.stale()
    engine.index()
    assert [r.file_path for r in engine.list_files().collect()] == ["src/db.py"]
    assert engine.search("login", 3, "bm25").collect() == [] and engine.find_symbol("Store", mode="exact").count() == 1
    assert engine.stats()["files"] == 1 and engine.get_file("src/db.py").startswith("class Store")
    with pytest.raises(PermissionError):
        get_file(str(root), "../../etc/passwd")


def test_interfaces(spark, tmp_path):
    import io
    import json
    import threading
    from urllib.request import Request, urlopen

    from spindrift.serve import TOOLS, Api, http_server, serve_lines

    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.py").write_text("def login(user):\n    return user\n")
    engine = Engine(spark, str(tmp_path / "t"), f"file://{tmp_path}/base", None, E.HashProvider(16))
    engine.index()
    api = Api(engine)
    call = lambda *a: (lambda r: (r[0], json.loads(r[2])))(api.handle(*a))
    status, found = call("POST", "/api/search", b'{"query": "login", "limit": 1, "mode": "bm25"}')
    assert status == 200 and found["mode"] == "bm25" and found["results"][0]["file_path"] == "a.py"
    assert call("GET", "/api/files?pattern=*.py") == (200, [{"path": "a.py", "extension": "py"}])
    assert call("GET", "/api/stats")[1]["chunks"] == 1 and call("GET", "/health")[1]["status"] == "healthy"
    assert api.handle("GET", "/api/files/a.py")[2].startswith(b"def login")
    assert [call(*a)[0] for a in (("GET", "/api/files/../x"), ("GET", "/api/files/no.py"), ("GET", "/nope"), ("POST", "/api/search", b"{}"))] == [403, 404, 404, 400]
    assert b"search_requests_total" in api.handle("GET", "/metrics")[2]
    server = http_server(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urlopen(Request(f"http://127.0.0.1:{server.server_port}/api/search", b'{"query": "login"}')) as reply:
        assert json.load(reply)["mode"] == "hybrid"
    server.shutdown()
    lines = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "nope"}]
    tools = [("search", {"query": "login"}), ("list_files", {}), ("get_file", {"path": "a.py"}), ("find_symbol", {"query": "logn"}), ("list_symbols", {}), ("find_references", {"symbol_name": "user", "mode": "text"}), ("get_file", {"path": "../x"})]
    lines += [{"id": 10 + i, "method": "tools/call", "params": {"name": n, "arguments": a}} for i, (n, a) in enumerate(tools)]
    sink = io.StringIO()
    serve_lines(engine, io.StringIO("\n".join(map(json.dumps, lines)) + "\nnot json\n"), sink)
    replies = {r["id"]: r for r in map(json.loads, sink.getvalue().splitlines())}
    assert {t["name"] for t in replies[2]["result"]["tools"]} == set(TOOLS) and "error" in replies[3] and "error" in replies[None]
    assert [replies[10 + i]["result"]["isError"] for i in range(7)] == [False] * 6 + [True]
    assert "login" in replies[13]["result"]["content"][0]["text"]


def test_projects(tmp_path, spark):
    (tmp_path / "p/src/deep").mkdir(parents=True)
    (tmp_path / "p/package.json").write_text("{}")
    (tmp_path / "p/Makefile").write_text("")
    found = detect(str(tmp_path / "p/src/deep"))
    assert (found.root, found.marker, found.type) == (str(tmp_path / "p"), "package.json", "node")
    (tmp_path / "p/.git").mkdir()
    assert detect(str(tmp_path / "p")).marker == ".git"
    assert not resolve(str(tmp_path / "p"), "/shared").is_local and project_id(str(tmp_path / "p")) in resolve(str(tmp_path / "p"), "/shared").table
    (tmp_path / "p/.spindrift").mkdir()
    assert detect(str(tmp_path / "p/src")).marker == ".spindrift" and resolve(str(tmp_path / "p"), "/shared").is_local
    r = Registry(str(tmp_path / "r.json"))
    r.add("b", str(tmp_path / "p"))
    r.add("a", str(tmp_path))
    with pytest.raises(ValueError):
        r.add("a", ".")
    r.update_stats("a", 1, 2, 3)
    again = Registry(str(tmp_path / "r.json"))
    assert again.default == "b" and again.find_by_path(str(tmp_path / "p/src")).name == "b" and again.projects["a"].chunk_count == 2
    assert [x.name for x in again.table(spark).collect()] == ["a", "b"]
    again.remove("b")
    assert again.default is None
    (tmp_path / "s/x-0123abcd").mkdir(parents=True)
    assert shared_indexes(str(tmp_path / "s")) == [("x-0123abcd", "x", "0123abcd")]
    remove_index(str(tmp_path / "s"), "x-0123abcd")
    assert shared_indexes(str(tmp_path / "s")) == []
    with pytest.raises(KeyError):
        remove_index(str(tmp_path / "s"), "..")
    assert needs_index("on_missing", False, False) and not needs_index("never", False, True) and needs_index("on_missing_or_stale", True, True)


def test_config():
    assert parse("") == Config() and parse("[search]\nrrf_k = 10").search.rrf_k == 10
    with pytest.raises(ValueError):
        parse("[search]\nnope = 1")
