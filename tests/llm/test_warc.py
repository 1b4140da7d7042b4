import base64
import hashlib
import random

import pytest

from spindrift.llm import warc
from spindrift.llm.warc import LoserTree


def expected(rows):
    payload = [(i, (h or "").encode()) for i, _, h in rows]
    best: dict = {}
    for i, b in payload:
        best[b] = max(best.get(b, (0, None)), (0, None) if i is None else (1, i), key=lambda x: x[:1] if x[1] is None else x)
    out = []
    for i, b in payload:
        first = best[b][1]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://www.B.example/x?q=1#f", "same"), (2, "https://user@a.example:80/Path Two", "same"), (3, None, None), (4, "", ""), (5, "no url\r\nX: y", "<p>é</p>"),
    (6, "http://b.example/x?q=1", "x" * 2_000_000), (None, "http://b.example", "same"), (None, "http://b.example", "alone"), (7, "http://ü.example/ß", "same\r\n\r\nsame"),
    (8, "http://b.example/x?q=1", "only"), (8, "http://b.example/x?q=1", "only"),
]
SCHEMA = "page_id long, url string, html string"


def frame(spark, rows, parts=3):
    wide = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", digest string, best string")
    return wide.repartition(parts)


@pytest.mark.parametrize("small", [False, True])
def test_round_trip(spark, monkeypatch, small):
    rows = ROWS + [(i, f"http://h{i % 5}.example/{i % 7}", f"page {i % 90}" * (i % 3)) for i in range(100, 500)]
    if small:
        monkeypatch.setattr(warc, "FAN_IN", 2)
        monkeypatch.setattr(warc, "RANGE_LINES", 60)
    out = warc.archive_pages(frame(spark, rows, 7 if small else 3)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr) == expected(rows)
    order = [(r.url_key.encode(), r.captured, (0, 0) if r.page_id is None else (1, r.page_id)) for r in out]
    assert order == sorted(order)
    keys = {r.page_id: r.url_key for r in out}
    assert keys[1] == keys[6] == "example,b)/x?q=1" and keys[3] == ""


def test_archives_stay_small(spark):
    rows = [(i, "http://a.example/", f"text {i}") for i in range(300)]
    root = warc.scratch(spark, "small")
    written = warc.write_archives(warc.elect(frame(spark, rows)), root, archive_bytes=2000)
    assert written.count() > 20 and written.agg({"lines": "sum"}).first()[0] == 300
    assert sorted(r.page_id for r in warc.merge_and_read(written, root).collect()) == list(range(300))


def test_repeated_orders_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_LINES", 500)
    rows = [(i, f"http://a.example/{i:05d}", f"t{i}") for i in range(1500)] + [(700, "http://a.example/00700", "t700")] * 900 + [(None, "http://a.example/00900", "n")] * 600
    out = warc.archive_pages(frame(spark, rows, 2)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr) == expected(rows)


def test_slices_keep_all_lines(tmp_path):
    store = warc._Store(f"file://{tmp_path}")
    orders = [(b"a", b"1", i) for i in range(300)] + [(b"b", b"1", 7)] * 900 + [(b"c", b"1", i) for i in range(300)]
    bounds = [(b"0", b"1", (1, 0)), (b"b", b"1", (1, 7)), (b"b", b"1", (1, 8)), (b"c", b"1", (1, 0)), (b"d", b"1", (1, 0))]
    offsets, at = warc._Offsets(bounds, 0, 6), 0
    with store.writer("run") as out:
        for key, when, page in orders:
            offsets.see((key, when, (1, page)), at)
            line = b"%s\t%s\t%d\t0\t0\trun\n" % (key, when, page)
            out.write(line)
            at += len(line)
    offsets.write(store, "marks", at)
    run = warc.Run(("run",), 6, ("marks",))
    sizes = [sum(1 for _ in run.slice(store, r, r + 1)) for r in range(6)]
    assert sizes == [0, 300, 900, 0, 300, 0]
    for step in (1, 2, 4, 6):
        read = [o for r in range(0, 6, step) for o, _ in run.slice(store, r, min(r + step, 6))]
        assert read == [(k, w, (1, p)) for k, w, p in orders]


def test_index_is_written_once_and_read_by_its_manifest(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 2)
    monkeypatch.setattr(warc, "RANGE_LINES", 40)
    rows = [(i, f"http://h{i % 5}.example/{i % 7}", f"page {i % 90}") for i in range(400)] + [(8, "http://h3.example/1", "page 8")] * 3
    root = warc.scratch(spark, "manifest")
    out = warc.archive_pages(frame(spark, rows, 7), root)
    store = warc._Store(root)
    listed = lambda: sorted(f.base_name for f in store.fs.get_file_info(warc.fs.FileSelector(store.root)))
    before = listed()
    first, again = out.collect(), out.collect()
    assert first == again and len(first) == len(rows) and listed() == before
    manifest = spark.read.parquet(f"{root}/manifest").orderBy("part").collect()
    assert len(manifest) > 5 and sum(r.lines for r in manifest) == len(rows)
    lines = [line for r in manifest for line in store.lines(r.file)]
    assert [warc._order(x) for x in lines] == sorted(warc._order(x) for x in lines)
    ids = []
    for line in lines:
        _, _, page, offset, length, name = line.split(b"\t")
        with store.fs.open_input_file(store.path(f"{name.decode()}.warc.gz")) as file:
            file.seek(int(offset))
            headers, _ = warc.read_record(file.read(int(length)))
        ids.append(headers["warc-record-id"])
        assert headers["x-page-id"] == page.decode()
        assert headers["warc-type"] == "response" or "warc-refers-to-target-uri" in headers and "warc-refers-to-date" in headers
    assert len(set(ids)) == len(rows)


def test_archives_begin_with_their_warcinfo(spark):
    root = warc.scratch(spark, "info")
    name = warc.write_archives(warc.elect(frame(spark, [(1, "http://a.example/", "x")], 1)), root).first()["run"]
    store = warc._Store(root)
    with store.fs.open_input_file(store.path(f"{name}.warc.gz")) as file:
        headers, _ = warc.read_record(file.read())
    assert headers["warc-type"] == "warcinfo" and headers["warc-filename"] == f"{name}.warc.gz"


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_damage_is_noticed():
    digest = hashlib.sha1(b"abc").digest()
    row = {"page_id": 1, "url": "u", "captured": "20240101000000", "html": "abc", "digest": digest, "revisit": False}
    assert warc.decoded(warc.record(row, "a"))[:2] == (1, 3)
    with pytest.raises(ValueError):
        warc.decoded(warc.record(row | {"html": "abd"}, "a"))


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(200):
        sources = [sorted(rng.randint(0, 9) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 9))]
        merged = [order for order, _ in LoserTree([iter([(x, None) for x in s]) for s in sources])]
        assert merged == sorted(x for s in sources for x in s)
