"""WARC archives with revisit records, and their external index merge.

Every task writes its captures, sorted by URL key and time, as one gzip member each into an archive, and a
sorted run of index lines beside it. Runs are merged by loser trees, ``FAN_IN`` at a time where there are more; keys
drawn from the runs cut the lines into ranges, so that every pass after the first, and the last one, is dealt out by range. Where a range
begins in a run is written down once, so a task's work does not depend on the number of ranges. The last pass writes the
global index, one part for each range, and a manifest that names the parts in order; records are read back
by the parts that the manifest names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_arrow, materialize, scratch

#: Runs that one loser tree merges.
FAN_IN = 64
#: Index lines of one range of the last merge.
RANGE_LINES = 16_384
#: Keys that the driver sees to choose the ranges.
SAMPLED_KEYS = 100_000
ARCHIVE_BYTES = 1 << 28
FIRST_CAPTURE, FIRST_DATE = 1_704_067_200, 20240101000000
_SPAN = 315_360_000
_ROWS = 256


# --- records


def _date(when: str) -> str:
    return f"{when[:4]}-{when[4:6]}-{when[6:8]}T{when[8:10]}:{when[10:12]}:{when[12:]}Z"


def _member(head: list[str], block: bytes) -> bytes:
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    lines = ["WARC/1.1", *head, f"Content-Length: {len(block)}"]
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"


def warcinfo(name: str) -> bytes:
    """The first record of the archive ``name``."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: {_id(name)}", f"WARC-Date: {_date(str(FIRST_DATE))}", f"WARC-Filename: {name}.warc.gz"]
    return _member([*head, "Content-Type: application/warc-fields"], b"software: spindrift\r\nformat: WARC File Format 1.1\r\n")


def record(row: dict, name: str) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit has no payload but its length and digest. ``name`` is unique, and so is the record's id."""
    payload, revisit = (row["html"] or "").encode("utf-8", "surrogatepass"), row["revisit"]
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(name)}", f"WARC-Date: {_date(row['captured'])}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(row['digest']).decode()}", f"X-Payload-Length: {len(payload)}",
    ]
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {quote(row['url'], safe=_URL_SAFE)}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if row["refers_to"] is not None:
            head += [f"X-Refers-To-Page-ID: {row['refers_to']}", f"WARC-Refers-To-Date: {_date(row['refers_date'])}"]
        if row["refers_url"] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {quote(row['refers_url'], safe=_URL_SAFE)}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    return _member([*head, "Content-Type: application/http; msgtype=response"], http if revisit else http + payload)


_URL_SAFE = "!#$%&'()*+,/:;=?@[]~-._"


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the HTTP payload."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def decoded(member: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record; a payload must match its digest."""
    headers, payload = read_record(member)
    kind = headers["warc-type"]
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    size = int(headers["x-payload-length"])
    if kind == "response":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
            raise ValueError(f"damaged payload of {headers['warc-record-id']}")
        size = len(payload)
    return _number(headers.get("x-page-id")), size, digest, kind, _number(headers.get("x-refers-to-page-id"))


# --- index lines: key, time, page id (empty: none), offset, length, archive


def _order(line: bytes) -> tuple:
    """What lines are sorted by; a line without page id comes first."""
    key, when, page = line.split(b"\t", 3)[:3]
    return key, when, (1, int(page)) if page else (0, 0)


class LoserTree:
    """k sorted iterators of (order, item) as one. Inner nodes hold losers; a winner's replacement replays one path."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources = sources
        self.heads = [next(s, None) for s in sources]
        size = len(sources)
        self.losers = [-1] * max(size, 1)
        winner = [0] * (2 * size)
        for node in range(2 * size - 1, 0, -1):
            if node >= size:
                winner[node] = node - size
            else:
                a, b = winner[2 * node], winner[2 * node + 1]
                winner[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.best = winner[1] if size else -1

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def __iter__(self):
        size = len(self.sources)
        while size and (head := self.heads[self.best]) is not None:
            yield head
            at = self.best
            self.heads[at] = next(self.sources[at], None)
            node = (at + size) // 2
            while node:
                if self._before(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.best = at


class _Store:
    """Files of the shared folder, whatever kind of store it is."""

    def __init__(self, root: str):
        self.fs, self.root = fs.FileSystem.from_uri(root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def writer(self, name: str):
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(self.path(name), compression=None)

    def lines(self, name: str, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
        """Lines of a file between two offsets."""
        with self.fs.open_input_file(self.path(name)) as file:
            file.seek(start)
            left, rest = (1 << 62) if stop is None else stop - start, b""
            while left > 0 and (chunk := file.read(min(left, 1 << 16))):
                left -= len(chunk)
                *whole, rest = (rest + chunk).split(b"\n")
                yield from whole
            if rest:
                yield rest

    def numbers(self, name: str, at: int, count: int) -> tuple[int, ...]:
        with self.fs.open_input_file(self.path(name)) as file:
            file.seek(8 * at)
            return struct.unpack(f"<{count}q", file.read(8 * count))


class _Offsets:
    """Where the ranges from ``begin`` on start in a file of sorted lines, and where the last one ends."""

    def __init__(self, bounds: list[tuple], begin: int, end: int):
        self.bounds, self.part, self.end, self.found = bounds, begin, end, [0]

    def see(self, order: tuple, at: int) -> None:
        """A line of ``order`` stands at ``at``."""
        while self.part + 1 < self.end and order >= self.bounds[self.part]:
            self.found.append(at)
            self.part += 1

    def write(self, store: _Store, name: str, size: int) -> None:
        self.found += [size] * (self.end - self.part)
        with store.writer(name) as out:
            out.write(struct.pack(f"<{len(self.found)}q", *self.found))


class Run(NamedTuple):
    """Sorted lines in one file for every ``step`` ranges; beside each, under ``offsets``, where its ranges begin (else it is read as a whole)."""

    files: tuple[str, ...]
    step: int
    offsets: tuple[str, ...] = ()

    def slice(self, store: _Store, begin: int, end: int) -> Iterator[tuple]:
        """(order, line) of the ranges from ``begin`` to before ``end``."""
        for file in range(begin // self.step, (end - 1) // self.step + 1):
            marks: tuple = (0, None)
            if self.offsets:
                first, last = max(begin, file * self.step), min(end, (file + 1) * self.step)
                marks = store.numbers(self.offsets[file], first - file * self.step, last - first + 1)
            for line in store.lines(self.files[file], marks[0], marks[-1]):
                yield _order(line), line


# --- stages


def url_key(url) -> Column:
    """Host labels reversed, then path and query in lower case; the whole value where it is no absolute URL."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(text, pattern, 1)), r"^www\d*\.", "")
    path = F.lower(F.regexp_extract(text, pattern, 2))
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    surt = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)
    return F.regexp_replace(F.when(host == "", text).otherwise(surt), r"[\s\p{Cntrl}]", "%20")


def capture_time(page_id) -> Column:
    """14 digits; tables without a time column get one second for each id."""
    seconds = F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(_SPAN))
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyyMMddHHmmss")


def elect(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, revisit, refers_to, refers_url, refers_date: equal payloads revisit the one with the largest page_id.

    Payloads are compared by SHA-1, length and a second hash in thin rows, counted map-side first; html is not shuffled unless there are
    more repeated payloads than may be broadcast.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    key = F.struct(F.unhex(F.sha1(payload)).alias("digest"), F.length(payload).alias("size"), F.xxhash64(payload).alias("other"))
    rows = pages.select("page_id", "url", "html", key.alias("key"))
    most = F.max(F.struct("page_id", "url"))
    repeated = rows.groupBy("key").agg(most.alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(broadcast_if_small(materialize(repeated, "repeated-payloads")), "key", "left")
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best.page_id"))
    return joined.select(
        "page_id", "url", "html", "key.digest", revisit.alias("revisit"), F.when(revisit, F.col("best.page_id")).alias("refers_to"),
        F.when(revisit, F.col("best.url")).alias("refers_url"), F.when(revisit, capture_time(F.col("best.page_id"))).alias("refers_date"),
    )


def write_archives(pages: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(run, lines, keys): one row for each run, a file of sorted lines for each archive, which is named after it.

    A failed task's files are never named in the result, so a retry leaves no trace in the index.
    """

    def write(batches):
        store, out = _Store(root), []
        archive = run = name = None
        size = lines = 0
        keys: list[bytes] = []

        def close():
            if name is not None:
                archive.close()
                run.close()
                out.append((name, lines, keys[:: max(1, len(keys) // 64)]))

        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                for row in batch.slice(at, _ROWS).to_pylist():
                    if name is None or size >= archive_bytes:
                        close()
                        name = uuid.uuid4().hex
                        archive, run, lines, keys = store.writer(f"{name}.warc.gz"), store.writer(name), 0, []
                        archive.write(first := warcinfo(name))
                        size = len(first)
                    member = record(row, f"{name}:{lines}")
                    page = b"" if row["page_id"] is None else b"%d" % row["page_id"]
                    order = b"\t".join([row["url_key"].encode("utf-8", "surrogatepass"), row["captured"].encode(), page])
                    run.write(order + b"\t%d\t%d\t%s\n" % (size, len(member), name.encode()))
                    if lines % 64 == 0:
                        keys.append(order)
                    lines += 1
                    archive.write(member)
                    size += len(member)
        close()
        yield pa.record_batch(
            [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.binary()))],
            names=["run", "lines", "keys"],
        )

    captures = pages.select(
        "page_id", "url", "html", "digest", "revisit", "refers_to", "refers_url", "refers_date",
        url_key(F.col("url")).alias("url_key"), capture_time(F.col("page_id")).alias("captured"),
    )
    ordered = captures.sortWithinPartitions("url_key", "captured", F.asc_nulls_first("page_id"))
    return materialize(map_arrow(ordered, write, "run string, lines long, keys array<binary>"), "runs")


def _bounds(written: DataFrame, runs: int, lines: int) -> list[tuple]:
    """Keys that divide the lines into ranges of about RANGE_LINES; at most SAMPLED_KEYS of them."""
    parts = ceil(lines / RANGE_LINES)
    if parts < 2:
        return []
    each = max(1, min(64, SAMPLED_KEYS // runs))
    step = F.greatest(F.lit(1), F.ceil(F.size("keys") / each).cast("int"))
    some = F.filter("keys", lambda _, i: i % step == 0)
    keys = sorted(_order(bytes(r["key"])) for r in written.select(F.explode(some).alias("key")).collect())
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)})


def _merged(spark: SparkSession, root: str, groups: list[list[Run]], bounds: list[tuple], step: int) -> list[Run]:
    """One pass: the runs of each group become one, dealt out by ``step`` ranges; a task writes one file and its offsets."""
    parts = len(bounds) + 1
    files = ceil(parts / step)
    shared = spark.sparkContext.broadcast((groups, bounds))

    def merge(batches):
        store = _Store(root)
        sources, edges = shared.value
        for batch in batches:
            done = []
            for task in batch.column(0).to_pylist():
                group, file = divmod(task, files)
                begin, end = file * step, min(parts, (file + 1) * step)
                offsets, at, name = _Offsets(edges, begin, end), 0, uuid.uuid4().hex
                with store.writer(name) as out:
                    for order, line in LoserTree([r.slice(store, begin, end) for r in sources[group]]):
                        offsets.see(order, at)
                        out.write(line + b"\n")
                        at += len(line) + 1
                offsets.write(store, name + ".offsets", at)
                done.append((task, name))
            yield _named(done)

    names = _names(spark, len(groups) * files, merge)
    shared.destroy()
    cut = (tuple(names[i : i + files]) for i in range(0, len(names), files))
    return [Run(some, step, tuple(n + ".offsets" for n in some)) for some in cut]


def _named(done: list[tuple[int, str]]):
    return pa.record_batch([pa.array([t for t, _ in done], pa.int64()), pa.array([n for _, n in done], pa.string())], names=["task", "name"])


def _names(spark: SparkSession, tasks: int, function) -> list[str]:
    """The names that so many tasks give to what they write, in order; files of lost attempts are never named."""
    done = materialize(map_arrow(spark.range(0, tasks, 1, max(tasks, 1)), function, "task long, name string"), "named")
    return [r["name"] for r in done.orderBy("task").collect()]


def _indexed(spark: SparkSession, root: str, runs: list[Run], bounds: list[tuple]) -> list[Run]:
    """Runs of one file with the offsets of their ranges; each is read once."""
    shared = spark.sparkContext.broadcast((runs, bounds))

    def index(batches):
        store = _Store(root)
        files, edges = shared.value
        for batch in batches:
            done = []
            for task in batch.column(0).to_pylist():
                offsets, at, name = _Offsets(edges, 0, len(edges) + 1), 0, uuid.uuid4().hex + ".offsets"
                for line in store.lines(files[task].files[0]):
                    offsets.see(_order(line), at)
                    at += len(line) + 1
                offsets.write(store, name, at)
                done.append((task, name))
            yield _named(done)

    names = _names(spark, len(runs), index)
    shared.destroy()
    return [Run(run.files, run.step, (name,)) for run, name in zip(runs, names, strict=True)]


MANIFEST = "part int, file string, lines long"


def merge_index(written: DataFrame, root: str) -> DataFrame:
    """The manifest: (part, file, lines) of the global index, whose parts in order hold all lines in order of (url_key, captured, page_id).

    It is also written as the table ``manifest`` under ``root``. Index files that it does not name are left from lost tasks.
    """
    spark = written.sparkSession
    head = written.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")).first()
    names = sorted(r["run"] for r in written.select("run").collect())  # a name for each archive
    bounds = _bounds(written, max(head["runs"], 1), head["lines"])
    parts, first = len(bounds) + 1, ceil(len(names) / FAN_IN)
    runs = [Run((name,), parts) for name in names]
    if len(runs) <= FAN_IN and bounds:
        runs = _indexed(spark, root, runs, bounds)
    while len(runs) > FAN_IN:
        groups = [runs[i : i + FAN_IN] for i in range(0, len(runs), FAN_IN)]
        # as many tasks in every pass: the fewer groups, the more files of fewer ranges each
        runs = _merged(spark, root, groups, bounds, max(1, parts * len(groups) // first))
    shared = spark.sparkContext.broadcast(runs)

    def write(batches):
        store = _Store(root)
        for batch in batches:
            done = []
            for part in batch.column(0).to_pylist():
                name, lines = f"index-{part:06d}-{uuid.uuid4().hex[:8]}.cdx", 0
                with store.writer(name) as out:
                    for _, line in LoserTree([r.slice(store, part, part + 1) for r in shared.value]):
                        out.write(line + b"\n")
                        lines += 1
                done.append((part, name, lines))
            columns = zip(*done, strict=True) if done else [[], [], []]
            kinds = (("part", pa.int32()), ("file", pa.string()), ("lines", pa.int64()))
            yield pa.record_batch([pa.array(list(c), t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    path = f"{root}/manifest"
    map_arrow(spark.range(0, parts, 1, parts), write, MANIFEST).write.mode("overwrite").parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string"


def read_index(manifest: DataFrame, root: str) -> DataFrame:
    """Every record that the manifest's index parts name, in their order within and across partitions; nothing is written."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    named = [r["file"] for r in manifest.orderBy("part").select("file").collect()]  # at most SAMPLED_KEYS + 1
    spark = manifest.sparkSession
    shared = spark.sparkContext.broadcast(named)

    def read(batches):
        store = _Store(root)
        files, rows = OrderedDict(), []
        for batch in batches:
            for part in batch.column(0).to_pylist():
                for line in store.lines(shared.value[part]):
                    key, when, _, offset, length, name = line.split(b"\t")
                    file = _opened(store, files, name.decode())
                    file.seek(int(offset))
                    found = decoded(file.read(int(length)))
                    rows.append((*found, key.decode("utf-8", "surrogatepass"), when.decode()))
                    if len(rows) == 4096:
                        yield _batch(rows, names, types)
                        rows = []
        yield _batch(rows, names, types)
        for file in files.values():
            file.close()

    return map_arrow(spark.range(0, len(named), 1, max(len(named), 1)), read, SCHEMA)


def merge_and_read(written: DataFrame, root: str) -> DataFrame:
    """All captures in global order of (url_key, captured, page_id) within and across partitions, read from the archives."""
    return read_index(merge_index(written, root), root)


def _opened(store: _Store, files: OrderedDict, name: str):
    if name not in files:
        if len(files) >= 2 * FAN_IN:
            files.popitem(last=False)[1].close()
        files[name] = store.fs.open_input_file(store.path(f"{name}.warc.gz"))
    files.move_to_end(name)
    return files[name]


def _batch(rows: list[tuple], names: list[str], types: list):
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def archive_pages(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write all pages as WARC archives under ``root`` (the shared folder) and return one row per page, read back.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured. Defined cases: null html is an empty
    payload; equal payloads are responses on the row with the largest page_id and revisits of it elsewhere (rows that
    repeat that id too are responses); a null page_id is smaller than all, and refers to none only if all of its
    payload are null; a null url has an empty key; an empty table writes no archive and gives no rows.
    """
    root = root or scratch(pages.sparkSession, "warc")
    thin = pages.select(*(F.col(c).cast(t).alias(c) for c, t in (("page_id", "long"), ("url", "string"), ("html", "string"))))
    return merge_and_read(write_archives(elect(thin), root), root)


ORACLE_SQL = """
WITH digests AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
groups AS (SELECT hex, max(page_id) AS best FROM digests GROUP BY 1),
nibbles AS (SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(hex, (i + 1)::BIGINT, 1)) - 1) AS b FROM digests JOIN groups USING (hex)),
twenty AS (SELECT *, list_transform(range(8), lambda i: b[5*i+1] * 65536 + b[5*i+2] * 4096 + b[5*i+3] * 256 + b[5*i+4] * 16 + b[5*i+5]) AS v FROM nibbles)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[j // 4 + 1] >> (15 - 5 * (j % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM twenty
"""
