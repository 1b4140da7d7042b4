"""Token counts by a map-side two-tier lookup.

The first tier is a table of the lengths, in tokens, of frequent pieces (runs without white space, which no pre-token crosses)
of all documents: each task makes one bounded summary of its pieces, summaries are merged as wholes, and the table is
broadcast. It only saves work; a piece that it lacks is counted like any other. The second tier is each worker's cache; what
neither has is encoded by the vocabulary file's library. Pieces are never shuffled, by themselves or by key.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_vocabulary, has_unknown, pieces, segments
from .common import map_arrow

LIMIT = 2048
#: Entries of the broadcast table, and of the summary of each task; the number of merged summaries that come to the driver.
TABLE = 1 << 15
SUMMARY = 1 << 12
MERGED = 16
CACHE = 1 << 18


def _reduced(found: Counter, size: int) -> Counter:
    """Misra-Gries: the ``size`` largest counts less the largest of the rest, so a sum of such summaries misses at most its share."""
    if len(found) <= size:
        return found
    top = heapq.nlargest(size + 1, found.items(), key=lambda x: x[1])
    least = top[-1][1]
    return Counter({w: n - least for w, n in top if n > least})


def _packed(found: Counter, size: int):
    """A summary as one row."""
    top = list(_reduced(found, size).items())
    columns = [pa.array([[w for w, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))]
    return pa.record_batch(columns, names=["pieces", "counts"])


def frequent_pieces(docs: DataFrame, special: list[str], size: int = TABLE, summary: int = SUMMARY) -> list[str]:
    """At most ``size`` frequent pieces of all documents.

    A task holds at most some times ``size`` counters and hands on one row of ``summary`` of them; these rows are merged
    in ``MERGED`` tasks, whatever the input's size, and the driver merges what these hand on.
    """
    pattern = "|".join(map(re.escape, special))

    def count(batches):
        found: Counter = Counter()
        cut = re.compile(f"({pattern})")
        for batch in batches:
            for text in batch.column("text"):
                for part in segments(text.as_py() or "", cut):
                    if part not in special:
                        found.update(pieces(part))
                if len(found) > 4 * size:
                    found = _reduced(found, size)
        yield _packed(found, summary)

    def merge(batches):
        found: Counter = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                words, counts = (batch.column(c)[i].as_py() for c in ("pieces", "counts"))
                found.update(dict(zip(words, counts, strict=True)))
                if len(found) > 4 * size:
                    found = _reduced(found, size)
        yield _packed(found, size)

    schema = "pieces array<string>, counts array<long>"
    each = map_arrow(docs.select("text"), count, schema)
    total: Counter = Counter()
    for row in map_arrow(each.repartition(MERGED), merge, schema).collect():  # MERGED rows of at most ``size`` pieces
        total.update(dict(zip(row["pieces"], row["counts"], strict=True)))
    return [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]]


class Lengths:
    """Both tiers of one worker."""

    def __init__(self, table: dict[str, int], spec: str):
        self.table, self.whole, self.tokenizer = table, _tokenizer(spec), _tokenizer(spec, normalised=True)
        self.special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.cache: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; pieces that are new are encoded in one call."""
        split = [[1 if x in self.special else self.parts(x) for x in segments(t, self.cut)] for t in texts]
        table, cache = self.table, self.cache
        if len(cache) >= CACHE:
            cache.clear()
        parts = [p for text in split for p in text if isinstance(p, list)]
        new = list({x for p in parts for x in p if x not in table and x not in cache})
        for x, encoded in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            cache[x] = len(encoded)
        both = lambda x: table.get(x) or cache[x]  # noqa: E731  every piece has a token
        return [sum(p if isinstance(p, int) else sum(map(both, p)) for p in text) for text in split]

    def parts(self, segment: str) -> list[str] | int:
        """Pieces; or the number of tokens at once where the standard library does not know a character."""
        if has_unknown(segment):
            return len(self.whole.encode(segment, add_special_tokens=False))
        return pieces(segment)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    Defined cases: a null text has no bytes and no tokens; special strings inside a text are one token each, as
    the library has it; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    with open(path or default_vocabulary(), encoding="utf-8") as file:
        spec = file.read()
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    driver = Lengths({}, spec)
    frequent = frequent_pieces(thin, driver.special)
    lengths = dict(zip(frequent, map(len, driver.tokenizer.encode_batch_fast(frequent, add_special_tokens=False)), strict=True))
    shared = spark.sparkContext.broadcast((spec, lengths))

    def run(batches):
        known = _worker(shared)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts: list[int] = []
            for some in _groups(texts):
                counts += known.count(some)
            n = pa.array(counts, pa.int64())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                 n, pa.array([c > limit for c in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_arrow(thin, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _groups(texts: list[str], characters: int = 1 << 20):
    """Runs of texts of about so many characters, to bound what is held in split form."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= characters:
            yield texts[start : i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def _tokenizer(spec: str, normalised: bool = False):
    """The file's library; with ``normalised`` for pieces that are normalised already (doing it twice may reorder marks)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(json.dumps({**json.loads(spec), "normalizer": None}) if normalised else spec)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    tokenizer.encode_special_tokens = True  # special strings are cut out before; what looks like one now is text
    return tokenizer


_state: dict = {}


def _worker(shared) -> Lengths:
    """One per worker process and broadcast, so that the cache outlives a task."""
    spec, lengths = shared.value
    if _state.get("lengths") is not lengths:
        _state.update(lengths=lengths, known=Lengths(lengths, spec))
    return _state["known"]
