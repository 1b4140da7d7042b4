"""Benchmark decontamination with DataFrame expressions only.

Windows of a document as long as a benchmark item are fingerprinted by SimHash over word shingles.
Of all windows, those are fingerprinted that hold as many shared shingles as the similarity needs and that no
neighbour is sure to equal (``_starts``). Multi-index Hamming
blocks then find, for every window, all items of that length within ``radius`` bits: 8 blocks of 8
bits, each probed within 2 flips, which misses nothing up to 8 * 3 - 1 = 23 bits. Candidates are verified
by the exact weighted Jaccard similarity of their shingles (words compared as text, weights are counts).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, broadcast_if_small, materialize

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 8
FLIPS = 2
RADIUS = BLOCKS * (FLIPS + 1) - 1


def words_of(text) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _gram(words, at, size) -> Column:
    return F.array_join(F.slice(words, at + 1, size), " ")


def shingles_of(words, size) -> Column:
    """All shingles in order, repeats included; the whole sequence if it is shorter than a shingle."""
    last = F.greatest(F.size(words) - size, F.lit(0))
    every = F.sequence(F.lit(0), last)
    return _once(words, lambda w: F.transform(every, lambda i: _gram(w, i, size)))


def simhash(shingles) -> Column:
    """Bit b is 1 if it is set in over half of the shingles' XXH64 values."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    return _once(hashes, _majority)


def _majority(hashes) -> Column:
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: F.when(
            F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1)) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)
        ).otherwise(F.lit(0).cast("long")),
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _block(fp, i) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)).cast("int")


def benchmark_items(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, words, n, k, shingles, fp); items without a word are left out, k is at most their length."""
    worded = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("words"))
    sized = worded.where(F.size("words") > 0).distinct().select(
        "*", F.size("words").alias("n"), F.least(F.size("words"), F.lit(shingle)).alias("k")
    )
    full = sized.withColumn("shingles", shingles_of(F.col("words"), F.col("k")))
    return materialize(full.withColumn("fp", simhash(F.col("shingles"))), "benchmark-items")


def _grams(words, size: int) -> Column:
    """(h, k, pos) of every shingle of ``size`` words: the hash of its words' hashes, its size and its place."""
    places = F.sequence(F.lit(0), F.size(words) - size)
    found = F.transform(places, lambda i: F.struct(F.xxhash64(*(F.get(words, i + j) for j in range(size))).alias("h"), F.lit(size).alias("k"), i.alias("pos")))
    return F.when(F.size(words) >= size, found).otherwise(F.filter(found, lambda x: F.lit(False)))


def _hashed(words) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _once(value, use) -> Column:
    """use(value), with the value computed once however often ``use`` refers to it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shared(keyed: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, length, n, k, item, pos): the shingles that a document and an item share. A text is cut into words and hashed once."""

    def grams(words):
        return _once(_hashed(words), lambda w: F.struct(F.size(w).alias("length"), F.concat(*(_grams(w, k) for k in sizes)).alias("all")))

    anchors = items.select("n", F.col("k").alias("size"), F.xxhash64("words").alias("item"), F.explode(grams(F.col("words"))["all"]).alias("x"))
    anchors = anchors.where("x.k = size").select("x.h", "x.k", "n", "item").distinct()
    lists = keyed.select("key", F.explode(F.array(grams(words_of(F.col("text"))))).alias("g"))
    spread = lists.select("key", "g.length", F.explode("g.all").alias("x")).select("key", "length", "x.h", "x.k", "x.pos")
    return spread.join(broadcast_if_small(materialize(anchors, "anchors")), ["h", "k"]).select("key", "length", "n", "k", "item", "pos")


def _starts(hits: DataFrame, similarity: float) -> DataFrame:
    """(key, n, k, start, last): windows that begin with a shared shingle, or end the document, and hold enough shared ones for ``similarity``.

    No other window needs a look: moved on to the next shared shingle it loses none, so the best windows of an item
    include one of these. Within a run of shared shingles, a window that gains none at its end is no better than the one before.
    """
    last = F.greatest(F.col("length") - F.col("n"), F.lit(0))
    grams = F.least("length", "n") - F.col("k") + 1
    least = F.ceil((grams + F.col("n") - F.col("k") + 1) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9)).cast("int")
    found = hits.groupBy("key", "length", "n", "k", "item").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    full = found.select("key", "n", "k", last.alias("last"), grams.alias("grams"), F.greatest(least, F.lit(1)).alias("least"), "at").where(F.size("at") >= F.col("least"))

    def begins(p, i):
        end = p + F.col("grams") - 1
        enough = (p <= F.col("last")) & (F.get("at", i + F.col("least") - 1) <= end)
        gains = F.array_contains(F.slice("at", i + F.col("least"), F.col("grams") - F.col("least") + 1), end)
        return enough & ((i == 0) | (F.get("at", i - 1) != p - 1) | gains)

    at_end = F.when(F.get("at", F.size("at") - F.col("least")) >= F.col("last"), F.array("last")).otherwise(F.array().cast("array<int>"))
    starts = F.concat(F.filter("at", begins), at_end)
    return full.select("key", "n", "k", F.explode(starts).alias("start"), (F.col("start") == F.col("last")).alias("last")).distinct()


def _windows(plain: DataFrame, items: DataFrame, sizes: list[int], similarity: float) -> DataFrame:
    """(doc_id, n, k, start, last, window). Only keys and positions are exploded; words are cut out where a window begins."""
    keyed = plain.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    starts = materialize(_starts(_shared(keyed, items, sizes), similarity), "starts")
    window = F.slice(words_of(F.col("text")), F.col("start") + 1, F.col("n"))
    return keyed.join(broadcast_if_small(starts), "key").select("doc_id", "n", "k", "start", "last", window.alias("window"))


def _probes(items: DataFrame) -> DataFrame:
    """Every item under every block value within FLIPS bits of its own."""
    masks = [sum(1 << b for b in some) for n in range(FLIPS + 1) for some in combinations(range(8), n)]
    return items.select(
        "item_id", "n", "k", F.col("fp").alias("item_fp"),
        F.explode(F.array(*(F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i).alias("own")) for i in range(BLOCKS)))).alias("b"),
    ).select(
        "item_id", "n", "k", "item_fp", "b.block",
        F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: m.bitwiseXOR(F.col("b.own")))).alias("value"),
    )


def weighted_jaccard(a, b) -> Column:
    """Sum of the smaller over sum of the larger counts of two arrays of shingles."""

    def count(of, x):
        return F.size(F.filter(of, lambda y: y == x))

    common = F.aggregate(
        F.array_distinct(b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x))
    )
    return common / (F.size(a) + F.size(b) - common)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """(doc_id, item_id, similarity, start_word): every document and item with a window at ``similarity`` or above.

    similarity is the best of all the pair's windows, one word apart, rounded to 6 places; start_word the first word of the
    first such window that begins with a shared shingle or ends the document (there always is one). Defined cases: texts or items that are null, empty or without letters and digits match nothing; a
    document shorter than an item is one window; an item shorter than a shingle is one shingle of all its words; rows
    that repeat an id are one document; a null doc_id is an id like others; an empty table gives no rows.
    """
    items = benchmark_items(benchmark, shingle)
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most ``shingle`` values
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not sizes:
        return plain.select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("similarity", "double"), ("start_word", "int")))).limit(0)
    printed = _windows(plain, items, sizes, similarity).withColumn("shingles", shingles_of(F.col("window"), F.col("k"))).withColumn(
        "fp", simhash(F.col("shingles"))
    )
    blocks = F.array(*(F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i).alias("value")) for i in range(BLOCKS)))
    met = printed.withColumn("x", F.explode(blocks)).select("*", "x.block", "x.value").join(
        broadcast_if_small(materialize(_probes(items), "probes")), ["n", "k", "block", "value"]
    )
    differing = F.col("fp").bitwiseXOR(F.col("item_fp"))
    earlier = reduce(
        lambda a, b: a | b,
        (F.lit(i).__lt__(F.col("block")) & (F.bit_count(_block(differing, i)) <= FLIPS) for i in range(BLOCKS)),
    )
    close = met.where(~earlier & (F.bit_count(differing) <= RADIUS)).drop("n", "k", "block", "value", "x")
    texts = items.select("item_id", F.col("fp").alias("item_fp"), F.col("shingles").alias("item_shingles"))
    begins = F.col("last") | F.array_contains("item_shingles", F.get("shingles", F.lit(0)))
    verified = close.join(broadcast_if_small(texts, BROADCAST_ROWS // 50), ["item_id", "item_fp"]).select(
        "doc_id", "item_id", "start", begins.alias("begins"), weighted_jaccard(F.col("shingles"), F.col("item_shingles")).alias("s")
    )
    best = verified.where(F.col("s") >= similarity).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("s", "begins", (-F.col("start")).alias("back"))).alias("best")
    )
    return best.select(
        "doc_id", "item_id", F.round("best.s", 6).alias("similarity"), (-F.col("best.back")).cast("int").alias("start_word")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The input without the rows that ``contaminated`` finds; rows are told apart by id and text."""
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    found = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark, shingle, similarity)
    goes = materialize(found.select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    names = docs.columns
    inner = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    left = inner.join(broadcast_if_small(goes), "key", "left_anti")
    return left.select(*(F.col("row")[c].alias(c) for c in names))


_WORDS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
#: Every window of every document, one word apart; a window without a shared shingle has similarity 0 and makes no row.
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {_WORDS_SQL} AS words FROM documents),
items AS (SELECT row_number() OVER () AS i, item_id, words, len(words) AS n, least(len(words), {SHINGLE}) AS k FROM (SELECT DISTINCT item_id, {_WORDS_SQL} AS words FROM benchmark) WHERE len(words) > 0),
ranged AS (SELECT d, words, len(words) AS m, k, unnest(range(0, len(words) - k + 1)) AS pos FROM docs, (SELECT DISTINCT k FROM items) WHERE len(words) >= k),
grams AS (SELECT d, m, k, pos, array_to_string(words[pos + 1:pos + k], ' ') AS gram FROM ranged),
item_ranged AS (SELECT i, words, n, k, unnest(range(0, n - k + 1)) AS pos FROM items),
wanted AS (SELECT i, n, k, array_to_string(words[pos + 1:pos + k], ' ') AS gram, count(*) AS c FROM item_ranged GROUP BY ALL),
placed AS (
  SELECT d, i, m, n, k, gram, c, pos, unnest(range(greatest(pos - (least(m, n) - k), 0), least(pos, greatest(m - n, 0)) + 1)) AS start
  FROM grams JOIN wanted USING (k, gram)),
held AS (SELECT d, i, m, n, k, start, least(count(*), c) AS c, bool_or(pos = start) AS begins FROM placed GROUP BY d, i, m, n, k, start, gram, placed.c),
scored AS (
  SELECT d, i, start, sum(c) / (least(m, n) - k + 1 + n - k + 1 - sum(c)) AS s, bool_or(begins) OR start = greatest(m - n, 0) AS begins
  FROM held GROUP BY d, i, m, n, k, start),
best AS (
  SELECT doc_id, item_id, s, start, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY s DESC, begins DESC, start) AS r
  FROM scored JOIN docs USING (d) JOIN items USING (i) WHERE s >= {SIMILARITY})
SELECT doc_id, item_id, round(s, 6) AS similarity, start::INTEGER AS start_word FROM best WHERE r = 1
"""
