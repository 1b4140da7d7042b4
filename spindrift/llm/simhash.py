"""SimHash near-deduplication with pigeonhole blocks.

Fingerprints are 64-bit majorities over the XXH64 values of word shingles. Two fingerprints that
differ in at most 3 bits agree in at least 3 of 6 blocks, so every close pair meets under one of the
20 keys that three blocks form (31 to 33 bits each). Under each key the Hamming distances are verified
and a spanning forest of the links leaves the task, never all pairs; components join the forests.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_arrow, materialize
from .components import components

SEED = 42
SHINGLE = 3
RADIUS = 3
BLOCKS = 2 * RADIUS
#: Distinct fingerprints that one task compares under one key; larger keys are dealt out in pairs of parts.
PART = 65_536
_PIECE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, unsigned; 0 for a text without words. Whole text, repeated shingles count."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[shingle - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(last), _PIECE):
        part = zip(starts[at : at + _PIECE], last[at : at + _PIECE], strict=False)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in part], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * total > len(last), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), and key if the input has it: fp is the fingerprint as a signed long."""
    ids = ["doc_id", "key"] if "key" in docs.columns else ["doc_id"]

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([*map(batch.column, ids), pa.array(fps.view(np.int64))], names=[*ids, "fp"])

    thin = docs.select(*(F.col(c).cast("long").alias(c) for c in ids), F.col("text").cast("string").alias("text"))
    return map_arrow(thin, run, "".join(f"{c} long, " for c in ids) + "fp long")


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Masks of the unions of ``blocks`` - ``radius`` blocks, as signed longs."""
    width = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    starts = [0, *accumulate(width)]
    single = [((1 << w) - 1) << s for w, s in zip(width, starts, strict=False)]
    masks = [sum(single[i] for i in some) for some in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the graph of distinct ``fps`` (uint64) within ``radius``, as index pairs.

    Nodes outside the largest component so far are compared with all nodes, one at a time; nodes
    of the largest one need no comparison of their own, as its links to others show from the other end.
    """
    size = len(fps)
    if size == 2:
        return [(0, 1)] if (int(fps[0]) ^ int(fps[1])).bit_count() <= radius else []
    label = np.arange(size)
    members = np.ones(size, np.int64)
    done = np.zeros(size, bool)
    links: list[tuple[int, int]] = []
    largest = 0
    while len(rest := np.flatnonzero(~done & (label != largest))):
        pivot = int(rest[0])
        done[pivot] = True
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[pivot]) <= radius)
        labels, first = np.unique(label[near], return_index=True)
        links += [(pivot, int(near[i])) for i, x in zip(first, labels, strict=True) if x != label[pivot]]
        target = int(labels[members[labels].argmax()])
        for x in labels:
            if x != target:
                label[label == x] = target
                members[target] += members[x]
                members[x] = 0
        if members[target] > members[largest]:
            largest = target
    return links


def _link_sorted(radius: int):
    """mapInArrow over rows (key columns, fp) that are sorted by key: links (u, v) of each key."""

    def emit(fps: np.ndarray):
        distinct = np.unique(fps).view(np.uint64)
        if len(distinct) < 2:
            return []
        signed = distinct.view(np.int64)
        return [(int(signed[a]), int(signed[b])) for a, b in spanning_links(distinct, radius)]

    def run(batches):
        held: list[np.ndarray] = []
        key = None
        out: list[tuple[int, int]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            keys, fps = columns[:-1], columns[-1]
            change = np.zeros(len(fps), bool)
            for c in keys:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(fps)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                own = tuple(int(c[lo]) for c in keys)
                if own != key:
                    if sum(map(len, held)) > 1:
                        out += emit(np.concatenate(held))
                    held, key = [], own
                held.append(fps[lo:hi])
            if len(out) >= 8192:
                yield _pairs(out)
                out = []
        if sum(map(len, held)) > 1:
            out += emit(np.concatenate(held))
        yield _pairs(out)

    return run


def _pairs(out):
    return pa.record_batch(
        [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["u", "v"]
    )


def hamming_links(distinct: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """distinct (fp) -> (u, v): links within ``radius`` that connect whatever all links connect.

    A key with more than ``part`` fingerprints is dealt out: its fingerprints fall into parts
    and each pair of parts is a group of its own, so no pair is lost and no task holds more than two parts.
    """
    masks = block_masks(radius, 2 * radius)
    keyed = distinct.select(
        "fp",
        F.explode(
            F.array(*(F.struct(F.lit(i).alias("b"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)))
        ).alias("x"),
    ).select("x.b", "x.k", "fp")
    hot = materialize(
        keyed.groupBy("b", "k").count().where(F.col("count") > part)
        .select("b", "k", F.ceil(F.col("count") / part).cast("int").alias("parts")),
        "hot-blocks",
    )
    split = keyed.join(broadcast_if_small(hot), ["b", "k"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1),
        lambda j: F.struct(
            F.least(j, F.coalesce(own, F.lit(0))).alias("i"), F.greatest(j, F.coalesce(own, F.lit(0))).alias("j")
        ),
    )
    dealt = split.select("b", "k", F.explode(pairs).alias("p"), "fp").select("b", "k", "p.i", "p.j", "fp")
    at = ["b", "k", "i", "j"]
    return map_arrow(dealt.repartition(*at).sortWithinPartitions(*at), _link_sorted(radius), "u long, v long")


def _components_of(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) of materialized fingerprints; root tells components apart even if ids repeat."""
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps")
    roots = materialize(components(hamming_links(distinct.select("fp"), radius), "simhash-edges"), "simhash-roots")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id.

    component_id is the smallest doc_id reachable over fingerprints that differ in at most
    ``radius`` bits. Defined cases: null, empty and blank texts have fingerprint zero, linked like any
    other; fewer words than a shingle are one shingle; equal fingerprints share a component; repeated
    rows give repeated rows; a null doc_id stays null and is never a component's id unless all of the
    component are null; an empty table gives no rows; other columns are ignored.
    """
    rows = materialize(fingerprints(docs.select("doc_id", "text"), shingle), "fingerprints")
    return rows.join(_components_of(rows, radius), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The input without all but one document of each component: the one with the smallest doc_id stays.

    Of rows that repeat an id, one stays; a null doc_id stays only if all of its component are null. The text is
    shuffled only if more documents go than may be broadcast.
    """
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    rows = materialize(fingerprints(docs.select("doc_id", "text", key.alias("key")), shingle), "fingerprints")
    known = materialize(rows.join(_components_of(rows, radius), "fp").select("key", "doc_id", "root", "component_id"), "components")
    stays = known.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("key").alias("key"))
    goes = materialize(known.select("key").distinct().join(stays.select("key"), "key", "left_anti"), "near-copies")
    twins = materialize(known.groupBy("key").count().where("count > 1").select("key").join(goes, "key", "left_anti"), "repeated-rows")
    names = docs.columns
    inner = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    left = inner.join(broadcast_if_small(goes), "key", "left_anti")
    if not twins.isEmpty():
        some = left.join(broadcast_if_small(twins), "key", "left_semi").dropDuplicates(["key"])
        left = left.join(broadcast_if_small(twins), "key", "left_anti").unionByName(some)
    return left.select(*(F.col("row")[c].alias(c) for c in names))
