"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) the vectors of its letters,
each permuted (rotated) by its place; a document's vector bundles (adds) those of all its trigrams. A language's prototype
bundles its training documents, each scaled to length one. A document's language is that of the prototype with the largest
cosine. Words are padded with one boundary symbol; case and everything that is no letter are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, held_out, map_arrow, materialize

DIMENSION = 1024
#: Documents of each language that prototypes are learned from: the first by hash of the id.
TRAIN_DOCS = 4096
UNKNOWN = "und"
SEED = 7
#: Trigram vectors, and letter vectors, that a worker keeps.
CACHE, LETTERS = 1 << 14, 1 << 12
_PIECE = 1 << 20


class Encoder:
    """Bundled trigram vectors of texts."""

    def __init__(self, dimension: int = DIMENSION, seed: int = SEED):
        self.dimension, self.seed = dimension, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((1024, dimension), np.float32)
        self.is_letter = np.zeros(0x110000, np.int8) - 1

    def letter(self, code: int) -> np.ndarray:
        vector = self.letters.get(code)
        if vector is None:
            if len(self.letters) >= LETTERS:
                self.letters.clear()
            noise = np.random.Generator(np.random.PCG64(zlib.crc32(f"{self.seed}:{code}".encode())))
            vector = self.letters[code] = noise.integers(0, 2, self.dimension).astype(np.float32) * 2 - 1
        return vector

    def codes(self, text: str) -> np.ndarray:
        """Code points of lower-cased letters; 0 stands for each run of anything else, and at both ends."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known = self.is_letter
        if (unseen := points[known[points] < 0]).size:
            for p in np.unique(unseen).tolist():
                known[p] = chr(p).isalpha()
        letters = np.concatenate([[0], np.where(known[points] == 1, points, 0), [0]]).astype(np.uint64)
        inside = letters != 0
        return letters[np.concatenate([[True], inside[1:] | inside[:-1]])]

    def vector_rows(self, trigrams: list[int]) -> np.ndarray:
        """Rows of the table that hold the trigrams' vectors, made where they are new."""
        rows = self.rows
        if len(rows) + len(trigrams) > max(CACHE, len(trigrams)):
            rows.clear()
        for t in trigrams:
            if t not in rows:
                at = rows[t] = len(rows)
                if at >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                a, b, c = t >> 42, t >> 21 & 0x1FFFFF, t & 0x1FFFFF
                self.table[at] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
        return np.array([rows[t] for t in trigrams], np.intp)

    def encode(self, text: str | None) -> np.ndarray | None:
        """The bundle over the whole text; None if it has no letter."""
        total, found = np.zeros(self.dimension, np.float64), False
        codes = self.codes(text or "")
        for at in range(0, max(len(codes) - 2, 0), _PIECE):
            part = codes[at : at + _PIECE + 2]
            trigrams, counts = np.unique(part[:-2] << np.uint64(42) | part[1:-1] << np.uint64(21) | part[2:], return_counts=True)
            for lo in range(0, len(trigrams), CACHE):
                some = trigrams[lo : lo + CACHE].tolist()
                rows = self.vector_rows(some)
                total += counts[lo : lo + CACHE].astype(np.float32) @ self.table[rows]
            found |= bool((part != 0).any())
        return total if found else None


def train(docs: DataFrame, per_language: int = TRAIN_DOCS, dimension: int = DIMENSION, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes of unit length by language, from rows that are not held out and have a language.

    Only ids and languages are ranked; the texts of at most ``per_language`` rows of each language are read for
    it, and what comes to the driver is one vector for each language.
    """
    ranked = docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # hashes are even over their range: a language's first rows lie below that share of it, with room to spare;
    # so no task ranks more of a frequent language than a rare one has
    totals = materialize(ranked.groupBy("lang").count(), "languages")
    place = (F.col("h") / 2.0**64 + 0.5) * F.col("count")
    low = ranked.join(broadcast_if_small(totals), "lang").where(place <= 1.2 * per_language + 100)
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = low.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_language)
    ids = broadcast_if_small(materialize(chosen.select("doc_id").distinct(), "training-ids"))

    def bundle(batches):
        encoder = Encoder(dimension, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                vector = encoder.encode(text)
                if vector is not None and (norm := np.linalg.norm(vector)):
                    sums[lang] = sums.get(lang, 0) + vector / norm
        yield pa.record_batch(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            names=["lang", "v"],
        )

    some = docs.where(~held_out() & F.col("lang").isNotNull()).join(ids, "doc_id", "left_semi")
    rows = map_arrow(some.select("lang", "text"), bundle, "lang string, v array<double>")
    summed = rows.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    totals: dict[str, np.ndarray] = {}
    for row in summed.collect():  # one number for each language and dimension
        totals.setdefault(row["lang"], np.zeros(dimension))[row["i"]] = row["x"]
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(totals.items())}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], dimension: int = DIMENSION, seed: int = SEED,
             keep: tuple[str, ...] = (), prediction: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """doc_id, held_out and the ``prediction`` columns for every input row; with ``keep`` these input columns instead of the first two.

    score is the cosine with the nearest prototype, at least 0. Defined cases: a text that is null or has no letter is
    "und" with score 0, as is every text if no prototype was learned; equal cosines go to the
    language first in the alphabet; a null doc_id is held out; repeated rows give repeated rows; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float64).reshape(len(names), dimension)
    shared = spark.sparkContext.broadcast((names, matrix))

    source = f"kept_{keep.index('text')}" if "text" in keep else "text"

    def run(batches):
        encoder = Encoder(dimension, seed)
        languages, profiles = shared.value
        for batch in batches:
            found, scores = [], []
            for text in batch.column(source):
                vector = encoder.encode(text.as_py()) if languages else None
                norm = 0.0 if vector is None else float(np.linalg.norm(vector))
                if not norm:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = profiles @ vector / norm
                best = int(cosines.argmax())
                found.append(languages[best])
                scores.append(float(min(max(cosines[best], 0.0), 1.0)))
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch(
                [*(batch.column(c) for c in kept), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=[*kept, "lang_pred", "score"],
            )

    columns = [F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out")]
    if source == "text":
        columns.append(F.col("text").cast("string").alias("text"))
    inner = docs.select(*columns, *(F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema if f.name != "text")
    out = map_arrow(inner, run, f"{types}, lang_pred string, score double")
    if keep:
        return out.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), F.col("lang_pred").alias(prediction[0]), F.col("score").alias(prediction[1]))
    return out.select("doc_id", "held_out", *(F.col(c).alias(n) for c, n in zip(("lang_pred", "score"), prediction, strict=True)))


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, then predict all rows."""
    return identify(docs, train(docs))
