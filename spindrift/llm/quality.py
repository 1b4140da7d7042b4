"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded and filtered by learned kernels at every second byte. The filters' rectified responses are max-pooled
over overlapping chunks that cover the whole document; the mean and the maximum over the chunks are combined by
one logistic unit into one probability. Training (Adam, exact gradients) takes a bounded sample of labelled rows; training and scoring
read every byte of a text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_arrow, materialize

#: Bounds of the training sample: labelled rows (the first by hash of the id), and bytes of all their whole texts (a row beyond them is passed over).
TRAIN_DOCS = 4096
TRAIN_BYTES = 16 << 20
THRESHOLD = 0.3
KERNEL, STRIDE, EMBED, FILTERS = 12, 2, 4, 48
#: Positions of the kernel in a hop and in a chunk; a chunk overlaps the next by half.
HOP = 64
CHUNK = 2 * HOP
CHUNK_BYTES = CHUNK * STRIDE + KERNEL - STRIDE
_PIECE = 1 << 14
#: Chunks that training looks at together.
_STEP = 512


@dataclass
class Network:
    seed: int = 11
    weights: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
            self.weights = {
                "embed": normal(256, EMBED, scale=0.5),
                "kernel": normal(KERNEL * EMBED, FILTERS, scale=(KERNEL * EMBED) ** -0.5),
                "bias": np.zeros(FILTERS, np.float32),
                "out": normal(2 * FILTERS, scale=0.05),
                "offset": np.zeros(1, np.float32),
            }

    def score(self, text: bytes) -> float:
        """Probability of label 1 from all bytes of a document."""
        w = self.weights
        hops = max(-(-len(text) // (HOP * STRIDE)), 1)
        padded = np.zeros((hops + 1) * HOP * STRIDE + KERNEL - STRIDE, np.uint8)
        padded[: len(text)] = np.frombuffer(text, np.uint8)
        pooled = np.empty((hops + 1, FILTERS), np.float32)
        step = _PIECE // HOP
        for at in range(0, hops + 1, step):
            n = min(step, hops + 1 - at)
            part = padded[at * HOP * STRIDE : (at + n) * HOP * STRIDE + KERNEL - STRIDE]
            rows = _windows(w["embed"][part], n * HOP)
            pooled[at : at + n] = (rows @ w["kernel"]).reshape(n, HOP, FILTERS).max(axis=1)
        chunks = np.maximum(np.maximum(pooled[:-1], pooled[1:]) + w["bias"], 0)
        logit = chunks.mean(axis=0) @ w["out"][:FILTERS] + chunks.max(axis=0) @ w["out"][FILTERS:] + w["offset"][0]
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))

    def gradients(self, chunks: np.ndarray, doc: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Weighted mean log loss and its gradients; ``chunks`` (n, CHUNK_BYTES) belong to documents ``doc`` (0.., sorted)."""
        w, n, docs = self.weights, len(chunks), len(labels)
        place, raw = np.empty((n, FILTERS), np.int16), np.empty((n, FILTERS), w["kernel"].dtype)
        for at in range(0, n, _STEP):
            some = chunks[at : at + _STEP]
            response = (_windows_of(w["embed"][some]) @ w["kernel"]).reshape(len(some), CHUNK, FILTERS)
            place[at : at + _STEP] = response.argmax(axis=1)
            raw[at : at + _STEP] = response.max(axis=1) + w["bias"]
        pooled = np.maximum(raw, 0)
        starts = np.searchsorted(doc, np.arange(docs))
        size = np.bincount(doc, minlength=docs).astype(np.float32)[:, None]
        mean, top = np.add.reduceat(pooled, starts) / size, np.maximum.reduceat(pooled, starts)
        logit = mean @ w["out"][:FILTERS] + top @ w["out"][FILTERS:] + w["offset"]
        p = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
        loss = -np.mean(weight * np.where(labels == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9)))
        error = (weight * (p - labels) / docs).astype(np.float32)
        is_top = pooled == top[doc]
        ties = np.add.reduceat(is_top.astype(np.float32), starts)[doc]
        to_mean = (error[:, None] * w["out"][:FILTERS] / size)[doc]
        to_top = (error[:, None] * w["out"][FILTERS:])[doc] * is_top / ties
        g = ((to_mean + to_top) * (raw > 0)).astype(np.float32)
        embed, kernel = np.zeros((256, EMBED)), np.zeros_like(w["kernel"])
        for begin in range(0, n, _STEP):
            part, size = g[begin : begin + _STEP], len(g[begin : begin + _STEP])
            at = place[begin : begin + _STEP, :, None].astype(np.int64) * STRIDE + np.arange(KERNEL)
            byte = chunks[np.arange(begin, begin + size)[:, None, None], at]
            picked = w["embed"][byte].reshape(size, FILTERS, KERNEL * EMBED)
            kernel += np.einsum("nf,nfk->kf", part, picked, optimize=True)
            into = (part[:, :, None] * w["kernel"].T).reshape(size, FILTERS, KERNEL, EMBED)
            embed += np.stack([np.bincount(byte.ravel(), into[..., e].ravel(), 256) for e in range(EMBED)], axis=1)
        return float(loss), {
            "embed": embed.astype(np.float32),
            "kernel": kernel,
            "bias": g.sum(axis=0),
            "out": np.concatenate([error @ mean, error @ top]),
            "offset": error.sum(keepdims=True),
        }

    def fit(self, documents: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 4e-3) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch.

        The rarer label weighs more by the root of the ratio of their numbers.
        """
        ratio = max(int((labels == 1).sum()), 1) / max(int((labels == 0).sum()), 1)
        weights = np.where(labels == 0, ratio**0.5, 1.0)
        rng = np.random.default_rng(self.seed + 1)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, history = 0, []
        for epoch in range(epochs):
            order, losses = rng.permutation(len(documents)), []
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                doc = np.repeat(np.arange(len(some)), [len(documents[i]) for i in some])
                loss, gradient = self.gradients(np.concatenate([documents[i] for i in some]), doc, labels[some], weights[some])
                losses.append(loss)
                step += 1
                speed = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in gradient.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.weights[k] -= (speed * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
            history.append(float(np.mean(losses)))
        return history


def _windows(embedded: np.ndarray, positions: int) -> np.ndarray:
    """(positions, KERNEL * EMBED): what the kernel sees at every stride."""
    step = embedded.strides[0]
    view = np.lib.stride_tricks.as_strided(
        embedded, (positions, KERNEL, EMBED), (STRIDE * step, step, embedded.strides[1]), writeable=False
    )
    return view.reshape(positions, KERNEL * EMBED)


def _windows_of(embedded: np.ndarray) -> np.ndarray:
    n = len(embedded)
    a, b, c = embedded.strides
    view = np.lib.stride_tricks.as_strided(
        embedded, (n, CHUNK, KERNEL, EMBED), (a, STRIDE * b, b, c), writeable=False
    )
    return view.reshape(n * CHUNK, KERNEL * EMBED)


def training_chunks(text: bytes) -> np.ndarray:
    """All of the document's chunks, as (n, CHUNK_BYTES)."""
    hops = max(-(-len(text) // (HOP * STRIDE)), 1)
    padded = np.zeros((hops + 1) * HOP * STRIDE + KERNEL - STRIDE, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK_BYTES)[:: HOP * STRIDE]


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES, epochs: int = 12) -> Network:
    """A network fitted to at most ``most`` labelled rows that are not held out, of ``most_bytes`` together.

    Ids are ranked by hash before any text is read; in that order, rows are taken whole as long as they fit. Of rows that
    repeat an id the greatest text counts. Without both labels among them the network stays as it was drawn.
    """
    known = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    some = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = materialize(some.groupBy("doc_id", "quality").agg(F.max("text").alias("text")), "labelled-texts")
    taken, total = [], 0
    for r in rows.select("doc_id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if total + r["size"] <= most_bytes:
            taken.append(r["doc_id"])
            total += r["size"]
    found = rows.where(F.col("doc_id").isin(taken)).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    network, marks = Network(), np.array([r["quality"] for r in found], np.int64)
    if len(set(marks.tolist())) == 2:
        network.fit([training_chunks(_utf8(r["text"])) for r in found], marks, epochs)
    return network


def classify(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every input row.

    Defined cases: null and empty texts are one chunk of padding and get its score; a null doc_id is held
    out; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            scores = [shared.value.score(_utf8(t.as_py())) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = map_arrow(thin, run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows that are not held out, then score all rows."""
    return classify(docs, train(docs, labels))
