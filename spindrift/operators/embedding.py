"""Embedding of text columns by providers: Python objects that are sent to the workers."""

from __future__ import annotations

import hashlib
import time
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 32
#: Vector lengths by model.
DIMENSIONS = {
    "all-minilm-l6-v2": 384, "bge-small-en-v1.5": 384, "nomic-embed-text-v1.5": 768, "bge-base-en-v1.5": 768, "bge-large-en-v1.5": 1024,
    "text-embedding-3-small": 1536, "text-embedding-ada-002": 1536, "text-embedding-3-large": 3072,
}
DEFAULT_MODEL = "nomic-embed-text-v1.5"
ALIASES = {"nomic": DEFAULT_MODEL, "minilm": "all-minilm-l6-v2", "bge-small": "bge-small-en-v1.5", "bge-base": "bge-base-en-v1.5", "bge-large": "bge-large-en-v1.5"}


@runtime_checkable
class Provider(Protocol):
    name: str
    dimension: int
    max_batch: int

    def embed(self, texts: list[str]) -> list: ...

    def embed_query(self, text: str): ...

    def healthy(self) -> bool: ...

    def capabilities(self) -> dict: ...


class BaseProvider:
    """What providers share: a query is embedded like any text, a provider is well if it embeds one."""

    local, batches = True, True

    def embed_query(self, text: str):
        return self.embed([text])[0]

    def healthy(self) -> bool:
        try:
            return len(self.embed_query("x")) == self.dimension
        except Exception:  # noqa: BLE001  whatever goes wrong, it is not well
            return False

    def capabilities(self) -> dict:
        return {"name": self.name, "dimension": self.dimension, "max_batch": self.max_batch, "local": self.local, "batches": self.batches}


def model_name(name: str) -> str:
    """The full name of a model or alias; unknown ones are the default."""
    low = name.lower().rpartition("/")[2]
    return low if low in DIMENSIONS else ALIASES.get(low, DEFAULT_MODEL)


def model_dimension(name: str) -> int:
    return DIMENSIONS[model_name(name)]


class HashProvider(BaseProvider):
    """Deterministic unit vectors from the MD5 of the text: for tests and plans without a model."""

    def __init__(self, dimension: int = 768, max_batch: int = BATCH):
        self.name, self.dimension, self.max_batch = "hash", dimension, max_batch

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            # fixed values of the generator: the multiplier and increment of a 64-bit congruential sequence
            state, values = int(hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()[:16], 16), []
            for _ in range(self.dimension):
                state = (state * 1103515245 + 12345) % (1 << 64)
                values.append((state // 65536) % 1000 / 1000)
            v = np.array(values, np.float64)
            norm = float(np.linalg.norm(v))
            out.append((v / norm if norm else v).astype(np.float32))
        return out


_sessions: dict[tuple[str, str], tuple] = {}


class LocalModelProvider(BaseProvider):
    """A transformer in an ONNX file with its tokenizer file: token vectors averaged under the attention mask, to length one.

    Only paths travel with a task; each worker process loads a model once. Paths must be readable on every worker.
    """

    def __init__(self, model: str, tokenizer: str, dimension: int, name: str = "local", max_batch: int = BATCH, max_tokens: int = 512):
        self.model, self.tokenizer, self.dimension, self.name = model, tokenizer, dimension, name
        self.max_batch, self.max_tokens = max_batch, max_tokens

    def _loaded(self):
        key = self.model, self.tokenizer
        if key not in _sessions:
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1  # a worker process stands for one core
            _sessions[key] = onnxruntime.InferenceSession(self.model, options, providers=["CPUExecutionProvider"]), Tokenizer.from_file(self.tokenizer)
        return _sessions[key]

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        session, tokenizer = self._loaded()
        wanted = {i.name for i in session.get_inputs()}
        out: list[np.ndarray] = []
        for at in range(0, len(texts), self.max_batch):
            ids = [e.ids[: self.max_tokens] or [0] for e in tokenizer.encode_batch(texts[at : at + self.max_batch])]
            width = max(map(len, ids))
            matrix, mask = np.zeros((len(ids), width), np.int64), np.zeros((len(ids), width), np.int64)
            for row, seen, own in zip(matrix, mask, ids, strict=True):
                row[: len(own)], seen[: len(own)] = own, 1
            given = {"input_ids": matrix, "attention_mask": mask, "token_type_ids": np.zeros_like(matrix)}
            states = session.run(None, {k: v for k, v in given.items() if k in wanted})[0].astype(np.float64)
            mean = (states * mask[:, :, None]).sum(axis=1) / mask.sum(axis=1)[:, None]
            norm = np.linalg.norm(mean, axis=1, keepdims=True)
            out += list((mean / np.where(norm > 0, norm, 1)).astype(np.float32))
        return out


class TokenBucket:
    """At most ``per_minute`` calls a minute; ``wait`` sleeps until one is free."""

    def __init__(self, per_minute: float = 3500, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.most, self.clock, self.sleep = per_minute / 60, per_minute, clock, sleep
        self.held, self.at = per_minute, clock()

    def wait(self) -> None:
        now = self.clock()
        self.held, self.at = min(self.most, self.held + (now - self.at) * self.rate), now
        if self.held < 1:
            self.sleep((1 - self.held) / self.rate)
            self.held, self.at = 1, self.clock()
        self.held -= 1


class RemoteProvider(BaseProvider):
    """A remote service behind ``call(texts) -> vectors``: rate limit, batches, and retries with doubling delays.

    ``per_minute`` is the service's limit; as each worker process has a bucket of its own, ``workers`` (how many run at
    once) divides it.
    """

    local = False

    def __init__(self, call, name: str, dimension: int, max_batch: int = 2048, per_minute: float = 3500, retries: int = 3, delay: float = 1.0, workers: int = 1):
        self.call, self.name, self.dimension, self.max_batch = call, name, dimension, min(max_batch, 2048)
        self.per_minute, self.retries, self.delay = per_minute / workers, retries, delay
        self._bucket: TokenBucket | None = None

    def embed(self, texts: list[str]) -> list:
        self._bucket = self._bucket or TokenBucket(self.per_minute)
        out: list = []
        for at in range(0, len(texts), self.max_batch):
            for attempt in range(self.retries + 1):
                self._bucket.wait()
                try:
                    out += self.call(texts[at : at + self.max_batch])
                    break
                except Exception:
                    if attempt == self.retries:
                        raise
                    time.sleep(self.delay * 2**attempt)
        return out


def json_service(url: str, model: str, key: str | None = None, timeout: float = 30.0):
    """A ``call`` for ``RemoteProvider``: one POST of {model, input} for each batch, answered by {data: [{index, embedding}]}."""

    def call(texts: list[str]) -> list:
        import json
        from urllib.request import Request, urlopen

        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        with urlopen(Request(url, json.dumps({"model": model, "input": texts}).encode(), headers), timeout=timeout) as answer:  # noqa: S310
            rows = json.load(answer)["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]

    return call


class FallbackProvider(BaseProvider):
    """Tries providers in order; all must have one dimension."""

    def __init__(self, providers: list):
        if len({p.dimension for p in providers}) != 1:
            raise ValueError("providers of one chain must have one dimension")
        self.providers, self.name = providers, "+".join(p.name for p in providers)
        self.dimension, self.max_batch = providers[0].dimension, min(p.max_batch for p in providers)

    def embed(self, texts: list[str]) -> list:
        failures = []
        for p in self.providers:
            try:
                return p.embed(texts)
            except Exception as e:  # noqa: BLE001  the next provider is tried
                failures.append(f"{p.name}: {e}")
        raise RuntimeError("; ".join(failures))


def embed(rows: DataFrame, provider: Provider, column: str = "content", into: str = "vector", batch: int = BATCH, error: str | None = None) -> DataFrame:
    """Rows with a vector of the text. A batch that fails gets zero vectors, and its message in ``error`` if named."""
    size = min(batch, provider.max_batch)
    names = rows.columns

    def run(batches):
        model = provider  # travels with the task, so that classes of the caller's own work too
        for b in batches:
            texts = [t or "" for t in b.column(column).to_pylist()]
            vectors, errors = [], []
            for at in range(0, len(texts), size):
                some = texts[at : at + size]
                try:
                    got = [np.asarray(v, np.float32) for v in model.embed(some)]
                    if len(got) != len(some) or any(len(v) != model.dimension for v in got):
                        raise ValueError("wrong number or length of vectors")
                    errors += [None] * len(some)
                except Exception as e:  # noqa: BLE001  the rows are kept, the failure is shown
                    got = [np.zeros(model.dimension, np.float32)] * len(some)
                    errors += [f"{type(e).__name__}: {e}"] * len(some)
                vectors += got
            extra = [pa.array(vectors, pa.list_(pa.float32()))] + ([pa.array(errors, pa.string())] if error else [])
            yield pa.record_batch([*(b.column(c) for c in names), *extra], names=[*names, into, *([error] if error else [])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `{into}` array<float>" + (f", `{error}` string" if error else ""))


def zero_vectors(rows: DataFrame, column: str = "vector") -> DataFrame:
    """Rows whose embedding failed."""
    return rows.where(F.forall(column, lambda x: x == 0))
