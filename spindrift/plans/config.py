"""Settings of an index: one TOML file, the nearest whole file wins."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields

from ..functions.chunks import CHUNK_TOKENS, MAX_UNIT_TOKENS, MIN_UNIT_TOKENS
from ..functions.paths import EXTENSIONS, IGNORED
from ..operators.fusion import KEYWORD_WEIGHT, RRF_K, VECTOR_WEIGHT


@dataclass
class IndexerConfig:
    extensions: tuple = EXTENSIONS
    ignore_patterns: tuple = IGNORED
    global_ignore_file: str | None = None
    chunk_size: int = CHUNK_TOKENS
    chunker_strategy: str = "ast"
    min_chunk_tokens: int = MIN_UNIT_TOKENS
    max_chunk_tokens: int = MAX_UNIT_TOKENS


@dataclass
class EmbeddingsConfig:
    provider: str = "hash"
    model: str = "nomic-embed-text-v1.5"
    batch_size: int = 32


@dataclass
class SearchConfig:
    mode: str = "hybrid"
    default_limit: int = 10
    vector_weight: float = VECTOR_WEIGHT
    keyword_weight: float = KEYWORD_WEIGHT
    rrf_k: int = RRF_K


@dataclass
class WatcherConfig:
    debounce_ms: int = 500
    threshold_files: int = 50
    threshold_rate: float = 20.0
    collection_delay_ms: int = 3000


@dataclass
class Config:
    indexer: IndexerConfig = field(default_factory=IndexerConfig)
    embeddings: EmbeddingsConfig = field(default_factory=EmbeddingsConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
    watcher: WatcherConfig = field(default_factory=WatcherConfig)
    auto_index: str = "on_missing"


def parse(text: str) -> Config:
    """Every field that a section leaves out has its default; unknown fields are an error."""
    raw = tomllib.loads(text)
    sections = {"indexer": IndexerConfig, "embeddings": EmbeddingsConfig, "search": SearchConfig, "watcher": WatcherConfig}
    made = {}
    for name, value in raw.items():
        if name in sections:
            known = {f.name for f in fields(sections[name])}
            if unknown := set(value) - known:
                raise ValueError(f"unknown settings in [{name}]: {', '.join(sorted(unknown))}")
            made[name] = sections[name](**{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})
        elif name == "auto_index":
            made[name] = value
        else:
            raise ValueError(f"unknown section: {name}")
    return Config(**made)


def load(*candidates: str) -> Config:
    """The first file that exists, else the defaults."""
    for path in candidates:
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as file:
                return parse(file.read())
    return Config()
