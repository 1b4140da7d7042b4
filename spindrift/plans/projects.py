"""Projects on the driver: detection, where their index lies, and the registry."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

LOCAL_DIR = ".spindrift"
MAX_DEPTH = 100
#: What marks the root of a project, in order of priority, and its type.
MARKERS = (
    (LOCAL_DIR, 0, "generic"), (".git", 1, "git"), ("Cargo.toml", 2, "rust"), ("package.json", 2, "node"), ("pyproject.toml", 2, "python"),
    ("go.mod", 2, "go"), ("pom.xml", 2, "java"), ("build.gradle", 2, "java"), ("setup.py", 3, "python"), ("requirements.txt", 3, "python"),
    ("Makefile", 10, "generic"), (".editorconfig", 10, "generic"),
)


def find_markers(folder: str) -> list[tuple[str, int, str]]:
    return [m for m in MARKERS if os.path.exists(os.path.join(folder, m[0]))]


def is_root(folder: str) -> bool:
    return bool(find_markers(folder))


@dataclass
class Detected:
    root: str
    marker: str | None
    type: str


def detect(start: str) -> Detected:
    """The nearest folder upward with an index of its own; else the nearest with any marker; else the start."""
    at, found = os.path.realpath(start), None
    for _ in range(MAX_DEPTH):
        if os.path.isdir(os.path.join(at, LOCAL_DIR)):
            return Detected(at, LOCAL_DIR, "generic")
        if found is None and (here := find_markers(at)):
            best = min(here, key=lambda m: m[1])
            found = Detected(at, best[0], best[2])
        up = os.path.dirname(at)
        if up == at:
            break
        at = up
    return found or Detected(os.path.realpath(start), None, "generic")


def project_id(root: str) -> str:
    """The same as ``functions.text.project_id`` of the real path."""
    path = os.path.realpath(root).rstrip("/")
    name = re.sub(r"[^\w-]", "-", path.rpartition("/")[2]).lower()
    return f"{name}-{hashlib.md5(path.encode()).hexdigest()[:8]}"


@dataclass
class Location:
    root: str
    base: str
    is_local: bool

    @property
    def table(self) -> str:
        return f"{self.base}/chunks"

    @property
    def keywords(self) -> str:
        return f"{self.base}/keywords"


def resolve(root: str, shared: str) -> Location:
    """In the project if it has a folder for it, else below the shared folder by id."""
    local = os.path.join(os.path.realpath(root), LOCAL_DIR)
    if os.path.isdir(local):
        return Location(root, local, True)
    return Location(root, f"{shared.rstrip('/')}/{project_id(root)}", False)


def needs_index(policy: str, exists: bool, stale: bool) -> bool:
    """never, on_missing, or on_missing_or_stale"""
    return {"never": False, "on_missing": not exists, "on_missing_or_stale": not exists or stale}[policy]


@dataclass
class Project:
    name: str
    path: str
    created_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    last_indexed: str | None = None
    file_count: int | None = None
    chunk_count: int | None = None
    index_size_bytes: int | None = None


class Registry:
    """Named projects in one JSON file, written beside and renamed over. The first one added is the default."""

    def __init__(self, path: str):
        self.path = path
        self.projects: dict[str, Project] = {}
        self.default: str | None = None
        if os.path.exists(path):
            with open(path, encoding="utf-8") as file:
                raw = json.load(file)
            self.projects = {n: Project(**p) for n, p in raw["projects"].items()}
            self.default = raw.get("default")

    def save(self) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        beside = f"{self.path}.{uuid.uuid4().hex[:8]}"
        with open(beside, "w", encoding="utf-8") as file:
            json.dump({"projects": {n: asdict(p) for n, p in self.projects.items()}, "default": self.default}, file, indent=1)
            file.flush()
            os.fsync(file.fileno())
        os.replace(beside, self.path)

    def add(self, name: str, path: str) -> Project:
        if name in self.projects:
            raise ValueError(f"a project named {name} exists")
        self.projects[name] = Project(name, os.path.realpath(path))
        self.default = self.default or name
        self.save()
        return self.projects[name]

    def remove(self, name: str) -> None:
        del self.projects[name]
        if self.default == name:
            self.default = None
        self.save()

    def set_default(self, name: str) -> None:
        if name not in self.projects:
            raise KeyError(name)
        self.default = name
        self.save()

    def find_by_path(self, path: str) -> Project | None:
        """The project whose folder holds the path, the innermost if there are more."""
        real = os.path.realpath(path)
        holders = [p for p in self.projects.values() if real == p.path or real.startswith(p.path + os.sep)]
        return max(holders, key=lambda p: len(p.path), default=None)

    def update_stats(self, name: str, file_count: int, chunk_count: int, index_size_bytes: int) -> None:
        p = self.projects[name]
        p.file_count, p.chunk_count, p.index_size_bytes = file_count, chunk_count, index_size_bytes
        p.last_indexed = datetime.now(UTC).isoformat()
        self.save()

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p.name, p.path, p.created_at, p.last_indexed, p.file_count, p.chunk_count, p.index_size_bytes, p.name == self.default) for p in self.projects.values()]
        schema = "name string, path string, created_at string, last_indexed string, file_count long, chunk_count long, index_size_bytes long, is_default boolean"
        return spark.createDataFrame(rows, schema).orderBy("name")


def shared_indexes(shared: str) -> list[tuple[str, str, str]]:
    """(id, name, hash) of the indexes below the shared folder, by id."""
    names = sorted(os.listdir(shared)) if os.path.isdir(shared) else []
    matches = ((n, re.fullmatch(r"(.+)-([0-9a-f]{8})", n)) for n in names if os.path.isdir(os.path.join(shared, n)))
    return [(n, m[1], m[2]) if m else (n, n, "") for n, m in matches]


def remove_index(shared: str, index_id: str) -> None:
    """Delete one index below the shared folder by its id."""
    if index_id not in {i for i, _, _ in shared_indexes(shared)}:
        raise KeyError(index_id)
    shutil.rmtree(os.path.join(shared, index_id))
