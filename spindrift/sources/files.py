"""File sources: listings, texts and single files, in any store that Spark can read."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import EXTENSIONS, IGNORED, has_extension, is_ignored

#: Paths that a read names one by one; more are found by reading the tree and joining.
NAMED_PATHS = 10_000
#: Characters that paths of a read would take for a pattern.
_PATTERN = re.compile(r"[\\*?\[\]{}]")


def _bare(path: str) -> str:
    return re.sub(r"^[A-Za-z][\w+.-]*:/*", "/", path).rstrip("/")


def _relative(path, root: str):
    """Path below the root, without a store's scheme."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    # a host after the scheme stands before the root's own path
    return F.regexp_replace(bare, "^" + re.escape(_bare(root)) + "/", "")


def list_tree(spark: SparkSession, root: str, extensions=EXTENSIONS, ignored=IGNORED, mode: str = "substring", hidden: bool = False) -> DataFrame:
    """(file_path, mtime, length) of the regular files below a root, in any store; contents are not read.

    Hidden parts (leading dot) and ignored paths are left out; ``ignore_rules`` and ``without_ignored`` add a tree's own rules.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = found.select(_relative(F.col("path"), root).alias("file_path"), F.unix_timestamp("modificationTime").alias("mtime"), "length")
    kept = rows.where(has_extension(F.col("file_path"), extensions) & ~is_ignored(F.col("file_path"), ignored, mode))
    return kept if hidden else kept.where(~F.col("file_path").rlike(r"(^|/)\."))


def read_tree(spark: SparkSession, root: str, paths: DataFrame | None = None, extensions=EXTENSIONS, ignored=IGNORED, mode: str = "substring", hidden: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files, errors): texts of a tree (or of some of its paths); what is no UTF-8 is an error row, not a failure.

    A few paths are read by name, so an incremental run opens only what changed; paths that are gone give nothing.
    """
    names = None
    if paths is not None:
        some = [r["file_path"] for r in paths.select("file_path").distinct().limit(NAMED_PATHS + 1).collect()]
        if len(some) <= NAMED_PATHS and not any(_PATTERN.search(p) for p in some):
            names = [f"{root.rstrip('/')}/{p}" for p in some]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    there = root if names is None else _existing(spark, names)
    if there:
        rows = found.option("ignoreMissingFiles", True).load(there)
    else:
        rows = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    path = _relative(F.col("path"), root).alias("file_path")
    texts = rows.select(path, F.unix_timestamp("modificationTime").alias("mtime"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    kept = texts.where(has_extension(F.col("file_path"), extensions) & ~is_ignored(F.col("file_path"), ignored, mode))
    if not hidden:
        kept = kept.where(~F.col("file_path").rlike(r"(^|/)\."))
    if paths is not None and names is None:
        kept = kept.join(paths.select("file_path").distinct(), "file_path", "left_semi")
    errors = kept.where("content is null").select(F.col("file_path").alias("path"), F.lit("file_read").alias("stage"), F.lit("not UTF-8").alias("error"))
    return kept.where("content is not null").select("file_path", "content", F.greatest("mtime", F.lit(0)).alias("mtime")), errors


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _existing(spark: SparkSession, names: list[str]) -> list[str]:
    """Those of a few paths that are files now."""
    if not names:
        return []
    fs = _path(spark, names[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [n for n in names if fs.exists(_path(spark, n)) and fs.getFileStatus(_path(spark, n)).isFile()]


# --- ignore files


def gitignore_rules(text: str, base: str = "") -> list[tuple[bool, bool, str]]:
    """(ignored, folders only, regular expression of a path) of the lines of an ignore file in the folder ``base``; the last that matches wins."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        rule = line[keep:].removeprefix("\\")
        anchored = "/" in rule.rstrip("/")
        body = "".join(
            {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(t) or (t.replace("[!", "[^") if t.startswith("[") else re.escape(t.removeprefix("\\")))
            for t in re.findall(r"\\.|/\*\*/|\*\*/|/\*\*|\*|\?|\[[^\]]+\]|[^*?\[/\\]+|.", rule.strip("/"))
        )
        start = re.escape(base.strip("/") + "/") if base.strip("/") else ""
        out.append((not keep, rule.endswith("/"), f"{start}{'' if anchored else '(?:.*/)?'}{body}"))
    return out


def is_path_ignored(path: str, rules: list[tuple[bool, bool, re.Pattern]]) -> bool:
    """By the last rule that matches the path; a file below an ignored folder is ignored whatever rules name it."""
    parts = path.split("/")
    for i in range(1, len(parts) + 1):
        some, folder = "/".join(parts[:i]), i < len(parts)
        state = False
        for ignore, folders_only, pattern in rules:
            if (folder or not folders_only) and pattern.fullmatch(some):
                state = ignore
        if state:
            return True
    return False


def ignore_rules(spark: SparkSession, root: str, global_file: str | None = None) -> list[tuple[bool, bool, str]]:
    """The rules of a tree, the weakest first: a global file's, ``.git/info/exclude``, then every folder's ``.gitignore`` from the root down."""
    from ..plans.store import Paths

    here = Paths(spark, root)
    if not here.exists():
        return []
    rules: list[tuple[bool, bool, str]] = []
    if global_file is not None:
        folder, _, name = global_file.rpartition("/")
        rules += gitignore_rules(Paths(spark, folder or ".").read(name) or "")
    rules += gitignore_rules(here.read(".git/info/exclude") or "")
    # ignore files are few and small beside what they rule; Spark leaves out names that begin with a dot, so folders are asked
    folders = list_tree(spark, root, (), (), hidden=True).select(F.regexp_replace("file_path", "/?[^/]*$", "").alias("folder")).distinct()
    every = {""}
    for r in folders.collect():
        parts = r["folder"].split("/") if r["folder"] else []
        every.update("/".join(parts[:i]) for i in range(1, len(parts) + 1))
    for folder in sorted(every, key=lambda f: (f.count("/") + bool(f), f)):
        text = here.read(f"{folder}/.gitignore".lstrip("/"))
        if text:
            rules += gitignore_rules(text, folder)
    return rules


def without_ignored(files: DataFrame, rules: list[tuple[bool, bool, str]]) -> DataFrame:
    """Files that the rules do not ignore. Only paths, and what stands beside them in a listing, travel to Python."""
    if not rules:
        return files

    def run(batches):
        compiled = [(ignore, folders, re.compile(pattern)) for ignore, folders, pattern in rules]
        for batch in batches:
            yield batch.filter(pa.array([not is_path_ignored(p, compiled) for p in batch.column("file_path").to_pylist()], pa.bool_()))

    return files.mapInArrow(run, files.schema)


# --- single files


def safe_path(root: str, path: str) -> str:
    """The real path of a file below a local root; one that leads out is an error."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path))
    if full != base and not full.startswith(base + os.sep):
        raise PermissionError(f"outside of the root: {path}")
    return full


def get_file(root: str, path: str, strip: bool = True, spark: SparkSession | None = None) -> str:
    """The text of one file; with a session also from stores other than this machine's disk."""
    scheme = re.match(r"([A-Za-z][\w+.-]*):", root)
    if scheme is None or scheme[1] == "file":
        with open(safe_path(_bare(root) if scheme else root, path), encoding="utf-8") as file:
            text = file.read()
    else:
        from ..plans.store import Paths

        inside = os.path.normpath(path)
        if os.path.isabs(path) or inside.split(os.sep)[0] == "..":
            raise PermissionError(f"outside of the root: {path}")
        text = Paths(spark, root).read(inside) if spark is not None else None
        if text is None:
            raise FileNotFoundError(f"{root.rstrip('/')}/{path}")
    return text.rstrip() if strip else text


def documents_as_files(docs: DataFrame) -> DataFrame:
    """The documents table as files: path from source, id and language, content and mtime."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return docs.select("doc_id", path.alias("file_path"), F.col("text").alias("content"), F.col("lang").alias("language"), F.col("doc_id").alias("mtime"))
