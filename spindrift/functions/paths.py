"""Path predicates and language detection as column expressions."""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which extensions are indexed, and which path parts are not, by default.
EXTENSIONS = ("rs", "py", "ts", "tsx", "js", "jsx", "go", "java", "c", "cc", "cpp", "cxx", "h", "hpp", "hxx")
IGNORED = ("node_modules", "target", ".git", "dist", "build", "__pycache__", ".venv", "vendor")

#: Language by extension, for lines, for syntax units, and for parsers.
LINE_LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "java": "java", "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "rb": "ruby",
    "php": "php", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "cs": "csharp",
}
UNIT_LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "java": "java",
}
PARSER_LANGUAGES = UNIT_LANGUAGES | {
    "mjs": "javascript", "cjs": "javascript", "tsx": "tsx", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "c++": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
}
#: The unit languages with C and C++, which the unit extractors also cover.
ALL_UNIT_LANGUAGES = UNIT_LANGUAGES | {"c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp"}


def file_name(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path) -> Column:
    """Text after the last dot of the file name; null without one, or where it is the only dot and leads."""
    return F.when(file_name(path).rlike(r"^.+\.[^.]*$"), F.regexp_extract(path, r"\.([^./]*)$", 1))


def _lookup(table: dict[str, str], key) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))[key]


def detect_language(path, table: str = "line") -> Column:
    """Language by extension. For lines an unknown extension is its own language; otherwise it has none."""
    ext = extension(path)
    if table == "line":
        return F.coalesce(_lookup(LINE_LANGUAGES, ext), ext)
    return _lookup({"unit": UNIT_LANGUAGES, "parser": PARSER_LANGUAGES, "all": ALL_UNIT_LANGUAGES}[table], ext)


def has_extension(path, extensions=EXTENSIONS) -> Column:
    """Case counts; a file without extension is out; no extensions mean all files."""
    return extension(path).isin(*extensions) if extensions else F.lit(True)


def is_ignored(path, patterns=IGNORED, mode: str = "substring") -> Column:
    """True if the path contains a pattern anywhere, or (``mode="component"``) as one of its parts."""
    if not patterns:
        return F.lit(False)
    if mode == "component":
        return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, patterns)))
    return reduce(lambda a, b: a | b, (F.contains(path, F.lit(p)) for p in patterns))


def glob_regex(glob: str) -> str:
    """A regular expression for a glob in which * and ? also cross /.

    ``**/`` also matches nothing; [abc], [a-z] and [!a] are classes. An open bracket is an error.
    """
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
            continue
        if c == "*":
            out.append(".*")
            while at + 1 < len(glob) and glob[at + 1] == "*":
                at += 1
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", at + 2)
            if end < 0:
                raise ValueError(f"invalid pattern: {glob}")
            inside = glob[at + 1 : end]
            negated = inside.startswith("!")
            body = re.sub(r"([\\^\[\]&])", r"\\\1", inside[negated:])
            out.append(f"[{'^' if negated else ''}{body}]")
            at = end
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "/_" else c)
        at += 1
    return "^" + "".join(out) + "$"


def matches_glob(path, glob: str | None) -> Column:
    """With the glob's fixed beginning as a prefix test, which Parquet scans can use."""
    if glob is None:
        return F.lit(True)
    fixed = re.match(r"[^*?\[]*", glob)[0]
    match = path.rlike(glob_regex(glob))
    return match & path.startswith(fixed) if fixed else match


def same_text(a, b) -> Column:
    """ASCII-case-insensitive equality; null is equal to nothing."""
    return F.lower(a) == F.lower(b)
