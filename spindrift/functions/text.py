"""Scalar functions on text: lines, headers, tokens, previews, scores and names. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_LINES = 50
WORD = r"([\p{L}\p{N}]+)"
#: Characters with a meaning in keyword query syntax.
QUERY_SYNTAX = '+-&|!(){}[]^"~*?:\\/'


def lines(content) -> Column:
    """Lines without their ends: split at LF, a CR before it dropped, no empty line after the last LF."""
    parts = F.split(content, r"\r?\n", -1)
    return F.when(content == "", F.array().cast("array<string>")).otherwise(
        F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    )


def file_header(content, count: int = HEADER_LINES) -> Column:
    return F.array_join(F.slice(lines(content), 1, count), "\n")


def token_estimate(content) -> Column:
    """UTF-8 bytes by four, rounded down: what chunk sizes are measured in."""
    return F.floor(F.octet_length(content) / 4)


def billed_tokens(content) -> Column:
    """UTF-8 bytes by four, rounded up: what remote embedding is billed by."""
    return F.ceil(F.octet_length(content) / 4)


def tokens(content) -> Column:
    """Keyword tokens: lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(content), F.lit(WORD), 1)


def escape_query(query) -> Column:
    """The query with syntax characters replaced by spaces."""
    return F.translate(query, QUERY_SYNTAX, " " * len(QUERY_SYNTAX))


def preview(content, count: int = 5) -> Column:
    """The first lines indented by three spaces, and dots if there are more."""
    every = lines(content)
    shown = F.array_join(F.transform(F.slice(every, 1, count), lambda x: F.concat(F.lit("   "), x)), "\n")
    return F.when(F.size(every) > count, F.concat(shown, F.lit("\n   ..."))).otherwise(shown)


def distance_score(distance) -> Column:
    return 1 / (1 + distance)


def score_percent(score, digits: int = 0) -> Column:
    return F.round(score * 100, digits)


def sanitize_name(name) -> Column:
    """Lower case, everything but letters, digits, - and _ replaced by -."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "-"))


def project_id(root) -> Column:
    """The sanitised last part of a path and eight hex digits of the MD5 of the path without a slash at its end."""
    path = F.regexp_replace(root, "/+$", "")
    return F.concat_ws("-", sanitize_name(F.element_at(F.split(path, "/"), -1)), F.substring(F.md5(path), 1, 8))


def human_bytes(size) -> Column:
    """B, KB, MB or GB; all but B with two decimals, halves to even.

    The rounding is of the exact binary value: a scaled size has at most 30 binary places, so hundredths of its fraction are exact.
    """

    def scaled(power, unit):
        value = size / float(1024**power)
        hundredths = F.rint((value - F.floor(value)) * 100).cast("long")
        whole = F.floor(value) + F.floor(hundredths / 100)
        return F.format_string(f"%d.%02d {unit}", whole, hundredths % 100)

    return (
        F.when(size >= 1024**3, scaled(3, "GB")).when(size >= 1024**2, scaled(2, "MB")).when(size >= 1024, scaled(1, "KB"))
        .when(size.isNotNull(), F.format_string("%d B", size.cast("long")))
    )


def truncate_end(text, most: int) -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def truncate_start(text, most: int) -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.lit("..."), F.right(text, F.lit(most - 3))))


def edit_distance(a, b, most: int | None = None) -> Column:
    """Levenshtein distance over characters; -1 beyond ``most``."""
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def chunk_id(file_path, start_line, end_line) -> Column:
    """Stable id of a chunk; it names the place, not the text."""
    return F.sha2(F.concat_ws("\x1f", file_path, start_line.cast("string"), end_line.cast("string")), 256)
