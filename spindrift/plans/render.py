"""Text forms of query results for people and tools; they take collected, limited results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def search_results(query: str, found: DataFrame) -> str:
    rows = found.collect()
    if not rows:
        return f"No results for: {query}"
    out = [f"# {len(rows)} results for: {query}"]
    for i, r in enumerate(rows, 1):
        out.append(f"## {i}. {r['file_path']}:{r['start_line']}-{r['end_line']} ({r['score'] * 100:.1f}%)\n```\n{r['content']}\n```")
    return "\n\n".join(out)


def file_list(found: DataFrame, glob: str | None = None) -> str:
    paths = [r["file_path"] for r in found.collect()]
    head = f"{len(paths)} files" + (f" matching {glob}" if glob else "")
    return "\n".join([head, *(f"- {p}" for p in paths)])


def symbol_list(found: DataFrame) -> str:
    out = []
    for r in found.collect():
        score = f" ({r['score'] * 100:.0f}%)" if "score" in found.columns else ""
        out.append(f"- **{r['name']}** {r['kind']} {r['file_path']}:{r['start_line']}{score}" + (f"\n  `{r['signature']}`" if r["signature"] else ""))
    return "\n".join(out) or "No symbols."


def references(name: str, found: DataFrame) -> str:
    rows = found.collect()
    files = {r["file_path"] for r in rows}
    return "\n".join([f"{len(rows)} references to {name} in {len(files)} files", *(f"- {r['file_path']}:{r['start_line']} {r['line_content']}" for r in rows)])
