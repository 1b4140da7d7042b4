"""Counters and histograms over tables, and their text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the histograms' buckets.
BUCKETS = {
    "search_latency_seconds": (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0),
    "search_results_count": (0.0, 1.0, 5.0, 10.0, 20.0, 50.0),
    "indexing_duration_seconds": (0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0),
    "embedding_latency_seconds": (0.01, 0.05, 0.1, 0.5, 1.0, 2.0),
    "batched_files_count": (1.0, 10.0, 50.0, 100.0, 500.0, 1000.0),
}


def histogram(rows: DataFrame, value: str, buckets, digits: int = 6) -> DataFrame:
    """One pass: (le, n, total, average), one row for each bucket, counts cumulative; the last bucket is infinite."""
    bounds = [*map(float, buckets), float("inf")]
    v = F.col(value)
    sums = rows.agg(
        *(F.count(F.when(v <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)),
        F.round(F.coalesce(F.sum(v.cast("double")), F.lit(0.0)), digits).alias("total"),
        F.round(F.coalesce(F.avg(v.cast("double")), F.lit(0.0)), digits).alias("average"),
    )
    pairs = F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)))
    return sums.select(F.explode(pairs).alias("x"), "total", "average").select("x.le", "x.n", "total", "average")


def exposition(name: str, help_text: str, found: DataFrame) -> str:
    """The histogram in the text format that metric servers scrape."""
    rows = found.orderBy("le").collect()  # one row for each bucket
    lines = [f"# HELP {name} {help_text}", f"# TYPE {name} histogram"]
    for r in rows:
        bound = "+Inf" if r["le"] == float("inf") else f"{r['le']:g}"
        lines.append(f'{name}_bucket{{le="{bound}"}} {r["n"]}')
    lines += [f"{name}_sum {rows[-1]['total']:g}", f"{name}_count {rows[-1]['n']}"]
    return "\n".join(lines) + "\n"


class Metrics:
    """Process-wide counters and gauges of the engine; tables are measured by ``histogram``."""

    def __init__(self):
        self.counters: dict[str, float] = {}
        self.samples: dict[str, list[float]] = {}

    def count(self, name: str, by: float = 1) -> None:
        self.counters[name] = self.counters.get(name, 0) + by

    def gauge(self, name: str, value: float) -> None:
        self.counters[name] = value

    def observe(self, name: str, value: float) -> None:
        bounds = (*BUCKETS[name], float("inf"))
        held = self.samples.setdefault(name, [0.0] * (len(bounds) + 1))
        for i, b in enumerate(bounds):
            held[i] += value <= b
        held[-1] += value

    def average(self, name: str) -> float:
        held = self.samples.get(name)
        return held[-1] / held[-2] if held and held[-2] else 0.0

    def text(self) -> str:
        out = []
        for name, value in sorted(self.counters.items()):
            out += [f"# TYPE {name} {'counter' if name.endswith('_total') else 'gauge'}", f"{name} {value:g}"]
        for name, held in sorted(self.samples.items()):
            out.append(f"# TYPE {name} histogram")
            for b, n in zip((*BUCKETS[name], float("inf")), held, strict=False):
                out.append(f'{name}_bucket{{le="{"+Inf" if b == float("inf") else format(b, "g")}"}} {n:g}')
            out += [f"{name}_sum {held[-1]:g}", f"{name}_count {held[-2]:g}"]
        return "\n".join(out) + "\n"
