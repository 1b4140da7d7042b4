"""Compare a query with its SQL: row counts, column types and order-insensitive values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    return x


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> str | None:
    """None if equal, else what differs first."""
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    kinds = {c[0]: str(c[1]) for c in want.description}
    rows = want.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(names)} and {sorted(spark_df.columns)}"
    got = normal(spark_df.collect(), spark_df.columns)
    wanted = normal(rows, names)
    if len(got) != len(wanted):
        return f"{len(got)} rows, SQL has {len(wanted)}"
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, kind in spark_df.dtypes:
        if pairs.get(kind) != kinds[name]:
            return f"{name} is {kind}, in SQL {kinds[name]}"
    for a, b in zip(got, wanted, strict=True):
        if a != b:
            return f"{a} and {b}"
    return None
