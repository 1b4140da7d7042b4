import pytest
from pyspark.sql import types as T

WIDE = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("key", "fp", "digest", "row", "score", "host", "keys", "words", "h", "held_out", "n_tokens", "rank", "component_id")]
)
CLASH = len(WIDE) - 4


@pytest.fixture(scope="session")
def docs(spark):
    """rows (doc_id, text[, lang[, source]]) -> a table that also has columns named like the operators' own."""

    def make(*rows, parts: int = 2):
        full = [tuple(r) + (None,) * (4 - len(r)) + ("x",) * CLASH for r in rows]
        return spark.createDataFrame(full, WIDE).repartition(parts) if full else spark.createDataFrame([], WIDE)

    return make
