"""Ranks where distances or scores lie closer together than the digits that the SQL ranks by."""

import os
import random

import numpy as np
import parity
import pytest
from pyspark.sql import functions as F

from spindrift.functions.text import human_bytes
from spindrift.operators import bm25
from spindrift.plans.queries import QUERIES, SQL


@pytest.fixture
def tables(spark, sf, tmp_path):
    """Gives a function that makes a folder of the test tables with some of them replaced."""

    def made(**replaced):
        for t in parity.TABLES:
            if t in replaced:
                replaced[t].coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            else:
                os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
        return str(tmp_path)

    return made


@pytest.mark.parametrize("name", ["bm25_index_batch", "bm25_batch"])
def test_scores_that_tie_in_sql_go_by_key(spark, tables, name):
    """Documents a word shorter of some hundred thousand, which the sixth digit does not always show."""
    docs = spark.range(1, 4).select(
        F.col("id").alias("doc_id"), F.expr("concat('word ', repeat('x ', 200002 - cast(id as int)))").alias("text"),
        F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(0).cast("long").alias("n_chars"),
    )
    d = tables(documents=docs, benchmark=spark.createDataFrame([(7, "word")], "item_id long, text string"))
    found = QUERIES[name](spark, d)
    assert parity.differences(found, parity.connect(d), SQL[name]) is None
    assert len({r.score for r in found.collect()}) < 3


def test_scores_of_equal_parts_tie_in_any_order(spark):
    terms = [f"w{i}" for i in range(200)]
    orders = random.Random(1)
    posted = [(t, i, 1 + int(t[1:]) % 7) for i in range(100) for t in orders.sample(terms, len(terms))]
    rows = spark.createDataFrame(posted, "term string, id long, tf long").coalesce(1)
    lengths = spark.range(100_000).select("id", F.lit(900).cast("long").alias("dl"))
    asked = spark.createDataFrame([(0, " ".join(terms))], "query_id long, query string")
    found = bm25.bm25_search_index(rows, lengths, asked, 100).orderBy("rank").collect()
    assert [r.id for r in found] == list(range(100)) and len({r.score for r in found}) == 1


def test_bytes_round_their_binary_value(spark):
    """Shortest decimals of large sizes end in a half where the value itself does not."""
    con = parity.connect("/root/testdata/sf0.001")
    sizes = [2**20 * 3 // 2, 1280 + 64 * 2, 1024 * 1024 - 1, 1024**3 - 1, 1024 + 128 + 5, 2**63 - 1, *(o * o * k for o, k in ((258258, 2582580), (899999, 8999999)))]
    sizes += [(10**8 + i) * 2**30 + (2**30 * (2 * j + 1) // 200) + e for i in range(40) for j in (2, 21, 42) for e in (-1, 0, 1, 2)]
    con.execute("CREATE TABLE sized AS SELECT unnest(?::BIGINT[]) AS o_orderkey", [[*sizes, None]])
    sql = SQL["human_bytes"].replace("o_custkey * o_custkey * o_orderkey", "o_orderkey").replace("FROM orders", "FROM sized")
    rows = spark.createDataFrame([(s,) for s in [*sizes, None]], "o_orderkey long")
    assert parity.differences(rows.select("o_orderkey", human_bytes(F.col("o_orderkey")).alias("size")), con, sql) is None


@pytest.mark.parametrize("name", ["vector_topk_batch", "vector_topk", "vector_topk_cosine"])
def test_distances_that_tie_in_sql_go_by_key(spark, tables, name):
    """Near copies: their distances differ in digits that the SQL does not rank by."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(10, 16)) / 4
    rows = [(i, (base[i % 10] + rng.normal(size=16) * 1e-5).tolist(), i % 5) for i in range(400)]
    d = tables(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert parity.differences(QUERIES[name](spark, d), parity.connect(d), SQL[name]) is None
