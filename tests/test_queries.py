"""Every query against its SQL, and every query without SQL for its shape."""

import parity
import pytest

from spindrift.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return parity.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert parity.differences(QUERIES[name](spark, sf), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_plans(spark, sf):
    """Top-k without a full sort, pruned scans, predicates at the scan."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    top = plan(QUERIES["vector_topk"](spark, sf))
    assert "TakeOrderedAndProject" in top and "Exchange" not in top
    lines = plan(QUERIES["delete_by_file"](spark, sf))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in lines and "o_totalprice" not in lines
    assert "text" not in plan(QUERIES["list_files"](spark, sf))
