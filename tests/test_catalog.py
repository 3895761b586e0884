"""Every query of the core against its SQL on the smallest tables, and the plans that matter."""

import os

import pytest

from structgraph.catalog import core_queries, core_sql
from structgraph.catalog.graph import graph
from structgraph.operators import resolve, traverse
from tests.compare import spark_rows, sql_rows, views

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    views(c, ROOT)
    return c


@pytest.mark.parametrize("name", sorted(core_queries()))
def test_query(spark, con, name):
    got = spark_rows(core_queries()[name](spark, ROOT))
    if name in core_sql():
        assert got == sql_rows(con, core_sql()[name])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_cross_join(spark):
    g = graph(spark, ROOT)
    for df in (traverse.callers_of(g, "a"), resolve.resolve_calls(g), traverse.file_dependencies(g)):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_is_asked(spark):
    text = plan(traverse.name_edges(graph(spark, ROOT)))
    assert "docstring" not in text.split("ReadSchema", 1)[1].split("\n", 1)[0] or "struct<" in text
