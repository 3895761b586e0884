"""Term frequencies by hand, with dirt, and over whole tables against SQL."""

import os
from datetime import datetime

import pytest

pytest.importorskip("structgraph.llm")

from structgraph import llm  # noqa: E402
from structgraph.llm.terms import code_terms, occurrences, term_frequencies  # noqa: E402
from tests.compare import spark_rows, sql_rows, views  # noqa: E402

ROOT = "/root/testdata/sf0.001"
T = [datetime(2024, 1, d) for d in range(1, 29)]


def test_terms_count_occurrences_and_records(spark, table):
    calls = spark.createDataFrame(
        [(1, "a", " f "), (1, "a", " f "), (2, "a", "f"), (3, "b", "f"), (4, "b", None), (5, "c", " \t"), (6, None, "g"), (7, "c", "g\u00a0")], "call_id bigint, caller string, target string"
    )
    imports = spark.createDataFrame([], "import_id bigint, module string, imported string")
    decos = spark.createDataFrame([("u", " @x", T[0]), ("u", "@x", T[0]), ("v", "x ", T[1]), ("v", "@ ", T[1])], "uri string, decorator string, seen_at timestamp")
    got = table(term_frequencies(code_terms(calls, imports, decos)))
    assert got == sorted([("call", "f", 3, 2, "common"), ("call", "g", 1, 1, "rare"), ("decorator", "x", 2, 2, "common")], key=repr)


def test_terms_of_nothing(spark, table):
    none = spark.createDataFrame([], "field string, term string, record string, row_id string, term2 string")
    assert table(term_frequencies(none)) == []


def test_terms_bounds_follow_the_field(spark, table):
    df = spark.createDataFrame([(i, f"r{i}", "often" if i < 10 else "seldom" if i < 12 else f"t{i}") for i in range(100)], "id bigint, r string, t string")
    got = {r[1]: r[4] for r in table(term_frequencies(occurrences(df, "f", df.t, df.r, df.id)))}
    assert got["often"] == "common" and got["seldom"] == "useful" and got["t50"] == "rare"


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(llm.sql()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    views(con, ROOT)
    assert spark_rows(llm.queries()[name](spark, ROOT)) == sql_rows(con, llm.sql()[name])


def test_counts_combine_before_every_shuffle(spark):
    df = spark.createDataFrame([(i, f"r{i % 9}", f"t{i % 5}") for i in range(50)], "id bigint, r string, t string")
    lines = term_frequencies(occurrences(df, "f", df.t, df.r, df.id))._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [lines[i + 1] for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    assert below and all("HashAggregate" in x for x in below)
