"""Named queries over a directory of tables, each with the SQL that says the same where SQL can."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def core_queries() -> dict[str, Query]:
    from structgraph.catalog import general, graph, language

    return {**graph.QUERIES, **language.QUERIES, **general.QUERIES}


def core_sql() -> dict[str, str]:
    from structgraph.catalog import general, graph, language

    return {**graph.SQL, **language.SQL, **general.SQL}
