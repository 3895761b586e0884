"""Edges as Mermaid or DOT text, results as JSON."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_id(c: Column) -> Column:
    """A node id: dots, dashes, blanks and slashes become underscores."""
    return F.translate(c, ".- /", "____")


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """Lines of a Mermaid graph of ``edges`` (src, dst): (section, line). Rows with a null src are single nodes. The head is section
    0, edges 1, nodes 2; within a section lines are ordered by text, each once."""
    label = lambda c: F.concat(safe_id(F.col(c)), F.lit('["'), F.col(c), F.lit('"]'))
    arcs = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.lit(1).alias("section"), F.concat(F.lit("    "), label("src"), F.lit(" --> "), label("dst")).alias("line"))
    alone = edges.where("src IS NULL AND dst IS NOT NULL").select(F.lit(2).alias("section"), F.concat(F.lit("    "), label("dst")).alias("line"))
    return _whole(edges, "graph TD", arcs, alone, None)


def dot_lines(edges: DataFrame, name: str = "graph") -> DataFrame:
    """Lines of a DOT digraph of ``edges`` (src, dst): head, edges, node labels, closing brace: (section, line)."""
    quote = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    arcs = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.lit(1).alias("section"), F.concat(F.lit("    "), quote("src"), F.lit(" -> "), quote("dst"), F.lit(";")).alias("line"))
    nodes = edges.select(F.col("src").alias("n")).unionByName(edges.select(F.col("dst").alias("n"))).where("n IS NOT NULL")
    alone = nodes.select(F.lit(2).alias("section"), F.concat(F.lit("    "), quote("n"), F.lit(" [label="), quote("n"), F.lit("];")).alias("line"))
    return _whole(edges, f"digraph {name} {{", arcs, alone, "}")


def _whole(edges: DataFrame, head: str, arcs: DataFrame, alone: DataFrame, tail: str | None) -> DataFrame:
    frame = [(0, head)] + ([(3, tail)] if tail else [])
    ends = edges.sparkSession.createDataFrame(frame, "section int, line string")
    return ends.unionByName(arcs.distinct()).unionByName(alone.distinct())


def text_of(lines: DataFrame) -> str:
    """The document of (section, line) rows; for graphs that a person is to look at."""
    return "\n".join(r["line"] for r in lines.orderBy("section", "line").toLocalIterator())


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text: (json)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
