"""Browsing the index: projections, filters and equi-joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.model import CodeGraph

ROW = ["uri", "name", "kind", "file", "start_line", "end_line"]


def resolve_entity(g: CodeGraph, name: str) -> DataFrame:
    """Entities of a name, or of ``file:name`` with a file whose path contains the part before the first colon. Needs a start line,
    which modules and parameters lack; no match gives no rows."""
    part, _, bare = name.partition(":") if ":" in name and not name.startswith("http") else ("", "", name)
    rows = g.entities.where((F.col("name") == bare) & F.col("start_line").isNotNull())
    return (rows.where(F.col("file").contains(part)) if part else rows).select(ROW)


def list_files(g: CodeGraph) -> DataFrame:
    """Paths of all modules in order."""
    return g.modules.select("path").distinct().orderBy("path")


def _in_modules(g: CodeGraph, chosen: DataFrame) -> DataFrame:
    own = g.defines.join(chosen.select(F.col("uri").alias("parent")).distinct(), "parent", "left_semi")
    return g.entities.join(own.select(F.col("child").alias("uri")), "uri")


def entities_in_file(g: CodeGraph, path: str) -> DataFrame:
    """What modules whose path contains ``path`` define directly (so no methods), by start line."""
    return _in_modules(g, g.modules.where(F.col("path").contains(path))).where("start_line IS NOT NULL").select(ROW).orderBy("start_line", "uri")


def functions_in(g: CodeGraph, path: str) -> DataFrame:
    """Functions that the module of exactly ``path`` defines, by start line."""
    return _in_modules(g, g.modules.where(F.col("path") == path)).where("kind = 'Function' AND start_line IS NOT NULL").select(ROW).orderBy("start_line", "uri")


def all_classes(g: CodeGraph) -> DataFrame:
    """Classes with both lines, by name."""
    return g.entities.where("kind = 'Class' AND start_line IS NOT NULL AND end_line IS NOT NULL").select(ROW).orderBy("name", "uri")


def all_functions(g: CodeGraph) -> DataFrame:
    """Functions and methods with both lines, by name."""
    return g.entities.where(F.col("kind").isin("Function", "Method") & F.col("start_line").isNotNull() & F.col("end_line").isNotNull()).select(ROW).orderBy("name", "uri")


def class_hierarchy(g: CodeGraph, name: str) -> DataFrame:
    """Direct inheritance edges in which ``name`` is the class or the base: (class_name, base)."""
    named = g.entities.where("kind = 'Class'").select(F.col("uri").alias("cls"), F.col("name").alias("class_name"))
    return named.join(g.inherits.select("cls", "base"), "cls").where((F.col("class_name") == name) | (F.col("base") == name)).select("class_name", "base")


def context_around(g: CodeGraph, name: str) -> DataFrame:
    """The functions and methods of a name with what contains, calls and is called by them: (section, uri, related)."""
    me = g.entities.where(F.col("kind").isin("Function", "Method") & (F.col("name") == name)).select("uri", "docstring", "file", "start_line")
    names = g.entities.select(F.col("uri").alias("other"), F.col("name").alias("other_name"))
    mods = g.modules.select(F.col("uri").alias("other"), F.col("path").alias("other_name"))
    inside = g.defines.join(me.select(F.col("uri").alias("child")), "child", "left_semi")
    parts = [
        me.select(F.lit("function").alias("section"), "uri", F.concat_ws(":", "file", "start_line").alias("related")),
        me.where("docstring <> ''").select(F.lit("docstring").alias("section"), "uri", F.col("docstring").alias("related")),
        inside.join(names.unionByName(mods), F.col("parent") == F.col("other")).select(F.lit("container").alias("section"), F.col("child").alias("uri"), F.col("other_name").alias("related")),
        g.resolved.join(me.select(F.col("uri").alias("callee")), "callee", "left_semi").join(names, F.col("caller") == F.col("other")).select(F.lit("caller").alias("section"), F.col("callee").alias("uri"), F.col("other_name").alias("related")),
        g.calls.join(me.select(F.col("uri").alias("caller")), "caller", "left_semi").select(F.lit("callee").alias("section"), F.col("caller").alias("uri"), F.col("target").alias("related")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
