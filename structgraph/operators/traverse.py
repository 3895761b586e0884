"""Traversal of call, inheritance and import edges."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structgraph.model import CodeGraph
from structgraph.plans.reach import reach


def _names(g: CodeGraph) -> DataFrame:
    return g.entities.select("repo", "uri", "name", "kind")


def _matching(g: CodeGraph, name: str, exact: bool) -> DataFrame:
    test = F.col("name") == name if exact else F.col("name").contains(name)
    return g.entities.where(test).select("uri")


def callers_of(g: CodeGraph, name: str, exact: bool = False) -> DataFrame:
    """Direct callers: of entities whose name contains ``name`` by resolved edges, and by call texts that contain it."""
    resolved = g.resolved.join(_matching(g, name, exact).withColumnRenamed("uri", "callee"), "callee", "left_semi").select("caller")
    literal = g.calls.where(F.col("target") == name if exact else F.col("target").contains(name)).select("caller")
    who = resolved.unionByName(literal).distinct()
    return who.join(_names(g).withColumnRenamed("uri", "caller"), "caller").select("caller", F.col("name").alias("caller_name"), F.col("kind").alias("caller_kind"))


def callees_of(g: CodeGraph, name: str) -> DataFrame:
    """What functions of exactly ``name`` call: resolved entities as (uri, name), and call texts as (text, text)."""
    me = _names(g).where(F.col("name") == name).select(F.col("uri").alias("caller"))
    resolved = g.resolved.join(me, "caller", "left_semi").join(_names(g).select(F.col("uri").alias("callee"), F.col("name").alias("callee_name")), "callee").select("callee", "callee_name")
    literal = g.calls.join(me, "caller", "left_semi").select(F.col("target").alias("callee"), F.col("target").alias("callee_name"))
    return resolved.unionByName(literal).distinct()


def impact_of(g: CodeGraph, name: str, exact: bool = False) -> DataFrame:
    """All direct and indirect callers of entities whose name contains ``name``, and direct callers by call text. An entity that
    reaches itself over a loop is among them."""
    edges = g.resolved.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    found = reach(edges, _matching(g, name, exact).select(F.col("uri").alias("node"))).select(F.col("node").alias("caller"))
    literal = g.calls.where(F.col("target") == name if exact else F.col("target").contains(name)).select("caller")
    return found.unionByName(literal).distinct().join(_names(g).select(F.col("uri").alias("caller"), F.col("name").alias("caller_name")), "caller").select("caller", "caller_name")


def name_edges(g: CodeGraph) -> DataFrame:
    """Call edges between names within a repo: (repo, src, dst), resolved and literal, as a set."""
    n = _names(g)
    by = g.resolved.join(n.select("repo", F.col("uri").alias("caller"), F.col("name").alias("src")), "caller").join(n.select(F.col("uri").alias("callee"), F.col("name").alias("dst")), "callee")
    functions = n.where(F.col("kind").isin("Function", "Method")).select(F.col("uri").alias("caller"), F.col("name").alias("src"))
    literal = g.calls.join(functions, "caller").select("repo", "src", F.col("target").alias("dst"))
    return by.select("repo", "src", "dst").unionByName(literal).distinct()


def all_call_edges(g: CodeGraph, limit: int = 200) -> DataFrame:
    """The first ``limit`` call edges between names in order of names; the limit is the export's."""
    return name_edges(g).select("src", "dst").distinct().orderBy("src", "dst").limit(limit)


def call_graph_from(g: CodeGraph, root: str, depth: int = 3) -> DataFrame:
    """Call edges within ``depth`` levels of functions named ``root``, by name within each repo: (src, dst, level), level being the
    least distance of src from the root. A root without edges gives none."""
    sep = "\x1f"
    edges = name_edges(g)
    key = lambda c: F.concat_ws(sep, "repo", c)
    # walking away from the root is reaching it along turned edges
    turned = edges.select(key("dst").alias("src"), key("src").alias("dst"))
    seeds = edges.where(F.col("src") == root).select(key("src").alias("node"))
    levels = reach(turned, seeds, min_steps=0, max_steps=depth - 1)
    return edges.join(levels.withColumnRenamed("node", "k"), key("src") == F.col("k")).groupBy("src", "dst").agg(F.min("steps").cast("bigint").alias("level"))


def inheritance_edges(g: CodeGraph) -> DataFrame:
    """Edges base -> class by name, and classes without any edge as rows with a null base: (base, cls)."""
    classes = g.entities.where("kind = 'Class'").select("uri", "name")
    edges = classes.join(g.inherits.select(F.col("cls").alias("uri"), "base"), "uri").select("base", F.col("name").alias("cls")).distinct()
    ends = edges.select(F.col("base").alias("name")).unionByName(edges.select(F.col("cls").alias("name"))).distinct()
    alone = classes.select("name").distinct().join(ends, "name", "left_anti")
    return edges.unionByName(alone.select(F.lit(None).cast("string").alias("base"), F.col("name").alias("cls")))


def stem(path: Column) -> Column:
    """Base name of a path without its extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def file_dependencies(g: CodeGraph) -> DataFrame:
    """File -> file, where the first dotted part of an import is the base name of a file of the same repo (of several such files
    the last path counts); no loops: (src, dst)."""
    targets = g.modules.groupBy("repo", stem(F.col("path")).alias("first")).agg(F.max("path").alias("dst"))
    made = g.imports.join(g.modules.select(F.col("uri").alias("module"), F.col("path").alias("src")), "module").select("repo", "src", F.substring_index("name", ".", 1).alias("first")).distinct()
    return made.join(targets, ["repo", "first"]).where("src <> dst").select("src", "dst").distinct()
