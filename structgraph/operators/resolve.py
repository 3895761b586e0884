"""Resolution of call texts to entities."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.model import CodeGraph
from structgraph.operators.analytics import contained
from structgraph.plans.lineage import cut
from structgraph.plans.skew import salted_lookup


def symbol_table(g: CodeGraph, methods: bool = False) -> DataFrame:
    """Candidates by name: functions and classes that a module defines directly (with ``methods`` also what classes define):
    (repo, name, uri, path, n), n being the number of candidates of the name in the repo."""
    own = g.defines.join(g.modules.select(F.col("uri").alias("parent"), "path"), "parent").select(F.col("child").alias("uri"), "path")
    named = g.entities.where(F.col("kind").isin("Function", "Method", "Class")).select("repo", "uri", "name", F.col("file"))
    table = named.join(own, "uri").select("repo", "name", "uri", "path")
    if methods:
        table = table.unionByName(named.join(own, "uri", "left_anti").select("repo", "name", "uri", F.col("file").alias("path")))
    # counted and joined back over salted keys: a name that a third of all definitions have must not be one window
    table = cut(table)
    return salted_lookup(table, table.groupBy("repo", "name").agg(F.count("*").alias("n")), ["repo", "name"], how="inner").select("repo", "name", "uri", "path", "n")


def first_containing(candidates: DataFrame, wanted: DataFrame, part: str) -> DataFrame:
    """Of ``candidates`` (repo, name, text, uri), for each ``wanted`` (repo, name, part) the least uri of its name whose text contains
    the part: (repo, name, part, callee). Only candidates that do contain it are brought together with it."""
    key = F.concat_ws("\x1f", "repo", "name").alias("repo")
    least = candidates.groupBy("repo", "name", "text").agg(F.min("uri").alias("uri"))
    hits = contained(least.select(key, F.col("text").alias("name")), wanted.select(key, F.col(part).alias("stem")))
    named = hits.select(F.substring_index("repo", "\x1f", 1).alias("repo"), F.regexp_replace("repo", r"^[^\x1f]*\x1f", "").alias("key"), F.col("name").alias("text"), "stem").withColumnRenamed("key", "name")
    return least.join(named, ["repo", "name", "text"]).groupBy("repo", "name", F.col("stem").alias(part)).agg(F.min("uri").alias("callee"))


def resolve_calls(g: CodeGraph, methods: bool = False) -> DataFrame:
    """Call edges that the index can resolve: (caller, target, callee).

    Only callers that a module defines directly are resolved unless ``methods``. For ``self.x`` and ``this.x``: the candidate x of
    the caller's own class. For other dotted texts: the last part, if it has one candidate. For plain names: the only candidate;
    else the first candidate whose path without extension contains the module part of the caller's first import of that
    name; else the candidate in the caller's own file. "First" is by uri, and for imports by import text.

    Plan: calls never meet all candidates of their name. Each rule is first decided for its distinct keys (a name; a name and a file;
    a name and a hint; a name and a class), which leaves one candidate per key, and that is looked up over salted keys. Hints and
    classes do not meet all candidates of their name either: those that contain them are found by grams. So neither a text that a
    third of all calls have nor a name that a third of all definitions have multiplies rows.
    """
    own = g.defines.join(g.modules.select(F.col("uri").alias("parent"), "path"), "parent").select(F.col("child").alias("caller"), F.col("path").alias("caller_path"))
    if methods:
        own = g.entities.where(F.col("kind").isin("Function", "Method")).select(F.col("uri").alias("caller"), F.col("file").alias("caller_path"))
    calls = g.calls.join(own, "caller").select("repo", "caller", "target", "caller_path").distinct()
    form = F.when(F.col("target").rlike(r"^(self|this)\."), "own").when(F.col("target").contains("."), "dotted").otherwise("plain")
    name = F.when(F.col("form") == "own", F.regexp_replace("target", r"^[^.]*\.", "")).when(F.col("form") == "dotted", F.substring_index("target", ".", -1)).otherwise(F.col("target"))
    calls = calls.withColumn("form", form).withColumn("name", name)
    last = F.substring_index("name", ".", -1)
    hints = (
        g.imports.join(g.modules.select(F.col("uri").alias("module"), F.col("path").alias("caller_path")), "module")
        .groupBy("caller_path", last.alias("name"))
        .agg(F.min("name").alias("text"))
        .select("caller_path", "name", F.when(F.col("text").contains("."), F.regexp_replace("text", r"\.[^.]*$", "")).alias("hint"))
    )
    classes = g.defines.join(g.entities.where("kind = 'Class'").select(F.col("uri").alias("parent"), F.col("name").alias("class_name")), "parent").select(F.col("child").alias("caller"), "class_name")
    calls = cut(calls)
    calls = cut(salted_lookup(calls, hints, ["caller_path", "name"]).join(classes, "caller", "left").select("repo", "caller", "target", "form", "name", "caller_path", "hint", "class_name"))
    symbols = cut(symbol_table(g, methods))
    least = F.min("uri").alias("callee")
    many = symbols.where("n > 1")
    hinted = calls.where("form = 'plain' AND hint IS NOT NULL").select("repo", "name", "hint").distinct()
    classed = calls.where("form = 'own' AND class_name IS NOT NULL").select("repo", "name", "class_name").distinct()
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    rules = [
        (1, "form <> 'own'", ["repo", "name"], symbols.where("n = 1").select("repo", "name", F.col("uri").alias("callee"))),
        (1, "form = 'own'", ["repo", "name", "class_name"], first_containing(symbols.withColumn("text", F.col("uri")), classed, "class_name")),
        (2, "form = 'plain'", ["repo", "name", "hint"], first_containing(many.withColumn("text", stem), hinted, "hint")),
        (3, "form = 'plain'", ["repo", "name", "caller_path"], many.groupBy("repo", "name", F.col("path").alias("caller_path")).agg(least)),
    ]
    found = [salted_lookup(calls.where(test), one, keys, how="inner").select("caller", "target", F.lit(rank).alias("rank"), "callee") for rank, test, keys, one in rules]
    return reduce(DataFrame.unionByName, found).groupBy("caller", "target").agg(F.min_by("callee", F.struct("rank", "callee")).alias("callee"))
