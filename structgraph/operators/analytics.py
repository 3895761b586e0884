"""Dead code, unused and circular imports, metrics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.model import CodeGraph
from structgraph.operators.traverse import stem

#: Names that frameworks call, besides test functions and double-underscore names; fixed values.
ENTRY_POINTS = ("main", "setUp", "tearDown", "setUpClass", "tearDownClass")


def dead_functions(g: CodeGraph, include_methods: bool = True) -> DataFrame:
    """Functions and methods whose name nobody in their repo calls, by text or resolved edge. Entry points, ``test_*`` and ``__*`` are left out."""
    kinds = ["Function", "Method"] if include_methods else ["Function"]
    named = g.entities.select("repo", F.col("uri").alias("callee"), "name")
    called = g.calls.select("repo", F.col("target").alias("name")).unionByName(g.resolved.join(named, "callee").select("repo", "name")).distinct()
    alive = g.entities.where(F.col("kind").isin(kinds) & F.col("start_line").isNotNull() & ~F.col("name").isin(*ENTRY_POINTS) & ~F.col("name").startswith("test_") & ~F.col("name").startswith("__"))
    return alive.join(called, ["repo", "name"], "left_anti").select("uri", "name", "kind", "start_line", "end_line")


def unused_imports(g: CodeGraph) -> DataFrame:
    """Imports whose last dotted part is neither a call text nor a name of the same repo."""
    used = g.calls.select("repo", F.col("target").alias("short")).unionByName(g.entities.select("repo", F.col("name").alias("short"))).unionByName(g.modules.select("repo", F.col("path").alias("short"))).distinct()
    made = g.imports.join(g.modules.select(F.col("uri").alias("module"), "path"), "module").withColumn("short", F.substring_index("name", ".", -1))
    return made.join(used, ["repo", "short"], "left_anti").select("module", "path", "name").distinct()


def _all_function_metrics(g: CodeGraph) -> DataFrame:
    functions = g.entities.where(F.col("kind").isin("Function", "Method"))
    fan_out = g.calls.join(functions.select(F.col("uri").alias("caller"), "name"), "caller").groupBy("repo", "name").agg(F.count_distinct("target").alias("fan_out"))
    fan_in = g.calls.groupBy("repo", F.col("target").alias("name")).agg(F.count_distinct("caller").alias("fan_in"))
    sized = functions.where("start_line IS NOT NULL AND end_line IS NOT NULL")
    return (
        sized.join(fan_in, ["repo", "name"], "left")
        .join(fan_out, ["repo", "name"], "left")
        .select("uri", "name", "kind", "start_line", "end_line", (F.col("end_line") - F.col("start_line") + 1).alias("size"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    )


def function_metrics(g: CodeGraph, limit: int = 50) -> DataFrame:
    """Size, fan-in and fan-out of the ``limit`` largest functions; fans are counted by name within the repo, as in a call graph of names."""
    return _all_function_metrics(g).orderBy(F.desc("size"), "uri").limit(limit)


def class_metrics(g: CodeGraph, limit: int = 50) -> DataFrame:
    """Size and number of methods of the ``limit`` largest classes; methods are counted by class name within the repo."""
    classes = g.entities.where("kind = 'Class'")
    methods = g.entities.where("kind = 'Method'").select(F.col("uri").alias("child"))
    count = g.defines.join(methods, "child", "left_semi").join(classes.select("repo", F.col("uri").alias("parent"), "name"), "parent").groupBy("repo", "name").agg(F.count("*").alias("method_count"))
    return (
        classes.where("start_line IS NOT NULL AND end_line IS NOT NULL")
        .join(count, ["repo", "name"], "left")
        .select("uri", "name", "start_line", "end_line", (F.col("end_line") - F.col("start_line") + 1).alias("size"), F.coalesce("method_count", F.lit(0)).alias("method_count"))
        .orderBy(F.desc("size"), "uri")
        .limit(limit)
    )


def refactoring_candidates(g: CodeGraph, min_size: int = 30, min_fan_in: int = 3, among: int = 500) -> DataFrame:
    """Of the ``among`` largest functions, those of at least ``min_size`` lines or ``min_fan_in`` callers."""
    return function_metrics(g, among).where((F.col("size") >= min_size) | (F.col("fan_in") >= min_fan_in))


#: Length of the grams by which contained names are looked up; shorter names are looked up whole.
GRAM = 6


def contained(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(repo, name, stem) of every ``parts`` (repo, stem) that occurs within a ``texts`` (repo, name) of its repo, once each.
    Empty and null texts and parts find nothing.

    An equi-join on grams: a part has one, its first :data:`GRAM` letters or itself; a text has those of the lengths that occur among
    the parts. Texts travel as hashes and are fetched for what has a gram in common, and compared then, so the result is exact.
    """
    texts = texts.where(F.length("name") > 0).distinct().withColumn("h", F.xxhash64("repo", "name"))
    keyed = parts.where(F.length("stem") > 0).select("repo", "stem", F.substring("stem", 1, GRAM).alias("gram")).distinct()
    lengths = [r["k"] for r in keyed.select(F.length("gram").alias("k")).distinct().collect()]  # at most GRAM numbers
    grams_of = lambda k: F.transform(F.sequence(F.lit(1), F.length("name") - k + 1), lambda i: F.substring("name", i, k))
    if not lengths:
        return texts.select("repo", "name", F.col("name").alias("stem")).limit(0)
    enough = [F.when(F.length("name") >= k, grams_of(k)).otherwise(F.array().cast("array<string>")) for k in sorted(lengths)]
    found = texts.select("repo", "h", F.explode(F.array_distinct(F.concat(*enough))).alias("gram")).join(keyed, ["repo", "gram"]).select("repo", "h", "stem").distinct()
    return found.join(texts, ["repo", "h"]).where(F.contains("name", "stem")).select("repo", "name", "stem")


def circular_dependencies(g: CodeGraph) -> DataFrame:
    """Pairs of importing files of a repo in which each one's base name occurs in an import of the other: (file_a, file_b), a < b.

    Containment is an equi-join on short grams: every position of a distinct import text gives the gram that begins there, base
    names are looked up by their first gram, and the rest of the name is compared at that position. No pair of files is compared
    that does not share one.
    """
    made = g.imports.join(g.modules.select(F.col("uri").alias("module"), "path"), "module").select("repo", "path", "name").distinct()
    files = made.select("repo", "path").distinct().withColumn("stem", stem(F.col("path")))
    inside = contained(made.select("repo", "name").distinct(), files.select("repo", "stem").distinct())
    needs = made.join(inside, ["repo", "name"]).select("repo", "path", "stem").distinct()
    pairs = needs.join(files.select("repo", F.col("path").alias("other"), "stem"), ["repo", "stem"]).where("path <> other").select("path", "other").distinct()
    back = pairs.select(F.col("other").alias("path"), F.col("path").alias("other"))
    return pairs.where("path < other").join(back, ["path", "other"], "left_semi").select(F.col("path").alias("file_a"), F.col("other").alias("file_b"))
