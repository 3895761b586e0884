"""What a diff touches, and what that may break."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from structgraph.model import CodeGraph
from structgraph.operators.analytics import contained
from structgraph.plans.reach import reach


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """Hunks of unified diffs: ``diffs`` is (diff_id, text), the result (diff_id, file, start, count).

    ``+++ b/`` names the file for the hunks that follow, ``+++ /dev/null`` none (deleted files have no hunks); a count that is left
    out is 1. Null or empty texts have no hunks. A window per diff carries the file down its lines; a diff is bounded by its text.
    """
    lines = diffs.where(F.col("text").isNotNull()).select("diff_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    heads = lines.where(F.col("line").startswith("+++ ") | F.col("line").startswith("@@ "))
    named = F.when(F.col("line").startswith("+++ b/"), F.substring(F.col("line"), 7, 1 << 30)).when(F.col("line").startswith("+++ "), "")
    down = Window.partitionBy("diff_id").orderBy("pos")
    hunk = r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@"
    count = F.regexp_extract("line", hunk, 2)
    return (
        heads.withColumn("file", F.last(named, ignorenulls=True).over(down))
        .where(F.col("line").rlike(hunk) & (F.col("file") != ""))
        .select("diff_id", "file", F.regexp_extract("line", hunk, 1).cast("bigint").alias("start"), F.when(count == "", 1).otherwise(count.cast("bigint")).alias("count"))
    )


def changed_entities(g: CodeGraph, hunks: DataFrame) -> DataFrame:
    """Entities that modules define directly and whose lines overlap a hunk of their file: (uri, name, kind, file), each once.

    ``hunks``: file, start, count. Overlap is start_line <= start + count - 1 and end_line >= start; a missing end line is the start line.
    The file is an equi-key, so the range test runs within a file only.
    """
    own = g.defines.join(g.modules.select(F.col("uri").alias("parent")), "parent", "left_semi").select(F.col("child").alias("uri"))
    e = g.entities.join(own, "uri", "left_semi").where("start_line IS NOT NULL").select("uri", "name", "kind", "file", "start_line", F.coalesce("end_line", "start_line").alias("last"))
    h = hunks.where("file IS NOT NULL").select(F.col("file").alias("h_file"), "start", "count").distinct()
    return e.join(h, (F.col("file") == F.col("h_file")) & (F.col("start_line") <= F.col("start") + F.col("count") - 1) & (F.col("last") >= F.col("start")), "left_semi").select("uri", "name", "kind", "file")


def diff_impact(g: CodeGraph, hunks: DataFrame) -> DataFrame:
    """Everything that directly or indirectly calls an entity whose name contains the name of a changed one in its repo:
    (caller_name, caller), one row per caller name (the least uri).

    One reachability from all changed entities at once. Names are matched by containment over distinct names, as an equi-join.
    """
    changed = changed_entities(g, hunks)
    names = changed.join(g.entities.select("uri", "repo"), "uri").select("repo", F.col("name").alias("part")).distinct()
    parts = names.select("repo", F.col("part").alias("stem"))
    hit = contained(g.entities.where("name IS NOT NULL").select("repo", "name").distinct(), parts).select("repo", "name").distinct()
    seeds = g.entities.join(hit, ["repo", "name"], "left_semi").select(F.col("uri").alias("node"))
    found = reach(g.resolved.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), seeds).select(F.col("node").alias("caller"))
    called = contained(g.calls.select("repo", F.col("target").alias("name")).distinct(), parts).select("repo", F.col("name").alias("target")).distinct()
    literal = g.calls.join(called, ["repo", "target"], "left_semi").select("caller")
    who = found.unionByName(literal).distinct().join(g.entities.select(F.col("uri").alias("caller"), F.col("name").alias("caller_name")), "caller")
    return who.groupBy("caller_name").agg(F.min("caller").alias("caller"))


def impact_summary(g: CodeGraph, hunks: DataFrame) -> DataFrame:
    """One row (changed_files, changed_entities, impacted_callers, summary); an empty diff gives zeros and a summary too."""
    files = hunks.agg(F.count_distinct("file").alias("changed_files"))
    ents = changed_entities(g, hunks).agg(F.count("*").alias("changed_entities"))
    calls = diff_impact(g, hunks).agg(F.count("*").alias("impacted_callers"))
    # three one-row aggregates side by side
    one = F.lit(1).alias("one")
    row = files.select("*", one).join(ents.select("*", one), "one").join(calls.select("*", one), "one").drop("one")
    text = F.concat(F.col("changed_files"), F.lit(" file(s), "), F.col("changed_entities"), F.lit(" entities changed, "), F.col("impacted_callers"), F.lit(" callers affected"))
    return row.withColumn("summary", text)
