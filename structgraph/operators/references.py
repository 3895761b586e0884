"""References to records that do not exist, or did not at the time (problem 3)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from structgraph.functions.text import class_name, non_blank, normal_path, path_of_uri, repo_of, strip, without_extension
from structgraph.plans.lineage import cut, stored
from structgraph.plans.skew import salted_lookup, salts_for, salts_of


def orphan_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """State of every reference against the lifetimes of its target.

    ``refs``: table_name, ref_id, scope, key, seen_at; repeats (same table_name and ref_id) count once, rows with a null key or
    seen_at are no references. ``targets``: table_name, scope, key, indexed_at, deleted_at, one row per lifetime
    [indexed_at, deleted_at), a null deleted_at being open; rows with a null key or indexed_at never live.

    The result has every reference once with ``state``: null if a target was alive at seen_at, else 'missing' (no target row
    at all), 'deleted' (one had begun by then) or 'late' (all began afterwards). Empty targets make every reference missing.

    Plan: the distinct keys are compared with the parent keys (anti-join), so a hot key crosses the network once. What a key's
    lifetimes have in common (first beginning, last end, their number) is one combined row a key, goes back to the rows over salted
    keys and decides all but references between the lifetimes of a key that has several; those are decided by :func:`alive_at`. No
    list of a key's lifetimes or references is ever gathered.
    """
    id_ = ["table_name", "scope", "key"]
    rows = refs.where(F.col("key").isNotNull() & F.col("seen_at").isNotNull()).dropDuplicates(["table_name", "ref_id"])
    wanted = cut(refs.where(F.col("key").isNotNull()).groupBy(*id_).count())
    lives = targets.where(F.col("key").isNotNull() & F.col("indexed_at").isNotNull()).select(*id_, "indexed_at", "deleted_at").distinct()
    keys = lives.groupBy(*id_).agg(F.min("indexed_at").alias("begin"), F.max("deleted_at").alias("end"), F.max(F.col("deleted_at").isNull()).alias("open"), F.count("*").alias("lives"))
    missing = wanted.select(*id_).join(keys, id_, "left_anti")
    known = keys.join(wanted.select(*id_), id_, "left_semi").withColumn("gone", F.lit(False))
    verdicts = known.unionByName(missing.withColumn("gone", F.lit(True)), allowMissingColumns=True)
    seen = F.col("seen_at")
    state = F.when(F.col("gone"), "missing").when(seen < F.col("begin"), "late").when(~F.col("open") & (seen >= F.col("end")), "deleted").when(F.col("lives") > 1, "between")
    columns = ["table_name", "ref_id", "scope", "key", "seen_at", "state"]
    judged = stored(salted_lookup(rows, verdicts, id_, salts=salts_of(wanted)).withColumn("state", state).select(columns), "judged_references")
    between = alive_at(judged.where("state = 'between'").drop("state"), lives).withColumn("state", F.when(~F.col("alive"), "deleted")).select(columns)
    return judged.where("state IS NULL OR state <> 'between'").unionByName(between)


def alive_at(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """``refs`` (table_name, ref_id, scope, key, seen_at) with ``alive``: whether one of the ``lives`` of its key holds its time.

    Beginnings and ends are events of +1 and -1; a reference is alive if the sum of the events up to its time is positive. Events and
    references are laid out in order of key and time over ranges of even size, so a hot key is spread over many; sums run within
    a range, and what earlier ranges hold of the same key is carried over: at most one number a range and key.
    """
    id_ = ["table_name", "scope", "key"]
    keys = refs.select(*id_).distinct()
    some = lives.where("deleted_at IS NULL OR deleted_at > indexed_at").join(keys, id_, "left_semi")
    events = some.select(*id_, F.explode(F.array(F.struct(F.col("indexed_at").alias("t"), F.lit(1).alias("d")), F.struct(F.col("deleted_at").alias("t"), F.lit(-1).alias("d")))).alias("e"))
    summed = events.select(*id_, "e.t", "e.d").where("t IS NOT NULL").groupBy(*id_, "t").agg(F.sum("d").alias("d"))
    both = summed.select(*id_, "t", F.lit(0).alias("is_ref"), "d", F.lit(None).cast(refs.schema["ref_id"].dataType).alias("ref_id")).unionByName(
        refs.select(*id_, F.col("seen_at").alias("t"), F.lit(1).alias("is_ref"), F.lit(0).cast("bigint").alias("d"), "ref_id")
    )
    order = [*id_, "t", "is_ref", "ref_id"]
    laid = stored(both.repartitionByRange(int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id()), "laid_references")
    sums = laid.groupBy(*id_, "part").agg(F.sum("d").alias("sum"))
    carried = sums.withColumn("before", F.sum("sum").over(Window.partitionBy(*id_).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).where("before <> 0").drop("sum")
    running = F.sum("d").over(Window.partitionBy("part", *id_).orderBy("t", "is_ref").rowsBetween(Window.unboundedPreceding, 0))
    here = laid.withColumn("here", running).where("is_ref = 1").join(carried, ["part", *id_], "left")
    return here.select("table_name", "ref_id", "scope", "key", F.col("t").alias("seen_at"), (F.col("here") + F.coalesce("before", F.lit(0)) > 0).alias("alive"))


def orphan_report(states: DataFrame) -> DataFrame:
    """References and orphans per table, month of seen_at and state: (table_name, period, refs, missing, deleted, late)."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return states.groupBy("table_name", F.date_format("seen_at", "yyyy-MM").alias("period")).agg(F.count("*").alias("refs"), n("missing"), n("deleted"), n("late"))


def call_references(calls: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls against entities by uri; the callee is trimmed and ``\\`` read as ``/``. A null or blank callee is no reference."""
    refs = calls.select(
        F.lit("calls").alias("table_name"), F.col("call_id").alias("ref_id"), F.lit("").alias("scope"), F.translate(non_blank(F.col("callee")), "\\", "/").alias("key"), "seen_at"
    )
    return refs, entities.select(F.lit("calls").alias("table_name"), F.lit("").alias("scope"), F.col("uri").alias("key"), "indexed_at", "deleted_at")


def base_references(inherits: DataFrame, entities: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bases against the classes of the same repo by bare name; names that packages lists as 'base' are no references."""
    refs = inherits.select(F.lit("inherits").alias("table_name"), F.col("inherit_id").alias("ref_id"), F.col("repo").alias("scope"), class_name(F.col("base")).alias("key"), "seen_at")
    known = packages.where("kind = 'base'").select(F.col("name").alias("key")).distinct()
    targets = entities.where("kind = 'Class'").select(
        F.lit("inherits").alias("table_name"), repo_of(F.col("file")).alias("scope"), F.col("name").alias("key"), "indexed_at", "deleted_at"
    )
    found = salted_lookup(refs, known.withColumn("known", F.lit(True)), ["key"], salts=salts_for(inherits, ["base"]))
    return found.where("known IS NULL").select(refs.columns), targets


def import_references(imports: DataFrame, modules: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Import texts against the modules of the same repo by path without extension; external packages are no references.

    A package is recognised by an equi-join on the text's prefixes that end before ``.`` or ``/``, over distinct texts.
    """
    text = strip(F.col("from_module"))
    rows = imports.where(text.isNotNull()).select("import_id", "repo", "module", "seen_at", text.alias("text"))
    texts = rows.select("text").distinct()
    ends = F.array_union(
        F.filter(F.sequence(F.lit(0), F.length("text") - 1), lambda i: F.substring(F.col("text"), i + 1, F.lit(1)).isin(".", "/")), F.array(F.length("text"))
    )
    prefixes = texts.where(F.length("text") > 0).select("text", F.explode(ends).alias("n")).select("text", F.substring(F.col("text"), F.lit(1), F.col("n")).alias("name"))
    external = prefixes.join(packages.where("kind = 'package'").select("name").distinct(), "name", "left_semi").select("text").distinct()
    own_dir = F.regexp_replace(F.substring(path_of_uri(F.col("module")), F.length("repo") + 2, F.lit(1 << 30)), r"[^/]*$", "")
    dots = F.length(F.regexp_extract("text", r"^(\.*)", 1))
    key = (
        F.when(F.col("text").rlike(r"^\.\.?/"), normal_path(F.concat(own_dir, F.regexp_replace("text", r"\.(js|ts)$", ""))))
        .when(F.col("text").startswith("."), normal_path(F.concat(own_dir, F.repeat(F.lit("../"), dots - 1), F.translate(F.regexp_replace("text", r"^\.+", ""), ".", "/"))))
        .when(F.col("text").endswith(".h"), F.regexp_replace("text", r"\.h$", ""))
        .otherwise(F.translate("text", ".", "/"))
    )
    own = salted_lookup(rows, external.withColumn("known", F.lit(True)), ["text"], salts=salts_for(imports, ["from_module"])).where("known IS NULL")
    refs = own.select(F.lit("imports").alias("table_name"), F.col("import_id").alias("ref_id"), F.col("repo").alias("scope"), key.alias("key"), "seen_at")
    targets = modules.select(
        F.lit("imports").alias("table_name"),
        F.col("repo").alias("scope"),
        without_extension(F.substring(F.col("path"), F.length("repo") + 2, F.lit(1 << 30))).alias("key"),
        "indexed_at",
        "deleted_at",
    )
    return refs, targets


def code_references(calls: DataFrame, inherits: DataFrame, imports: DataFrame, entities: DataFrame, modules: DataFrame, packages: DataFrame) -> DataFrame:
    """:func:`orphan_references` over the three referring tables, as one plan."""
    parts = [call_references(calls, entities), base_references(inherits, entities, packages), import_references(imports, modules, packages)]
    refs, targets = parts[0]
    for r, t in parts[1:]:
        refs, targets = refs.unionByName(r), targets.unionByName(t)
    return orphan_references(refs, targets)
