"""Re-indexing a stream of file events: debounce, parse, upsert."""

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from structgraph.functions.text import path_of_uri
from structgraph.model import RESOLVED, VOCAB, graph_iri
from structgraph.operators.encode import graph_from_quads, quads_of_parsed
from structgraph.operators.resolve import resolve_calls
from structgraph.operators.store import QuadStore, replace_graphs
from structgraph.plans.lineage import cut
from structgraph.sources.files import parse_files, skipped, tree_files

#: Extensions that are watched, and the quiet time after which a file counts as settled; fixed values.
WATCHED = (".py", ".ts", ".tsx", ".js", ".jsx")
QUIET = "300 milliseconds"


def should_handle(path: Column) -> Column:
    """Whether events of a path matter: a watched extension outside skipped directories."""
    ok = F.lit(False)
    for e in WATCHED:
        ok = ok | path.endswith(e)
    return ok & ~skipped(path)


def route_moves(events: DataFrame) -> DataFrame:
    """``events`` (path, event_type, ts, dest, content) with each move as a delete of its source and a create of its destination."""
    pairs = F.when(
        F.col("event_type") == "moved",
        F.array(
            F.struct(F.col("path"), F.lit("deleted").alias("event_type"), F.lit(None).cast("string").alias("content")), F.struct(F.col("dest").alias("path"), F.lit("created").alias("event_type"), F.col("content"))
        ),
    ).otherwise(F.array(F.struct("path", "event_type", "content")))
    return events.select("ts", F.explode(pairs).alias("e")).select("e.path", "e.event_type", "ts", "e.content")


def debounced(events: DataFrame, quiet: str = QUIET, late: str = "10 seconds") -> DataFrame:
    """One row per burst of events of a path: (path, first_ts, last_ts, events, event_type, content), the last event deciding.

    A burst ends when a path has been quiet for ``quiet``: a session window per path. On a stream the watermark lets a session
    close; events later than ``late`` are dropped. On a table all sessions are closed. Events at the same time: the delete wins.
    """
    e = route_moves(events).where(F.col("path").isNotNull() & should_handle(F.col("path")))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    order = F.struct("ts", (F.col("event_type") == "deleted").alias("d"))
    burst = e.groupBy("path", F.session_window("ts", quiet).alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"), F.max_by(F.struct("event_type", "content"), order).alias("last"))
    return burst.select("path", "first_ts", "last_ts", "events", "last.event_type", "last.content")


def apply_changes(quads: DataFrame, changes: DataFrame, repo: str = "") -> DataFrame:
    """``quads`` after ``changes`` (path, event_type, content): deleted files lose their graph, others have theirs replaced.

    Resolved calls are brought up to date with them: the calls of changed files, and of every caller that calls a name which a
    changed file defined before or defines now, are resolved anew; all other edges stay.
    """
    latest = cut(changes.dropDuplicates(["path"]))
    gone = latest.select(graph_iri(F.col("path")).alias("g"))
    kept = quads.join(gone, "g", "left_anti").select(quads.columns)
    paths = latest.select("path")
    edge = F.col("p") == VOCAB + "resolvedCalls"
    new = cut(quads_of_parsed(parse_files(latest.where("event_type <> 'deleted'")), repo).select(quads.columns))
    after = cut(replace_graphs(kept.where(~edge), new))
    named = F.col("p") == VOCAB + "name"
    names = quads.where(named).join(gone, "g", "left_semi").select(F.col("o").alias("name")).unionByName(new.where(named).select(F.col("o").alias("name"))).distinct()
    calls = after.where(F.col("p") == VOCAB + "calls").select(F.col("s").alias("caller"), F.substring_index("o", ".", -1).alias("name"))
    touched = calls.join(names, "name", "left_semi").select("caller").unionByName(calls.withColumn("path", path_of_uri(F.col("caller"))).join(paths, "path", "left_semi").select("caller")).distinct()
    graph = graph_from_quads(after, repo)
    graph.calls = graph.calls.join(touched, "caller", "left_semi")
    null = F.lit(None).cast("string")
    found = resolve_calls(graph).select("caller", "callee").distinct()
    fresh = found.select(F.lit(RESOLVED).alias("g"), F.col("caller").alias("s"), F.lit(VOCAB + "resolvedCalls").alias("p"), F.col("callee").alias("o"), F.lit("iri").alias("o_kind"), null.alias("o_dt"), null.alias("o_lang"))
    old = kept.where(edge)
    # an edge outlives neither end: those into changed files are found again through their callers
    stays = old.join(touched.withColumnRenamed("caller", "s"), "s", "left_anti").withColumn("path", path_of_uri(F.col("s"))).join(paths, "path", "left_anti").withColumn("path", path_of_uri(F.col("o"))).join(paths, "path", "left_anti")
    return cut(after.unionByName(stays.select(quads.columns)).unionByName(fresh.select(quads.columns)).distinct())


def watch(spark: SparkSession, events: DataFrame, store: QuadStore, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Start re-indexing a stream of file events into a store; batches are applied in order, each as one new version of the store
    in which only the buckets of changed files, and of callers whose calls resolve differently, are written.

    A batch that is repeated after a failure replaces the same graphs by the same quads, so the store ends up the same.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by(F.struct("event_type", "content"), "last_ts").alias("x")).select("path", "x.event_type", "x.content")
        if not newest.isEmpty():
            store.write(apply_changes(store.read(), newest))
        if on_batch:
            on_batch(newest, batch_id)

    writer = debounced(events).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(**trigger) if trigger else writer).start()


def file_events(spark: SparkSession, directory: str) -> DataFrame:
    """A stream of file events from JSON files that a watcher drops into a directory: (path, event_type, ts, dest, content)."""
    return spark.readStream.schema("path string, event_type string, ts timestamp, dest string, content string").json(directory)


LISTING = "path string, length bigint, modified_at timestamp"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Watched files below ``root`` as (path, length, modified_at): a distributed listing, no file is opened."""
    tree = tree_files(spark, root)
    return tree.where(should_handle(F.col("path"))).select("path", "length", "modified_at")


def listing_events(before: DataFrame, after: DataFrame, quiet: str = QUIET) -> DataFrame:
    """What happened between two listings: (path, event_type), created, modified or deleted, by length and time of modification. Files that
    changed less than ``quiet`` ago have not settled and are left to the next listing."""
    b, a = before.select("path", F.col("length").alias("l"), F.col("modified_at").alias("m")), after.select("path", "length", "modified_at")
    both = a.join(b, "path", "full")
    kind = F.when(F.col("length").isNull(), "deleted").when(F.col("l").isNull(), "created").when((F.col("length") != F.col("l")) | (F.col("modified_at") != F.col("m")), "modified")
    settled = F.col("modified_at").isNull() | (F.col("modified_at") <= F.current_timestamp() - F.expr(f"INTERVAL {quiet}"))
    return both.select("path", kind.alias("event_type"), settled.alias("settled")).where("event_type IS NOT NULL AND settled").drop("settled")


def watch_directory(spark: SparkSession, root: str, store: QuadStore, interval: float = 1.0, rounds: int | None = None, before: DataFrame | None = None, on_batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Keep a store in step with a directory: list it every ``interval`` seconds, read the files that changed, re-index them. ``before`` is the
    listing the store was made from (none: all files are new); the last one is returned, so that a watch can go on where it stopped.
    """
    known = cut(before if before is not None else spark.createDataFrame([], LISTING))
    n = 0
    while rounds is None or n < rounds:
        if n:
            time.sleep(interval)
        now = cut(listing(spark, root))
        events = cut(listing_events(known, now))
        if not events.isEmpty():
            texts = tree_files(spark, root).select("path", F.decode("content", "UTF-8").alias("content"))
            alive = events.where("event_type <> 'deleted'")
            changes = events.join(texts.join(alive.select("path"), "path", "left_semi"), "path", "left").select("path", "event_type", "content")
            store.write(apply_changes(store.read(), changes))
            # what has not settled stays as it was known, so that it differs again
            done = events.select("path")
            known = cut(known.join(done, "path", "left_anti").unionByName(now.join(done, "path", "left_semi")))
        if on_batch:
            on_batch(events, n)
        n += 1
    return known
