"""Set-semantics reachability over an edge table: the one recursive plan of the engine."""

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.plans.lineage import cut
from structgraph.plans.skew import salts_for

#: Graphs of at most so many distinct edges are walked by one task; larger ones in rounds, with the same result.
WALK_EDGES = 1_000_000
#: ... and with at most so many starting nodes where the walks of each are told apart.
WALK_STARTS = 2_000


def reach(edges: DataFrame, seeds: DataFrame, min_steps: int = 1, max_steps: int | None = None, walk_edges: int = WALK_EDGES) -> DataFrame:
    """Nodes from which a seed is reached along ``edges`` (src, dst), with the least number of steps: (node, steps).

    ``seeds`` has one column node. With ``min_steps=1`` a seed itself counts only if it lies on a loop, as a path of one or
    more edges demands; with 0 all seeds count. Null ends are ignored; loops end because a node is expanded once.

    A graph whose counted edges are at most ``walk_edges`` is walked breadth first by one task. Beyond that, rounds are semi-naive: each
    expands only the nodes found in the last one. Edges are laid out by dst once, split where one dst has too many; the nodes
    found lie by node, each round's beside those of the earlier ones, so a round shuffles its frontier and what that leads to, and
    neither the edges nor the result.
    """
    known = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    start = seeds.select("node").where("node IS NOT NULL").distinct()
    spark = edges.sparkSession
    known = cut(known)
    kind = known.schema["src"].dataType.simpleString()
    if known.count() <= walk_edges:
        both = known.unionByName(start.select(F.lit(None).cast(kind).alias("src"), F.col("node").cast(kind).alias("dst"))).coalesce(1)

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            into, first = _adjacency(batches)
            steps = dict.fromkeys(first, 0) if min_steps == 0 else {}
            frontier, step = first, 0
            while frontier and (max_steps is None or step < max_steps):
                step += 1
                frontier = list(dict.fromkeys(s for d in frontier for s in into.get(d, ()) if s not in steps))
                steps |= dict.fromkeys(frontier, step)
            yield pd.DataFrame({"node": pd.Series(list(steps), dtype=object), "steps": pd.Series(list(steps.values()), dtype="int32")})

        return both.mapInPandas(walk, f"node {kind}, steps int")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = salts_for(known, ["dst"])
    salt = F.pmod(F.xxhash64("src"), F.lit(salts)).cast("int")
    laid = cut(known.withColumn("salt", salt).repartition(n, "dst", "salt"), keep_layout=True)
    frontier = cut(start.repartition(n, "node"), keep_layout=True)
    parts = [frontier.select("node", F.lit(0).alias("steps"))] if min_steps == 0 else []
    seen = frontier if min_steps == 0 else None
    step = 0
    while max_steps is None or step < max_steps:
        step += 1
        ends = frontier.select(F.col("node").alias("dst"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        found = laid.join(ends, ["dst", "salt"], "left_semi").select(F.col("src").alias("node")).distinct()
        frontier = cut(found if seen is None else found.join(seen, "node", "left_anti"), keep_layout=True)
        if frontier.isEmpty():
            break
        parts.append(frontier.select("node", F.lit(step).alias("steps")))
        seen = frontier if seen is None else seen.unionByName(frontier)
    out = spark.createDataFrame([], f"node {kind}, steps int")
    for p in parts:
        out = out.unionByName(p)
    return out


def closure(edges: DataFrame, starts: DataFrame, walk_edges: int = WALK_EDGES) -> DataFrame:
    """Pairs (start, node) such that one or more ``edges`` (src, dst) lead from a start to the node; ``starts`` has one column node.

    The result has a row per pair, up to starts times nodes. Small graphs are walked by one task each with a share of the starts, others
    in semi-naive rounds as in :func:`reach`: what a round finds is stored once and never written again.
    """
    known = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    start = cut(starts.select("node").where("node IS NOT NULL").distinct())
    spark = edges.sparkSession
    kind = known.schema["src"].dataType.simpleString()
    if known.count() <= walk_edges and start.count() <= WALK_STARTS:
        # walking from a start is walking into it along turned edges
        turned = known.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        both = turned.unionByName(start.select(F.lit(None).cast(kind).alias("src"), F.col("node").cast(kind).alias("dst"))).coalesce(1)

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out, first = _adjacency(batches)
            for s in first:
                seen: set = set()
                queue = deque([s])
                while queue:
                    new = [t for t in out.get(queue.popleft(), ()) if t not in seen]
                    seen.update(new)
                    queue.extend(dict.fromkeys(new))
                if seen:
                    yield pd.DataFrame({"start": pd.Series([s] * len(seen), dtype=object), "node": pd.Series(list(seen), dtype=object)})

        return both.mapInPandas(walk, f"start {kind}, node {kind}")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = salts_for(known, ["src"])
    salt = F.pmod(F.xxhash64("dst"), F.lit(salts)).cast("int")
    laid = cut(known.withColumn("salt", salt).repartition(n, "src", "salt"), keep_layout=True)
    each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    hop = lambda f: laid.join(f.select("start", F.col("node").alias("src"), each), ["src", "salt"]).select("start", F.col("dst").alias("node")).distinct()
    seen = frontier = cut(hop(start.select(F.col("node").alias("start"), "node")), keep_layout=True)
    while not frontier.isEmpty():
        frontier = cut(hop(frontier).join(seen, ["start", "node"], "left_anti"), keep_layout=True)
        seen = seen.unionByName(frontier)
    return seen


def _adjacency(batches: Iterator[pd.DataFrame]) -> tuple[dict, list]:
    """dst -> its srcs, and the dsts of rows without a src, which are the nodes to begin with."""
    into: dict = {}
    first = []
    for pdf in batches:
        none = pdf["src"].isna()
        for s, d in zip(pdf["src"][~none].tolist(), pdf["dst"][~none].tolist()):
            into.setdefault(d, []).append(s)
        first += pdf["dst"][none].tolist()
    return into, first
