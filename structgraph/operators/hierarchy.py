"""Parent-child links to full hierarchies: path, depth, root, descendants and loops (problem 5)."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from structgraph.functions.text import class_name, repo_of
from structgraph.plans.lineage import cut
from structgraph.plans.skew import HOT_ROWS, salted_lookup, salts_for

#: Rounds of leaf peeling before what is left goes to pointer doubling; chains longer than this are rare, loops never end.
PEEL_ROUNDS = 4


def class_parents(entities: DataFrame, inherits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct class uris as nodes (key) and, of each, the class its first base names in its repo as parent (child, parent)."""
    classes = entities.where((F.col("kind") == "Class") & F.col("uri").isNotNull())
    nodes = classes.select(F.col("uri").alias("key")).distinct()
    names = classes.groupBy(repo_of(F.col("file")).alias("repo"), F.col("name").alias("base_name")).agg(F.min("uri").alias("parent"))
    bases = inherits.select("repo", F.col("cls").alias("child"), "base_no", class_name(F.col("base")).alias("base_name")).where(F.col("base_name").isNotNull()).distinct()
    found = salted_lookup(bases, names, ["repo", "base_name"], salts=salts_for(inherits, ["repo", "base"]), how="inner")
    return nodes, found.groupBy("child").agg(F.min_by("parent", F.struct("base_no", "parent")).alias("parent"))


def numbered(nodes: DataFrame) -> DataFrame:
    """Distinct non-null keys with a dense-enough long id; stored, so that the ids stay."""
    return cut(nodes.where(F.col("key").isNotNull()).select("key").distinct().withColumn("id", F.monotonically_increasing_id()))


def loop_members(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes on loops and the links among which they were found.

    ``links`` is (id, parent) with one parent per id. Leaves (ids that nobody has as parent) are peeled off a few times; what
    survives is a superset of the loops. Pointer doubling then finds the image of a jump longer than any chain left: exactly
    the loop nodes. Every round is one join of two columns; rounds grow with the logarithm of the longest chain.
    """
    rest = links
    for i in range(PEEL_ROUNDS):
        rest = rest.join(rest.select(F.col("parent").alias("id")).distinct(), "id", "left_semi")
    rest = cut(rest)
    # a chain into a loop or to a root keeps its tail; jumps of 2^k along existing links lose all but loop nodes
    jump, n = rest, rest.count()
    k, m = 0, n
    while n and (1 << k) < n + 1:
        far = jump.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        # jumps gather on few nodes, and more so with every round
        after = cut(salted_lookup(jump, far, ["parent"], 1 if m <= HOT_ROWS else salts_for(jump, ["parent"]), "inner").select("id", F.col("next").alias("parent")))
        m = after.count()
        k += 1
        jump = after
        if m == 0:
            n = 0
    if not n:
        return jump.select("id").limit(0), jump
    return cut(jump.select(F.col("parent").alias("id")).distinct()), rest


def rank_lists(arcs: DataFrame) -> DataFrame:
    """Parallel list ranking. ``arcs``: (arc, next, w) with next null at a list's end; returns (arc, last, steps, total):
    the list's last arc, the arcs from this one to it, itself included, and the sum of w over them.

    Pointer jumping: each round doubles the stretch an arc has summed, so the rounds are the logarithm of the longest list.
    """
    state = cut(arcs.select("arc", "next", F.col("arc").alias("last"), F.lit(1).cast("bigint").alias("steps"), F.col("w").cast("bigint").alias("total")))
    ended = state.where(F.col("next").isNull())
    open_ = state.where(F.col("next").isNotNull())
    while not open_.isEmpty():
        ahead = open_.unionByName(ended).select(*[F.col(c).alias(f"b_{c}") for c in state.columns])
        moved = cut(
            open_.join(ahead, F.col("next") == F.col("b_arc")).select(
                "arc", F.col("b_next").alias("next"), F.col("b_last").alias("last"), (F.col("steps") + F.col("b_steps")).alias("steps"), (F.col("total") + F.col("b_total")).alias("total")
            )
        )
        # an arc that has reached the end is written once
        ended = ended.unionByName(moved.where(F.col("next").isNull()))
        open_ = moved.where(F.col("next").isNotNull())
    return ended.select("arc", "last", "steps", "total")


def euler_arcs(ids: DataFrame, links: DataFrame) -> DataFrame:
    """Arcs of the Euler tours of all trees: node v goes down as arc 2v (w +1) and up as 2v+1 (w -1).

    The children of one parent are chained in pieces by a hash of the child, as many as the children of the parent that has most need
    for pieces of HOT_ROWS, and the pieces then end to end, so no task holds all children of a parent that has a third of the rows.
    """
    most = links.groupBy("parent").count().agg(F.max("count")).first()[0] or 1
    child = links.select(F.col("id").alias("v"), F.col("parent").alias("p"), F.pmod(F.xxhash64("id"), F.lit(-(-most // HOT_ROWS))).alias("piece"))
    within = Window.partitionBy("p", "piece").orderBy("v")
    chained = child.withColumn("sibling", F.lead("v").over(within))
    pieces = child.groupBy("p", "piece").agg(F.min("v").alias("first"), F.max("v").alias("tail"))
    heads = Window.partitionBy("p").orderBy("piece")
    pieces = pieces.withColumn("follow", F.lead("first").over(heads)).withColumn("rank", F.row_number().over(heads))
    first_child = pieces.where("rank = 1").select(F.col("p").alias("id"), F.col("first"))
    across = pieces.where(F.col("follow").isNotNull()).select(F.col("tail").alias("v"), "follow")
    ups = chained.join(across, "v", "left").select(
        (F.col("v") * 2 + 1).alias("arc"), F.when(F.coalesce("sibling", "follow").isNotNull(), F.coalesce("sibling", "follow") * 2).otherwise(F.col("p") * 2 + 1).alias("next"), F.lit(-1).alias("w")
    )
    roots = ids.select("id").join(links.select("id"), "id", "left_anti")
    root_ups = roots.select((F.col("id") * 2 + 1).alias("arc"), F.lit(None).cast("bigint").alias("next"), F.lit(-1).alias("w"))
    downs = ids.select("id").join(first_child, "id", "left").select((F.col("id") * 2).alias("arc"), F.when(F.col("first").isNotNull(), F.col("first") * 2).otherwise(F.col("id") * 2 + 1).alias("next"), F.lit(1).alias("w"))
    return reduce(DataFrame.unionByName, [downs, ups, root_ups])


def hierarchy(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Root, depth and tour interval of every node.

    ``nodes``: key; ``parents``: (child, parent) keys, at most one parent per child. Null keys, links from or to unknown keys
    and repeated rows fall away. Result: (key, parent, root, depth, entry, leave, descendants, on_loop). A node without a parent
    is its own root at depth 0. A node on a loop, or below one, has depth -1 and as root the smallest key of the loop;
    ``entry`` and ``leave`` are then null if it is on the loop, and descendants of loop nodes are null. In a tree, v is
    a descendant of u exactly if both have the same root and u.entry < v.entry < u.leave.

    Below a loop, the tree that hangs on a loop node is toured like any other, its top being the node next to the loop.
    """
    ids = numbered(nodes)
    a, b = ids.select(F.col("key").alias("child"), "id"), ids.select(F.col("key").alias("parent"), F.col("id").alias("pid"))
    one = parents.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).groupBy("child").agg(F.min("parent").alias("parent"))
    one = cut(one.join(a, "child"))
    hot = salts_for(one, ["parent"])  # a parent may have a third of all links
    links = cut(salted_lookup(one, b, ["parent"], hot, "inner").select("id", F.col("pid").alias("parent")))
    on_loop, rest = loop_members(links)
    # smallest key of each loop, by doubling the stretch over which the minimum is taken
    loop_links = rest.join(on_loop, "id", "left_semi").select("id", F.col("parent").alias("next"))
    tops = cut(loop_links.join(ids, "id").select("id", "next", F.col("key").alias("top")))
    size = tops.count()
    span = 1
    while span < size:
        ahead = tops.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("top").alias("top2"))
        after = cut(tops.join(ahead, "next").select("id", F.col("next2").alias("next"), F.least("top", "top2").alias("top")))
        span *= 2
        same = after.join(tops.select("id", F.col("top").alias("before")), "id").where("top <> before").isEmpty()
        tops = after
        if same:
            break
    # trees: links whose child is off the loops; those onto a loop are cut and remembered
    off = links.join(on_loop, "id", "left_anti")
    onto = salted_lookup(off, tops.select(F.col("id").alias("parent"), "top"), ["parent"], hot, "inner").select("id", "top")
    tree = off.join(onto.select("id"), "id", "left_anti")
    tree_ids = ids.join(on_loop, "id", "left_anti")
    ranked = rank_lists(euler_arcs(tree_ids, tree))
    v = F.floor(F.col("arc") / 2).cast("bigint")
    spans = ranked.select(v.alias("id"), (F.col("arc") % 2).alias("side"), F.floor(F.col("last") / 2).cast("bigint").alias("root"), "steps", "total")
    per_node = spans.groupBy("id").agg(
        F.max("root").alias("rid"),
        F.max(F.when(F.col("side") == 0, F.col("steps"))).alias("from_entry"),
        F.max(F.when(F.col("side") == 1, F.col("steps"))).alias("from_leave"),
        F.max(F.when(F.col("side") == 0, -F.col("total"))).alias("depth"),
    )
    tree_roots = cut(per_node)
    length = tree_roots.where("id = rid").select("rid", F.col("from_entry").alias("len"))
    keyed = ids.select(F.col("id").alias("rid"), F.col("key").alias("root_key"))
    parent_key = salted_lookup(links, ids.select(F.col("id").alias("parent"), F.col("key").alias("parent_key")), ["parent"], hot, "inner").select("id", "parent_key")
    heads = length.join(keyed, "rid").join(onto.withColumnRenamed("id", "rid"), "rid", "left")
    in_trees = salted_lookup(tree_roots, heads, ["rid"], how="inner").select(
        "id",
        F.coalesce("top", "root_key").alias("root"),
        F.when(F.col("top").isNotNull(), -1).otherwise(F.col("depth")).cast("bigint").alias("depth"),
        (F.col("len") - F.col("from_entry")).alias("entry"),
        (F.col("len") - F.col("from_leave")).alias("leave"),
        F.floor((F.col("from_entry") - F.col("from_leave") - 1) / 2).cast("bigint").alias("descendants"),
        F.lit(False).alias("on_loop"),
    )
    none = F.lit(None).cast("bigint")
    loops = tops.select("id", F.col("top").alias("root"), F.lit(-1).cast("bigint").alias("depth"), none.alias("entry"), none.alias("leave"), none.alias("descendants"), F.lit(True).alias("on_loop"))
    return in_trees.unionByName(loops).join(ids, "id").join(parent_key, "id", "left").select("key", F.col("parent_key").alias("parent"), "root", "depth", "entry", "leave", "descendants", "on_loop")


def tree_paths(tree: DataFrame) -> DataFrame:
    """Full path of every node of :func:`hierarchy` that is in a tree, as an array of keys from the root to itself: (key, path).

    Ancestor stretches double each round: a node that knows its 2^k nearest ancestors takes on those of the furthest one. The
    rounds grow with the logarithm of the depth, and the volume is that of the result.
    """
    state = cut(tree.where("depth >= 0").select("key", F.col("parent").alias("up"), F.array("key").alias("path")))
    while not state.where(F.col("up").isNotNull()).isEmpty():
        ahead = state.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        moved = salted_lookup(state.where(F.col("up").isNotNull()), ahead, ["up"], how="inner")
        state = cut(moved.select("key", F.col("up2").alias("up"), F.concat("path2", "path").alias("path")).unionByName(state.where(F.col("up").isNull())))
    return state.select("key", "path")


def descendant_pairs(paths: DataFrame) -> DataFrame:
    """Every (ancestor, descendant, distance) of the trees, from their paths: as many rows as the result has, no join."""
    return paths.select(F.col("key").alias("descendant"), F.size("path").alias("n"), F.posexplode("path").alias("pos", "ancestor")).where("pos < n - 1").select(
        "ancestor", "descendant", (F.col("n") - 1 - F.col("pos")).cast("bigint").alias("distance")
    )
