"""Problems 3 and 5 against brute force, with nulls, repeats, ties, loops and empty tables."""

import random
from datetime import datetime

from structgraph.operators.hierarchy import descendant_pairs, hierarchy, tree_paths
from structgraph.operators.references import base_references, code_references, import_references, orphan_references, orphan_report
from structgraph.plans.skew import salted_lookup

T = [datetime(2024, 1, d) for d in range(1, 29)]


def test_orphans_states(spark, table):
    refs = spark.createDataFrame(
        [("t", 1, "", "a", T[5]), ("t", 1, "", "a", T[5]), ("t", 2, "", "a", T[0]), ("t", 3, "", "a", T[9]), ("t", 4, "", "zz", T[5]), ("t", 5, "", None, T[5]), ("t", 6, "", "a", T[20]), ("t", 7, "", "a", None)],
        "table_name string, ref_id bigint, scope string, key string, seen_at timestamp",
    )
    targets = spark.createDataFrame(
        [("t", "", "a", T[2], T[9]), ("t", "", "a", T[15], None), ("t", "", "a", T[15], None), ("t", "", None, T[1], None)], "table_name string, scope string, key string, indexed_at timestamp, deleted_at timestamp"
    )
    out = orphan_references(refs, targets)
    assert table(out, "ref_id", "state") == sorted([(1, None), (2, "late"), (3, "deleted"), (4, "missing"), (6, None)], key=repr)
    assert table(orphan_report(out)) == [("t", "2024-01", 5, 1, 1, 1)]
    assert {r.state for r in orphan_references(refs, targets.limit(0)).collect()} == {"missing"}
    assert orphan_references(refs.limit(0), targets).count() == 0


def test_import_texts(spark, table):
    packages = spark.createDataFrame([("os", "package"), ("stdio.h", "package"), ("@x/ui", "package"), ("Base", "base")], "name string, kind string")
    modules = spark.createDataFrame([(f"o/r/{p}", "o/r", T[0], None) for p in ("a/b.py", "a/c.ts", "d.js", "lib/h.c")], "path string, repo string, indexed_at timestamp, deleted_at timestamp")
    texts = ["os", "os.path", "osx", "@x/ui/core", "stdio.h", "./c", "./c.ts", "../d.js", ".b", "..d", "a.b", "lib/h.h", "./gone", "...d"]
    imports = spark.createDataFrame([(i, "o/r", "https://h.invalid/entity/o/r/a/me.py", t, T[3]) for i, t in enumerate(texts)], "import_id bigint, repo string, module string, from_module string, seen_at timestamp")
    got = dict(table(orphan_references(*import_references(imports, modules, packages)), "ref_id", "state"))
    assert {texts[i]: s for i, s in got.items()} == {"osx": "missing", "./c": None, "./c.ts": None, "../d.js": None, ".b": None, "..d": None, "a.b": None, "lib/h.h": None, "./gone": "missing", "...d": None}


def test_base_names(spark, table):
    packages = spark.createDataFrame([("Exception", "base")], "name string, kind string")
    entities = spark.createDataFrame([("u", "Class", "Foo", "o/r/x.py", T[0], None)], "uri string, kind string, name string, file string, indexed_at timestamp, deleted_at timestamp")
    inherits = spark.createDataFrame([(i, "o/r", "c", b, T[2]) for i, b in enumerate([" m.Foo ", "ns::Foo<T>", "Foo[int, str]", "Exception", "Bar", "", None])], "inherit_id bigint, repo string, cls string, base string, seen_at timestamp")
    assert table(orphan_references(*base_references(inherits, entities, packages)), "ref_id", "state") == [(0, None), (1, None), (2, None), (4, "missing")]


def test_hot_reference_key(spark):
    refs = spark.range(20_000).selectExpr("'t' table_name", "id ref_id", "'' scope", "if(id % 3 = 0, 'hot', concat('k', id % 50)) key", "timestamp'2024-01-05' seen_at")
    targets = spark.createDataFrame([("t", "", "hot", T[0], None)], "table_name string, scope string, key string, indexed_at timestamp, deleted_at timestamp")
    got = {r.state: r["count"] for r in orphan_references(refs, targets).groupBy("state").count().collect()}
    assert got == {None: 6667, "missing": 13333}


def test_salted_lookup_keeps_rows_and_names(spark, table):
    left = spark.createDataFrame([(1, "a", 7), (2, None, 8), (2, None, 8)], "id int, k string, _salt int")
    right = spark.createDataFrame([("a", 5)], "k string, v int")
    assert table(salted_lookup(left, right, ["k"])) == [("a", 1, 7, 5), (None, 2, 8, None), (None, 2, 8, None)]


def brute(nodes, parent):
    out = {}
    for n in nodes:
        seen, at = [], n
        while at is not None and at not in seen:
            seen.append(at)
            at = parent.get(at)
        if at is None:
            out[n] = (seen[-1], len(seen) - 1)
        else:
            out[n] = (min(seen[seen.index(at) :]), -1)
    return out


def check_tree(spark, table, nodes, parent):
    tree = hierarchy(spark.createDataFrame([(n,) for n in nodes], "key string"), spark.createDataFrame(list(parent.items()), "child string, parent string")).cache()
    expected = brute(nodes, parent)
    assert {r.key: (r.root, r.depth) for r in tree.collect()} == expected
    paths = {r.key: list(r.path) for r in tree_paths(tree).collect()}
    for n, (_root, depth) in expected.items():
        if depth >= 0:
            walk = [n]
            while parent.get(walk[-1]):
                walk.append(parent[walk[-1]])
            assert paths[n] == walk[::-1]
    pairs = {(r.ancestor, r.descendant): r.distance for r in descendant_pairs(tree_paths(tree)).collect()}
    by = {r.key: r for r in tree.where("depth >= 0").collect()}
    for a in by.values():
        inside = {b.key for b in by.values() if b.root == a.root and a.entry < b.entry < a.leave}
        assert inside == {d for (x, d) in pairs if x == a.key} and a.descendants == len(inside)


def test_hierarchy_of_a_random_forest_with_loops(spark, table):
    rnd = random.Random(3)
    nodes = [f"n{i:03}" for i in range(120)]
    parent = {n: rnd.choice(nodes) for n in nodes if rnd.random() < 0.8}
    check_tree(spark, table, nodes, parent)


def test_hierarchy_of_a_chain_a_star_and_a_self_loop(spark, table):
    chain = [f"c{i:02}" for i in range(40)]
    star = [f"s{i:02}" for i in range(60)]
    parent = {b: a for a, b in zip(chain, chain[1:])} | {s: "s00" for s in star[1:]} | {"x": "x", "y": "x"}
    check_tree(spark, table, [*chain, *star, "x", "y", "z"], parent)


def test_hierarchy_of_nothing_and_of_dirt(spark, table):
    nodes = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "key string")
    links = spark.createDataFrame([("b", "a"), ("b", "a"), ("b", "gone"), (None, "a"), ("ghost", "a"), ("a", None)], "child string, parent string")
    # of several parents the least counts
    assert table(hierarchy(nodes, links), "key", "root", "depth") == [("a", "a", 0), ("b", "a", 1)]
    assert hierarchy(nodes.limit(0), links).count() == 0


def test_code_references_over_empty_tables(spark):
    t = lambda s: spark.createDataFrame([], s)
    out = code_references(
        t("call_id bigint, callee string, seen_at timestamp"), t("inherit_id bigint, repo string, base string, seen_at timestamp"), t("import_id bigint, repo string, module string, from_module string, seen_at timestamp"),
        t("uri string, kind string, name string, file string, indexed_at timestamp, deleted_at timestamp"), t("path string, repo string, indexed_at timestamp, deleted_at timestamp"), t("name string, kind string"),
    )
    assert out.count() == 0


def test_states_against_brute_force_with_many_lifetimes(spark):
    rnd = random.Random(4)
    day = lambda: T[rnd.randrange(28)]
    lives = [("t", "", rnd.choice("aaaab"), b := day(), rnd.choice((None, day(), b))) for _ in range(60)] + [("t", "", "c", T[3], T[9]), ("t", "", "c", T[9], T[12]), ("t", "", "c", T[20], None)]
    refs = [("t", i, "", rnd.choice("aabcd"), day()) for i in range(300)]
    got = {r.ref_id: r.state for r in orphan_references(spark.createDataFrame(refs, "table_name string, ref_id bigint, scope string, key string, seen_at timestamp"), spark.createDataFrame(lives, "table_name string, scope string, key string, indexed_at timestamp, deleted_at timestamp")).collect()}
    for _, i, _, k, t in refs:
        mine = [(b, e) for _, _, x, b, e in lives if x == k]
        alive = any(b <= t and (e is None or t < e) for b, e in mine)
        assert got[i] == ("missing" if not mine else None if alive else "deleted" if any(b <= t for b, _ in mine) else "late")


def test_a_key_with_a_third_of_the_rows_is_spread(spark):
    """The largest range of the running sums, and the largest reducer of a salted lookup, hold a fraction of the hot key's rows."""
    from structgraph.operators.references import alive_at
    from structgraph.plans import skew

    n = 30_000
    refs = spark.range(n).selectExpr("'t' table_name", "id ref_id", "'' scope", "if(id % 3 = 0, 'hot', concat('k', id)) key", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id % 5000 as int)) seen_at")
    lives = spark.range(4_000).selectExpr("'t' table_name", "'' scope", "'hot' key", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id * 2 as int)) indexed_at", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id * 2 + 1 as int)) deleted_at")
    import structgraph.operators.references as module

    laid = []
    real = module.stored
    module.stored = lambda df, name: laid.append(real(df, name)) or laid[-1]
    try:
        out = {r.ref_id: r.alive for r in alive_at(refs, lives).where("key = 'hot'").collect()}
    finally:
        module.stored = real
    assert all(a == (i % 5000 < 8000 and i % 2 == 0) for i, a in out.items()) and len(out) == n // 3
    parts = [r["count"] for r in laid[0].where("key = 'hot'").groupBy("part").count().collect()]
    assert len(parts) > 1 and max(parts) < (n // 3 + 8_000) * 0.8
    assert skew.salts_for(refs, ["key"], hot_rows=1_000) == 2 and skew.salts_for(refs.where("key <> 'hot'"), ["key"], hot_rows=1_000) == 1
    joined = salted_lookup(refs, refs.select("key").distinct(), ["key"], salts=16, how="inner")
    sizes = [r["count"] for r in joined.where("key = 'hot'").groupBy(skew.F.pmod(skew.F.xxhash64(*refs.columns), skew.F.lit(16))).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1_000 and joined.count() == n


def test_siblings_are_chained_in_pieces(spark, table, monkeypatch):
    from structgraph.operators import hierarchy as module

    monkeypatch.setattr(module, "HOT_ROWS", 7)
    nodes = [f"s{i:03}" for i in range(90)]
    check_tree(spark, table, nodes, {s: "s000" for s in nodes[1:60]} | {s: "s001" for s in nodes[60:]})
