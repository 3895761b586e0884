"""Operators on graphs made from small sources, against what follows by hand."""

import json
import random

from structgraph.catalog import core_queries
from structgraph.model import quads_of
from structgraph.operators import analytics, encode, export, refactor, resolve, store, traverse
from structgraph.sources.files import language, parse_files, read_tree, skipped


def graph(spark, sources):
    return encode.graph_from_parsed(parse_files(spark.createDataFrame(list(sources.items()), "path string, content string")))


def test_circular_imports_by_containment(spark, table):
    g = graph(
        spark,
        {
            "a/alpha.py": "from b.beta import x\n", "b/beta.py": "import a.alpha\n", "c/lone.py": "import beta\n", "d/be.py": "import os\nimport alphabet\n", "e/x.py": "from be import y\n", "f/longer_name.py": "import p.short_module\n",
            "g/short_module.py": "import my_longer_names\n",
        },
    )
    # "b.beta.x" holds be, and "alphabet" holds alpha; longer_name is within my_longer_names
    assert table(analytics.circular_dependencies(g)) == [("a/alpha.py", "b/beta.py"), ("a/alpha.py", "d/be.py"), ("f/longer_name.py", "g/short_module.py")]


def test_contained_against_brute_force(spark, table):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("ab") for _ in range(n))
    texts, parts = sorted({word(rnd.randint(1, 14)) for _ in range(60)}), sorted({word(rnd.randint(1, 9)) for _ in range(40)})
    df = spark.createDataFrame([("r", t) for t in [*texts, "", None]], "repo string, name string")
    got = table(analytics.contained(df, spark.createDataFrame([("r", p) for p in [*parts, ""]], "repo string, stem string")), "name", "stem")
    assert got == sorted([(t, p) for t in texts for p in parts if p in t], key=repr)


def test_file_dependencies(spark, table):
    g = graph(spark, {"app.py": "from config import a\nimport app\nimport models.user\n", "config.py": "", "x/models.py": "import os\n", "y/models.py": ""})
    assert table(traverse.file_dependencies(g)) == [("app.py", "config.py"), ("app.py", "y/models.py")]


def test_resolution_precedence(spark, table):
    g = graph(
        spark,
        {
            "app.py": "from lib import pick\ndef run():\n    pick()\n    only()\n    obj.only()\n    obj.pick()\n    twice()\n    len()\ndef twice():\n    pass\n",
            "lib.py": "def pick():\n    pass\n", "other.py": "def pick():\n    pass\ndef twice():\n    pass\n", "one.py": "def only():\n    pass\n",
            "k.py": "class K:\n    def f(self):\n        self.g()\n        only()\n    def g(self):\n        pass\n",
        },
    )
    short = lambda rows: sorted((a.split("#")[1], t, c.rsplit("/", 1)[1]) for a, t, c in rows)
    plain = short(table(resolve.resolve_calls(g)))
    assert plain == [("Function.run", "obj.only", "one.py#Function.only"), ("Function.run", "only", "one.py#Function.only"), ("Function.run", "pick", "lib.py#Function.pick"), ("Function.run", "twice", "app.py#Function.twice")]
    assert ("Method.K.f", "self.g", "k.py#Method.K.g") in short(table(resolve.resolve_calls(g, methods=True)))
    empty = graph(spark, {"a.json": "{}"})
    assert resolve.resolve_calls(empty).count() == 0 and analytics.dead_functions(empty).count() == 0 and traverse.impact_of(empty, "x").count() == 0


def test_names_with_odd_characters(spark, table):
    g = graph(spark, {"a b\\c#.css": ".x > a#y, p { color: red }\n", "t.py": "x = 1\n"})
    uris = {r.uri for r in quads_of(g).selectExpr("s AS uri").distinct().collect()}
    assert any(u.endswith("/a%20b/c%23.css#Class..x%20%3E%20a%23y,%20p") for u in uris)


def test_store_versions(spark, table, tmp_path):
    s = store.QuadStore(spark, str(tmp_path / "s"))
    assert s.read().count() == 0
    q = quads_of(graph(spark, {"a.py": "def f(): pass\n", "b.py": "x = 1\n"}))
    s.write(q.unionByName(q))
    assert s.read().count() == q.count() and s.read().columns == q.columns
    g = s.read().where("g LIKE '%/a.py#graph'").first().g
    s.write(store.clear_graph(s.read(), g))
    assert 0 < s.read().count() < q.count()
    assert store.clear_graph(s.read(), "none").count() == s.read().count()
    s.clear()
    assert s.read().count() == 0


def test_quads_come_back_as_views(spark, table):
    g = graph(spark, {"a.py": "class A(B):\n    '''doc'''\n    @p\n    def f(self): g()\nimport os\n"})
    back = encode.graph_from_quads(quads_of(g))
    for name in ("modules", "entities", "defines", "calls", "imports", "inherits", "decorators"):
        a, b = getattr(g, name), getattr(back, name)
        cols = [c for c in a.columns if c != "repo"]
        assert table(a, *cols) == table(b, *cols), name


def test_scan(spark, table, tmp_path):
    for p in ("a.py", "A.PY", "x/b.ts", "x/.git/c.py", "x/y.egg-info/d.py", "build/e.py", "n.txt"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x = 1\n")
    assert table(read_tree(spark, str(tmp_path)), "path") == [("a.py",), ("x/b.ts",)]
    df = spark.createDataFrame([("a/venv/x.py",), ("venv",), ("q/w.HPP",), ("none",)], "p string")
    assert [tuple(r) for r in df.select(skipped(df.p), language(df.p)).collect()] == [(True, "py"), (False, None), (False, "cpp"), (False, None)]


def test_exports_of_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert export.text_of(export.mermaid_lines(none)) == "graph TD" and export.text_of(export.dot_lines(none, "g")) == "digraph g {\n}"


def test_safe_ids(spark):
    df = spark.createDataFrame([("a.b-c d/e",)], "n string")
    assert df.select(export.safe_id(df.n)).first()[0] == "a_b_c_d_e"


def test_file_lines_are_whole(spark, table):
    files = spark.createDataFrame([("a", "old", 1, None), ("a", "1\r\n2\n3\n4\r\n\n6\n", 2, None), ("b", "x", 1, None), ("c", None, 1, None), ("d", "", 1, None)], "path string, content string, op_id long, label string")
    assert [r.text for r in refactor.file_lines(files).where("path = 'a'").orderBy("line_no").collect()] == ["1", "2", "3", "4", "", "6"]
    assert table(refactor.file_lines(files), "path", "line_no")[-1] == ("b", 1) and refactor.file_lines(files).count() == 7
    assert table(refactor.source_lines(files, "a", -3, 2)) == [(1, "1", "   1 | 1"), (2, "2", "   2 | 2")]


def test_file_lines_query_goes_beyond_the_head(spark, tmp_path):
    spark.createDataFrame([("a", "\n".join("abcdef"), 1)], "path string, content string, op_id long").write.parquet(str(tmp_path / "files.parquet"))
    assert [r.text for r in core_queries()["file_lines"](spark, str(tmp_path)).orderBy("line_no").collect()] == list("abcdef")


def test_json_query_returns_the_json(spark):
    got = [json.loads(r.json) for r in core_queries()["export_json_rows"](spark, "/root/testdata/sf0.001").collect()]
    assert got and all(set(r) == {"uri", "name", "kind", "file", "start_line", "end_line"} and r["kind"] == "Class" and r["end_line"] >= r["start_line"] for r in got)


def test_contained_equals_brute_force(spark):
    import random

    from structgraph.operators.analytics import contained

    rnd = random.Random(2)
    word = lambda a, b: "".join(rnd.choice("ab.") for _ in range(rnd.randrange(a, b)))
    texts = [(rnd.choice("xy"), word(0, 14)) for _ in range(60)] + [("x", None), ("x", "aaaaaaaab")]
    parts = [(rnd.choice("xy"), word(0, 9)) for _ in range(40)] + [("x", None), ("x", "aaaaaaaab")]
    got = sorted(map(tuple, contained(spark.createDataFrame(texts, "repo string, name string"), spark.createDataFrame(parts, "repo string, stem string")).collect()))
    assert got == sorted({(r, t, p) for r, t in texts for q, p in parts if r == q and t and p and p in t})
    none = spark.createDataFrame([], "repo string, stem string")
    assert contained(spark.createDataFrame(texts, "repo string, name string"), none).count() == 0


def test_resolution_of_a_hot_name_does_not_multiply_rows(spark):
    """A name that all files define and import: hints times candidates would be 160,000 rows."""
    from pyspark.sql import functions as F

    from structgraph.model import CodeGraph
    from structgraph.operators import resolve

    n = 400
    ids = spark.range(n).withColumn("path", F.format_string("dir%05d/m.py", "id"))
    empty = lambda s: spark.createDataFrame([], s)
    g = CodeGraph(
        modules=ids.select(F.lit("").alias("repo"), F.concat(F.lit("u/"), "path").alias("uri"), "path"),
        entities=ids.select(F.lit("").alias("repo"), F.concat(F.lit("u/"), "path", F.lit("#Function.get")).alias("uri"), F.lit("Function").alias("kind"), F.lit("get").alias("name"), F.col("path").alias("file"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit("").alias("docstring")),
        defines=ids.select(F.concat(F.lit("u/"), "path").alias("parent"), F.concat(F.lit("u/"), "path", F.lit("#Function.get")).alias("child")),
        calls=ids.select(F.lit("").alias("repo"), F.concat(F.lit("u/"), "path", F.lit("#Function.get")).alias("caller"), F.lit("get").alias("target")),
        resolved=empty("caller string, callee string"),
        imports=ids.select(F.lit("").alias("repo"), F.concat(F.lit("u/"), "path").alias("module"), F.format_string("dir%05d.get", F.pmod(F.col("id") + 1, F.lit(n))).alias("name")),
        inherits=empty("repo string, cls string, base string"), decorators=empty("uri string, decorator string"), annotations=empty("uri string, kind string, value string, target string"),
    )
    seen = []
    real = resolve.contained
    resolve.contained = lambda texts, parts: seen.append(real(texts, parts)) or seen[-1]
    try:
        rows = resolve.resolve_calls(g).collect()
    finally:
        resolve.contained = real
    assert len(rows) == n and all(int(r.callee[5:10]) == (int(r.caller[5:10]) + 1) % n for r in rows)
    assert max(df.count() for df in seen) == n


def test_fuzzy_search_equals_the_scores_of_all_names(spark):
    import random
    from difflib import SequenceMatcher

    from structgraph.model import CodeGraph
    from structgraph.operators.search import fuzzy_search

    rnd = random.Random(6)
    names = sorted({"".join(rnd.choice("abcdE_") for _ in range(rnd.randrange(0, 9))) for _ in range(150)})
    e = spark.createDataFrame([(f"u{i}", n, "Function", "f.py") for i, n in enumerate(names)], "uri string, name string, kind string, file string")
    g = CodeGraph(*[e] * 9)
    for pattern, threshold in (("abc", 0.5), ("Deb_a", 0.7), ("", 0.5), ("zzz", 0.1)):
        low = pattern.lower()
        score = {n: SequenceMatcher(None, low, n.lower()).ratio() + (1.0 if low in n.lower() else 0.0) for n in names}
        want = sorted((n for n, s in score.items() if s >= threshold), key=lambda n: (-round(score[n], 3), n))[:20]
        assert [r.name for r in fuzzy_search(g, pattern, threshold).collect()] == want
