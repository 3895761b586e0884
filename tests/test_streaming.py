"""Debounce and re-index, on tables and on a stream that is fed file by file."""

import json
from datetime import datetime, timedelta

from structgraph.model import VOCAB
from structgraph.operators.store import QuadStore
from structgraph.streaming.reindex import apply_changes, debounced, file_events, watch

T0 = datetime(2024, 5, 1, 12)
EVENT = "path string, event_type string, ts timestamp, dest string, content string"


def at(ms):
    return T0 + timedelta(milliseconds=ms)


def test_debounce(spark, table):
    events = spark.createDataFrame(
        [
            ("a.py", "modified", at(0), None, "1"), ("a.py", "modified", at(200), None, "2"), ("a.py", "modified", at(450), None, "3"), ("a.py", "deleted", at(900), None, None),
            ("b.ts", "created", at(0), None, "b"), ("b.ts", "deleted", at(0), None, None), ("m.js", "moved", at(5), "n.js", "m"), ("x.md", "modified", at(0), None, "no"),
            ("node_modules/c.js", "modified", at(0), None, "no"), (None, "modified", at(0), None, "no"),
        ],
        EVENT,
    )
    got = table(debounced(events), "path", "events", "event_type", "content")
    assert got == sorted([("a.py", 3, "modified", "3"), ("a.py", 1, "deleted", None), ("b.ts", 2, "deleted", None), ("m.js", 1, "deleted", None), ("n.js", 1, "created", "m")], key=repr)
    assert debounced(events.limit(0)).count() == 0


def edges(quads, table):
    return {(a.split("#")[-1], b.split("#")[-1]) for a, b in table(quads.where(quads.p == VOCAB + "resolvedCalls"), "s", "o")}


def change(spark, *rows):
    return spark.createDataFrame([(p, "deleted" if c is None else "modified", c) for p, c in rows], "path string, event_type string, content string")


def test_changes_keep_edges_right(spark, table):
    store = QuadStore(spark)
    q = apply_changes(store.read(), change(spark, ("a.py", "def f():\n    g()\n"), ("b.py", "def g():\n    pass\n"), ("c.py", "def h():\n    f()\n")))
    assert edges(q, table) == {("Function.f", "Function.g"), ("Function.h", "Function.f")}
    q = apply_changes(q, change(spark, ("b.py", "def other():\n    f()\n")))
    assert edges(q, table) == {("Function.h", "Function.f"), ("Function.other", "Function.f")}
    q = apply_changes(q, change(spark, ("d.py", "def g():\n    pass\n")))
    assert ("Function.f", "Function.g") in edges(q, table)
    q = apply_changes(q, change(spark, ("a.py", None)))
    assert edges(q, table) == set() and q.where("g LIKE '%/a.py#graph'").count() == 0


def test_stream(spark, table, tmp_path):
    drop = tmp_path / "events"
    drop.mkdir()

    def feed(name, *rows):
        lines = [json.dumps({"path": p, "event_type": e, "ts": t.isoformat(), "content": c}) for p, e, t, c in rows]
        (drop / f"{name}.json").write_text("\n".join(lines))

    feed("1", ("a.py", "created", at(0), "def f():\n    pass\n"), ("a.py", "modified", at(100), "def f():\n    g()\n"), ("b.py", "created", at(0), "def g():\n    pass\n"))
    feed("2", ("tick.py", "created", at(60_000), "x = 1\n"))
    store = QuadStore(spark, str(tmp_path / "store"))
    seen = []
    for _ in range(2):
        q = watch(spark, file_events(spark, str(drop)), store, str(tmp_path / "cp"), lambda df, i: seen.extend(r.path for r in df.collect()), availableNow=True)
        q.awaitTermination(120)
    assert seen.count("a.py") == 1 and edges(store.read(), table) == {("Function.f", "Function.g")}
    feed("3", ("b.py", "deleted", at(120_000), None), ("tick.py", "modified", at(200_000), "x = 2\n"))
    for _ in range(2):
        q = watch(spark, file_events(spark, str(drop)), store, str(tmp_path / "cp"), availableNow=True)
        q.awaitTermination(120)
    assert edges(store.read(), table) == set() and store.read().where("g LIKE '%b.py#graph'").count() == 0


def test_store_writes_only_what_changed(spark, tmp_path, monkeypatch):
    import os

    from structgraph.model import ANNOTATIONS, ENTITY, QUADS, XSD
    from structgraph.operators import store as module

    monkeypatch.setattr(module, "BUCKET_QUADS", 40)

    def quads(n, o):
        return spark.range(n).selectExpr(f"concat('{ENTITY}f', id % 20, '.py#graph') g", f"concat('{ENTITY}f', id % 20, '.py#Function.', id) s", f"'{VOCAB}name' p", f"'{o}' o", "'lit' o_kind", f"'{XSD}string' o_dt", "cast(null as string) o_lang").select(QUADS.names)

    store = QuadStore(spark, str(tmp_path / "q"))
    assert store.read().count() == 0 and store.write(quads(200, "x").unionByName(quads(200, "x"))) >= 3 and store.read().count() == 200
    assert store.write(store.read()) == 0
    tag = spark.createDataFrame([(ANNOTATIONS, f"{ENTITY}f1.py#Function.1", VOCAB + "tag", "t", "lit", XSD + "string", None)], QUADS)
    before = {d for d, _, _ in os.walk(tmp_path / "q" / "data")}
    assert store.change([ANNOTATIONS], lambda q: q.unionByName(tag)) == 1 and store.read().count() == 201
    new = {d for d, _, _ in os.walk(tmp_path / "q" / "data")} - before
    assert [d.rsplit("/", 1)[-1] for d in sorted(new, key=len)][1:] == ["bucket=-1"]
    # one file of source is one bucket
    one = f"{ENTITY}f3.py#graph"
    assert store.change([one], lambda q: q.withColumn("o", q.o.substr(1, 0))) == 1 and store.read().where("o = ''").count() == 10
    assert store.write(store.read().where(f"g <> '{one}'")) == 1 and store.read().count() == 191
    for i in range(6):
        store.change([ANNOTATIONS], lambda q: q.limit(0) if i % 2 else tag)
    assert store.read().count() == 190 and len(store._versions()) == module.KEPT_VERSIONS
    dirs = sum(len([x for x in os.listdir(tmp_path / "q" / "data" / v) if x.startswith("bucket=")]) for v in os.listdir(tmp_path / "q" / "data"))
    assert dirs <= len(store._manifest()["at"]) + module.KEPT_VERSIONS
    store.clear()
    assert store.read().count() == 0


def test_watch_directory(spark, table, tmp_path):
    import os
    import time

    from structgraph.streaming.reindex import watch_directory

    root = tmp_path / "src"
    (root / "node_modules").mkdir(parents=True)

    def put(name, text, age=5):
        (root / name).write_text(text)
        os.utime(root / name, (time.time() - age, time.time() - age))

    put("a.py", "def f():\n    g()\n")
    put("b.py", "def g():\n    pass\n")
    put("node_modules/c.js", "function no() {}")
    put("notes.md", "no source")
    put("late.py", "def late():\n    pass\n", age=-60)
    store, seen = QuadStore(spark, str(tmp_path / "q")), []
    note = lambda df, i: seen.append(sorted((r.path, r.event_type) for r in df.collect()))
    known = watch_directory(spark, str(root), store, 0, 1, on_batch=note)
    assert seen == [[("a.py", "created"), ("b.py", "created")]] and edges(store.read(), table) == {("Function.f", "Function.g")}
    (root / "b.py").unlink()
    put("a.py", "def f():\n    pass\n", age=3)
    put("late.py", "def late():\n    f()\n", age=2)
    known = watch_directory(spark, str(root), store, 0, 2, known, on_batch=note)
    assert seen[1:] == [[("a.py", "modified"), ("b.py", "deleted"), ("late.py", "created")], []] and edges(store.read(), table) == {("Function.late", "Function.f")}
