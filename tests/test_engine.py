"""The whole way from files to answers, with the facts that follow by hand."""

import io
import json
import subprocess

import pytest

from structgraph import nl
from structgraph.cli import parser, run
from structgraph.engine import VERBS, Engine
from structgraph.operators import export, lookup, refactor
from structgraph.operators.impact import changed_entities, diff_hunks
from structgraph.serve import answer, tools
from tests.samples import PROJECT


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for p, t in PROJECT.items():
        f = root / p.split("/")[-1]
        f.write_text(t)
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.js").write_text("function no() {}")
    (root / "notes.md").write_text("no source")
    return root


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store") / "index"))
    e.first = e.index_codebase(str(tree)).first()
    return e


def test_index(engine, table):
    assert (engine.first.files_indexed, engine.first.files_failed, engine.first.resolved_calls) == (3, 0, 6)
    assert [r.path for r in engine.list_files().collect()] == ["app.py", "config.py", "models.py"]
    s = engine.stats().first()
    assert (s.modules, s.classes, s.functions, s.methods) == (3, 3, 6, 4)


def test_queries(engine, table):
    assert {r.caller_name for r in engine.impact_of("load").collect()} == {"create", "main"}
    assert {r.caller_name for r in engine.callers_of("step").collect()} == {"serve"}
    assert ("print", "print") in table(engine.callees_of("serve"), "callee", "callee_name")
    assert {r.name for r in engine.dead_code().collect()} == {"validate", "size", "wrap"}
    assert {r.name for r in engine.unused_imports().collect()} == {"os", "dataclasses.dataclass"}
    assert [r.name for r in engine.entities_in_file("config").collect()] == ["LIMIT", "PLACE", "load", "check"]
    assert table(lookup.class_hierarchy(engine.graph, "Cart")) == [("Cart", "Base"), ("Gift", "Cart")]
    assert engine.resolve_entity("app:create").count() == 1 and engine.resolve_entity("config:create").count() == 0
    assert engine.circular_dependencies().count() == 0
    assert {(r.section, r.related) for r in engine.context_around("create").collect()} >= {("docstring", "Build the shop."), ("container", "app.py"), ("caller", "main"), ("callee", "load")}
    assert engine.function_metrics().first().name == "create"
    assert {r.name: r.method_count for r in engine.class_metrics().collect()} == {"Base": 1, "Cart": 1, "Gift": 2}


def test_search(engine):
    assert [r.name for r in engine.search("LOA").collect()] == ["load"]
    best = engine.fuzzy_search("chekc").first()
    assert best.name == "check" and 0.5 < best.score < 1
    assert engine.fuzzy_search("load").first().score > 1


def test_sparql_agrees_with_operators(engine, table):
    got = table(engine.sparql_query('SELECT DISTINCT ?n WHERE { ?c code:resolvedCalls+ ?t . ?t code:name ?x . FILTER(CONTAINS(?x, "load")) ?c code:name ?n }'))
    assert got == [("create",), ("main",)]
    assert engine.sparql_query("ASK { ?x a code:Import }").first().ask is False


def test_shapes_and_inference(engine, table):
    assert table(engine.validate(), "shape", "path") == [("ResolvedCallsShape", "resolvedCalls")]
    assert engine.infer().count() > 0
    # the class that is called is now also typed as a function, so the shape holds
    assert engine.validate().count() == 0 and engine.infer().count() > 0


def test_annotations(engine, table):
    engine.add_tag("create", "entry")
    engine.add_tag("create", "entry")
    engine.add_note("create", "line one\nline two")
    engine.add_link("create", "load", "uses")
    assert table(engine.annotations("create"), "tags", "notes") == [(["entry"], ["line one\nline two"])]
    engine.reindex("app.py", PROJECT["shop/app.py"])
    assert engine.annotations("create").first().tags == ["entry"]
    engine.remove_tag("create", "entry")
    engine.remove_link("create", "load")
    engine.remove_note("create", "absent")
    row = engine.annotations("create").first()
    assert (row.tags, row.links, len(row.notes)) == ([], [], 1)
    engine.clear_annotations()
    assert engine.annotations().count() == 0
    with pytest.raises(ValueError, match="no entity named 'creat'. Did you mean"):
        engine.add_tag("creat", "x")


def test_rename_edit_and_undo(engine, table):
    shown = {r.path: r for r in engine.preview_rename("load", "read").collect()}
    assert set(shown) == {"app.py", "config.py"} and "-def load(path):" in shown["config.py"].diff and "+def read(path):" in shown["config.py"].diff
    assert table(engine.rename_symbol("load", "read")) == [("app.py",), ("config.py",)]
    assert engine.resolve_entity("load").count() == 0 and engine.resolve_entity("read").count() == 1
    engine.insert_code_at_line("config.py", 1, "# new")
    assert [r.text for r in engine.read_source("config.py", 1, 2).collect()] == ['"""Settings."""', "# new"]
    engine.add_function_to_file("config.py", "def extra():\n    return 1", after_entity="check")
    assert engine.resolve_entity("extra").count() == 1
    engine.replace_entity("extra", "def other():\n    return 2")
    assert engine.resolve_entity("extra").count() == 0 and engine.resolve_entity("other").count() == 1
    for _ in range(4):
        assert engine.undo_last().count() > 0
    assert engine.undo_last().count() == 0
    assert engine.resolve_entity("load").count() == 1 and engine.resolve_entity("other").count() == 0
    last = {r.path: r.content for r in refactor.current_files(engine.files).collect()}
    assert last["config.py"] == PROJECT["shop/config.py"]


def test_rename_leaves_texts_and_other_names(engine):
    text, n = refactor.renamed('def load():\n    """load"""\n    reload(load, "load")  # load\n    return f"{load}"\n', "x.py", "load", "get")
    assert n == 3 and text == 'def get():\n    """load"""\n    reload(get, "load")  # load\n    return f"{get}"\n'
    assert refactor.renamed("const load = `a ${load} load`; // load\n", "x.js", "load", "go") == ("const go = `a ${go} load`; // load\n", 2)
    assert refactor.renamed(None, "x.js", "a", "b") == (None, 0)


DIFF = """diff --git a/app.py b/app.py
--- a/app.py
+++ b/app.py
@@ -7,2 +8,3 @@ def create(path):
+x
@@ -30 +22 @@
+y
--- a/gone.py
+++ /dev/null
@@ -1,9 +0,0 @@
--- a/config.py
+++ b/config.py
@@ -1 +1,0 @@
"""


def test_diff_impact(engine, spark, table):
    hunks = diff_hunks(spark.createDataFrame([("d", DIFF), ("e", ""), ("n", None)], "diff_id string, text string"))
    assert table(hunks) == [("d", "app.py", 22, 1), ("d", "app.py", 8, 3), ("d", "config.py", 1, 0)]
    assert table(changed_entities(engine.graph, hunks), "name") == [("create",), ("step",)]


def test_git(spark, tree, engine):
    git = lambda *a: subprocess.run(["git", "-c", "user.email=a@b.invalid", "-c", "user.name=n", "-C", str(tree), *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "x")
    assert "0 file(s)" in engine.git_impact(str(tree)).first().summary
    (tree / "config.py").write_text(PROJECT["shop/config.py"].replace("return text", "return text or 1"))
    row = engine.git_impact(str(tree)).first()
    assert (row.changed_files, row.changed_entities) == (1, 1) and row.impacted_callers >= 2


def test_exports(engine):
    text = export.text_of(export.mermaid_lines(engine.sparql_query("SELECT ?src ?dst WHERE { ?c code:inheritsFrom ?src ; code:name ?dst }")))
    assert text.splitlines()[0] == "graph TD" and '    Cart["Cart"] --> Gift["Gift"]' in text
    lines = [r.line for r in engine.export_dependency_graph("dot").collect()]
    assert lines[0].startswith("digraph") and lines[-1] == "}" and '    "app.py" -> "config.py";' in lines


def test_tools_and_commands(engine):
    assert len(VERBS) == 38 and {t["name"] for t in tools()} == set(VERBS)
    reply = answer(engine, {"id": 1, "method": "tools/call", "params": {"name": "callers_of", "arguments": {"name": "step"}}})
    assert "serve" in reply["result"]["content"][0]["text"]
    assert answer(engine, {"id": 2, "method": "tools/call", "params": {"name": "nothing"}})["result"]["isError"]
    assert answer(engine, {"method": "notifications/initialized"}) is None
    out = io.StringIO()
    run(engine, parser().parse_args(["search", "load", "--limit", "5"]), out)
    assert json.loads(out.getvalue())[0]["name"] == "load"
    out = io.StringIO()
    run(engine, parser().parse_args(["export-inheritance"]), out)
    assert out.getvalue().startswith("graph TD")


def test_questions(engine):
    q = nl.extract_sparql("Sure:\n```sparql\nPREFIX code: <http://wrong#>\nPREFIX code: <http://twice#>\nSELECT ?n WHERE { ?x rdf:type code:Class ; code:name ?n }\n```")
    assert q.count("PREFIX code:") == 1 and "wrong" not in q and "PREFIX rdf:" in q
    engine.complete = lambda prompt: "The query is\nSELECT ?n WHERE { ?x a code:Class ; code:name ?n }"
    assert {r.n for r in engine.ask_question("which classes?").collect()} == {"Base", "Cart", "Gift"}

    def fail(prompt):
        raise OSError("down")

    engine.complete = fail
    assert engine.ask_question("x").first().error == "OSError: down"


def test_questions_over_a_chat_endpoint(engine):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from structgraph.cli import client

    asked = []

    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = json.dumps({"choices": [{"message": {"content": "```sparql\nSELECT ?n WHERE { ?x a code:Class ; code:name ?n }\n```"}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    args = parser().parse_args(["--model-url", f"http://127.0.0.1:{server.server_port}/v1/chat/completions", "--model", "m", "ask", "which classes?"])
    engine.complete = client(args)
    out = io.StringIO()
    run(engine, args, out)
    server.shutdown()
    assert {r["n"] for r in json.loads(out.getvalue())} == {"Base", "Cart", "Gift"}
    assert asked[0][0] is None and asked[0][1]["temperature"] == 0 and "which classes?" in asked[0][1]["messages"][0]["content"]
    assert client(parser().parse_args(["stats"])) is None


def test_session_of_server_sent_events(engine):
    import http.client
    import threading

    from structgraph.serve import serve_http

    server = serve_http(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    stream = http.client.HTTPConnection("127.0.0.1", server.server_port, timeout=60)
    stream.request("GET", "/sse")
    events = stream.getresponse()
    assert events.readline() == b"event: endpoint\n"
    address = events.readline().decode().removeprefix("data: ").strip()
    post = http.client.HTTPConnection("127.0.0.1", server.server_port, timeout=60)
    for rid in (1, 2):
        post.request("POST", address, json.dumps({"id": rid, "method": "tools/list"}))
        reply = post.getresponse()
        assert (reply.status, reply.read()) == (202, b"")
        assert events.readline() == b"\n" and events.readline() == b"event: message\n"
        assert json.loads(events.readline().decode().removeprefix("data: "))["id"] == rid
    post.request("POST", "/", json.dumps({"id": 3, "method": "ping"}))
    assert json.loads(post.getresponse().read())["result"] == {}
    server.shutdown()
