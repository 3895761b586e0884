"""Command line over the engine: ``python -m structgraph.cli --store DIR COMMAND ...``."""

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame

from structgraph.engine import Engine
from structgraph.nl import chat_client, repair_sparql
from structgraph.serve import serve_http, serve_streams, shown
from structgraph.session import get_session

#: Commands: name -> (verb, arguments). An argument that begins with ``--`` is an option, one with ``?`` may be left out.
COMMANDS = {
    "index": ("index_codebase", ["root"]), "stats": ("stats", []), "query": ("sparql_query", ["text"]), "update": ("sparql_update", ["text"]), "ask": ("ask_question", ["question"]), "callers-of": ("callers_of", ["name"]),
    "callees-of": ("callees_of", ["name"]), "impact-of": ("impact_of", ["name"]), "context": ("context_around", ["name"]), "search": ("search", ["pattern", "--limit:int"]),
    "fuzzy": ("fuzzy_search", ["pattern", "--threshold:float", "--limit:int"]), "tag": ("add_tag", ["name", "tag"]), "untag": ("remove_tag", ["name", "tag"]), "note": ("add_note", ["name", "note"]),
    "unnote": ("remove_note", ["name", "note"]), "link": ("add_link", ["source", "target", "--label"]), "unlink": ("remove_link", ["source", "target"]), "annotations": ("annotations", ["name?"]),
    "rename-preview": ("preview_rename", ["old", "new"]), "rename": ("rename_symbol", ["old", "new"]), "add-function": ("add_function_to_file", ["path", "code", "--after_entity", "--at_line:int"]),
    "replace-entity": ("replace_entity", ["name", "code"]), "insert-code": ("insert_code_at_line", ["path", "line:int", "code", "--position"]), "undo": ("undo_last", []), "undo-history": ("undo_history", []),
    "dead-code": ("dead_code", []), "unused-imports": ("unused_imports", []), "metrics": ("function_metrics", ["--limit:int"]), "class-metrics": ("class_metrics", ["--limit:int"]),
    "refactoring-candidates": ("refactoring_candidates", ["--min_size:int", "--min_fan_in:int"]), "circular-deps": ("circular_dependencies", []), "git-impact": ("git_impact", ["root", "--ref", "--base"]),
    "export-calls": ("export_call_graph", ["root?", "--depth:int", "--fmt"]), "export-inheritance": ("export_inheritance_graph", ["--fmt"]), "export-dependencies": ("export_dependency_graph", ["--fmt"]),
    "list-files": ("list_files", []), "entities": ("entities_in_file", ["path"]), "source": ("read_source", ["path", "--start:int", "--end:int"]), "resolve": ("resolve_entity", ["name"]),
    "infer": ("infer", []), "validate": ("validate", []), "checkout": ("checkout", ["root"]),
}
KINDS = {"int": int, "float": float}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="structgraph")
    top.add_argument("--store", default=".structgraph", help="directory of the index")
    top.add_argument("--master", default=None)
    top.add_argument("--model-url", default=None, help="chat-completions endpoint that answers questions")
    top.add_argument("--model", default="default")
    top.add_argument("--model-key-file", default=None, help="file with the key of the endpoint")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (_, args) in COMMANDS.items():
        p = sub.add_parser(name)
        for a in args:
            bare, _, kind = a.partition(":")
            opts = {"type": KINDS[kind]} if kind else {}
            if bare.startswith("--"):
                p.add_argument(bare, default=None, **opts)
            elif bare.endswith("?"):
                p.add_argument(bare[:-1], nargs="?", default=None)
            else:
                p.add_argument(bare, **opts)
    sub.add_parser("repl")
    w = sub.add_parser("watch")
    w.add_argument("events", help="directory into which file events are dropped as JSON")
    w.add_argument("--checkpoint", required=True)
    d = sub.add_parser("watch-dir")
    d.add_argument("root", help="directory whose files are kept indexed")
    d.add_argument("--interval", type=float, default=1.0)
    d.add_argument("--rounds", type=int, default=None)
    sub.add_parser("mcp-stdio")
    sub.add_parser("mcp-sse").add_argument("--port", type=int, default=8765)
    return top


def run(engine: Engine, argv: argparse.Namespace, out=sys.stdout) -> None:
    """One command on an engine; the result is written as JSON, graphs as their text."""
    if argv.command == "repl":
        for line in sys.stdin:
            if line.strip() in ("exit", "quit"):
                break
            if line.strip():
                try:
                    out.write(shown(engine.sparql_query(repair_sparql(line))) + "\n")
                except Exception as x:
                    out.write(f"{type(x).__name__}: {x}\n")
        return
    if argv.command == "mcp-stdio":
        serve_streams(engine)
        return
    if argv.command == "mcp-sse":
        serve_http(engine, argv.port).serve_forever()
        return
    if argv.command == "watch":
        from structgraph.streaming.reindex import file_events, watch

        watch(engine.spark, file_events(engine.spark, argv.events), engine.store, argv.checkpoint).awaitTermination()
        return
    if argv.command == "watch-dir":
        from structgraph.streaming.reindex import watch_directory

        watch_directory(engine.spark, argv.root, engine.store, argv.interval, argv.rounds)
        return
    verb, args = COMMANDS[argv.command]
    names = [a.partition(":")[0].strip("-?") for a in args]
    result = getattr(engine, verb)(**{n: getattr(argv, n) for n in names if getattr(argv, n) is not None})
    if isinstance(result, DataFrame) and argv.command.startswith("export-"):
        for r in result.toLocalIterator():
            out.write(r["line"] + "\n")
    else:
        out.write(shown(result) + "\n")


def client(args: argparse.Namespace):
    """The completion function that the arguments name, if any."""
    if not args.model_url:
        return None
    key = Path(args.model_key_file).read_text(encoding="utf-8").strip() if args.model_key_file else None
    return chat_client(args.model_url, args.model, key)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = get_session(master=args.master)
    spark.sparkContext.setLogLevel("ERROR")
    try:
        run(Engine(spark, args.store, client(args)), args)
    except ValueError as x:
        print(x, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
