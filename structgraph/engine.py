"""One object with every verb: index a tree, ask about it, annotate and edit it."""

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph import nl
from structgraph.model import ANNOTATIONS, QUADS, RESOLVED, VOCAB, XSD, CodeGraph
from structgraph.operators import analytics, annotate, encode, export, impact, infer, lookup, refactor, resolve, search, store, traverse, validate
from structgraph.plans import sparql
from structgraph.plans.lineage import cut, stored
from structgraph.session import ship_package
from structgraph.sources.files import EXTENSIONS, index_errors, index_stats, parse_files, read_tree
from structgraph.sources.git import git_diff
from structgraph.sources.parse import parse

_FILES = "path string, content string, op_id bigint, label string"


class Engine:
    """An index of a source tree in a directory (or in memory), with the verbs of the command line and the tool server.

    Query verbs return DataFrames; verbs that change something write a new version of the store and return what they did.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, complete: Callable[[str], str] | None = None) -> None:
        ship_package(spark)
        self.spark, self.path, self.complete = spark, path, complete
        self.store = store.QuadStore(spark, f"{path}/quads" if path else None)
        self._files = spark.createDataFrame([], _FILES)
        self._graph: CodeGraph | None = None

    # state
    @property
    def quads(self) -> DataFrame:
        return self.store.read()

    @property
    def graph(self) -> CodeGraph:
        if self._graph is None:
            self._graph = encode.graph_from_quads(self.quads)
        return self._graph

    @property
    def files(self) -> DataFrame:
        """Versions of all source files."""
        if not self.path:
            return self._files
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/files")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self._files
        return self.spark.read.schema(_FILES).parquet(f"{self.path}/files")

    def _save(self, quads: DataFrame) -> None:
        self.store.write(quads)
        self._graph = None

    def _save_files(self, files: DataFrame) -> None:
        if self.path:
            files.select("path", "content", "op_id", "label").join(self.files.select("path", "op_id"), ["path", "op_id"], "left_anti").select("path", "content", "op_id", "label").write.mode("append").parquet(f"{self.path}/files")
        else:
            self._files = cut(files.select("path", "content", "op_id", "label"))

    # indexing
    def index_codebase(self, root: str, extensions: tuple[str, ...] = EXTENSIONS, resolve_pass: bool = True) -> DataFrame:
        """Read, parse and encode a tree, replacing the graphs of its files; then resolve calls. Returns the statistics."""
        tree = read_tree(self.spark, root, extensions).select("path", "content").cache()
        parsed = parse_files(tree).cache()
        quads = encode.quads_of_parsed(parsed)
        self._save(store.replace_graphs(self.quads, quads))
        old = self.files
        self._save_files(old.unionByName(tree.select("path", "content", F.lit(0).cast("bigint").alias("op_id"), F.lit("index").alias("label"))).dropDuplicates(["path", "op_id"]))
        edges = self.resolve_calls() if resolve_pass else self.graph.resolved
        self.errors = index_errors(parsed)
        return index_stats(parsed, self.quads, edges)

    def resolve_calls(self) -> DataFrame:
        """Drop all resolved edges and compute them anew."""
        edges = resolve.resolve_calls(self.graph).select("caller", "callee").distinct()
        none = F.lit(None).cast("string")
        rows = edges.select(F.lit(RESOLVED).alias("g"), F.col("caller").alias("s"), F.lit(VOCAB + "resolvedCalls").alias("p"), F.col("callee").alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))
        self._save(store.load_quads(self.quads.where(F.col("p") != VOCAB + "resolvedCalls"), rows))
        return self.graph.resolved

    def reindex(self, path: str, content: str | None) -> None:
        """Replace the graph of one file; None drops it."""
        from structgraph.streaming.reindex import apply_changes

        row = self.spark.createDataFrame([(path, "deleted" if content is None else "modified", content)], "path string, event_type string, content string")
        self._save(apply_changes(self.quads, row))

    # lookup, traversal, search
    def list_files(self) -> DataFrame:
        return lookup.list_files(self.graph)

    def entities_in_file(self, path: str) -> DataFrame:
        return lookup.entities_in_file(self.graph, path)

    def resolve_entity(self, name: str) -> DataFrame:
        return lookup.resolve_entity(self.graph, name)

    def read_source(self, path: str, start: int = 1, end: int | None = None) -> DataFrame:
        return refactor.source_lines(self.files, path, start, end)

    def callers_of(self, name: str) -> DataFrame:
        return traverse.callers_of(self.graph, name)

    def callees_of(self, name: str) -> DataFrame:
        return traverse.callees_of(self.graph, name)

    def impact_of(self, name: str) -> DataFrame:
        return traverse.impact_of(self.graph, name)

    def context_around(self, name: str) -> DataFrame:
        return lookup.context_around(self.graph, name)

    def search(self, pattern: str, limit: int = 50) -> DataFrame:
        return search.search_by_name(self.graph, pattern, limit)

    def fuzzy_search(self, pattern: str, threshold: float = 0.5, limit: int = 20) -> DataFrame:
        return search.fuzzy_search(self.graph, pattern, threshold, limit)

    def sparql_query(self, text: str) -> DataFrame:
        return sparql.query(self.quads, text)

    def sparql_update(self, text: str) -> None:
        self._save(sparql.update(self.quads, text))

    def ask_question(self, question: str) -> DataFrame:
        """Answer of a question in words, by the completion function the engine was given."""
        if self.complete is None:
            raise ValueError("no completion function was given")
        got = nl.nl_to_sparql(question, self.complete)
        return self.spark.createDataFrame([(got["error"],)], "error string") if "error" in got else self.sparql_query(got["sparql"])

    def stats(self) -> DataFrame:
        return store.store_stats(self.quads)

    # annotations
    def _annotate(self, edit: Callable[[DataFrame], DataFrame]) -> None:
        """Edit the annotations; the rest of the store is neither read nor written."""
        self.store.change([ANNOTATIONS], edit)
        self._graph = None

    def _note(self, name: str, prop: str, value: str, add: bool) -> None:
        uri = annotate.entity_uri(self.graph, name)
        if add:
            self._annotate(lambda q: store.load_quads(q, self._quad(uri, prop, value, "lit")))
        else:
            self._annotate(lambda q: q.where(~((F.col("s") == uri) & (F.col("p") == VOCAB + prop) & (F.col("o") == value))))

    def _quad(self, s: str, prop: str, o: str, kind: str) -> DataFrame:
        return self.spark.createDataFrame([(ANNOTATIONS, s, VOCAB + prop, o, kind, XSD + "string" if kind == "lit" else None, None)], QUADS)

    def add_tag(self, name: str, tag: str) -> None:
        self._note(name, "tag", tag, True)

    def remove_tag(self, name: str, tag: str) -> None:
        self._note(name, "tag", tag, False)

    def add_note(self, name: str, note: str) -> None:
        self._note(name, "note", note, True)

    def remove_note(self, name: str, note: str) -> None:
        self._note(name, "note", note, False)

    def add_link(self, source: str, target: str, label: str = "") -> None:
        a, b = annotate.entity_uri(self.graph, source), annotate.entity_uri(self.graph, target)
        rows = self._quad(a, "linksTo", b, "iri")
        if label:
            rows = rows.unionByName(self._quad(a, "linkLabel", f"{label}->{b}", "lit"))
        self._annotate(lambda q: store.load_quads(q, rows))

    def remove_link(self, source: str, target: str) -> None:
        a, b = annotate.entity_uri(self.graph, source), annotate.entity_uri(self.graph, target)
        gone = (F.col("s") == a) & (((F.col("p") == VOCAB + "linksTo") & (F.col("o") == b)) | ((F.col("p") == VOCAB + "linkLabel") & F.col("o").endswith(f"->{b}")))
        self._annotate(lambda q: q.where(~gone))

    def annotations(self, name: str | None = None) -> DataFrame:
        if name is not None:
            return annotate.annotations_for(self.graph, name)
        g = self.graph
        return g.annotations.join(g.entities.select("uri", "name"), "uri").select("name", "kind", "value", "target").distinct().orderBy("name", "kind", "value")

    def clear_annotations(self) -> None:
        self._annotate(lambda q: q.limit(0))

    # editing
    def preview_rename(self, old: str, new: str) -> DataFrame:
        return refactor.preview_rename(self.graph, self.files, old, new)

    def _apply(self, files: DataFrame) -> DataFrame:
        """Keep new file versions and re-index the changed files; returns their paths."""
        before = self.files
        changed = files.join(before.select("path", "op_id"), ["path", "op_id"], "left_anti").select("path", "content")
        rows = stored(changed, "edited")  # before the versions it is compared with change
        self._save_files(files)
        from structgraph.streaming.reindex import apply_changes

        self._save(apply_changes(self.quads, rows.withColumn("event_type", F.lit("modified"))))
        return rows.select("path")

    def rename_symbol(self, old: str, new: str) -> DataFrame:
        return self._apply(refactor.rename_symbol(self.graph, self.files, old, new))

    def replace_entity(self, name: str, code: str) -> DataFrame:
        return self._apply(refactor.replace_entity(self.graph, self.files, name, code))

    def add_function_to_file(self, path: str, code: str, after_entity: str | None = None, at_line: int | None = None) -> DataFrame:
        return self._apply(refactor.add_function(self.graph, self.files, path, code, after_entity, at_line))

    def insert_code_at_line(self, path: str, line: int, code: str, position: str = "after") -> DataFrame:
        return self._apply(refactor.insert_code(self.files, path, line, code, position))

    def undo_last(self) -> DataFrame:
        """Take back the newest edit: a new version with the contents from before it, so that nothing is lost. Returns the paths."""
        done = self.files
        undone = done.where(F.col("label").startswith("undo ")).select(F.substring("label", 6, 20).cast("bigint").alias("op_id"))
        open_ = done.where((F.col("op_id") > 0) & ~F.coalesce("label", F.lit("")).startswith("undo ")).join(undone, "op_id", "left_anti")
        last = open_.agg(F.max("op_id")).first()[0]
        if last is None:
            return self.spark.createDataFrame([], "path string")
        paths = done.where(F.col("op_id") == last).select("path").distinct()
        back = refactor.current_files(done.where(F.col("op_id") < last)).join(paths, "path", "left_semi").select("path", "content")
        return self._apply(refactor.with_versions(done, back, f"undo {last}"))

    def undo_history(self) -> DataFrame:
        return refactor.undo_history(self.files)

    def checkout(self, root: str) -> int:
        """Write the current versions of edited files below ``root`` and return how many there are; a step on the driver, for work trees."""
        n = 0
        for row in refactor.current_files(self.files).where("op_id > 0").toLocalIterator():
            target = Path(root) / row["path"]
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(row["content"], encoding="utf-8")
            n += 1
        return n

    # analysis
    def dead_code(self, include_methods: bool = True) -> DataFrame:
        return analytics.dead_functions(self.graph, include_methods)

    def unused_imports(self) -> DataFrame:
        return analytics.unused_imports(self.graph)

    def function_metrics(self, limit: int = 50) -> DataFrame:
        return analytics.function_metrics(self.graph, limit)

    def class_metrics(self, limit: int = 50) -> DataFrame:
        return analytics.class_metrics(self.graph, limit)

    def refactoring_candidates(self, min_size: int = 30, min_fan_in: int = 3) -> DataFrame:
        return analytics.refactoring_candidates(self.graph, min_size, min_fan_in)

    def circular_dependencies(self) -> DataFrame:
        return analytics.circular_dependencies(self.graph)

    def git_impact(self, root: str, ref: str = "HEAD", base: str | None = None) -> DataFrame:
        hunks = impact.diff_hunks(git_diff(self.spark, root, ref, base)).select("file", "start", "count")
        return impact.impact_summary(self.graph, hunks)

    # exports, inference, validation
    def _text(self, edges: DataFrame, fmt: str, name: str) -> DataFrame:
        lines = export.dot_lines(edges, name) if fmt == "dot" else export.mermaid_lines(edges)
        return lines.orderBy("section", "line").select("line")

    def export_call_graph(self, root: str | None = None, depth: int = 3, fmt: str = "mermaid") -> DataFrame:
        edges = traverse.call_graph_from(self.graph, root, depth).select("src", "dst") if root else traverse.all_call_edges(self.graph)
        return self._text(edges, fmt, "calls")

    def export_inheritance_graph(self, fmt: str = "mermaid") -> DataFrame:
        return self._text(traverse.inheritance_edges(self.graph).select(F.col("base").alias("src"), F.col("cls").alias("dst")), fmt, "inheritance")

    def export_dependency_graph(self, fmt: str = "mermaid") -> DataFrame:
        return self._text(traverse.file_dependencies(self.graph), fmt, "dependencies")

    def infer(self) -> DataFrame:
        """Write the types that follow from the vocabulary to the inferred graph; what is stated already is not repeated."""
        base = self.quads.where(~F.col("g").endswith("_inferred#graph"))
        new = infer.infer_types(base)
        self._save(store.load_quads(base, new))
        return new

    def validate(self) -> DataFrame:
        return validate.violations(self.quads)

    def parse_text(self, path: str, text: str) -> dict:
        """Structure of one text, without indexing it."""
        return parse(path, text)


#: Tool verbs: name -> what it does. Each is a method of :class:`Engine` of that name.
VERBS = (
    "list_files", "entities_in_file", "resolve_entity", "read_source", "index_codebase", "callers_of", "callees_of", "impact_of", "context_around", "search", "fuzzy_search", "sparql_query", "ask_question",
    "stats", "add_tag", "remove_tag", "add_note", "remove_note", "add_link", "remove_link", "annotations", "preview_rename", "rename_symbol", "replace_entity", "add_function_to_file", "insert_code_at_line",
    "dead_code", "unused_imports", "function_metrics", "class_metrics", "refactoring_candidates", "circular_dependencies", "git_impact", "export_call_graph", "export_inheritance_graph",
    "export_dependency_graph", "undo_last", "undo_history",
)
