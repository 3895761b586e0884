"""Queries of the code-graph operators over the indexed tables, with their SQL."""

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.catalog.general import _STRIP
from structgraph.model import ENTITY, RDF_TYPE, RESOLVED, VOCAB, XSD, CodeGraph, graph_from_tables, quads_of
from structgraph.operators import analytics, annotate, export, impact, infer, lookup, refactor, resolve, search, store, traverse, validate
from structgraph.sources.tables import table

#: Arguments of the queries below, fixed so that Spark and SQL ask the same.
NAME, PART, FILE, CLASS, PACKAGE = "render_beacon", "schedule_", "hasago", "SettingsBase", "logging"
EDITED = "plinth/zasata"


def graph(spark: SparkSession, root: str) -> CodeGraph:
    return graph_from_tables(*(table(spark, root, n) for n in ("modules", "entities", "calls", "imports", "inherits", "decorators")))


def hunks(spark: SparkSession, root: str) -> DataFrame:
    """Diff hunks for the impact queries: the places where one package is imported."""
    i, m = table(spark, root, "imports").where(F.col("from_module") == PACKAGE), table(spark, root, "modules")
    where = m.select(F.col("uri").alias("module"), F.col("path").alias("file")).distinct()
    return i.join(where, "module").select("file", (F.col("start_line") + F.col("import_id") % 40).alias("start"), (F.col("import_id") % 5).alias("count")).distinct()


def diff_texts(spark: SparkSession, root: str) -> DataFrame:
    """One unified diff per repo made of :func:`hunks`, to be parsed back."""
    h = hunks(spark, root)
    size = F.when(F.col("count") == 1, "").otherwise(F.concat(F.lit(","), F.col("count")))
    text = F.concat(F.lit("--- a/"), "file", F.lit("\n+++ b/"), "file", F.lit("\n@@ -1 +"), "start", size, F.lit(" @@\n+x\n"))
    return h.select(F.regexp_extract("file", "^([^/]+/[^/]+)/", 1).alias("diff_id"), text.alias("t")).groupBy("diff_id").agg(F.array_join(F.sort_array(F.collect_list("t")), "").alias("text"))


def _files(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "files").select("path", "content", "op_id", F.lit(None).cast("string").alias("label"))


def by_stem(g: CodeGraph) -> CodeGraph:
    """The graph with every import named by the last part of its path, as files name each other within a directory."""
    last = F.regexp_extract(F.regexp_replace("name", r"\.(js|ts|h)$", ""), r"([^./]+)$", 1)
    return replace(g, imports=g.imports.select("repo", "module", last.alias("name")).where("name <> ''").distinct())


def both_ways(g: CodeGraph) -> CodeGraph:
    """:func:`by_stem` with an import back for every dependency between files, so that there are circles."""
    g = by_stem(g)
    m = g.modules.select("repo", F.col("uri").alias("module"), F.col("path").alias("dst"))
    back = traverse.file_dependencies(g).join(m, "dst").select("repo", "module", traverse.stem(F.col("src")).alias("name"))
    return replace(g, imports=g.imports.unionByName(back).distinct())


def _first(g: CodeGraph, kind: str):
    """The least annotation of a kind, to be removed or built on."""
    return g.annotations.where(F.col("kind") == kind).orderBy("uri", "value", "target").select("uri", "value", "target").first()


def _edited(spark: SparkSession, root: str, edit) -> DataFrame:
    """Lines of the longest-named current Python file after an edit."""
    files = _files(spark, root)
    path = refactor.current_files(files).where("path LIKE '%.py' AND content LIKE '%\n%\n%\n%\n%'").agg(F.max(F.struct(F.length("path").alias("n"), "path"))).first()[0]["path"]
    return refactor.source_lines(edit(files, path), path).select("line_no", "text")


_Q = {
    "resolve_entity": lambda g: lookup.resolve_entity(g, NAME),
    "resolve_entity_qualified": lambda g: lookup.resolve_entity(g, f"{EDITED}:{CLASS}"),
    "list_files": lookup.list_files,
    "entities_in_file": lambda g: lookup.entities_in_file(g, FILE),
    "functions_in": lambda g: lookup.functions_in(g, "plinth/zasata/temago/shard_lattice.py"),
    "all_classes": lookup.all_classes,
    "all_functions": lookup.all_functions,
    "class_hierarchy": lambda g: lookup.class_hierarchy(g, CLASS),
    "context_around": lambda g: lookup.context_around(g, NAME),
    "callers_of": lambda g: traverse.callers_of(g, PART),
    "callees_of": lambda g: traverse.callees_of(g, NAME),
    "impact_of": lambda g: traverse.impact_of(g, PART),
    "call_graph_bfs": lambda g: traverse.call_graph_from(g, NAME, 3),
    "all_call_edges": traverse.all_call_edges,
    "inheritance_edges": traverse.inheritance_edges,
    "file_dependencies": lambda g: traverse.file_dependencies(by_stem(g)),
    "symbol_table": resolve.symbol_table,
    "resolve_calls": resolve.resolve_calls,
    "search_by_name": lambda g: search.search_by_name(g, "Beacon"),
    "fuzzy_search": lambda g: search.fuzzy_search(g, "rendr_becon"),
    "suggest_on_miss": lambda g: search.suggest(g, "rendr_becon"),
    "dead_functions": analytics.dead_functions,
    "unused_imports": analytics.unused_imports,
    "function_metrics": analytics.function_metrics,
    "class_metrics": analytics.class_metrics,
    "refactoring_candidates": analytics.refactoring_candidates,
    "circular_dependencies": lambda g: analytics.circular_dependencies(both_ways(g)),
    "list_tags": lambda g: annotate.list_values(g, "tag"),
    "list_notes": lambda g: annotate.list_values(g, "note"),
    "list_links": annotate.list_links,
    "list_links_of": lambda g: annotate.list_links(g, CLASS),
    "add_tag": lambda g: annotate.add_tag(g.annotations, _first(g, "tag")["uri"], "reviewed").select("uri", "kind", "value", "target"),
    "add_note": lambda g: annotate.add_note(g.annotations, _first(g, "tag")["uri"], "see above").select("uri", "kind", "value", "target"),
    "add_link": lambda g: annotate.add_link(g.annotations, _first(g, "tag")["uri"], _first(g, "link")["target"], "uses").select("uri", "kind", "value", "target"),
    "remove_tag": lambda g: (lambda r: annotate.remove_value(g.annotations, "tag", r["uri"], r["value"]))(_first(g, "tag")).select("uri", "kind", "value", "target"),
    "remove_note": lambda g: (lambda r: annotate.remove_value(g.annotations, "note", r["uri"], r["value"]))(_first(g, "note")).select("uri", "kind", "value", "target"),
    "remove_link": lambda g: (lambda r: annotate.remove_link(g.annotations, r["uri"], r["target"]))(_first(g, "link")).select("uri", "kind", "value", "target"),
    "annotations_for": lambda g: annotate.annotations_for(g, CLASS).select("uri", *[F.array_join(c, ",").alias(c) for c in ("tags", "notes", "links")]),
    "rename_affected_files": lambda g: refactor.affected_files(g, NAME),
    "find_entity": lambda g: refactor.find_entity(g, NAME),
    "quads": quads_of,
    "store_stats": lambda g: store.store_stats(quads_of(g)),
    "union_graph": lambda g: store.union_graph(quads_of(g)),
    "clear_graph": lambda g: store.clear_graph(quads_of(g), RESOLVED).select("g", "s", "p", "o"),
    "infer_types": lambda g: infer.infer_types(quads_of(g)).select("s", "o"),
    "shacl_violations": lambda g: validate.violations(quads_of(g)).select("shape", "focus", "path"),
    "export_mermaid": lambda g: export.mermaid_lines(traverse.inheritance_edges(g).select(F.col("base").alias("src"), F.col("cls").alias("dst"))),
    "export_dot": lambda g: export.dot_lines(traverse.file_dependencies(by_stem(g))),
    "export_json": lambda g: export.json_rows(lookup.all_classes(g)),
}


def _over_graph(f):
    return lambda spark, root: f(graph(spark, root))


QUERIES = {k: _over_graph(f) for k, f in _Q.items()}
QUERIES |= {
    "diff_hunks": lambda s, d: impact.diff_hunks(diff_texts(s, d)),
    "changed_entities": lambda s, d: impact.changed_entities(graph(s, d), hunks(s, d)),
    "diff_impact": lambda s, d: impact.diff_impact(graph(s, d), hunks(s, d)),
    "impact_summary": lambda s, d: impact.impact_summary(graph(s, d), hunks(s, d)),
    "current_files": lambda s, d: refactor.current_files(_files(s, d)).select("path", "op_id"),
    "undo_last": lambda s, d: refactor.current_files(refactor.undo_last(_files(s, d))).select("path", "op_id"),
    "undo_history": lambda s, d: refactor.undo_history(_files(s, d)).select("op_id", "files"),
    "source_lines": lambda s, d: refactor.file_lines(_files(s, d)),
    "insert_code": lambda s, d: _edited(s, d, lambda f, p: refactor.insert_code(f, p, 3, "# one\n# two")),
    "replace_lines": lambda s, d: _edited(s, d, lambda f, p: refactor.replace_lines(f, p, 2, 4, "# one")),
}

V = f"""
mods AS (SELECT DISTINCT repo, uri, path FROM modules WHERE deleted_at IS NULL AND uri IS NOT NULL),
ents AS (
  SELECT regexp_extract(file, '^([^/]+/[^/]+)/', 1) AS repo, * FROM (
    SELECT uri, arg_max(kind, indexed_at) AS kind, arg_max(name, indexed_at) AS name, arg_max(file, indexed_at) AS file, arg_max(start_line, indexed_at) AS start_line,
           arg_max({{end_line: end_line}}, indexed_at).end_line AS end_line, arg_max({{d: docstring}}, indexed_at).d AS docstring FROM entities WHERE deleted_at IS NULL GROUP BY uri)),
defs AS (SELECT CASE WHEN kind = 'Method' THEN regexp_replace(uri, '#Method[.](.*)[.][^.]*$', '#Class.\\1') ELSE regexp_replace(uri, '#.*$', '') END AS parent, uri AS child FROM ents),
cal AS (SELECT DISTINCT repo, caller, {_STRIP('target')} AS target FROM calls WHERE {_STRIP('target')} <> '' AND caller IS NOT NULL),
res AS (SELECT DISTINCT caller, replace({_STRIP('callee')}, chr(92), '/') AS callee FROM calls WHERE {_STRIP('callee')} <> '' AND caller IS NOT NULL),
imp AS (SELECT DISTINCT repo, module, CASE WHEN {_STRIP('imported')} <> '' THEN {_STRIP('from_module')} || '.' || {_STRIP('imported')} ELSE {_STRIP('from_module')} END AS name FROM imports WHERE module IS NOT NULL),
inh AS (SELECT DISTINCT repo, cls, {_STRIP('base')} AS base FROM inherits WHERE {_STRIP('base')} <> '' AND cls IS NOT NULL),
deco AS (SELECT DISTINCT uri, {_STRIP(f"regexp_replace({_STRIP('decorator')}, '^@+', '')")} AS decorator FROM decorators WHERE {_STRIP(f"regexp_replace({_STRIP('decorator')}, '^@+', '')")} <> ''),
link AS (SELECT i.cls AS uri, i.base AS value, e.uri AS target FROM inh i JOIN ents e ON e.kind = 'Class' AND e.repo = i.repo AND e.name = i.base),
note AS (SELECT uri, {_STRIP('docstring')} AS value FROM ents WHERE kind = 'Class' AND {_STRIP('docstring')} <> ''),
own AS (SELECT d.child AS uri, m.path FROM defs d JOIN mods m ON m.uri = d.parent),
hunk AS (SELECT DISTINCT m.path AS file, i.start_line + i.import_id % 40 AS start, i.import_id % 5 AS cnt FROM imports i JOIN (SELECT DISTINCT uri, path FROM modules) m ON m.uri = i.module WHERE i.from_module = '{PACKAGE}')
"""
_ROW = "uri, name, kind, file, start_line, end_line"
#: Fields of a row as JSON; a null one is left out.
_FIELDS = ", ".join(f"""'"{c}":' || CASE WHEN {c} IS NOT NULL THEN CAST(to_json({c}) AS VARCHAR) END""" for c in _ROW.split(", "))
_POU = lambda c: f"regexp_replace(regexp_replace({c}, '^[a-z]+://[^/]+/entity/', ''), '#.*$', '')"
_STEM = lambda c: f"regexp_replace(regexp_replace({c}, '^.*/', ''), '[.][^.]*$', '')"

_NAME_EDGES = """ne AS (
  SELECT c.repo, c.name AS src, e.name AS dst FROM res r JOIN ents c ON c.uri = r.caller JOIN ents e ON e.uri = r.callee
  UNION SELECT l.repo, c.name, l.target FROM cal l JOIN ents c ON c.uri = l.caller AND c.kind IN ('Function', 'Method'))"""
_INH_EDGES = """ie AS (SELECT DISTINCT i.base, e.name AS cls FROM inh i JOIN ents e ON e.uri = i.cls AND e.kind = 'Class'),
iall AS (SELECT base, cls FROM ie UNION ALL SELECT DISTINCT NULL, name FROM ents WHERE kind = 'Class' AND name NOT IN (SELECT base FROM ie) AND name NOT IN (SELECT cls FROM ie))"""
_STEMS = f"""ims AS (SELECT DISTINCT repo, module, regexp_extract(regexp_replace(name, '[.](js|ts|h)$', ''), '([^./]+)$', 1) AS name FROM imp WHERE regexp_extract(regexp_replace(name, '[.](js|ts|h)$', ''), '([^./]+)$', 1) <> '')"""
_FILE_DEPS = f"""{_STEMS}, fd AS (
  SELECT DISTINCT m.path AS src, t.path AS dst FROM ims i JOIN mods m ON m.uri = i.module
  JOIN (SELECT repo, {_STEM('path')} AS stem, max(path) AS path FROM mods GROUP BY 1, 2) t ON t.repo = i.repo AND t.stem = string_split(i.name, '.')[1] WHERE m.path <> t.path)"""
_RESOLVE = """sym AS (SELECT e.repo, e.name, e.uri, o.path, count(*) OVER (PARTITION BY e.repo, e.name) AS n FROM ents e JOIN own o USING (uri) WHERE e.kind IN ('Function', 'Method', 'Class')),
rc AS (
  SELECT DISTINCT c.repo, c.caller, c.target, o.path AS caller_path,
         CASE WHEN regexp_matches(c.target, '^(self|this)[.]') THEN 'own' WHEN contains(c.target, '.') THEN 'dotted' ELSE 'plain' END AS form
  FROM cal c JOIN own o ON o.uri = c.caller),
rn AS (SELECT *, CASE form WHEN 'own' THEN regexp_replace(target, '^[^.]*[.]', '') WHEN 'dotted' THEN string_split(target, '.')[-1] ELSE target END AS name FROM rc),
hint AS (
  SELECT m.path AS caller_path, string_split(i.name, '.')[-1] AS name, min(i.name) AS t FROM imp i JOIN mods m ON m.uri = i.module GROUP BY 1, 2),
inclass AS (SELECT d.child AS caller, e.name AS class_name FROM defs d JOIN ents e ON e.uri = d.parent AND e.kind = 'Class'),
ranked AS (
  SELECT r.caller, r.target, s.uri,
         CASE WHEN form = 'own' THEN CASE WHEN contains(s.uri, k.class_name) THEN 1 END WHEN s.n = 1 THEN 1 WHEN form = 'dotted' THEN NULL
              WHEN contains(h.t, '.') AND contains(regexp_replace(s.path, '[.][^.]*$', ''), regexp_replace(h.t, '[.][^.]*$', '')) THEN 2
              WHEN s.path = r.caller_path THEN 3 END AS rank
  FROM rn r JOIN sym s ON s.repo = r.repo AND s.name = r.name LEFT JOIN hint h ON h.caller_path = r.caller_path AND h.name = r.name LEFT JOIN inclass k ON k.caller = r.caller),
resolved AS (SELECT caller, target, arg_min(uri, (rank, uri)) AS callee FROM ranked WHERE rank IS NOT NULL GROUP BY 1, 2)"""
_METRICS = """fo AS (SELECT c.repo, e.name, count(DISTINCT c.target) AS fan_out FROM cal c JOIN ents e ON e.uri = c.caller AND e.kind IN ('Function', 'Method') GROUP BY 1, 2),
fi AS (SELECT repo, target AS name, count(DISTINCT caller) AS fan_in FROM cal GROUP BY 1, 2),
fm AS (SELECT e.uri, e.name, e.kind, e.start_line, e.end_line, e.end_line - e.start_line + 1 AS size, coalesce(fi.fan_in, 0) AS fan_in, coalesce(fo.fan_out, 0) AS fan_out
  FROM ents e LEFT JOIN fi ON fi.repo = e.repo AND fi.name = e.name LEFT JOIN fo ON fo.repo = e.repo AND fo.name = e.name
  WHERE e.kind IN ('Function', 'Method') AND e.start_line IS NOT NULL AND e.end_line IS NOT NULL)"""
_CHANGED = """ch AS (SELECT DISTINCT e.uri, e.name, e.kind, e.file, e.repo FROM ents e JOIN own o ON o.uri = e.uri JOIN hunk h ON h.file = e.file
  AND e.start_line <= h.start + h.cnt - 1 AND coalesce(e.end_line, e.start_line) >= h.start WHERE e.start_line IS NOT NULL),
di AS (
  SELECT e.uri AS node FROM ents e WHERE EXISTS (SELECT 1 FROM ch WHERE ch.repo = e.repo AND contains(e.name, ch.name))),
up AS (SELECT r.caller AS node FROM res r JOIN di ON di.node = r.callee UNION SELECT r.caller FROM res r JOIN up ON up.node = r.callee),
who AS (SELECT node AS caller FROM up UNION SELECT c.caller FROM cal c WHERE EXISTS (SELECT 1 FROM ch WHERE ch.repo = c.repo AND contains(c.target, ch.name))),
dim AS (SELECT e.name AS caller_name, min(w.caller) AS caller FROM who w JOIN ents e ON e.uri = w.caller GROUP BY 1)"""
_ESC = lambda c: "replace(" * 11 + f"replace({c}, chr(92), '/')" + "".join(f", '{a}', '%{ord(a):02X}')" for a in '%<>"{}|^` #')
_GRAPH = lambda path: f"'{ENTITY}' || {_ESC(path)} || '#graph'"


def _quad(source: str, g: str, s: str, p: str, o: str, kind: str = "lit", dt: str = "string") -> str:
    iri = RDF_TYPE if p == "type" else VOCAB + p
    return f"SELECT {g} AS g, {s} AS s, '{iri}' AS p, CAST({o} AS VARCHAR) AS o, '{kind}' AS o_kind, {f'{chr(39)}{XSD + dt}{chr(39)}' if kind == 'lit' else 'NULL'} AS o_dt, CAST(NULL AS VARCHAR) AS o_lang FROM {source} WHERE {o} IS NOT NULL"


_own = lambda u: _GRAPH(_POU(u))
_QUADS = "q AS (" + " UNION ".join([
    _quad("mods", _GRAPH("path"), "uri", "type", f"'{VOCAB}Module'", "iri"), _quad("mods", _GRAPH("path"), "uri", "name", "path"), _quad("mods", _GRAPH("path"), "uri", "filePath", "path"),
    _quad("ents", _own("uri"), "uri", "type", f"'{VOCAB}' || kind", "iri"), _quad("ents", _own("uri"), "uri", "name", "name"), _quad("ents", _own("uri"), "uri", "startLine", "start_line", dt="integer"),
    _quad("ents", _own("uri"), "uri", "endLine", "end_line", dt="integer"), _quad("ents", _own("uri"), "uri", "docstring", "nullif(docstring, '')"),
    _quad("defs", _own("child"), "parent", "defines", "child", "iri"), _quad("cal", _own("caller"), "caller", "calls", "target"), _quad("imp", _own("module"), "module", "imports", "name"),
    _quad("inh", _own("cls"), "cls", "inheritsFrom", "base"), _quad("deco", _own("uri"), "uri", "hasDecorator", "decorator"), _quad("res", f"'{RESOLVED}'", "caller", "resolvedCalls", "callee", "iri"),
    _quad("deco", f"'{ENTITY}_annotations#graph'", "uri", "tag", "decorator"), _quad("note", f"'{ENTITY}_annotations#graph'", "uri", "note", "value"),
    _quad("link", f"'{ENTITY}_annotations#graph'", "uri", "linksTo", "target", "iri"), _quad("link", f"'{ENTITY}_annotations#graph'", "uri", "linkLabel", "value || '->' || target"),
]) + ")"
_KIND = lambda k: f"s IN (SELECT s FROM q WHERE p = '{RDF_TYPE}' AND o IN ({', '.join(chr(39) + VOCAB + x + chr(39) for x in k)}))"
_REQUIRED_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT '{k}Shape' AS shape, s AS focus, '{p}' AS path FROM q WHERE p = '{RDF_TYPE}' AND o = '{VOCAB}{k}' AND s NOT IN (SELECT s FROM q WHERE p = '{VOCAB}{p}')"
    f" UNION ALL SELECT DISTINCT '{k}Shape', s, '{p}' FROM q WHERE p = '{VOCAB}{p}' AND coalesce(o_dt, '') <> '{XSD}{dt}' AND {_KIND([k])}"
    for k, props in validate.REQUIRED
    for p, dt in props
)
_SHACL = (
    f"SELECT * FROM ({_REQUIRED_SQL}"
    + "".join(f" UNION ALL SELECT DISTINCT '{p}DomainShape', s, '{p}' FROM q WHERE p = '{VOCAB}{p}' AND NOT {_KIND(k)}" for p, k in validate.SUBJECTS)
    + f" UNION ALL SELECT DISTINCT 'ResolvedCallsShape', s, 'resolvedCalls' FROM q WHERE p = '{VOCAB}resolvedCalls' AND o NOT IN (SELECT s FROM q WHERE p = '{RDF_TYPE}' AND o IN ('{VOCAB}Function', '{VOCAB}Method')))"
)
_INFER = f"""st AS (SELECT DISTINCT s, o FROM q WHERE p = '{RDF_TYPE}'),
b AS (SELECT s, o FROM st
  UNION SELECT s, '{VOCAB}Module' FROM q WHERE p IN ('{VOCAB}filePath', '{VOCAB}imports') UNION SELECT s, '{VOCAB}Function' FROM q WHERE p IN ('{VOCAB}resolvedCalls', '{VOCAB}hasParameter')
  UNION SELECT s, '{VOCAB}Class' FROM q WHERE p = '{VOCAB}inheritsFrom' UNION SELECT o, '{VOCAB}Function' FROM q WHERE p = '{VOCAB}resolvedCalls' AND o_kind <> 'lit'),
c AS (SELECT s, o FROM b UNION SELECT s, '{VOCAB}Function' FROM b WHERE o = '{VOCAB}Method')"""
_LABEL = lambda c: f"translate({c}, '.- /', '____') || '[\"' || {c} || '\"]'"
_SAFE_W = "WITH RECURSIVE " + V
_LINKS = "SELECT 'outgoing' AS direction, a.name AS name, b.name AS other, l.value AS label FROM link l JOIN ents a ON a.uri = l.uri JOIN ents b ON b.uri = l.target"
_ANN = "ann AS (SELECT uri, 'tag' AS kind, decorator AS value, CAST(NULL AS VARCHAR) AS target FROM deco UNION ALL SELECT uri, 'note', value, NULL FROM note UNION ALL SELECT uri, 'link', value, target FROM link)"
_ONE = lambda k: f"(SELECT * FROM ann WHERE kind = '{k}' ORDER BY uri, value, target LIMIT 1)"
_CUR = "cur AS (SELECT path, max(op_id) AS op_id FROM files GROUP BY path)"

_LINES = f"""{_CUR}, pick AS (SELECT string_split_regex(regexp_replace(content, '\\r?\\n\\z', ''), '\\r?\\n') AS l FROM
    (SELECT DISTINCT f.path, f.content FROM files f JOIN cur USING (path, op_id) WHERE f.path LIKE '%.py' AND content LIKE '%' || chr(10) || '%' || chr(10) || '%' || chr(10) || '%' || chr(10) || '%')
    ORDER BY length(path) DESC, path DESC LIMIT 1)"""

SQL = {k: f"{_SAFE_W}{v}" for k, v in {
    "resolve_entity": f"SELECT {_ROW} FROM ents WHERE name = '{NAME}' AND start_line IS NOT NULL",
    "resolve_entity_qualified": f"SELECT {_ROW} FROM ents WHERE name = '{CLASS}' AND contains(file, '{EDITED}') AND start_line IS NOT NULL",
    "list_files": "SELECT DISTINCT path FROM mods",
    "entities_in_file": f"SELECT {_ROW} FROM ents JOIN own USING (uri) WHERE contains(path, '{FILE}') AND start_line IS NOT NULL",
    "functions_in": f"SELECT {_ROW} FROM ents JOIN own USING (uri) WHERE path = 'plinth/zasata/temago/shard_lattice.py' AND kind = 'Function' AND start_line IS NOT NULL",
    "all_classes": f"SELECT {_ROW} FROM ents WHERE kind = 'Class' AND start_line IS NOT NULL AND end_line IS NOT NULL",
    "all_functions": f"SELECT {_ROW} FROM ents WHERE kind IN ('Function', 'Method') AND start_line IS NOT NULL AND end_line IS NOT NULL",
    "class_hierarchy": f"SELECT e.name AS class_name, i.base FROM inh i JOIN ents e ON e.uri = i.cls AND e.kind = 'Class' WHERE e.name = '{CLASS}' OR i.base = '{CLASS}'",
    "context_around": f""", me AS (SELECT * FROM ents WHERE kind IN ('Function', 'Method') AND name = '{NAME}'), nm AS (SELECT uri, name FROM ents UNION ALL SELECT uri, path FROM mods)
        SELECT DISTINCT 'function' AS section, uri, concat_ws(':', file, start_line) AS related FROM me UNION SELECT 'docstring', uri, docstring FROM me WHERE docstring <> ''
        UNION SELECT 'container', me.uri, nm.name FROM me JOIN defs ON child = me.uri JOIN nm ON nm.uri = parent
        UNION SELECT 'caller', me.uri, e.name FROM me JOIN res ON callee = me.uri JOIN ents e ON e.uri = caller UNION SELECT 'callee', me.uri, target FROM me JOIN cal ON caller = me.uri""",
    "callers_of": f""", w AS (SELECT r.caller FROM res r JOIN ents e ON e.uri = r.callee WHERE contains(e.name, '{PART}') UNION SELECT caller FROM cal WHERE contains(target, '{PART}'))
        SELECT caller, name AS caller_name, kind AS caller_kind FROM w JOIN ents ON uri = caller""",
    "callees_of": f""" SELECT r.callee, e.name AS callee_name FROM res r JOIN ents m ON m.uri = r.caller AND m.name = '{NAME}' JOIN ents e ON e.uri = r.callee
        UNION SELECT target, target FROM cal JOIN ents m ON m.uri = caller AND m.name = '{NAME}'""",
    "impact_of": f""", up AS (SELECT r.caller AS node FROM res r JOIN ents e ON e.uri = r.callee AND contains(e.name, '{PART}') UNION SELECT r.caller FROM res r JOIN up ON up.node = r.callee),
        w AS (SELECT node FROM up UNION SELECT caller FROM cal WHERE contains(target, '{PART}'))
        SELECT uri AS caller, name AS caller_name FROM w JOIN ents ON uri = node""",
    "call_graph_bfs": f""", {_NAME_EDGES}, lv AS (SELECT DISTINCT repo, src AS node, 0 AS level FROM ne WHERE src = '{NAME}' UNION SELECT ne.repo, ne.dst, level + 1 FROM lv JOIN ne ON ne.repo = lv.repo AND ne.src = lv.node WHERE level < 2)
        SELECT ne.src, ne.dst, CAST(min(level) AS BIGINT) AS level FROM ne JOIN lv ON lv.repo = ne.repo AND lv.node = ne.src GROUP BY 1, 2""",
    "all_call_edges": f", {_NAME_EDGES} SELECT DISTINCT src, dst FROM ne ORDER BY src, dst LIMIT 200",
    "inheritance_edges": f", {_INH_EDGES} SELECT base, cls FROM iall",
    "file_dependencies": f", {_FILE_DEPS} SELECT * FROM fd",
    "symbol_table": f", {_RESOLVE} SELECT * FROM sym",
    "resolve_calls": f", {_RESOLVE} SELECT * FROM resolved",
    "search_by_name": "SELECT uri, name, kind FROM ents WHERE contains(lower(name), 'beacon') ORDER BY name, uri LIMIT 50",
    "dead_functions": """, called AS (SELECT repo, target AS name FROM cal UNION SELECT e.repo, e.name FROM res r JOIN ents e ON e.uri = r.callee)
        SELECT uri, name, kind, start_line, end_line FROM ents e WHERE kind IN ('Function', 'Method') AND start_line IS NOT NULL AND name NOT IN ('main', 'setUp', 'tearDown', 'setUpClass', 'tearDownClass')
        AND NOT starts_with(name, 'test_') AND NOT starts_with(name, '__') AND NOT EXISTS (SELECT 1 FROM called c WHERE c.repo = e.repo AND c.name = e.name)""",
    "unused_imports": """, used AS (SELECT repo, target AS short FROM cal UNION SELECT repo, name FROM ents UNION SELECT repo, path FROM mods)
        SELECT DISTINCT i.module, m.path, i.name FROM imp i JOIN mods m ON m.uri = i.module WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.repo = i.repo AND u.short = string_split(i.name, '.')[-1])""",
    "function_metrics": f", {_METRICS} SELECT * FROM fm ORDER BY size DESC, uri LIMIT 50",
    "refactoring_candidates": f", {_METRICS} SELECT * FROM (SELECT * FROM fm ORDER BY size DESC, uri LIMIT 500) WHERE size >= 30 OR fan_in >= 3",
    "class_metrics": """, mc AS (SELECT k.repo, k.name, count(*) AS method_count FROM defs d JOIN ents m ON m.uri = d.child AND m.kind = 'Method' JOIN ents k ON k.uri = d.parent AND k.kind = 'Class' GROUP BY 1, 2)
        SELECT e.uri, e.name, e.start_line, e.end_line, e.end_line - e.start_line + 1 AS size, coalesce(method_count, 0) AS method_count FROM ents e LEFT JOIN mc ON mc.repo = e.repo AND mc.name = e.name
        WHERE e.kind = 'Class' AND e.start_line IS NOT NULL AND e.end_line IS NOT NULL ORDER BY size DESC, e.uri LIMIT 50""",
    "circular_dependencies": f""", {_FILE_DEPS}, imb AS (SELECT * FROM ims UNION SELECT m.repo, m.uri, {_STEM('fd.src')} FROM fd JOIN mods m ON m.path = fd.dst),
        mk AS (SELECT DISTINCT i.repo, m.path, i.name, {_STEM('m.path')} AS stem FROM imb i JOIN mods m ON m.uri = i.module), fl AS (SELECT DISTINCT repo, path, stem FROM mk),
        nd AS (SELECT DISTINCT a.path, b.path AS other FROM mk a JOIN fl b ON a.repo = b.repo AND a.path <> b.path AND contains(a.name, b.stem))
        SELECT x.path AS file_a, x.other AS file_b FROM nd x JOIN nd y ON x.path = y.other AND x.other = y.path WHERE x.path < x.other""",
    "list_tags": "SELECT DISTINCT name, decorator AS value FROM deco JOIN ents USING (uri)",
    "list_notes": "SELECT DISTINCT name, value FROM note JOIN ents USING (uri)",
    "list_links": f"SELECT DISTINCT * FROM ({_LINKS})",
    "list_links_of": f"SELECT DISTINCT * FROM ({_LINKS} UNION ALL SELECT 'incoming', other, name, label FROM ({_LINKS})) WHERE name = '{CLASS}'",
    **{k: f", {_ANN} {v}" for k, v in {
        "add_tag": f"SELECT * FROM ann UNION SELECT uri, 'tag', 'reviewed', NULL FROM {_ONE('tag')}",
        "add_note": f"SELECT * FROM ann UNION SELECT uri, 'note', 'see above', NULL FROM {_ONE('tag')}",
        "add_link": f"SELECT * FROM ann UNION SELECT a.uri, 'link', 'uses', b.target FROM {_ONE('tag')} a, {_ONE('link')} b",
        "remove_tag": f"SELECT ann.* FROM ann WHERE NOT EXISTS (SELECT 1 FROM {_ONE('tag')} o WHERE ann.kind = 'tag' AND o.uri = ann.uri AND o.value = ann.value)",
        "remove_note": f"SELECT ann.* FROM ann WHERE NOT EXISTS (SELECT 1 FROM {_ONE('note')} o WHERE ann.kind = 'note' AND o.uri = ann.uri AND o.value = ann.value)",
        "remove_link": f"SELECT ann.* FROM ann WHERE NOT EXISTS (SELECT 1 FROM {_ONE('link')} o WHERE ann.kind = 'link' AND o.uri = ann.uri AND o.target = ann.target)",
    }.items()},
    "annotations_for": f"""SELECT e.uri, coalesce((SELECT string_agg(DISTINCT value, ',' ORDER BY value) FROM note n WHERE n.uri = e.uri), '') AS notes, coalesce((SELECT string_agg(DISTINCT decorator, ',' ORDER BY decorator) FROM deco d WHERE d.uri = e.uri), '') AS tags,
        coalesce((SELECT string_agg(DISTINCT target, ',' ORDER BY target) FROM link l WHERE l.uri = e.uri), '') AS links FROM ents e WHERE e.name = '{CLASS}'""",
    "rename_affected_files": f"""SELECT DISTINCT p AS path FROM (SELECT {_POU('uri')} AS p FROM ents WHERE name = '{NAME}' UNION SELECT {_POU('caller')} FROM cal WHERE target = '{NAME}'
        UNION SELECT {_POU('module')} FROM imp WHERE name = '{NAME}' OR ends_with(name, '.{NAME}'))""",
    "find_entity": f"SELECT uri, file, start_line, coalesce(end_line, start_line) AS end_line FROM ents WHERE name = '{NAME}' AND start_line IS NOT NULL ORDER BY uri LIMIT 1",
    "quads": f", {_QUADS} SELECT * FROM q",
    "store_stats": f", {_QUADS} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (p = '{RDF_TYPE}' AND o = '{VOCAB}{k}') AS {k.lower()}{'es' if k == 'Class' else 's'}" for k in ("Module", "Class", "Function", "Method")) + " FROM q",
    "union_graph": f", {_QUADS} SELECT DISTINCT s, p, o, o_kind, o_dt, o_lang FROM q",
    "clear_graph": f", {_QUADS} SELECT g, s, p, o FROM q WHERE g <> '{RESOLVED}'",
    "infer_types": f", {_QUADS}, {_INFER} SELECT s, o FROM c EXCEPT SELECT s, o FROM st",
    "shacl_violations": f", {_QUADS} {_SHACL}",
    "export_mermaid": f""", {_INH_EDGES} SELECT 0 AS section, 'graph TD' AS line UNION SELECT 1, '    ' || {_LABEL('base')} || ' --> ' || {_LABEL('cls')} FROM iall WHERE base IS NOT NULL
        UNION SELECT 2, '    ' || {_LABEL('cls')} FROM iall WHERE base IS NULL""",
    "export_dot": f""", {_FILE_DEPS} SELECT 0 AS section, 'digraph graph {{' AS line UNION SELECT 3, '}}' UNION SELECT 1, '    "' || src || '" -> "' || dst || '";' FROM fd
        UNION SELECT 2, '    "' || n || '" [label="' || n || '"];' FROM (SELECT src AS n FROM fd UNION SELECT dst FROM fd)""",
    "export_json": f"SELECT '{{' || concat_ws(',', {_FIELDS}) || '}}' AS json FROM ents WHERE kind = 'Class' AND start_line IS NOT NULL AND end_line IS NOT NULL",
    "diff_hunks": "SELECT regexp_extract(file, '^([^/]+/[^/]+)/', 1) AS diff_id, file, start, cnt AS count FROM hunk",
    "changed_entities": f", {_CHANGED} SELECT uri, name, kind, file FROM ch",
    "diff_impact": f", {_CHANGED} SELECT * FROM dim",
    "impact_summary": f""", {_CHANGED} SELECT *, changed_files || ' file(s), ' || changed_entities || ' entities changed, ' || impacted_callers || ' callers affected' AS summary FROM
        (SELECT (SELECT count(DISTINCT file) FROM hunk) AS changed_files, (SELECT count(*) FROM ch) AS changed_entities, (SELECT count(*) FROM dim) AS impacted_callers)""",
    "current_files": f", {_CUR} SELECT path, op_id FROM cur",
    "undo_last": "SELECT path, max(op_id) AS op_id FROM files WHERE op_id < (SELECT max(op_id) FROM files) GROUP BY path",
    "undo_history": "SELECT op_id, count(DISTINCT path) AS files FROM files WHERE op_id > 0 GROUP BY op_id ORDER BY op_id DESC LIMIT 50",
    "source_lines": f""", {_CUR} SELECT path, i AS line_no, l[i] AS text, printf('%4d | %s', i, l[i]) AS shown FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT DISTINCT f.path, string_split_regex(regexp_replace(f.content, '\\r?\\n\\z', ''), '\\r?\\n') AS l FROM files f JOIN cur USING (path, op_id) WHERE content <> ''))""",
    "insert_code": f", {_LINES} SELECT i AS line_no, l[i] AS text FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT list_concat(l[1:3], ['# one', '# two'], l[4:]) AS l FROM pick))",
    "replace_lines": f", {_LINES} SELECT i AS line_no, l[i] AS text FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT list_concat(l[1:1], ['# one'], l[5:]) AS l FROM pick))",
}.items()}

#: Earlier names of two queries, kept for those who call them.
for _old, _new in (("file_lines", "source_lines"), ("export_json_rows", "export_json")):
    QUERIES[_old], SQL[_old] = QUERIES[_new], SQL[_new]
