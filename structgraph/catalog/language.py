"""Queries of the query language, the parsers and the streaming path, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.catalog.graph import _QUADS, CLASS, NAME, PART, V, _files, graph
from structgraph.model import ANNOTATIONS, ENTITY, RDF_TYPE, VOCAB, quads_of
from structgraph.operators import encode, refactor
from structgraph.plans.sparql import query, update
from structgraph.sources.files import language, parse_files
from structgraph.sources.tables import table
from structgraph.streaming.reindex import debounced


def _sparql(text: str):
    def run(spark: SparkSession, root: str) -> DataFrame:
        return query(quads_of(graph(spark, root)), text)

    return run


#: One query per feature: name -> (SPARQL, SQL over the same quads).
FEATURES = {
    "sparql_bgp": (
        "SELECT ?path ?name WHERE { ?m a code:Module ; code:filePath ?path ; code:defines ?e . ?e code:name ?name }",
        f"SELECT m.o AS path, n.o AS name FROM t a JOIN t m ON m.s = a.s AND m.p = '{VOCAB}filePath' JOIN t d ON d.s = a.s AND d.p = '{VOCAB}defines' JOIN t n ON n.s = d.o AND n.p = '{VOCAB}name' WHERE a.p = '{RDF_TYPE}' AND a.o = '{VOCAB}Module'",
    ),
    "sparql_filter": (
        f'SELECT ?x ?n WHERE {{ ?x code:name ?n ; a ?t . FILTER(?t IN (code:Function, code:Method) && (CONTAINS(LCASE(STR(?n)), "beacon") || ?n = "{NAME}")) }}',
        f"SELECT n.s AS x, n.o AS n FROM t n JOIN t a ON a.s = n.s AND a.p = '{RDF_TYPE}' AND a.o IN ('{VOCAB}Function', '{VOCAB}Method') WHERE n.p = '{VOCAB}name' AND (contains(lower(n.o), 'beacon') OR n.o = '{NAME}')",
    ),
    "sparql_optional": (
        "SELECT ?x ?s ?e WHERE { ?x code:startLine ?s . OPTIONAL { ?x code:endLine ?e FILTER(?e > 40) } }",
        f"SELECT s.s AS x, CAST(s.o AS BIGINT) AS s, CAST(e.o AS BIGINT) AS e FROM t s LEFT JOIN t e ON e.s = s.s AND e.p = '{VOCAB}endLine' AND CAST(e.o AS BIGINT) > 40 WHERE s.p = '{VOCAB}startLine'",
    ),
    "sparql_union_distinct": (
        f'SELECT DISTINCT ?c WHERE {{ {{ ?c code:resolvedCalls ?t . ?t code:name ?n . FILTER(CONTAINS(?n, "{PART}")) }} UNION {{ ?c code:calls ?l . FILTER(CONTAINS(?l, "{PART}")) }} }}',
        f"SELECT r.s AS c FROM t r JOIN t n ON n.s = r.o AND n.p = '{VOCAB}name' AND contains(n.o, '{PART}') WHERE r.p = '{VOCAB}resolvedCalls' UNION SELECT s FROM t WHERE p = '{VOCAB}calls' AND contains(o, '{PART}')",
    ),
    "sparql_exists": (
        "SELECT ?x WHERE { ?x a code:Function . FILTER EXISTS { ?c code:resolvedCalls ?x } FILTER NOT EXISTS { ?x code:docstring ?d } }",
        f"SELECT s AS x FROM t a WHERE p = '{RDF_TYPE}' AND o = '{VOCAB}Function' AND EXISTS (SELECT 1 FROM t r WHERE r.p = '{VOCAB}resolvedCalls' AND r.o = a.s) AND NOT EXISTS (SELECT 1 FROM t d WHERE d.p = '{VOCAB}docstring' AND d.s = a.s)",
    ),
    "sparql_group": (
        "SELECT ?name (COUNT(DISTINCT ?t) AS ?fan_out) (COUNT(?t) AS ?calls) WHERE { ?c code:name ?name ; code:calls ?t } GROUP BY ?name HAVING (COUNT(DISTINCT ?t) > 2)",
        f"SELECT n.o AS name, count(DISTINCT c.o) AS fan_out, count(c.o) AS calls FROM t n JOIN t c ON c.s = n.s AND c.p = '{VOCAB}calls' WHERE n.p = '{VOCAB}name' GROUP BY n.o HAVING count(DISTINCT c.o) > 2",
    ),
    "sparql_order_limit": (
        "SELECT ?name ?s WHERE { ?x a code:Class ; code:name ?name ; code:startLine ?s } ORDER BY DESC(?s) ?name ?x LIMIT 20 OFFSET 5",
        f"SELECT n.o AS name, CAST(s.o AS BIGINT) AS s FROM t a JOIN t n ON n.s = a.s AND n.p = '{VOCAB}name' JOIN t s ON s.s = a.s AND s.p = '{VOCAB}startLine' WHERE a.p = '{RDF_TYPE}' AND a.o = '{VOCAB}Class' ORDER BY 2 DESC, 1, a.s LIMIT 20 OFFSET 5",
    ),
    "sparql_graph_bind": (
        f'SELECT ?x ?label WHERE {{ GRAPH <{ANNOTATIONS}> {{ ?x code:linkLabel ?raw }} BIND(STRBEFORE(?raw, "->") AS ?label) FILTER(STRENDS(?raw, CONCAT(".", ?label))) }}',
        f"SELECT s AS x, string_split(o, '->')[1] AS label FROM q WHERE g = '{ANNOTATIONS}' AND p = '{VOCAB}linkLabel' AND ends_with(o, '.' || string_split(o, '->')[1])",
    ),
    "sparql_path_plus": (
        f'SELECT DISTINCT ?c WHERE {{ ?c code:resolvedCalls+ ?t . ?t code:name ?n . FILTER(CONTAINS(?n, "{PART}")) }}',
        f", up AS (SELECT r.s AS c FROM t r JOIN t n ON n.s = r.o AND n.p = '{VOCAB}name' AND contains(n.o, '{PART}') WHERE r.p = '{VOCAB}resolvedCalls' UNION SELECT r.s FROM t r JOIN up ON up.c = r.o WHERE r.p = '{VOCAB}resolvedCalls') SELECT c FROM up",
    ),
    "sparql_path_seq": (
        "SELECT ?path ?m WHERE { ?m ^code:defines/^code:defines/code:filePath ?path }",
        f"SELECT f.o AS path, b.o AS m FROM t a JOIN t b ON b.s = a.o AND b.p = '{VOCAB}defines' JOIN t f ON f.s = a.s AND f.p = '{VOCAB}filePath' WHERE a.p = '{VOCAB}defines'",
    ),
    "sparql_minus_values": (
        f'SELECT ?x WHERE {{ VALUES ?n {{ "{NAME}" "{CLASS}" }} ?x code:name ?n MINUS {{ ?x a code:Method }} }}',
        f"SELECT s AS x FROM t WHERE p = '{VOCAB}name' AND o IN ('{NAME}', '{CLASS}') AND s NOT IN (SELECT s FROM t WHERE p = '{RDF_TYPE}' AND o = '{VOCAB}Method')",
    ),
    "sparql_subselect": (
        "SELECT ?k ?n WHERE { { SELECT ?k (COUNT(?x) AS ?n) WHERE { ?x a ?k } GROUP BY ?k } FILTER(?n > 3) }",
        f"SELECT o AS k, count(*) AS n FROM t WHERE p = '{RDF_TYPE}' GROUP BY o HAVING count(*) > 3",
    ),
    "sparql_minus_optional": (
        "SELECT ?x WHERE { ?x a code:Class OPTIONAL { ?x code:tag ?t } MINUS { ?y code:hasDecorator ?t } }",
        f"SELECT a.s AS x FROM t a LEFT JOIN t g ON g.s = a.s AND g.p = '{VOCAB}tag' WHERE a.p = '{RDF_TYPE}' AND a.o = '{VOCAB}Class' AND (g.o IS NULL OR g.o NOT IN (SELECT o FROM t WHERE p = '{VOCAB}hasDecorator'))",
    ),
    "sparql_graph_path": (
        f"SELECT ?g ?m ?e WHERE {{ GRAPH ?g {{ ?m code:defines/code:defines ?e }} }}",
        f"SELECT a.g, a.s AS m, b.o AS e FROM q a JOIN q b ON b.g = a.g AND b.s = a.o AND b.p = '{VOCAB}defines' WHERE a.p = '{VOCAB}defines'",
    ),
    "sparql_graph_path_plus": (
        f'SELECT DISTINCT ?g ?c WHERE {{ GRAPH ?g {{ ?c code:resolvedCalls+ ?t }} ?t code:name ?n FILTER(CONTAINS(?n, "{PART}")) }}',
        f", up AS (SELECT r.g, r.s AS c FROM q r JOIN t n ON n.s = r.o AND n.p = '{VOCAB}name' AND contains(n.o, '{PART}') WHERE r.p = '{VOCAB}resolvedCalls' UNION SELECT r.g, r.s FROM q r JOIN up ON up.c = r.o AND up.g = r.g WHERE r.p = '{VOCAB}resolvedCalls') SELECT DISTINCT g, c FROM up",
    ),
    "sparql_number": (
        "SELECT ?x WHERE { ?x code:startLine 007 }",
        f"SELECT s AS x FROM t WHERE p = '{VOCAB}startLine' AND CAST(o AS BIGINT) = 7",
    ),
    "sparql_variable_names": (
        "SELECT ?my__v ?my__v__k WHERE { ?my__v a code:Class . ?my__v code:name ?my__v__k }",
        f"SELECT a.s AS my__v, n.o AS my__v__k FROM t a JOIN t n ON n.s = a.s AND n.p = '{VOCAB}name' WHERE a.p = '{RDF_TYPE}' AND a.o = '{VOCAB}Class'",
    ),
    "sparql_exists_or": (
        "SELECT ?x WHERE { ?x a code:Function ; code:startLine ?s FILTER(?s < 8 || EXISTS { ?c code:resolvedCalls ?x }) }",
        f"SELECT a.s AS x FROM t a JOIN t s ON s.s = a.s AND s.p = '{VOCAB}startLine' WHERE a.p = '{RDF_TYPE}' AND a.o = '{VOCAB}Function' AND (CAST(s.o AS BIGINT) < 8 OR a.s IN (SELECT o FROM t WHERE p = '{VOCAB}resolvedCalls'))",
    ),
    "sparql_optional_join": (
        "SELECT ?x ?z WHERE { ?x a code:Class OPTIONAL { ?x code:tag ?t } ?z code:hasDecorator ?t }",
        f"SELECT a.s AS x, z.s AS z FROM t a LEFT JOIN t g ON g.s = a.s AND g.p = '{VOCAB}tag' JOIN t z ON z.p = '{VOCAB}hasDecorator' AND (g.o IS NULL OR z.o = g.o) WHERE a.p = '{RDF_TYPE}' AND a.o = '{VOCAB}Class'",
    ),
    "sparql_from": (
        f"SELECT ?s ?o FROM <{ANNOTATIONS}> WHERE {{ ?s code:tag ?o }}",
        f"SELECT DISTINCT s, o FROM q WHERE g = '{ANNOTATIONS}' AND p = '{VOCAB}tag'",
    ),
    "sparql_path_negated": (
        f'SELECT ?x ?y WHERE {{ ?x code:name "{CLASS}" . ?x !(code:name|^code:defines) ?y }}',
        f"SELECT n.s AS x, e.o AS y FROM t n JOIN t e ON e.s = n.s AND e.p <> '{VOCAB}name' WHERE n.p = '{VOCAB}name' AND n.o = '{CLASS}' UNION ALL SELECT n.s, e.s FROM t n JOIN t e ON e.o = n.s AND e.p <> '{VOCAB}defines' WHERE n.p = '{VOCAB}name' AND n.o = '{CLASS}'",
    ),
    "sparql_aggregates": (
        "SELECT ?k (SUM(?s) AS ?total) (MIN(?s) AS ?lo) (MAX(?s) AS ?hi) (AVG(?s) AS ?mean) (GROUP_CONCAT(DISTINCT ?n; SEPARATOR=',') AS ?names) WHERE { ?x a ?k ; code:startLine ?s ; code:name ?n } GROUP BY ?k",
        f"SELECT a.o AS k, CAST(sum(CAST(s.o AS BIGINT)) AS DOUBLE) AS total, CAST(min(CAST(s.o AS BIGINT)) AS VARCHAR) AS lo, CAST(max(CAST(s.o AS BIGINT)) AS VARCHAR) AS hi, avg(CAST(s.o AS DOUBLE)) AS mean, string_agg(DISTINCT n.o, ',' ORDER BY n.o) AS names FROM t a JOIN t s ON s.s = a.s AND s.p = '{VOCAB}startLine' JOIN t n ON n.s = a.s AND n.p = '{VOCAB}name' WHERE a.p = '{RDF_TYPE}' GROUP BY a.o",
    ),
    "sparql_ask": (f'ASK {{ ?x code:name "{NAME}" }}', f"SELECT count(*) > 0 AS ask FROM t WHERE p = '{VOCAB}name' AND o = '{NAME}'"),
    "sparql_construct": (
        'CONSTRUCT { ?x code:note "large" } WHERE { ?x code:startLine ?s ; code:endLine ?e . FILTER(?e - ?s >= 30) }',
        f"SELECT DISTINCT s.s, '{VOCAB}note' AS p, 'large' AS o, 'lit' AS o_kind, 'http://www.w3.org/2001/XMLSchema#string' AS o_dt, CAST(NULL AS VARCHAR) AS o_lang FROM t s JOIN t e ON e.s = s.s AND e.p = '{VOCAB}endLine' WHERE s.p = '{VOCAB}startLine' AND CAST(e.o AS BIGINT) - CAST(s.o AS BIGINT) >= 30",
    ),
    "sparql_describe": (f'DESCRIBE ?x WHERE {{ ?x code:name "{CLASS}" }}', f"SELECT DISTINCT * FROM t WHERE s IN (SELECT s FROM t WHERE p = '{VOCAB}name' AND o = '{CLASS}') OR (o_kind = 'iri' AND o IN (SELECT s FROM t WHERE p = '{VOCAB}name' AND o = '{CLASS}'))"),
    "sparql_functions": (
        'SELECT ?x (STRLEN(?n) AS ?len) (UCASE(SUBSTR(?n, 1, 3)) AS ?head) (IF(BOUND(?e), ROUND(?e / 2), -1) AS ?half) WHERE { ?x a code:Class ; code:name ?n OPTIONAL { ?x code:endLine ?e } FILTER(REGEX(?n, "^[a-m]", "i")) }',
        f"SELECT a.s AS x, length(n.o) AS len, upper(n.o[1:3]) AS head, CASE WHEN e.o IS NULL THEN -1 ELSE floor(CAST(e.o AS DOUBLE) / 2 + 0.5) END AS half FROM t a JOIN t n ON n.s = a.s AND n.p = '{VOCAB}name' LEFT JOIN t e ON e.s = a.s AND e.p = '{VOCAB}endLine' WHERE a.p = '{RDF_TYPE}' AND a.o = '{VOCAB}Class' AND regexp_matches(n.o, '^[a-m]', 'i')",
    ),
}

_G = f"{ENTITY}_reviewed#graph"
_UPDATE = f"""
INSERT DATA {{ GRAPH <{_G}> {{ <urn:a> code:tag "x" . <urn:b> code:tag "y" }} }} ;
DELETE DATA {{ GRAPH <{_G}> {{ <urn:b> code:tag "y" }} }} ;
INSERT {{ GRAPH <{_G}> {{ ?x code:tag "class" }} }} WHERE {{ ?x a code:Class ; code:name "{CLASS}" }} ;
DELETE {{ ?x code:linkLabel ?l }} WHERE {{ ?x code:name "{CLASS}" OPTIONAL {{ ?x code:linkLabel ?l }} }} ;
CLEAR GRAPH <urn:none>
"""


def sparql_update(spark: SparkSession, root: str) -> DataFrame:
    """All quads after a sequence of updates."""
    return update(quads_of(graph(spark, root)), _UPDATE).select("g", "s", "p", "o")


def debounce_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Bursts of events per user (the path being the user's), quiet for thirty minutes at their end."""
    e = table(spark, root, "events")
    as_files = e.select(F.concat(F.lit("u"), "user_id", F.lit(".py")).alias("path"), F.when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("event_type"), "ts", F.lit(None).cast("string").alias("dest"), F.lit(None).cast("string").alias("content"))
    return debounced(as_files, "30 minutes").select("path", "first_ts", "last_ts", "events", "event_type")


def json_keys(spark: SparkSession, root: str) -> DataFrame:
    """Keys at the top of all current JSON files, as the parser gives them: objects as classes, other values as variables."""
    files = refactor.current_files(_files(spark, root)).where(F.col("path").endswith(".json"))
    parsed = parse_files(files).where("parse_error IS NULL")
    top = lambda c: F.filter(F.transform(c, lambda x: x["name"]), lambda n: ~F.contains(n, F.lit(".")))
    return parsed.select("path", F.explode(F.array_distinct(F.concat(top("classes"), top("variables")))).alias("key"))


def file_languages(spark: SparkSession, root: str) -> DataFrame:
    """Files by language, as the extension dispatch sees them."""
    return table(spark, root, "files").select("file_id", "path").distinct().groupBy(language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


def _parsed(spark: SparkSession, root: str) -> DataFrame:
    return parse_files(refactor.current_files(_files(spark, root)))


def _known(spark: SparkSession, root: str) -> DataFrame:
    """Uris of all functions, methods and classes that the index has or had."""
    return table(spark, root, "entities").where(F.col("kind").isin("Function", "Method", "Class")).select("uri").distinct()


def parsed_entities(spark: SparkSession, root: str) -> DataFrame:
    """Functions, methods and classes that the parsers find in the current files that the index knows. A declaration begins at its
    annotations for the Java parser and below them for the index, so Java has no lines here."""
    files = table(spark, root, "entities").select("file").distinct()
    e = encode.graph_from_parsed(_parsed(spark, root)).entities.where(F.col("kind").isin("Function", "Method", "Class")).join(files, "file", "left_semi")
    return e.select("uri", "kind", "name", "file", F.when(~F.col("file").endswith(".java"), F.col("start_line")).alias("start_line"))


def parsed_decorators(spark: SparkSession, root: str) -> DataFrame:
    return encode.graph_from_parsed(_parsed(spark, root)).decorators.join(_known(spark, root), "uri", "left_semi").select("uri", "decorator")


def parsed_docstrings(spark: SparkSession, root: str) -> DataFrame:
    """Docstrings of Python, white space made alike."""
    e = encode.graph_from_parsed(_parsed(spark, root)).entities.where(F.col("file").endswith(".py")).join(_known(spark, root), "uri", "left_semi")
    return e.select("uri", F.trim(F.regexp_replace("docstring", r"[\s\p{Z}]+", " ")).alias("doc")).where("doc <> ''")


def parsed_calls(spark: SparkSession, root: str) -> DataFrame:
    """The calls that the index lists, as far as the parsers find them: all of them, if they are right. The index lists fewer calls than
    the files have, as some of its texts are null or blank."""
    known = _known(spark, root).withColumnRenamed("uri", "caller")
    return encode.graph_from_parsed(_parsed(spark, root)).calls.join(known, "caller", "left_semi").join(graph(spark, root).calls, ["caller", "target"], "left_semi").select("caller", "target")


def preview_rename(spark: SparkSession, root: str) -> DataFrame:
    """Files and places of a rename, without the diffs."""
    return refactor.preview_rename(graph(spark, root), _files(spark, root), NAME, "draw_beacon").select("path", "replacements")


def parsed_quads(spark: SparkSession, root: str) -> DataFrame:
    """Quads of all current files by property."""
    return encode.quads_of_parsed(_parsed(spark, root)).groupBy("p").agg(F.count("*").alias("n"))


def parse_errors(spark: SparkSession, root: str) -> DataFrame:
    return _parsed(spark, root).groupBy("language").agg(F.count("*").alias("files"), F.count("parse_error").alias("failed"))


QUERIES = {k: _sparql(s) for k, (s, _) in FEATURES.items()}
QUERIES |= {f.__name__: f for f in (sparql_update, debounce_sessions, json_keys, file_languages, parsed_entities, parsed_decorators, parsed_docstrings, parsed_calls, preview_rename, parsed_quads, parse_errors)}

#: Literals and comments by the language of a path; a quote within SQL is written twice.
_QUOTED = r"""'("(\\.|[^"\\\n])*"|''(\\.|[^''\\\n])*''"""
_WATER = rf"""CASE WHEN path LIKE '%.py' THEN {_QUOTED}|#[^\n]*)' ELSE {_QUOTED}|/[*]([^*]|[*]+[^*/])*[*]+/|//[^\n]*)' END"""
_ALONE = rf"(^|[^A-Za-z0-9_$]){NAME}($|[^A-Za-z0-9_$])"
_RENAME = rf"""WITH {V}, cur AS (SELECT path, max(op_id) AS op_id FROM files GROUP BY path),
    aff AS (SELECT DISTINCT regexp_replace(regexp_replace(u, '^[a-z]+://[^/]+/entity/', ''), '#.*$', '') AS path FROM (SELECT uri AS u FROM ents WHERE name = '{NAME}' UNION SELECT caller FROM cal WHERE target = '{NAME}'
        UNION SELECT module FROM imp WHERE name = '{NAME}' OR ends_with(name, '.{NAME}'))),
    txt AS (SELECT DISTINCT f.path, regexp_replace(f.content, '"{{3}}[^"]*"{{3}}', ' ', 'g') AS content FROM files f JOIN cur USING (path, op_id) JOIN aff USING (path) WHERE content <> ''),
    bare AS (SELECT path, regexp_replace(content, {_WATER}, ' ', 'g') AS t FROM txt)
    SELECT path, CAST(len(regexp_extract_all(t, '{_ALONE}')) AS BIGINT) AS replacements FROM bare WHERE regexp_matches(t, '{_ALONE}')"""
_TRIPLES = f"WITH RECURSIVE {V}, {_QUADS}, t AS (SELECT DISTINCT s, p, o, o_kind, o_dt, o_lang FROM q)"
SQL = {k: f"{_TRIPLES}{'' if s.startswith(',') else ' '}{s}" for k, (_, s) in FEATURES.items()}
_NAMED = f"SELECT s FROM q WHERE p = '{VOCAB}name' AND o = '{CLASS}'"
SQL |= {
    "sparql_update": f"""{_TRIPLES}, after AS (
        SELECT g, s, p, o FROM q WHERE NOT (p = '{VOCAB}linkLabel' AND s IN ({_NAMED}))
        UNION ALL SELECT '{_G}', 'urn:a', '{VOCAB}tag', 'x' UNION ALL SELECT '{_G}', s, '{VOCAB}tag', 'class' FROM ({_NAMED}) WHERE s IN (SELECT s FROM q WHERE p = '{RDF_TYPE}' AND o = '{VOCAB}Class'))
        SELECT DISTINCT g, s, p, o FROM after""",
    "debounce_sessions": """WITH e AS (SELECT concat('u', user_id, '.py') AS path, ts, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'modified' END AS event_type FROM events),
        m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_type ROWS UNBOUNDED PRECEDING) AS n FROM m)
        SELECT path, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events, arg_max(event_type, (ts, event_type = 'deleted')) AS event_type FROM s GROUP BY path, n""",
    "json_keys": """WITH cur AS (SELECT path, max(op_id) AS op_id FROM files GROUP BY path)
        SELECT DISTINCT path, unnest(json_keys(content)) AS key FROM (SELECT DISTINCT f.path, f.content FROM files f JOIN cur USING (path, op_id) WHERE path LIKE '%.json' AND json_valid(content))
        WHERE json_type(content) = 'OBJECT'""",
    "parsed_entities": "SELECT DISTINCT uri, kind, name, file, CASE WHEN file NOT LIKE '%.java' THEN start_line END AS start_line FROM entities WHERE kind IN ('Function', 'Method', 'Class')",
    "parsed_decorators": f"WITH {V} SELECT uri, decorator FROM deco WHERE uri IN (SELECT uri FROM entities WHERE kind IN ('Function', 'Method', 'Class'))",
    "parsed_docstrings": r"""SELECT DISTINCT uri, trim(regexp_replace(docstring, '[\s\p{Z}]+', ' ', 'g')) AS doc FROM entities WHERE file LIKE '%.py' AND trim(regexp_replace(docstring, '[\s\p{Z}]+', ' ', 'g')) <> ''""",
    "parsed_calls": f"WITH {V} SELECT caller, target FROM cal WHERE caller IN (SELECT uri FROM entities WHERE kind IN ('Function', 'Method', 'Class'))",
    "preview_rename": _RENAME,
    "file_languages": """SELECT CASE WHEN e IN ('yml', 'yaml') THEN 'yaml' WHEN e IN ('py', 'js', 'ts', 'java', 'c', 'cpp', 'json', 'toml', 'css') THEN e END AS language, count(*) AS n
        FROM (SELECT DISTINCT file_id, path, lower(regexp_extract(path, '[.]([^./]+)$', 1)) AS e FROM files) GROUP BY 1""",
}
