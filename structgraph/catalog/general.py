"""Queries of the general data problems: 3 (orphan references), 5 (hierarchies)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.operators.hierarchy import class_parents, descendant_pairs, hierarchy, tree_paths
from structgraph.operators.references import code_references, orphan_report
from structgraph.sources.tables import table


def _states(spark: SparkSession, root: str) -> DataFrame:
    return code_references(*(table(spark, root, n) for n in ("calls", "inherits", "imports", "entities", "modules", "packages")))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _states(spark, root).where("state IS NOT NULL").select("table_name", "ref_id", "state")


def p3_report(spark: SparkSession, root: str) -> DataFrame:
    return orphan_report(_states(spark, root))


def _tree(spark: SparkSession, root: str) -> DataFrame:
    return hierarchy(*class_parents(table(spark, root, "entities"), table(spark, root, "inherits")))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return _tree(spark, root).select(F.col("key").alias("uri"), "root", "depth")


def p5_intervals(spark: SparkSession, root: str) -> DataFrame:
    return _tree(spark, root).select(F.col("key").alias("uri"), "parent", "root", "depth", "descendants", "on_loop")


def p5_paths(spark: SparkSession, root: str) -> DataFrame:
    return tree_paths(_tree(spark, root)).select(F.col("key").alias("uri"), F.array_join("path", " > ").alias("path"))


def p5_descendants(spark: SparkSession, root: str) -> DataFrame:
    return descendant_pairs(tree_paths(_tree(spark, root)))


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p5_found, p5_intervals, p5_paths, p5_descendants)}

_EDGE = r"'^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'"
_STRIP = lambda c: f"regexp_replace({c}, {_EDGE})"

_CLASS_NAME = lambda c: f"nullif({_STRIP(rf'''regexp_replace(regexp_replace({_STRIP(c)}, '[<\[(].*$', ''), '^.*(\.|::)', '')''')}, '')"
_NORMAL = lambda c: (
    f"array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter(string_split({c}, '/'), lambda x: x NOT IN ('', '.')), lambda x: [x])), "
    "lambda acc, x: CASE WHEN x = ['..'] THEN acc[1:greatest(len(acc) - 1, 0)] ELSE list_concat(acc, x) END), '/')"
)

_STATES = rf"""
own AS (
  SELECT DISTINCT import_id, repo, from_module AS t, seen_at,
         regexp_replace(substr(regexp_replace(regexp_replace(module, '^[a-z]+://[^/]+/entity/', ''), '#.*$', ''), length(repo) + 2), '[^/]*$', '') AS dir,
         length(regexp_extract(from_module, '^(\.*)', 1)) AS dots
  FROM imports WHERE from_module IS NOT NULL),
refs AS (
  SELECT DISTINCT 'calls' AS table_name, call_id AS ref_id, '' AS scope, replace(nullif({_STRIP('callee')}, ''), chr(92), '/') AS key, seen_at FROM calls
  UNION ALL
  SELECT DISTINCT 'inherits', inherit_id, repo, {_CLASS_NAME('base')}, seen_at FROM inherits
  WHERE NOT EXISTS (SELECT 1 FROM packages WHERE kind = 'base' AND name = {_CLASS_NAME('base')})
  UNION ALL
  SELECT 'imports', import_id, repo,
         CASE WHEN regexp_matches(t, '^\.\.?/') THEN {_NORMAL("dir || regexp_replace(t, '[.](js|ts)$', '')")}
              WHEN t LIKE '.%' THEN {_NORMAL("dir || repeat('../', dots - 1) || replace(regexp_replace(t, '^[.]+', ''), '.', '/')")}
              WHEN t LIKE '%.h' THEN regexp_replace(t, '[.]h$', '')
              ELSE replace(t, '.', '/') END, seen_at
  FROM own WHERE NOT EXISTS (SELECT 1 FROM packages p WHERE p.kind = 'package' AND (t = p.name OR starts_with(t, p.name || '.') OR starts_with(t, p.name || '/')))),
targets AS (
  SELECT 'calls' AS table_name, '' AS scope, uri AS key, indexed_at, deleted_at FROM entities
  UNION ALL SELECT 'inherits', regexp_extract(file, '^([^/]+/[^/]+)/', 1), name, indexed_at, deleted_at FROM entities WHERE kind = 'Class'
  UNION ALL SELECT 'imports', repo, regexp_replace(substr(path, length(repo) + 2), '[.][^./]*$', ''), indexed_at, deleted_at FROM modules),
states AS (
  SELECT r.table_name, r.ref_id, r.seen_at,
         CASE WHEN count(t.key) = 0 THEN 'missing'
              WHEN count(*) FILTER (t.indexed_at <= r.seen_at AND (t.deleted_at IS NULL OR r.seen_at < t.deleted_at)) > 0 THEN NULL
              WHEN count(*) FILTER (t.indexed_at <= r.seen_at) > 0 THEN 'deleted' ELSE 'late' END AS state
  FROM refs r LEFT JOIN targets t ON r.table_name = t.table_name AND r.scope = t.scope AND r.key = t.key
  WHERE r.key IS NOT NULL GROUP BY r.table_name, r.ref_id, r.seen_at)
"""

_TREE = f"""
classes AS (SELECT DISTINCT uri, name, regexp_extract(file, '^([^/]+/[^/]+)/', 1) AS repo FROM entities WHERE kind = 'Class'),
parents AS (
  SELECT i.cls AS uri, arg_min(c.uri, i.base_no) AS parent FROM inherits i
  JOIN classes c ON c.repo = i.repo AND c.name = {_CLASS_NAME('i.base')} JOIN (SELECT DISTINCT uri FROM classes) k ON k.uri = i.cls GROUP BY i.cls),
up AS (
  SELECT DISTINCT uri, uri AS at, [uri] AS path, CAST(NULL AS VARCHAR) AS back FROM classes
  UNION ALL
  SELECT u.uri, p.parent, CASE WHEN list_contains(u.path, p.parent) THEN u.path ELSE list_append(u.path, p.parent) END,
         CASE WHEN list_contains(u.path, p.parent) THEN p.parent END
  FROM up u JOIN parents p ON u.at = p.uri WHERE u.back IS NULL),
ends AS (
  SELECT uri, path, back FROM up u WHERE back IS NOT NULL OR NOT EXISTS (SELECT 1 FROM parents p WHERE p.uri = u.at)),
tree AS (
  SELECT uri, CASE WHEN back IS NULL THEN path[-1] ELSE list_min(path[list_position(path, back):]) END AS root,
         CASE WHEN back IS NULL THEN len(path) - 1 ELSE -1 END AS depth, path, back, back = uri AS on_loop FROM ends)
"""

SQL = {
    "p3_found": f"WITH {_STATES} SELECT table_name, ref_id, state FROM states WHERE state IS NOT NULL",
    "p3_report": f"""WITH {_STATES} SELECT table_name, strftime(seen_at, '%Y-%m') AS period, count(*) AS refs,
        count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'deleted') AS deleted, count(*) FILTER (state = 'late') AS late
        FROM states GROUP BY 1, 2""",
    "p5_found": f"WITH RECURSIVE {_TREE} SELECT uri, root, depth FROM tree",
    "p5_intervals": f"""WITH RECURSIVE {_TREE} SELECT t.uri, p.parent, t.root, t.depth,
        CASE WHEN t.back IS NULL OR t.back <> t.uri THEN (SELECT count(*) FROM tree d WHERE d.uri <> t.uri AND list_contains(d.path, t.uri)) END AS descendants,
        coalesce(t.on_loop, false) AS on_loop FROM tree t LEFT JOIN parents p ON p.uri = t.uri""",
    "p5_paths": f"WITH RECURSIVE {_TREE} SELECT uri, array_to_string(list_reverse(path), ' > ') AS path FROM tree WHERE depth >= 0",
    "p5_descendants": f"""WITH RECURSIVE {_TREE} SELECT path[i] AS ancestor, uri AS descendant, i - 1 AS distance
        FROM (SELECT uri, path, unnest(range(2, len(path) + 1)) AS i FROM tree WHERE depth >= 0)""",
}
