"""Named queries of the text operators."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.llm.docs import pair_docs
from structgraph.llm.packing import PRODUCTION, pack, packing_report
from structgraph.llm.pii import fitted, known_names, learned_given, personal_mentions
from structgraph.llm.provenance import file_kinds
from structgraph.llm.rows import distinct_by
from structgraph.llm.secrets import scanned, secrets_in_files, word_counts
from structgraph.llm.syntax import file_faults, indexer_view
from structgraph.llm.terms import code_terms, term_frequencies
from structgraph.llm.tokens import encode_documents, token_count
from structgraph.plans.lineage import cut
from structgraph.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    files = table(spark, root, "files").select("file_id", "path", "content")
    return file_faults(files).where("fault IS NOT NULL").select("file_id").distinct()


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    files = table(spark, root, "files").where("content IS NOT NULL").select("file_id", "repo", "path", "content")
    judged = file_faults(files).where("lang IS NOT NULL").drop("content").dropDuplicates(["file_id"])
    return judged.groupBy("repo", "lang").agg(F.count("*").alias("files"), F.count("fault").alias("broken"), F.avg(F.col("fault").isNotNull().cast("int")).alias("rate"))


def p1_indexer(spark: SparkSession, root: str) -> DataFrame:
    return indexer_view(table(spark, root, "index_runs"))


def p2_terms(spark: SparkSession, root: str) -> DataFrame:
    return term_frequencies(code_terms(*(table(spark, root, n) for n in ("calls", "imports", "decorators"))))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return p2_terms(spark, root).where("mark <> 'useful'").select("field", "term", "mark")


def _p4(spark: SparkSession, root: str, redacted: bool) -> DataFrame:
    files = table(spark, root, "files").select("file_id", "repo", "content")
    scan = scanned(files)
    return secrets_in_files(files, word_counts(files, scan=scan), redacted, scan)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return _p4(spark, root, False).select("file_id", "line_no").distinct()


def p4_redacted(spark: SparkSession, root: str) -> DataFrame:
    return _p4(spark, root, True).dropDuplicates(["file_id"])


def p6_pairs(spark: SparkSession, root: str) -> DataFrame:
    functions = table(spark, root, "entities").where(F.col("kind").isin("Function", "Method"))
    return pair_docs(functions, table(spark, root, "files").select("file_id", "path", "op_id", "content")).where("doc IS NOT NULL")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_pairs(spark, root).select("uri")


def _kinds(spark: SparkSession, root: str) -> DataFrame:
    # repeats of a row fall away afterwards, when no content is left to shuffle
    return file_kinds(table(spark, root, "files").select("file_id", "repo", "path", "content")).dropDuplicates(["file_id"])


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return _kinds(spark, root).where("kind IS NOT NULL").select("file_id")


def p7_report(spark: SparkSession, root: str) -> DataFrame:
    return _kinds(spark, root).groupBy("repo", "kind").agg(F.count("*").alias("files"))


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return distinct_by(table(spark, root, "documents").select("doc_id", "text"), "doc_id")


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode_documents(_documents(spark, root))


def _capacities(spark: SparkSession, root: str, most: int = 1000) -> list[tuple[int, int]]:
    """The capacities, at most ``most``: every document is packed once for each, so more of them are an error."""
    rows = table(spark, root, "capacities").select("capacity_id", "capacity").distinct().orderBy("capacity_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} capacities")
    return [(r["capacity_id"], r["capacity"]) for r in rows]


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    sizes = cut(_documents(spark, root).select("doc_id", token_count(F.col("text")).alias("tokens")))
    return pack(sizes, _capacities(spark, root), PRODUCTION)


def p9_report(spark: SparkSession, root: str) -> DataFrame:
    return packing_report(p9_containers(spark, root))


def _p10(spark: SparkSession, root: str, replaced: bool) -> DataFrame:
    docs = _documents(spark, root)
    names = known_names(table(spark, root, "contributors"))
    names += learned_given(docs, names)
    return personal_mentions(docs, names, fitted(docs, names), replaced)


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return _p10(spark, root, False)


def p10_redacted(spark: SparkSession, root: str) -> DataFrame:
    return _p10(spark, root, True)


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_indexer, p2_found, p2_terms, p4_found, p4_redacted, p6_found, p6_pairs, p7_found, p7_report, p8_ids, p9_containers, p9_report, p10_found, p10_redacted)}

_EDGE = r"'^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'"
_STRIP = lambda c: f"regexp_replace({c}, {_EDGE})"

_TERMS = f"""
occ AS (
  SELECT DISTINCT 'call' AS field, {_STRIP('target')} AS term, caller AS record, CAST(call_id AS VARCHAR) AS row_id FROM calls
  UNION ALL SELECT DISTINCT 'import', {_STRIP('imported')}, module, CAST(import_id AS VARCHAR) FROM imports
  UNION ALL SELECT DISTINCT 'decorator', {_STRIP(f"regexp_replace({_STRIP('decorator')}, '^@+', '')")}, uri, CAST(seen_at AS VARCHAR) FROM decorators),
good AS (SELECT * FROM occ WHERE term <> '' AND record IS NOT NULL),
tot AS (SELECT field, count(DISTINCT record) AS total FROM good GROUP BY field),
freq AS (
  SELECT field, term, count(DISTINCT (record, row_id)) AS occurrences, count(DISTINCT record) AS records FROM good GROUP BY field, term),
marked AS (
  SELECT field, term, occurrences, records,
         CASE WHEN records < 2 THEN 'rare' WHEN records > total * 0.05 THEN 'common' ELSE 'useful' END AS mark
  FROM freq JOIN tot USING (field))
"""

SQL: dict[str, str] = {
    "p2_terms": f"WITH {_TERMS} SELECT * FROM marked",
    "p2_found": f"WITH {_TERMS} SELECT field, term, mark FROM marked WHERE mark <> 'useful'",
    "p1_indexer": r"""WITH once AS (SELECT DISTINCT run_id, repo, files_indexed, errors FROM index_runs),
        said AS (SELECT DISTINCT repo, regexp_replace(regexp_extract(e, '^([^:]+):', 1), '^(/builds/|[.]/)', '') AS path
                 FROM (SELECT repo, unnest(errors) AS e FROM once)
                 WHERE regexp_matches(e, '(?i)syntax|unexpected end|could not parse|parse error|unterminated|unbalanced'))
        SELECT o.repo, count(*) AS runs, CAST(sum(files_indexed) AS BIGINT) AS files_indexed, coalesce(any_value(s.n), 0) AS reported,
               coalesce(any_value(s.n), 0) / nullif(sum(files_indexed), 0)::DOUBLE AS rate
        FROM once o LEFT JOIN (SELECT repo, count(*) AS n FROM said GROUP BY repo) s ON o.repo = s.repo GROUP BY o.repo""",
}
