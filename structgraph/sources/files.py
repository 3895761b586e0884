"""Source trees as DataFrames: scan, dispatch, parse."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.functions.lexers import LANGUAGES
from structgraph.model import PARSED
from structgraph.sources.parse import parse_batches

#: Directories that are never entered, and extensions that are read; fixed values.
SKIP_DIRS = ("__pycache__", ".git", ".hg", ".svn", "node_modules", "venv", ".venv", "env", ".env", ".tox", ".mypy_cache", ".pytest_cache", "dist", "build")
EXTENSIONS = (".py", ".ts", ".tsx", ".js", ".jsx", ".java", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".html", ".htm", ".css", ".json", ".yaml", ".yml", ".toml")


def skipped(path: Column) -> Column:
    """Whether a directory of the path is one that is skipped, or ends in ``.egg-info``."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: d.isin(*SKIP_DIRS) | d.endswith(".egg-info"))


def language(path: Column) -> Column:
    """Language by the lower-cased extension, null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.when(F.lit(False), "")
    for e, lang in LANGUAGES.items():
        out = out.when(ext == e, lang)
    return out


def read_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, content, modified_at) of the files below ``root``: paths relative to it, contents decoded as UTF-8. The directory listing and the
    reads are distributed; skipped directories and other extensions (compared with case) are dropped before a file is read.
    """
    wanted = F.lit(False)
    for e in extensions:
        wanted = wanted | F.col("path").endswith(e)
    # the filter on the path prunes before contents are loaded
    return tree_files(spark, root).where(wanted & ~skipped(F.col("path"))).select("path", F.decode("content", "UTF-8").alias("content"), "modified_at")


def tree_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified_at, content) of everything below ``root``, paths relative to it; contents are bytes and read only where asked for."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    prefix = base if "://" in base or base.startswith("file:") else f"file:{base}"
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "file:/"), "^" + _quoted(prefix.replace("file:///", "file:/")) + "/", "")
    return raw.select(rel.alias("path"), "length", F.col("modificationTime").alias("modified_at"), "content")


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() or c in "/_:" else "\\" + c for c in s)


def parse_files(files: DataFrame) -> DataFrame:
    """The records of ``files`` (path, content): one row per row, with a parse_error instead of a failure. No shuffle."""
    return files.select("path", "content").mapInPandas(parse_batches, PARSED)


def index_stats(parsed: DataFrame, quads: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row about an index run: (files_indexed, total_triples, resolved_calls, files_failed); the errors themselves are in :func:`index_errors`."""
    one = F.lit(1).alias("one")
    a = parsed.agg(F.count_if(F.col("parse_error").isNull()).alias("files_indexed"), F.count("parse_error").alias("files_failed")).select("*", one)
    b, c = quads.agg(F.count("*").alias("total_triples")).select("*", one), resolved.agg(F.count("*").alias("resolved_calls")).select("*", one)
    return a.join(b, "one").join(c, "one").select("files_indexed", "total_triples", "resolved_calls", "files_failed")


def index_errors(parsed: DataFrame) -> DataFrame:
    """Files that were not read whole: (path, error)."""
    return parsed.where("parse_error IS NOT NULL").select("path", F.col("parse_error").alias("error"))
