"""Source refactoring over file versions, with undo.

A file table is (path, content, op_id, label): versions of files, the highest op_id of a path being current. Operations append
versions; undo drops those of the newest operation. Nothing is overwritten in place.
"""

import difflib
import io
import tokenize

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.functions.lexers import LANGUAGES, tokens
from structgraph.model import CodeGraph
from structgraph.functions.text import path_of_uri

#: Operations whose earlier versions are kept.
UNDO_DEPTH = 50


def affected_files(g: CodeGraph, name: str) -> DataFrame:
    """Files that define ``name``, call exactly it, or import it: (path)."""
    parts = [
        g.entities.where(F.col("name") == name).select(path_of_uri(F.col("uri")).alias("path")),
        g.calls.where(F.col("target") == name).select(path_of_uri(F.col("caller")).alias("path")),
        g.imports.where((F.col("name") == name) | F.col("name").endswith(f".{name}")).select(path_of_uri(F.col("module")).alias("path")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("path <> ''").distinct()


def find_entity(g: CodeGraph, name: str) -> DataFrame:
    """The entity of a name with lines, the least uri of several: (uri, file, start_line, end_line); the end defaults to the start."""
    return g.entities.where((F.col("name") == name) & F.col("start_line").isNotNull()).select("uri", "file", "start_line", F.coalesce("end_line", "start_line").alias("end_line")).orderBy("uri").limit(1)


def current_files(files: DataFrame) -> DataFrame:
    """Current version of every path, once: (path, content, op_id, label). One shuffle by path, combined before it; what nobody asks for
    of a version is not read."""
    of = lambda c: F.max_by(c, "op_id").alias(c)
    return files.groupBy("path").agg(of("content"), F.max("op_id").alias("op_id"), of("label"))


def file_lines(files: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """Lines of the current versions of all files: (path, line_no, text, shown); bounds are clamped, null and empty contents give none."""
    body = F.regexp_replace("content", r"\r?\n\z", "")
    lines = current_files(files).where("content <> ''").select("path", F.posexplode(F.split(body, r"\r?\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).cast("bigint").alias("line_no"), "text")
    lines = lines.where(F.col("line_no") >= max(1, start))
    if end is not None:
        lines = lines.where(F.col("line_no") <= end)
    return lines.withColumn("shown", F.format_string("%4d | %s", "line_no", "text"))


def source_lines(files: DataFrame, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    """Lines of the current version of a file: (line_no, text, shown), as in :func:`file_lines`; an unknown path gives none."""
    return file_lines(files.where(F.col("path") == path), start, end).drop("path")


def identifiers(text: str, language: str, name: str) -> list[tuple[int, int]]:
    """(start, end) of every token of ``text`` that is exactly the identifier ``name``; comments and literals are left alone, but
    the expressions inside Python's f-strings and template literals count."""
    if language == "py":
        try:
            starts = [0]
            for line in text.splitlines(keepends=True):
                starts.append(starts[-1] + len(line))
            return [(starts[t.start[0] - 1] + t.start[1], starts[t.end[0] - 1] + t.end[1]) for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.NAME and t.string == name]
        except (tokenize.TokenError, SyntaxError, IndentationError):
            pass
    return [(pos, pos + len(body)) for kind, body, pos in tokens(text, language) if kind == "id" and body == name]


def renamed(text: str | None, path: str, old: str, new: str) -> tuple[str | None, int]:
    """``text`` with the identifier ``old`` replaced, and how often; unknown languages and null texts stay as they are."""
    lang = LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if path else None
    if text is None or lang in (None, "html", "yaml"):
        return text, 0
    spots = identifiers(text, lang, old)
    for a, b in reversed(spots):
        text = text[:a] + new + text[b:]
    return text, len(spots)


def compute_rename(g: CodeGraph, files: DataFrame, old: str, new: str) -> DataFrame:
    """New contents of the affected files: (path, content, new_content, replacements), only files with replacements."""
    hit = current_files(files).join(affected_files(g, old), "path", "left_semi").select("path", "content")

    def go(batches):
        for pdf in batches:
            done = [renamed(c, p, old, new) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame({"path": pdf["path"], "content": pdf["content"], "new_content": pd.Series([d[0] for d in done], dtype=object), "replacements": [d[1] for d in done]})

    return hit.mapInPandas(go, "path string, content string, new_content string, replacements bigint").where("replacements > 0")


def preview_rename(g: CodeGraph, files: DataFrame, old: str, new: str) -> DataFrame:
    """Unified diffs of a rename: (path, replacements, diff)."""

    @F.pandas_udf("string")
    def diff(path: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["".join(difflib.unified_diff(x.splitlines(True), y.splitlines(True), f"a/{p}", f"b/{p}")) for p, x, y in zip(path, a, b)], dtype=object)

    return compute_rename(g, files, old, new).select("path", "replacements", diff("path", "content", "new_content").alias("diff"))


def with_versions(files: DataFrame, changed: DataFrame, label: str) -> DataFrame:
    """``files`` with a new version of each row of ``changed`` (path, content), all under one new op_id."""
    last = files.agg(F.coalesce(F.max("op_id"), F.lit(0))).first()[0]
    return files.unionByName(changed.select("path", "content", F.lit(last + 1).cast("bigint").alias("op_id"), F.lit(label).alias("label")))


def rename_symbol(g: CodeGraph, files: DataFrame, old: str, new: str) -> DataFrame:
    return with_versions(files, compute_rename(g, files, old, new).select("path", F.col("new_content").alias("content")), f"rename {old} -> {new}")


def _edited(files: DataFrame, path: str, edit) -> DataFrame:
    @F.pandas_udf("string")
    def apply(contents: pd.Series) -> pd.Series:
        return pd.Series(["".join(edit((c or "").splitlines(True))) for c in contents], dtype=object)

    return current_files(files).where(F.col("path") == path).select("path", apply("content").alias("content"))


def _block(code: str) -> list[str]:
    return (code if code.endswith("\n") else code + "\n").splitlines(True)


def insert_code(files: DataFrame, path: str, line: int, code: str, position: str = "after") -> DataFrame:
    """A version of ``path`` with ``code`` before or after a 1-based line; lines outside the file mean its ends."""
    if position not in ("before", "after"):
        raise ValueError("position is 'before' or 'after'")

    def edit(lines: list[str]) -> list[str]:
        at = max(0, min(len(lines), line - 1 if position == "before" else line))
        head = lines[:at]
        if head and not head[-1].endswith("\n"):
            head[-1] += "\n"
        return head + _block(code) + lines[at:]

    return with_versions(files, _edited(files, path, edit), f"insert into {path}")


def replace_lines(files: DataFrame, path: str, start: int, end: int, code: str) -> DataFrame:
    """A version of ``path`` with lines start..end (1-based, inclusive) replaced by ``code``."""
    if start < 1 or end < start:
        raise ValueError("lines are 1-based and in order")
    return with_versions(files, _edited(files, path, lambda lines: lines[: start - 1] + _block(code) + lines[end:]), f"replace in {path}")


def replace_entity(g: CodeGraph, files: DataFrame, name: str, code: str) -> DataFrame:
    """A version with the lines of an entity replaced; an unknown name is an error."""
    row = find_entity(g, name).first()
    if row is None:
        raise ValueError(f"no entity named {name!r}")
    return replace_lines(files, row["file"], row["start_line"], row["end_line"], code)


def add_function(g: CodeGraph, files: DataFrame, path: str, code: str, after_entity: str | None = None, at_line: int | None = None) -> DataFrame:
    """A version of ``path`` with a function added: at a line, else after an entity, else at the end; a blank line goes before it."""
    line = at_line
    if line is None and after_entity is not None:
        row = find_entity(g, after_entity).first()
        if row is None:
            raise ValueError(f"no entity named {after_entity!r}")
        line = row["end_line"]
    return insert_code(files, path, 1 << 30 if line is None else line, "\n" + code)


def undo_last(files: DataFrame) -> DataFrame:
    """``files`` without the versions of the newest operation; without an operation (op_id above 0) nothing changes."""
    last = files.agg(F.max("op_id")).first()[0]
    return files if not last else files.where(F.col("op_id") < last)


def undo_history(files: DataFrame, depth: int = UNDO_DEPTH) -> DataFrame:
    """The latest operations, newest first: (op_id, label, files), at most ``depth``."""
    return files.where("op_id > 0").groupBy("op_id").agg(F.max("label").alias("label"), F.count_distinct("path").alias("files")).orderBy(F.desc("op_id")).limit(depth)
