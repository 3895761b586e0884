"""Files that nobody wrote by hand here: generated, minified, vendored, data saved as code (problem 7).

Layout statistics per file, held against thresholds per language, come first. What looks like hand-written code is then judged by
what its leading comment and its path declare, and by whether its body lies in several repositories: copies and much generated
code have the layout of code, so no statistic of it can tell them.
"""

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.llm.syntax import language_of
from structgraph.plans.lineage import stored


@dataclass(frozen=True)
class Thresholds:
    """Bounds above (or below) which a layout is not that of a person. Shares are of the text without its leading comment."""

    max_line: int = 400  # a minified text has a line at least this long ...
    mean_line: float = 120.0  # ... or lines this long on average ...
    whitespace: float = 0.09  # ... and at most this share of white space
    longest_word_line: float = 0.12  # white space in the longest line: prose and lists of words have more
    numeric: float = 0.55  # numbers among all words and numbers
    numbers: int = 60  # and at least so many of them
    encoded: float = 0.45  # characters in long encoded runs
    shape: float = 0.72  # lines that have one of the two commonest shapes
    shape_lines: int = 5  # among at least so many lines
    alnum_low: float = 0.38  # least share of letters and digits ...
    alnum_high: float = 0.88  # ... and greatest, of a text of at least so many characters
    alnum_size: int = 400


#: Tuned per language, each bound beyond what hand-written files of the language show (a thousandth of them at most): how much white
#: space indentation brings, how many numbers and signs its code holds, how long its lines are. Style sheets and configuration repeat line
#: shapes by nature, and data languages hold numbers and codes.
TUNED = {
    "py": Thresholds(whitespace=0.085, numeric=0.55, shape=0.72, alnum_low=0.40, alnum_high=0.88),
    "js": Thresholds(whitespace=0.090, numeric=0.52, shape=0.74, alnum_low=0.42, alnum_high=0.85),
    "ts": Thresholds(whitespace=0.075, numeric=0.50, shape=0.74, alnum_low=0.42, alnum_high=0.86),
    "java": Thresholds(whitespace=0.070, mean_line=110.0, numeric=0.48, shape=0.75, alnum_low=0.36, alnum_high=0.90),
    "c": Thresholds(whitespace=0.085, mean_line=110.0, numeric=0.50, encoded=0.40, shape=0.76, alnum_low=0.34, alnum_high=0.86),
    "cpp": Thresholds(whitespace=0.085, numeric=0.50, encoded=0.40, shape=0.76, alnum_low=0.36, alnum_high=0.86),
    "css": Thresholds(max_line=200, whitespace=0.05, numeric=1.1, shape=1.1, alnum_low=0.40, alnum_high=0.85),
    "json": Thresholds(max_line=10**9, mean_line=10**9, encoded=1.1, numeric=0.8, numbers=400, shape=1.1, alnum_low=0.15, alnum_high=0.95),
    "yaml": Thresholds(max_line=10**9, mean_line=10**9, encoded=1.1, numeric=0.8, numbers=400, shape=1.1, alnum_low=0.20, alnum_high=0.97),
    "toml": Thresholds(max_line=10**9, mean_line=10**9, encoded=1.1, numeric=0.8, numbers=400, shape=1.1, alnum_low=0.20, alnum_high=0.97),
    "html": Thresholds(shape=1.1, alnum_low=0.25, alnum_high=0.95),
}

#: What a tool writes at the head of its output, in several languages; fixed phrases.
GENERATED = re.compile(
    r"\bcode generated by\b|^\W*generated (?:by|from|with|using)\b|^\W*generated\s*:\s*[\dT:-]+|@generated\b|<auto-?generated|^\W*auto-?\s?generated\b|"
    r"\bfile (?:is|was|has been) (?:auto(?:matically)?[- ]?)?(?:generated|produced|created|written) by\b|\b(?:is|was) auto(?:matically)?[- ]generated\b|\bautomatically generated\b|"
    r"^\W*machine[- ](?:made|generated)\b|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bfichier (?:produit|g[ée]n[ée]r[ée])|\bne pas (?:modifier|[ée]diter)\b|"
    r"\b(?:archivo|fichero) (?:generado|producido)|\bgenerado (?:por|autom)|\bgerado (?:por|autom)|\bgenerato (?:da|autom)|\bmanual changes will be overwritten|\bchanges are lost on the next run|"
    r"\bregenerate (?:it )?with\b|^\W*generator\s*:|\bautogenerated file\b|\b(?:THIS FILE IS )?GENERATED (?:FILE|CODE)\b|自动生成|自動生成|請勿編輯|请勿(?:编辑|修改)|編集しないで",
    re.I | re.M,
)
#: Comments that only speak of the above.
_SPEAKS = re.compile(r"\bused to be\b|\bby hand now\b|\bno longer\b|\bnot generated\b|\bwrites the\b|\bemits\b|\bthe reader depends\b|\bcompared with\b|\bhere, not\b|\bnotice into\b", re.I)
#: Heads of library files: a name with a version and a licence, release or contributors.
VENDORED = re.compile(
    r"@licen[cs]e\s+\S+\s+v?\d+\.\d+|\bv?\d+\.\d+(?:\.\d+)?\S*\s+(?:\(c\)|©|copyright)|\bupstream\s*:|\bunmodified copy\b|\bvendored (?:from|copy)\b|\bv?\d+\.\d+\.\d+\s+[-–—|]\s*(?:released under|licen[cs]ed|https?:)|"
    r"\brelease[d]?\s+v?\d+\.\d+(?:\.\d+)?\b|^/\*!\s*\S+\s+v?\d+\.\d+|\bimported from \S+ v?\d+\.\d+|\bcopied (?:verbatim )?from https?:",
    re.I | re.M,
)
#: Directories that only package managers and copies use, and those that also hold other things.
THIRD_PARTY = {"node_modules", "site-packages", "bower_components", "third_party", "third-party", "thirdparty", "3rdparty", "jspm_packages", "vendor", "vendors", "vendored", "pods"}
MAYBE_THIRD_PARTY = {"deps", "contrib", "external", "externals", "ext", "static", "helpers", "libs", "assets", "public"}
_LOCK = re.compile(r"(?:^|[.-])lock\.(?:json|ya?ml|toml)$|^(?:package-lock|npm-shrinkwrap)\.json$|^pnpm-lock\.ya?ml$|^(?:poetry|cargo|uv|pdm)\.lock$", re.I)
_TOOL = re.compile(r"_pb2(?:_grpc)?\.pyi?$|\.pb\.(?:cc|h|go)$|\.g\.(?:cs|ts|dart)$|\.designer\.\w+$", re.I)
_MIN = re.compile(r"[.-]min\.(?:js|css|mjs)$", re.I)
_VERSIONED = re.compile(r"^(?:lib[_-])?[a-z][a-z0-9]*[-_.@]v?\d+\.\d+(?:\.\d+)?\.\w+$", re.I)
_LEAD = re.compile(r"\A(?:﻿|\s|#(?![a-z]+\s*[<\"])[^\n]*(?:\n|\Z)|//[^\n]*(?:\n|\Z)|/\*[\s\S]*?\*/|<!--[\s\S]*?-->|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')*")
_NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0[xX][\da-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[uUlLfFdD]*(?![\w])")
_QUOTED, _DIGITS = re.compile(r"'[^'\n]*'|\"[^\"\n]*\""), re.compile(r"\d+")
_NAMES = re.compile(r"(?<![A-Za-z])[A-Za-z]++(?:_[A-Za-z]++)+|(?<![\w])_?[A-Za-z]++(?=_?\d)|[A-Z][a-z]++(?:[A-Z][a-z]++)+")
_SIGNS = re.compile(r"[^\w\n]+")
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]*KEY[A-Z ]*-----[\s\S]*?(?:-----END [A-Z ]*-----|\Z)")
_WORD = re.compile(r"[^\W\d]\w*")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{48,}+|(?:\\x[0-9a-fA-F]{2}){16,}|(?:0x[0-9a-fA-F]{2},\s*){16,}")


_ALNUM = bytes(c for c in range(128) if chr(c).isalnum())


def _letters_and_digits(body: str) -> int:
    return len(body) - len(body.encode().translate(None, _ALNUM)) if body.isascii() else sum(map(str.isalnum, body))


def layout(text: str) -> dict[str, float]:
    """Layout statistics of a text, its leading comment cut off."""
    body = text[_LEAD.match(text).end() :]
    body = _KEY_BLOCK.sub("", body)  # a key in a file does not make the file a blob
    n = len(body)
    if not n:
        return {"n": 0, "max_line": 0, "mean_line": 0.0, "whitespace": 1.0, "line_space": 1.0, "alnum": 0.0, "numeric": 0.0, "numbers": 0, "encoded": 0.0, "shape": 0.0, "lines": 0}
    lines = [x for x in body.splitlines() if x.strip()]
    longest = max(lines, key=len, default="")
    spaces = n - len("".join(body.split()))
    numbers = len(_NUMBER.findall(body))
    words = sum(len(w) < 48 for w in _WORD.findall(body))
    encoded = sum(len(m) for m in _RUN.findall(body) if len(set(m)) > 12 and (re.search(r"\d", m) and re.search(r"[A-Za-z]", m)))
    # the shape of a line: quoted texts, numbers and compound names made alike, signs dropped
    plain = _SIGNS.sub(" ", _NAMES.sub("w", _DIGITS.sub("0", _QUOTED.sub("S", body))))
    shapes = Counter(x for x in plain.split("\n") if len(x) > 2)
    common = sum(k for _, k in shapes.most_common(2))
    full = sum(shapes.values())
    return {
        "n": n, "max_line": len(longest), "mean_line": sum(map(len, lines)) / max(1, len(lines)), "whitespace": spaces / n,
        "line_space": sum(map(str.isspace, longest.strip())) / max(1, len(longest)), "alnum": _letters_and_digits(body) / n, "numeric": numbers / max(1, numbers + words), "numbers": numbers,
        "encoded": encoded / n, "shape": common / max(1, full), "lines": full,
    }


def head_comment(text: str) -> str:
    """The comments and blank lines a text begins with."""
    return text[: _LEAD.match(text).end()]


def _locks(text: str) -> bool:
    """Whether a JSON text is a lock file by its own key, wherever that stands; one of a nested object says nothing."""
    if '"lockfileVersion"' not in text:
        return False
    try:
        d = json.loads(text.removeprefix("\ufeff"))
    except (ValueError, RecursionError):
        return bool(re.search(r'"lockfileVersion"\s*:\s*"?\d', text))
    return isinstance(d, dict) and "lockfileVersion" in d


def kind_by_layout(text: str, lang: str | None) -> str | None:
    """'minified', 'data' or 'generated' where the layout says so."""
    t = TUNED.get(lang or "", Thresholds())
    s = layout(text)
    if s["n"] == 0:
        return None
    if (s["max_line"] >= t.max_line or s["mean_line"] >= t.mean_line and s["n"] > 300) and s["line_space"] <= t.longest_word_line and s["whitespace"] <= t.whitespace and s["encoded"] < t.encoded:
        return "minified"
    if lang == "json" and _locks(text):
        return "generated"
    if s["encoded"] >= t.encoded and s["n"] > 200 or s["numeric"] >= t.numeric and s["numbers"] >= t.numbers:
        return "data"
    if s["n"] >= t.alnum_size and not t.alnum_low <= s["alnum"] <= t.alnum_high:
        return "data"
    if s["shape"] >= t.shape and s["lines"] >= t.shape_lines and s["numbers"] >= s["lines"] * 0.4:
        return "generated"
    return None


def kind_by_head(text: str) -> str | None:
    """What the leading comment declares, unless it merely speaks of generators or libraries."""
    head = head_comment(text)
    if not head.strip():
        return None
    said = "\n".join(x for x in head.splitlines() if not _SPEAKS.search(x))
    if GENERATED.search(said):
        return "generated"
    return "vendored" if VENDORED.search(said) else None


def kind_by_path(path: str) -> str | None:
    parts = path.lower().split("/")
    name, dirs = parts[-1], parts[2:-1]
    if _LOCK.search(name) or _TOOL.search(name):
        return "generated"
    if _MIN.search(name):
        return "minified"
    for i, d in enumerate(dirs):
        # a copy lies below such a directory, in one of its own or as a file with a version
        if d in THIRD_PARTY and (i < len(dirs) - 1 or _VERSIONED.match(name) or d in ("node_modules", "site-packages", "bower_components")):
            return "vendored"
        if d in MAYBE_THIRD_PARTY and (i < len(dirs) - 1 and dirs[-1] == re.sub(r"[-_.@]?v?\d[\d.]*$", "", dirs[-1]) and name.split(".")[0] in ("index", "main", "core", "mod", "init", dirs[-1]) or _VERSIONED.match(name)):
            return "vendored"
    return "vendored" if _VERSIONED.match(name) else None


def body_hash(text: str) -> int | None:
    """64-bit hash of a body without its leading comment and white space, signed; None for bodies too short to tell."""
    body = re.sub(r"\s+", "", text[_LEAD.match(text).end() :])
    if len(body) < 200:
        return None
    return xxhash.xxh3_64_intdigest(body.encode("utf-8", "surrogatepass")) - (1 << 63)


def file_kinds(files: DataFrame, min_repos: int = 2) -> DataFrame:
    """(file_id, repo, path, kind) of every row of ``files`` (file_id, repo, path, content), kind being null for hand-written
    files, else 'generated', 'minified', 'vendored' or 'data'.

    Order of evidence: layout, leading comment, path, then bodies of code that lie in at least ``min_repos`` repositories.
    Null content, blank files and files with nothing but comments are hand-written unless head or path say otherwise; null
    paths count as no evidence. Repeated rows come out repeated.

    Plan: one Arrow pass without a shuffle gives the kind and a body hash, which are stored, as they are used three times; copies are then counted on (hash, repo) pairs only,
    combined before the shuffle, so a library that a third of all repositories carry costs each mapper one row.
    """

    @F.pandas_udf("struct<kind:string,body:bigint>")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for paths, contents in batches:
            kinds, bodies = [], []
            for p, c in zip(paths, contents):
                lang = language_of(p)
                k = (kind_by_layout(c, lang) or kind_by_head(c)) if c else None
                kinds.append(k or (kind_by_path(p) if p and c and c.strip() else None))
                bodies.append(body_hash(c) if c and lang in ("py", "js", "ts", "java", "c", "cpp") else None)
            yield pd.DataFrame({"kind": pd.Series(kinds, dtype=object), "body": pd.Series(bodies, dtype="Int64")})

    judged = stored(files.select("file_id", "repo", "path", judge("path", "content").alias("j")).select("file_id", "repo", "path", "j.kind", "j.body"), "judged")
    open_ = judged.where("kind IS NULL AND body IS NOT NULL").select("body").distinct()
    spread = judged.where("body IS NOT NULL").select("body", "repo").distinct().join(open_, "body", "left_semi").groupBy("body").count().where(F.col("count") >= min_repos).select("body", F.lit(True).alias("copied"))
    return judged.join(spread, "body", "left").select("file_id", "repo", "path", F.coalesce("kind", F.when(F.col("copied"), "vendored")).alias("kind"))
