"""Functions paired with their documentation (problem 6): an island grammar per language.

The islands are documentation, annotations, signatures and balanced bodies; everything between them is water. Languages with
braces are read as lexer tokens, Python as literals, brackets, colons and line ends.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.functions.lexers import Token, line_of, line_starts, tokens
from structgraph.llm.syntax import language_of

#: What stands in place of documentation; fixed phrases, compared without case and punctuation.
PLACEHOLDERS = set("""
todo|fixme|xxx|tbd|tba|wip|n a|na|none|nil|hack|todo document|todo doc|todo doc write me|todo write me|todo add docs|todo docs|todo add documentation|
todo description|missing docs|missing doc|missing documentation|missing docstring|no docs|no documentation|undocumented|add description|add docs|
add documentation|add docstring|add docstring here|insert description here|insert description|insert docs here|documentation goes here|docs go here|
description goes here|docstring goes here|documentation here|description here|description|docstring|documentation|docs|doc|placeholder|summary|to be documented|
to be done|to do|to be written|to be determined|work in progress|not documented|not documented yet|write me|write docs|write documentation|fill me in|fill in|
fixme document|document me|document this|please document|lorem ipsum|empty|no description|see above|short description|comment|blah|foo|bar
""".replace("\n", "").split("|"))
#: Directives to tools, matched at the start of a line of documentation.
DIRECTIVE = re.compile(
    r"^\W*(?:type:\s*ignore|noqa|nolint|pylint\s*:|pragma\s*:|pragma\s+no|fmt\s*:|yapf\s*:|isort\s*:|mypy\s*:|flake8\s*:|ruff\s*:|pyright\s*:|nosec|bandit\s*:|black\s*:|coverage\s*:|"
    r"doctest\s*:|eslint[-\s]|jshint|jslint|tslint\s*:|tslint[-:]|prettier-ignore|istanbul\s+ignore|c8\s+ignore|v8\s+ignore|@?ts-(?:ignore|expect-error|nocheck|check)|"
    r"@suppress|@?SuppressWarnings|noinspection|checkstyle\s*:|CHECKSTYLE|spotless\s*:|@formatter\s*:|NOSONAR|NOPMD|clang-format\s+(?:on|off)|clang-tidy|cppcheck-suppress|"
    r"NOLINT\w*|coverity\[|LCOV_EXCL\w*|GCOVR?_EXCL\w*|stylelint-|biome-ignore|deno-lint-ignore|webpackChunkName|@vite-ignore|sourceMappingURL|#?region\b|#?endregion\b|lint\s*:|"
    r"\{?@inheritdoc\}?\s*$|@?flow\s*$|@?noflow|go:\w+|rubocop|SPDX-License-Identifier|vim\s*:|-\*-)",
    re.I,
)
#: Parameter and return tags, in the wordings of the common styles.
_TAG = re.compile(r"^\s*(?:[@\\:](?:param|arg|argument|parameter|return|returns|rtype|type|throws|raises|exception|raise|yields?|tparam|retval|brief)\b)(?P<rest>.*)$", re.I | re.S)
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|raises|yields|throws|notes?|examples?|attributes)\s*:?\s*$", re.I)
_RULE = re.compile(r"^\s*[-=~*_#^+.]{2,}\s*$")
#: Words that add nothing to a function's name: articles, auxiliaries and words for the thing itself; fixed.
FILLERS = set("""a an the this that these those it its is are was be been to of for in on at by with from and or as into function method func fn routine procedure
helper subroutine def call calls called implementation implements does do performs perform used use using given some any all one will shall which
""".split())


def words_of(name: str) -> list[str]:
    """Lower-case words of an identifier."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+", name)]


def stem(w: str) -> str:
    """Crude stem under which a word and its inflections agree: plural, third person, past, gerund, agent."""
    w = w.lower()
    for end, put in (("ies", "y"), ("ied", "y"), ("aies", "ay"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("zes", "z"), ("ses", "s"), ("ing", ""), ("ed", ""), ("er", ""), ("or", ""), ("s", "")):
        if w.endswith(end) and len(w) - len(end) >= 2 and not (end == "s" and w.endswith("ss")):
            w = w[: -len(end)] + put
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "aeiouls":
        w = w[:-1]
    if w.endswith("e") and len(w) > 2:
        w = w[:-1]
    return w[:-1] + "i" if w.endswith("y") and len(w) > 2 else w


def same_word(a: str, b: str) -> bool:
    return a == b or stem(a) == stem(b) or len(min(a, b, key=len)) >= 4 and a[: max(4, min(len(a), len(b)) - 1)] == b[: max(4, min(len(a), len(b)) - 1)] and abs(len(a) - len(b)) <= 3


def plain_lines(doc: str) -> list[str]:
    """Lines of a documentation text without comment markers and markup."""
    out = []
    for line in re.split(r"\r\n|\r|\n", doc):
        line = re.sub(r"^\s*(?:/\*+!?|//+[/!<]*|\*+(?!\w)/?|#+)?", "", line)
        line = re.sub(r"\*+/\s*$", "", line)
        out.append(re.sub(r"</?[a-zA-Z][^<>]*>", " ", line).strip())
    return out


_CODE_LINE = re.compile(
    r"^(?:(?:const|let|var|int|long|return|if|for|while|else|def|import|public|private|static|auto|final|void|char|bool|double|float|unsigned|struct|class|function|export|throw|new|delete|break|continue|switch|case)\b.*[;{}():]\s*$|"
    r"[\w.\[\]>*&:-]+(?:\s+[\w*&]+)?\s*(?:[-+*/|&^%]?=(?!=))\s*\S.*;\s*$|[\w.:>-]+\s*\(.*\)\s*[;{]\s*$|[{}\])]+[;,]?\s*$|.*[;{]\s*$|(?:return|break|continue)\b[^.]*;?$|\}\s*else\b.*|[\w.]+\s*=\s*[\w.()\[\]\"']+$|@\w+\(.*\)$)"
)


def is_code(lines: list[str]) -> bool:
    """Whether the lines of a comment are code that was commented out: each of most lines ends or begins as only code does."""
    said = [x for x in lines if x.strip()]
    if not said:
        return False
    hits = sum(bool(_CODE_LINE.match(x.strip())) and not re.match(r"^[A-Z][a-z]+ (?:[a-z]+ ){2,}[^;={}]*[;:]$", x.strip()) for x in said)
    return hits * 2 > len(said)


def says_something(doc: str | None, name: str) -> bool:
    """Whether a documentation text tells more than the function's own name.

    Null or blank texts, placeholders, tool directives, parameter or return tags without a text, rules of punctuation and the
    words of the name with fillers are trivial; so is code that is commented out. Length does not matter.
    """
    if doc is None or not doc.strip():
        return False
    lines = plain_lines(doc)
    kept = []
    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if not re.search(r"\w", line) or DIRECTIVE.match(line) or _SECTION.match(line) or _RULE.match(line):
            continue
        tag = _TAG.match(line)
        if tag:
            rest = tag["rest"]
            kind = line.lstrip()[1:7].lower()
            if kind.startswith(("param", "arg", "tparam")):
                m = re.match(r"^(?:\[[^\]]*\])?\s*(?:\{[^}]*\}\s*)?(?:[\w.\[\]*$]+(?:\s+\w+(?=\s*:))?)?\s*[:-]?\s*(.*)$", rest, re.S)
                rest = m[1] if m else rest
            elif kind.startswith("brief"):
                pass
            else:
                rest = re.sub(r"^\s*(?:\{[^}]*\})?\s*(?:[\w.]+(?=\s*:))?\s*[:-]?\s*", "", rest)
                if kind.startswith(("rtype", "type")):
                    rest = ""
            if re.search(r"\w", rest):
                kept.append(rest)
            continue
        # "name:" or "name: type" under a parameter section, without a text
        m = re.match(r"^\s*\*{0,2}\w+\s*(?:\([^)]*\))?\s*:\s*$", line)
        if m and len(lines) > 1 and any(_SECTION.match(x) for x in lines[: i - 1]):
            continue
        kept.append(line)
    if not kept or is_code([x for x in lines if x.strip()]):
        return False
    text = re.sub(r"\{@\w+\s+([^}]*)\}", r"\1", " ".join(kept))
    flat = " ".join(re.findall(r"\w+", text.lower().replace("'", "")))
    if not flat or flat in PLACEHOLDERS or re.sub(r"^(?:todo|fixme|xxx|wip) ", "", flat) in PLACEHOLDERS:
        return False
    own = words_of(name)
    said = [w for part in re.findall(r"\w+", text) for w in words_of(part)]
    if not said:
        return bool(re.search(r"[^\W\d_]", text))
    whole = "".join(own)
    return any(w not in FILLERS and w != whole and not any(same_word(w, o) for o in own) for w in said)


def islands(text: str, lang: str, toks: list[Token] | None = None) -> tuple[dict[int, str], list[int]]:
    """Documentation islands of a source: the line on which each ends -> its text, annotations below it skipped; and line starts.

    Line comments on consecutive lines, with nothing before them on their lines, are one island. A block comment is an island
    if nothing stands before it on its first line. The end line is that of the last annotation under the comment, if any.
    """
    toks = tokens(text, lang, comments=True) if toks is None else toks
    starts = line_starts(text)
    docs: dict[int, str] = {}
    pend: tuple[int, str, bool] | None = None  # end line, text, is a run of line comments
    first_on_line = True
    i, n = 0, len(toks)
    while i < n:
        kind, body, pos = toks[i]
        if kind == "nl":
            first_on_line = True
            i += 1
            continue
        line = line_of(starts, pos)
        if kind == "comment":
            if first_on_line:
                run = body.startswith("//")
                end = line_of(starts, pos + len(body.rstrip()) - 1)
                if pend and run and pend[2] and pend[0] == line - 1:
                    pend = (end, pend[1] + "\n" + body, True)
                else:
                    pend = (end, body, run)
                docs[pend[0]] = pend[1]
            i += 1
            continue
        if pend and first_on_line and line == pend[0] + 1 and (body == "@" and kind == "op" and i + 1 < n and toks[i + 1][1] != "interface" or body == "[" and i + 1 < n and toks[i + 1][1] == "["):
            # an annotation or attribute: its balanced extent, if it ends its line, moves the island's end
            depth, j, last = 0, i, pos
            while j < n:
                k, b, p = toks[j]
                if k == "open":
                    depth += 1
                elif k == "close":
                    depth -= 1
                elif k == "nl" and depth <= 0:
                    break
                if k != "nl":
                    last = p
                j += 1
            end = line_of(starts, last)
            pend = (end, pend[1], False)
            docs[end] = pend[1]
            i = j
            continue
        pend = None
        first_on_line = False
        i += 1
    return docs, starts


#: What the island grammar of Python stops at: literals, comments, brackets, colons and line ends; all else is water.
_PY_ISLANDS = re.compile(
    r"(?P<str>(?i:\b(?:rb|br|rf|fr|[rbuf]))?(?:\"\"\"(?:\\[\s\S]|(?!\"\"\")[^\\])*(?:\"\"\"|\Z)|'''(?:\\[\s\S]|(?!''')[^\\])*(?:'''|\Z)|\"(?:\\[\s\S]|[^\\\r\n\"])*\"|'(?:\\[\s\S]|[^\\\r\n'])*'))|"
    r"(?P<comment>#[^\r\n]*)|(?P<open>[\[({])|(?P<close>[\])}])|(?P<colon>:)|(?P<join>\\\r?\n)|(?P<nl>\n)"
)
_PY_HEAD = re.compile(r"(?P<lead>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)\s*(?:\[|\()")
_PY_INDENT = re.compile(r"[ \t]*(?![ \t\r\n#]|\Z)")
_QUOTES = re.compile(r"(?i:[ru]?)(\"\"\"|'''|\"|')")


class Function(NamedTuple):
    """A function as its islands give it: signature, text of its documentation or None, and where its body ends."""

    signature: str
    doc: str | None
    end: int


def python_function(text: str, a: int, name: str) -> Function | None:
    """The function ``name`` that begins on the line at ``a``: signature up to its colon, docstring as the first statement, body as far as
    the indentation goes. None if no such function begins there."""
    head = _PY_HEAD.match(text, a)
    if not head or head["name"] != name:
        return None
    indent = len(head["lead"].expandtabs(8))
    depth, signature, doc, started = 0, None, None, False
    end = len(text)
    for m in _PY_ISLANDS.finditer(text, head.end() - 1):
        kind = m.lastgroup
        if signature is None:
            if kind == "open":
                depth += 1
            elif kind == "close":
                depth -= 1
            elif kind == "colon" and depth <= 0:
                signature, at = text[a : m.end()].strip(), m.end()
            continue
        if not started and kind not in ("comment", "nl", "join"):
            started = True
            if kind == "str" and not text[at : m.start()].strip():
                q = _QUOTES.match(m.group())
                doc = m.group()[q.end() : -len(q[1])] if q else None
        if kind == "comment" or kind == "nl":
            at = m.end() if not started and not text[at : m.start()].strip() else at
        if kind == "open":
            depth += 1
        elif kind == "close":
            depth -= 1
        elif kind == "nl" and depth <= 0:
            started = started or bool(text[at : m.start()].strip())
            line = _PY_INDENT.match(text, m.end())
            if line and len(line.group().expandtabs(8)) <= indent:
                end = m.start()
                break
    return Function(signature, doc, end) if signature is not None else None


class Islands:
    """Documentation, signatures and balanced bodies of a source in a language with braces."""

    def __init__(self, text: str, lang: str) -> None:
        toks = tokens(text, lang, comments=True)
        self.text = text
        self.docs, self.starts = islands(text, lang, toks)
        self.toks = [t for t in toks if t[0] not in ("comment", "nl", "pre")]
        self.at = [t[2] for t in self.toks]
        self.pair: dict[int, int] = {}  # open bracket -> its close, by index
        stack: list[int] = []
        for i, t in enumerate(self.toks):
            if t[0] == "open":
                stack.append(i)
            elif t[0] == "close" and stack:
                self.pair[stack.pop()] = i

    def function(self, a: int, name: str) -> Function | None:
        """The function ``name`` that begins on the line at ``a``: its name, balanced parameters, and a balanced body, an arrow with an
        expression, or the semicolon of a declaration. None if its parameters are not balanced."""
        toks, i = self.toks, bisect_left(self.at, a)
        n = len(toks)
        while i < n and not (toks[i][0] == "id" and toks[i][1].lstrip("#") == name):
            if toks[i][1] in ("{", "}", ";"):
                return None
            i = self.pair[i] + 1 if toks[i][1] == "(" and i in self.pair else i + 1  # arguments of an annotation
        while i < n and toks[i][1] != "(":
            if toks[i][1] in ("{", "}", ";") or toks[i][1] == "=>":
                break
            i += 1
        if i < n and toks[i][1] == "(":
            if i not in self.pair:
                return None
            i = self.pair[i] + 1
        while i < n and toks[i][1] not in ("{", ";", "}"):
            i = self.pair[i] + 1 if toks[i][0] == "open" and i in self.pair else i + 1
        if i >= n:
            return Function(self.text[a:].strip(), None, len(self.text))
        signature = self.text[a : self.at[i]].strip()
        if toks[i][1] == "{" and i in self.pair:
            close = self.pair[i]
            return Function(signature, None, self.at[close] + 1)
        return Function(signature, None, self.at[i] + 1)


def pair_docs(functions: DataFrame, files: DataFrame) -> DataFrame:
    """Code and documentation of every function: (uri, name, lang, signature, code, doc), doc being null where there is none or it is trivial.

    ``functions``: uri, name, file, start_line, end_line, docstring, indexed_at; of several rows of a uri the latest counts.
    ``files``: path, content, op_id, file_id; the row with the highest op_id of a path is current. Signature, body and documentation
    are islands of the source: for Python the docstring, for other languages the comment that ends directly above start_line,
    annotations between. Where the index says that a Python function has no docstring, it has none. A function whose file is
    missing or null has neither signature nor code, and a doc only if its docstring is one; where no function of the name
    begins on start_line, the lines up to end_line are its code.

    Plan: texts are shuffled once, by path, which chooses the current ones and lets them meet their functions; the functions of one
    file travel as one array, as a file is bounded by its text.
    """
    latest = functions.where(F.col("uri").isNotNull()).groupBy("uri").agg(F.max_by(F.struct("name", "file", "start_line", "end_line", "docstring"), F.struct("indexed_at", "start_line")).alias("f"))
    per_file = latest.select("uri", "f.*").groupBy("file").agg(F.collect_list(F.struct("uri", "name", "start_line", "end_line", "docstring")).alias("fs"))
    current = files.groupBy("path").agg(F.max_by("content", F.struct("op_id", "file_id")).alias("content"))
    both = per_file.join(current.select(F.col("path").alias("file"), "content"), "file", "left").select("file", "content", "fs")

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [row for path, content, fs in zip(pdf["file"], pdf["content"], pdf["fs"]) for row in _pairs_of(language_of(path), content, fs)]
            yield pd.DataFrame(rows, columns=["uri", "name", "lang", "signature", "code", "doc"], dtype=object)

    return both.mapInPandas(pair, "uri string, name string, lang string, signature string, code string, doc string")


def _pairs_of(lang: str | None, content: str | None, fs: list) -> Iterator[tuple]:
    """Rows of :func:`pair_docs` for the functions ``fs`` of one file."""
    braces = content and lang in ("js", "ts", "java", "c", "cpp")
    found = Islands(content, lang) if braces else None
    starts = found.starts if found else line_starts(content) if content else [0]
    for f in fs:
        name, start, end = f["name"] or "", f["start_line"], f["end_line"]
        known = bool(content) and start is not None and start == start and 1 <= start <= len(starts)
        a = starts[int(start) - 1] if known else 0
        fn = None
        if known:
            fn = found.function(a, name) if found else python_function(content, a, name) if lang == "py" else None
        if lang == "py":
            doc = fn.doc.replace("\r\n", "\n") if fn and fn.doc and f["docstring"] is not None else f["docstring"]
        else:
            doc = found.docs.get(int(start) - 1) if found and start is not None and start == start else None
        if not says_something(doc, name):
            doc = None
        elif lang != "py":
            doc = "\n".join(plain_lines(doc)).strip()
        code = content[a : fn.end].rstrip() if fn else lines_of(content, starts, int(start), end) if known else None
        yield f["uri"], name, lang, fn.signature if fn else None, code, doc


def lines_of(content: str, starts: list[int], start: int, end: int | None) -> str:
    """Source lines ``start`` to ``end``, to the end of the text where there is no end line."""
    stop = starts[int(end)] if end is not None and end == end and int(end) < len(starts) else len(content)
    return content[starts[start - 1] : stop].rstrip("\r\n")
