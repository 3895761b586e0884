"""Tokens of source files, by language, with the faults a lexer can see.

A token is ``(kind, text, start)``; kinds are id, num, str, op, open, close, nl, comment, pre (a preprocessor line), regex and
err. White space gives no token. ``err`` is a fault: an unterminated literal or comment, or a character the language does not have.
"""

import re
from bisect import bisect_right
from functools import lru_cache

Token = tuple[str, str, int]

#: Extension -> language, a fixed list of what is handled.
LANGUAGES = {
    "py": "py", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "ts", "tsx": "ts", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "css": "css", "html": "html", "htm": "html",
}

_ID = r"[^\W\d]\w*"
_LINE = r"(?:\\(?:\r\n|[\s\S])|[^\\\r\n{q}])*"  # inside a one-line literal that ends at {q}
_one = lambda q: q + _LINE.replace("{q}", q)
_COMMON_OPEN = r"(?P<open>[\[({])|(?P<close>[\])}])"
_NUM_C = r"(?:0[xX][\da-fA-F_'.]+(?:[pP][+-]?\d+)?|0[bB][01_']+|(?:\d[\d_']*)?\.\d[\d_']*(?:[eE][+-]?\d+)?|\d[\d_']*\.?(?:[eE][+-]?\d+)?)[uUlLfFdDnzZ]*"
_BLOCK = r"/\*[\s\S]*?\*/"
_OPS_JS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\*\*|[-+*/%&|^]=|<<|>>|[-+*/%&|^!~?:=<>,;.@]"
_OPS_JAVA = r">>>=|\.\.\.|<<=|>>=|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|<<|[-+*/%&|^!~?:=<>,;.@]"
_OPS_C = r"<=>|\.\.\.|<<=|>>=|->\*|->|::|\.\*|==|!=|<=|>=|&&|\|\||\+\+|--|##|[-+*/%&|^]=|<<|[-+*/%&|^!~?:=<>,;.#]"
_OPS_PY = r"\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\*\*|//|>>|<<|==|!=|<=|>=|[-+*/%&|^@]=|[-+*/%&|^~<>=.,:;@]"


#: Names of the languages in which a literal may begin with letters end before a quote here; they are looked at again later.
_EARLY_ID = {"py": r"[^\W\d]\w*+(?![\"'])", "c": r"[^\W\d]\w*+(?![\"'])", "cpp": r"[^\W\d]\w*+(?![\"'])", "java": r"[^\W\d][\w$]*+", "js": r"[^\W\d][\w$]*+", "ts": r"[^\W\d][\w$]*+"}


@lru_cache(None)
def _master(lang: str, comments: bool) -> re.Pattern:
    """One expression for a token and the white space before it (and the comments, where they are not asked for)."""
    nl = r"(?P<nl>\r?\n|\r)"
    space = r"[^\S\r\n]++|\\\r?\n|﻿"
    tail = r"(?P<err>[\s\S])"
    if lang == "py":
        quote = r"(?i:rb|br|rf|fr|rt|tr|[rbuft])?"
        triple = rf"{quote}\"\"\"(?:\\[\s\S]|(?!\"\"\")[^\\])*\"\"\"|{quote}'''(?:\\[\s\S]|(?!''')[^\\])*'''"
        single = rf"{quote}{_one(chr(34))}\"|{quote}{_one(chr(39))}'"
        bad = rf"{quote}(?:\"|')"
        num = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)[jJ]?"
        parts = [nl, r"(?P<comment>#[^\r\n]*)", rf"(?P<str>{triple}|(?!{quote}(?:\"\"\"|'''))(?:{single}))", rf"(?P<unclosed>{bad})", rf"(?P<num>{num})", rf"(?P<id>{_ID})", _COMMON_OPEN, rf"(?P<op>{_OPS_PY})"]
    elif lang in ("js", "ts"):
        parts = [nl, rf"(?P<comment>//[^\r\n]*|{_BLOCK}|\A#![^\r\n]*)", r"(?P<badcomment>/\*)", rf"(?P<str>{_one(chr(34))}\"|{_one(chr(39))}')", r"(?P<unclosed>[\"'])", r"(?P<tick>`)",
                 rf"(?P<num>{_NUM_C.replace(chr(39), '')})", r"(?P<id>#?[^\W\d][\w$]*|#?\$[\w$]*)", _COMMON_OPEN, r"(?P<slash>/=?)", rf"(?P<op>{_OPS_JS})"]
    elif lang == "java":
        parts = [nl, rf"(?P<comment>//[^\r\n]*|{_BLOCK})", r"(?P<badcomment>/\*)", r'(?P<str>"""[^\S\r\n]*\r?\n(?:\\[\s\S]|(?!""")[^\\])*"""|(?!""")"(?:\\[^\r\n]|[^\\\r\n"])*"|\'(?:\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.|[^\\\'\r\n])\')', r"(?P<unclosed>[\"'])",
                 rf"(?P<num>{_NUM_C.replace(chr(39), '')})", r"(?P<id>[^\W\d][\w$]*|\$[\w$]*)", _COMMON_OPEN, rf"(?P<op>{_OPS_JAVA})"]
    elif lang in ("c", "cpp"):
        raw = r'(?:u8|[uUL])?R"(?P<delim>[^()\\\s]{0,16})\([\s\S]*?\)(?P=delim)"|' if lang == "cpp" else ""
        parts = [nl, rf"(?P<comment>//[^\r\n]*|{_BLOCK})", r"(?P<badcomment>/\*)", r"(?P<pre>(?:(?<=\n)|\A|(?<=\n[ \t])|(?<=\n[ \t]{2})|(?<=\n[ \t]{4}))#[^\S\r\n]*\w+(?:\\\r?\n|/\*[\s\S]*?\*/|(?!/[/*])[^\r\n])*|(?:(?<=\n)|\A)#[^\S\r\n]*(?=\r?\n))",
                 rf"(?P<str>{raw}(?:u8|[uUL])?(?:{_one(chr(34))}\"|{_one(chr(39))}'))", r"(?P<unclosed>(?:u8|[uUL])?[\"'])", rf"(?P<num>{_NUM_C})", rf"(?P<id>{_ID})", _COMMON_OPEN, rf"(?P<op>{_OPS_C})"]
    elif lang == "css":
        parts = [nl, rf"(?P<comment>{_BLOCK}|<!--|-->)", r"(?P<badcomment>/\*)", rf"(?P<str>url\([^\"'()\s]*\)|{_one(chr(34))}\"|{_one(chr(39))}')", r"(?P<unclosed>[\"'])",
                 r"(?P<num>[+-]?(?:\d*\.)?\d+(?:[eE][+-]?\d+)?(?:%|[a-zA-Z]+)?)", r"(?P<id>(?:@|#|--)?-?(?:[^\W\d]|\\.)(?:[\w-]|\\.)*|#[\w-]+)", _COMMON_OPEN, r"(?P<op>[*+>~=|^$:;,.!/&%<-])"]
    elif lang == "json":
        parts = [nl, r'(?P<str>"(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})|[^"\\\x00-\x1f])*")', r"(?P<unclosed>\")", r"(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))", r"(?P<id>true|false|null)(?!\w)", _COMMON_OPEN, r"(?P<op>[,:])"]
    elif lang == "toml":
        parts = [nl, r"(?P<comment>#[^\r\n]*)", r'(?P<str>"""(?:\\[\s\S]|(?!""")[^\\])*"{3,5}|\'\'\'[\s\S]*?\'{3,5}|(?!""")"(?:\\[^\r\n]|[^\\\r\n"])*"|(?!\'\'\')\'[^\'\r\n]*\')', r"(?P<unclosed>[\"'])", r"(?P<id>[\w+.:-]+)", _COMMON_OPEN, r"(?P<op>[=,])"]
    else:
        raise ValueError(f"no lexer for {lang}")
    if lang in _EARLY_ID:
        # the commonest tokens first: names that are no prefix of a literal, brackets and single signs
        parts = [rf"(?P<name>{_EARLY_ID[lang]})", r"(?P<sign>[,;](?!;)|=(?![=>])|\.(?![.\d*]))", *[x for x in parts if x == _COMMON_OPEN], *[x for x in parts if x != _COMMON_OPEN]]
    notes = [x[len("(?P<comment>") : -1] for x in parts if x.startswith("(?P<comment>")]
    if not comments:
        parts = [x for x in parts if not x.startswith("(?P<comment>")]
    skipped = "|".join([space, *(notes if not comments else [])])
    return re.compile(f"(?:{skipped})*+(?:{'|'.join([*parts, tail])})?+")


_REGEX = re.compile(r"/(?![*/])(?:\\[^\r\n]|\[(?:\\[^\r\n]|[^\]\\\r\n])*\]|[^/\\\[\r\n])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*(?P<end>`|\$\{)?")
#: Groups that are tokens without a further look, with their kinds.
_PLAIN = {"name": "id", "sign": "op", "id": "id", "num": "num", "op": "op", "str": "str", "pre": "pre"}
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}


def tokens(text: str, lang: str, comments: bool = False) -> list[Token]:
    """Tokens of ``text``; comments only on demand. Works in one pass and never fails: what fits nothing is an err token."""
    out: list[Token] = []
    put, known = out.append, _PLAIN.get
    match = _master(lang, comments).match
    script = lang in ("js", "ts")
    pos, n = 0, len(text)
    last: Token | None = None
    templates: list[int] = []  # bracket depth at which each open ${ ends
    depth = 0
    while pos < n:
        m = match(text, pos)
        kind = m.lastgroup
        if kind is None:  # nothing but white space is left
            break
        start, pos = m.start(kind), m.end()
        plain = known(kind)
        if plain:
            last = (plain, text[start:pos], start)
            put(last)
            continue
        if kind == "nl" or kind == "comment":
            put((kind, text[start:pos], start))
            continue
        if kind == "unclosed":
            end = text.find("\n", start)
            put(("err", "unterminated literal", start))
            pos = n if end < 0 else end
            last = None
            continue
        if kind == "badcomment":
            put(("err", "unterminated comment", start))
            break
        if kind == "slash":
            operand = last is not None and (last[0] in ("num", "str", "close", "regex") or last[0] == "id" and last[1] not in _BEFORE_REGEX)
            r = None if operand else _REGEX.match(text, start)
            kind = "op"
            if r:
                kind, pos = "regex", r.end()
        if kind == "tick" or kind == "close" and templates and depth == templates[-1] and text[start] == "}":
            if kind == "close":
                templates.pop()
            r = _TEMPLATE.match(text, pos)
            pos = r.end()
            if r["end"] is None:
                put(("err", "unterminated template", start))
                break
            if r["end"] == "${":
                templates.append(depth)
                # the pieces of a template are strings joined by its expressions
                put(("str", text[start:pos], start))
                put(last := ("op", "+", pos))
                continue
            if kind == "close" and out and out[-1][:2] == ("op", "+"):
                out.pop()
            elif kind == "close":
                put(("op", "+", start))
            kind = "str"
        if script:
            if kind == "open":
                depth += 1
            elif kind == "close":
                depth -= 1
        last = (kind, text[start:pos] if kind != "err" else f"stray {text[start]!r}", start)
        put(last)
    if templates and not (out and out[-1][0] == "err"):
        out.append(("err", "unterminated template", n))
    return out


def line_starts(text: str) -> list[int]:
    """Offsets at which lines begin, lines being split at ``\\n``."""
    return [0, *(m.end() for m in re.finditer("\n", text))]


def line_of(starts: list[int], pos: int) -> int:
    """1-based line of an offset."""
    return bisect_right(starts, pos)
