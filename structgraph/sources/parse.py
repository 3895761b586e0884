"""Structure of source files: functions, classes, imports and variables, by language.

Each parser turns a text into the nested record of :data:`structgraph.model.PARSED`. Python is read by its own grammar; brace languages
by an island parser over lexer tokens: declarations are read, everything else is skipped to the end of its statement. A text
that its language does not allow gives what can be read and a ``parse_error``.
"""

import ast
import re
import warnings
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd

from structgraph.functions.lexers import LANGUAGES, line_of, line_starts, tokens


def _function(name, start, end, parameters=(), decorators=(), docstring=None, calls=()) -> dict:
    return {"name": name, "start_line": start, "end_line": end, "parameters": list(parameters), "decorators": list(decorators), "docstring": docstring, "calls": list(calls)}


def _class(name, start, end, bases=(), decorators=(), docstring=None, methods=()) -> dict:
    return {"name": name, "start_line": start, "end_line": end, "docstring": docstring, "bases": list(bases), "decorators": list(decorators), "methods": list(methods)}


def _import(module, names, line, aliases=None) -> dict:
    return {"module": module, "names": list(names), "start_line": line, "aliases": aliases or {}}


class Module:
    """What a parser collects."""

    def __init__(self) -> None:
        self.functions: list[dict] = []
        self.classes: list[dict] = []
        self.imports: list[dict] = []
        self.variables: list[dict] = []
        self.error: str | None = None

    def variable(self, name: str, line: int) -> None:
        self.variables.append({"name": name, "start_line": line})


# Python ---------------------------------------------------------------------------------------------------------------


class _PythonReader:
    def __init__(self, text: str) -> None:
        self.text = text
        self.lines = [x.encode() for x in text.splitlines(keepends=True)] or [b""]

    def source(self, node: ast.AST) -> str:
        if node.lineno == node.end_lineno:
            return self.lines[node.lineno - 1][node.col_offset : node.end_col_offset].decode()
        part = [self.lines[node.lineno - 1][node.col_offset :], *self.lines[node.lineno : node.end_lineno - 1], self.lines[node.end_lineno - 1][: node.end_col_offset]]
        return b"".join(part).decode()

    def docstring(self, body: list[ast.stmt]) -> str | None:
        if not body or not isinstance(body[0], ast.Expr) or not isinstance(body[0].value, ast.Constant) or not isinstance(body[0].value.value, str):
            return None
        raw = self.source(body[0].value)
        for q in ('"""', "'''", '"', "'"):
            if raw.startswith(q) and raw.endswith(q) and len(raw) >= 2 * len(q):
                return raw[len(q) : -len(q)].strip()
        return None

    def calls(self, nodes: list[ast.AST]) -> list[str]:
        out: list[str] = []
        todo = list(reversed(nodes))
        while todo:
            node = todo.pop()
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Name | ast.Attribute):
                out.append(self.source(node.func))
            todo += reversed(list(ast.iter_child_nodes(node)))
        return out

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
        a = node.args
        names = [x.arg for x in [*a.posonlyargs, *a.args]]
        names += ([f"*{a.vararg.arg}"] if a.vararg else []) + [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
        return _function(node.name, node.lineno, node.end_lineno, names, self.decorators(node), self.docstring(node.body), self.calls(node.body))

    def decorators(self, node) -> list[str]:
        return [self.source(d).split("(")[0].strip() for d in node.decorator_list]

    def module(self) -> Module:
        m = Module()
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(self.text)
        for node in tree.body:
            match node:
                case ast.FunctionDef() | ast.AsyncFunctionDef():
                    m.functions.append(self.function(node))
                case ast.ClassDef():
                    bases = [self.source(b) for b in node.bases if isinstance(b, ast.Name | ast.Attribute)]
                    methods = [self.function(x) for x in node.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)]
                    m.classes.append(_class(node.name, node.lineno, node.end_lineno, bases, self.decorators(node), self.docstring(node.body), methods))
                case ast.Import():
                    m.imports.append(_import(None, [x.name for x in node.names], node.lineno))
                case ast.ImportFrom():
                    m.imports.append(_import("." * node.level + (node.module or ""), [x.name for x in node.names if x.name != "*"], node.lineno))
                case ast.Assign(targets=[ast.Name(id=name), *_]) | ast.AnnAssign(target=ast.Name(id=name)):
                    m.variable(name, node.lineno)
        return m


def parse_python(text: str) -> Module:
    try:
        return _PythonReader(text).module()
    except (SyntaxError, ValueError, RecursionError) as x:
        m = Module()
        m.error = f"{type(x).__name__}: {x}"[:200]
        # line scanner for what can still be told: heads at the margin
        for n, line in enumerate(text.splitlines(), 1):
            if h := re.match(r"(?:async\s+)?def\s+(\w+)", line):
                m.functions.append(_function(h[1], n, n))
            elif h := re.match(r"class\s+(\w+)\s*(?:\(([^()]*)\))?", line):
                m.classes.append(_class(h[1], n, n, [b.strip() for b in (h[2] or "").split(",") if re.fullmatch(r"\s*[\w.]+\s*", b)]))
            elif h := re.match(r"from\s+(\S+)\s+import\s+([\w, ]+)", line):
                m.imports.append(_import(h[1], [x.split(" as ")[0].strip() for x in h[2].split(",")], n))
            elif h := re.match(r"import\s+([\w., ]+)", line):
                m.imports.append(_import(None, [x.split(" as ")[0].strip() for x in h[1].split(",")], n))
        return m


# Brace languages ------------------------------------------------------------------------------------------------------

#: Words before a parenthesis that call nothing; fixed by the languages.
_NO_CALL = set("if for while switch catch function return typeof sizeof alignof with do else case in of new delete void throw await yield instanceof synchronized assert defined decltype static_assert noexcept import super_ constructor".split())
_MODIFIERS = set("public private protected static async readonly get set abstract override final native synchronized default transient volatile strictfp declare accessor sealed".split())


class Tokens:
    """Tokens of a text without comments, bracket pairs, and lines."""

    def __init__(self, text: str, lang: str) -> None:
        self.text, self.lang = text, lang
        self.starts = line_starts(text)
        self.t: list[tuple[str, str, int]] = []
        self.fresh: list[bool] = []  # first on its line
        newline = True
        self.error: str | None = None
        for tok in tokens(text, lang):
            if tok[0] == "nl":
                newline = True
                continue
            if tok[0] == "err":
                self.error = self.error or tok[1]
            self.t.append(tok)
            self.fresh.append(newline)
            newline = False
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for i, (kind, body, _) in enumerate(self.t):
            if kind == "open":
                stack.append(i)
            elif kind == "close":
                if stack and "([{".index(self.t[stack[-1]][1]) == ")]}".index(body):
                    j = stack.pop()
                    self.pair[j], self.pair[i] = i, j
                else:
                    self.error = self.error or f"unbalanced {body}"
        if stack:
            self.error = self.error or "premature end"
            for j in stack:
                self.pair[j] = len(self.t) - 1

    def __len__(self) -> int:
        return len(self.t)

    def s(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < len(self.t) else ""

    def is_id(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i][0] == "id"

    def line(self, i: int) -> int:
        return line_of(self.starts, self.t[i][2])

    def end_line(self, i: int) -> int:
        i = min(i, len(self.t) - 1)
        return line_of(self.starts, self.t[i][2] + max(0, len(self.t[i][1]) - 1))

    def past(self, i: int, opening: str) -> int:
        """Index after the bracket that opens at ``i``, or ``i`` if none does."""
        return self.pair.get(i, i) + 1 if self.s(i) == opening else i

    def past_angle(self, i: int) -> int:
        """Index after type arguments that begin at ``i``."""
        if self.s(i) != "<":
            return i
        depth = 0
        while i < len(self.t):
            x = self.s(i)
            if x == "<":
                depth += 1
            elif x in (">", ">>", ">>>"):
                depth -= len(x)
                if depth <= 0:
                    return i + 1
            elif x in (";", "{") and depth and self.lang != "ts":
                return i
            i = self.pair[i] + 1 if self.t[i][0] == "open" and i in self.pair else i + 1
        return i

    def calls(self, a: int, b: int) -> list[str]:
        """Texts of what is called between tokens a and b: names and member chains; outer calls before inner ones."""
        found = []
        for j in range(a, b):
            if self.s(j) != "(" or j == 0:
                continue
            i = j - 1
            if self.lang in ("ts", "java") and self.s(i) in (">", ">>"):
                back = self._angle_back(i)
                if back is not None and self.is_id(back - 1):
                    i = back - 1
            if not self.is_id(i) or self.s(i) in _NO_CALL:
                continue
            last = i
            ops = (".", "?.") if self.lang in ("js", "ts") else (".",) if self.lang == "java" else (".", "->", "::")
            while self.s(i - 1) in ops and i - 1 > a - 1:
                k = i - 2
                while self.s(k) in (")", "]") and k in self.pair and self.pair[k] > a - 1:
                    k = self.pair[k] - 1
                    if not (self.is_id(k) or self.s(k) in (")", "]")):
                        k += 1
                        break
                if self.is_id(k) or self.t[k][0] in ("str", "open", "regex"):
                    i = k
                else:
                    break
            if i == last and self.s(i) in ("super", "this") and self.lang != "cpp":
                continue
            if self.s(i - 1) == "new":
                if self.lang == "java":
                    found.append((self.t[i][2], -self.pair.get(j, j), self.text[self.t[i][2] : self.t[j][2]].strip()))
                if i == last or self.lang == "java":
                    continue
                continue
            if self.lang == "java" and self.is_id(i - 1) and self.s(i - 1) not in ("return", "else", "throw", "case", "assert", "yield", "do") and self.s(i - 1) not in _MODIFIERS:
                continue  # a declaration inside
            if self.lang in ("c", "cpp") and self.is_id(i - 1) and self.s(i - 1) not in ("return", "else", "throw", "case", "do", "co_await", "co_return", "co_yield", "not", "goto"):
                continue
            found.append((self.t[i][2], -self.pair.get(j, j), self.text[self.t[i][2] : self.t[last][2] + len(self.t[last][1])]))
        return [x[2] for x in sorted(found, key=lambda x: (x[0], x[1]))]

    def _angle_back(self, i: int) -> int | None:
        depth = 0
        while i > 0:
            x = self.s(i)
            if x in (">", ">>"):
                depth += len(x)
            elif x == "<":
                depth -= 1
                if depth == 0:
                    return i
            elif not (self.is_id(i) or x in (",", ".", "?", "[", "]", "|", "&")):
                return None
            i -= 1
        return None

    def split(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Ranges between commas at the top level of a..b."""
        i = start = a
        while i < b:
            if self.t[i][0] == "open":
                i = self.pair.get(i, i)
            elif self.s(i) == "<" and self.lang != "c":
                i = max(i, self.past_angle(i) - 1)
            elif self.s(i) == ",":
                yield start, i
                start = i + 1
            i += 1
        if start < b:
            yield start, b


def _decorators(t: Tokens, i: int) -> tuple[list[str], int]:
    out = []
    while t.s(i) == "@" and t.is_id(i + 1) and t.s(i + 1) != "interface":
        j = i + 2
        while t.s(j) == "." and t.is_id(j + 1):
            j += 2
        out.append("".join(t.s(k) for k in range(i + 1, j)))
        i = t.past(j, "(")
    return out, i


# JavaScript and TypeScript ----------------------------------------------------------------------------------------------


def _js_params(t: Tokens, i: int) -> list[str]:
    out = []
    for a, b in t.split(i + 1, t.pair.get(i, i)):
        _, a = _decorators(t, a)
        while t.s(a) in _MODIFIERS and t.is_id(a + 1):
            a += 1
        if t.s(a) == "..." and t.is_id(a + 1):
            out.append("..." + t.s(a + 1))
        elif t.is_id(a) and t.s(a) != "this":
            out.append(t.s(a))
    return out


def _js_type(t: Tokens, i: int) -> int:
    """Index after a type annotation at ``i`` (from its colon), which ends before a body, an arrow, ``=``, ``;`` or a new line."""
    if t.s(i) != ":":
        return i
    i += 1
    began = i
    while i < len(t):
        x = t.s(i)
        if x == "{" and i > began and t.s(i - 1) not in ("|", "&", ":", "=>"):
            return i
        if x in ("=", ";", ",") or x == "=>" and t.s(i - 1) != ")" and i > began:
            return i
        if x == "=>" and t.s(i - 1) == ")":
            return i
        if i > began and t.fresh[i] and x not in ("|", "&", "."):
            return i
        i = t.pair[i] + 1 if t.t[i][0] == "open" and i in t.pair else t.past_angle(i) if x == "<" else i + 1
    return i


def _js_arrow(t: Tokens, i: int) -> tuple[int, int] | None:
    """(index of the parameters, index after the arrow) if an arrow function begins at ``i``."""
    if t.s(i) == "async" and not t.fresh[i + 1]:
        i += 1
    p = t.past_angle(i)
    if t.s(p) == "(":
        j = _js_type(t, t.pair.get(p, p) + 1)
        if t.s(j) == "=>":
            return p, j + 1
    elif t.is_id(p) and t.s(p + 1) == "=>":
        return p, p + 2
    return None


def _js_end(t: Tokens, i: int) -> int:
    """Index of the last token of the expression statement that begins at ``i``."""
    begin = i
    while i < len(t):
        if t.s(i) == ";":
            return i
        if i > begin and t.fresh[i]:
            before, kind = t.s(i - 1), t.t[i - 1][0]
            starts = t.is_id(i) and t.s(i) not in ("in", "of", "instanceof", "as") or t.s(i) == "@" or t.t[i][0] in ("num", "str")
            if starts and (kind in ("id", "num", "str", "regex") or before in (")", "]", "}")):
                return i - 1
        if t.t[i][0] == "open" and i in t.pair:
            i = t.pair[i]
        elif t.t[i][0] == "close":
            return i - 1
        i += 1
    return len(t) - 1


def _js_class(t: Tokens, i: int, start: int, decorators: list[str]) -> tuple[dict, int]:
    name, i = (t.s(i), i + 1) if t.is_id(i) and t.s(i) not in ("extends", "implements") else ("anonymous", i)
    i = t.past_angle(i)
    bases = []
    while i < len(t) and t.s(i) != "{":
        word = t.s(i)
        i += 1
        if word in ("extends", "implements"):
            while i < len(t) and t.s(i) not in ("{", "implements"):
                a = i
                while t.is_id(i) or t.s(i) == ".":
                    i += 1
                if i > a:
                    bases.append("".join(t.s(k) for k in range(a, i)))
                i = t.past_angle(i)
                i = t.past(i, "(")
                if t.s(i) == ",":
                    i += 1
                elif i == a:
                    i += 1
    end = t.pair.get(i, len(t) - 1)
    methods = []
    j = i + 1
    while j < end:
        deco, j = _decorators(t, j)
        first = j
        while t.s(j) in _MODIFIERS and t.s(j + 1) not in ("(", "=", ";", ":", "?", "!") or t.s(j) == "*":
            j += 1
        name_at = j
        j = t.past(j, "[") if t.s(j) == "[" else j + 1
        while t.s(j) in ("?", "!"):
            j += 1
        j = t.past_angle(j)
        if t.s(j) == "(":
            params = j
            j = _js_type(t, t.pair.get(j, j) + 1)
            if t.s(j) == "{":
                close = t.pair.get(j, end)
                methods.append(_function(t.s(name_at), t.line(first), t.end_line(close), _js_params(t, params), deco, None, t.calls(j, close)))
                j = close + 1
                continue
        else:
            j = _js_type(t, j)
            if t.s(j) == "=":
                arrow = _js_arrow(t, j + 1)
                close = min(_js_end(t, j + 1), end - 1)
                if arrow:
                    params = _js_params(t, arrow[0]) if t.s(arrow[0]) == "(" else [t.s(arrow[0])]
                    methods.append(_function(t.s(name_at), t.line(first), t.end_line(close), params, [], None, t.calls(arrow[1], close + 1)))
                j = close + 1
                continue
        if t.s(j) == ";":
            j += 1
        elif j == first:
            j += 1
    return _class(name, start, t.end_line(end), bases, decorators, None, methods), end + 1


def _js_interface(t: Tokens, i: int, start: int) -> tuple[dict, int]:
    name, i = t.s(i), t.past_angle(i + 1)
    bases = []
    while i < len(t) and t.s(i) != "{":
        if t.is_id(i) and t.s(i) != "extends":
            bases.append(t.s(i))
            i += 1
            while t.s(i) == "." and t.is_id(i + 1):
                i += 2
            i = t.past_angle(i)
        else:
            i += 1
    end = t.pair.get(i, len(t) - 1)
    methods = []
    j = i + 1
    while j < end:
        first = j
        while t.s(j) in ("readonly", "get", "set") and t.is_id(j + 1):
            j += 1
        named = t.is_id(j) and t.s(j + 1) in ("(", ":", "?", "<")
        who = t.s(j)
        j += 1
        while j < end and t.s(j) not in (";", ",") and not (t.fresh[j] and t.s(j - 1) not in ("|", "&", ":", ",")):
            j = t.pair[j] + 1 if t.t[j][0] == "open" and j in t.pair else j + 1
        if named:
            methods.append(_function(who, t.line(first), t.end_line(j - 1)))
        if t.s(j) in (";", ","):
            j += 1
    return _class(name, start, t.end_line(end), bases, [], None, methods), end + 1


def _js_import(t: Tokens, i: int) -> tuple[dict | None, int]:
    line = t.line(i)
    j = i + 1
    names, aliases, module = [], {}, None
    if t.s(j) == "type" and t.s(j + 1) != "from":
        j += 1
    while j < len(t) and not (t.fresh[j] and t.is_id(j) and t.s(j) != "from" and j > i + 1 and t.s(j - 1) not in (",", "import")):
        kind, body, _ = t.t[j]
        if kind == "str":
            module = body.strip("'\"`")
            j += 1
            break
        if body == "{":
            for a, b in t.split(j + 1, t.pair.get(j, j)):
                if t.s(a) == "type" and b - a > 1 and t.s(a + 1) != "as":
                    a += 1
                names.append(t.s(a).strip("'\""))
                if t.s(a + 1) == "as":
                    aliases[t.s(a + 2)] = t.s(a)
            j = t.pair.get(j, j)
        elif body == "*" and t.s(j + 1) == "as":
            names.append(t.s(j + 2))
            j += 2
        elif kind == "id" and body != "from":
            names.append(body)
        elif body == "(":
            return None, _js_end(t, i) + 1
        j += 1
    return (_import(module, names, line, aliases) if module else None), j + (t.s(j) == ";")


def parse_script(text: str, lang: str) -> Module:
    t, m = Tokens(text, lang), Module()
    m.error = t.error
    i, n = 0, len(t)
    while i < n:
        deco, i = _decorators(t, i)
        if i >= n:
            break
        start = i
        while t.s(i) in ("export", "default", "declare", "abstract") and i < n - 1:
            i += 1
        if i > start and t.s(i) not in ("function", "async", "class", "interface", "const", "let", "var", "import"):
            i = _js_end(t, i) + 1
            continue
        first = start if i == start else next((k for k in range(start, i + 1) if t.s(k) not in ("export", "default")), i)
        word = t.s(i)
        if word == "async" and t.s(i + 1) == "function":
            i, word = i + 1, "function"
        if word == "function":
            j = i + 1 + (t.s(i + 1) == "*")
            name, p = t.s(j), t.past_angle(j + 1)
            body = _js_type(t, t.pair.get(p, p) + 1)
            if t.s(p) == "(" and t.s(body) == "{":
                close = t.pair.get(body, n - 1)
                m.functions.append(_function(name, t.line(first), t.end_line(close), _js_params(t, p), deco, None, t.calls(body, close)))
                i = close + 1
            else:
                i = _js_end(t, i) + 1
        elif word == "class":
            c, i = _js_class(t, i + 1, t.line(first), deco)
            m.classes.append(c)
        elif word == "interface" and t.is_id(i + 1):
            c, i = _js_interface(t, i + 1, t.line(first))
            m.classes.append(c)
        elif word == "import":
            got, i = _js_import(t, i)
            if got:
                m.imports.append(got)
        elif word in ("const", "let", "var") and (t.is_id(i + 1) or t.s(i + 1) in ("{", "[")):
            end = _js_end(t, i)
            eq = _js_type(t, t.past(i + 1, t.s(i + 1)) if t.s(i + 1) in ("{", "[") else i + 2)
            value = eq + 1 if t.s(eq) == "=" else None
            arrow = _js_arrow(t, value) if value is not None and value <= end else None
            if value is not None and t.s(value) == "require" and t.s(value + 1) == "(" and value + 2 < n and t.t[value + 2][0] == "str":
                a, b = t.t[i + 1][2], t.t[eq][2]
                m.imports.append(_import(t.s(value + 2).strip("'\"`"), [text[a:b].strip()], t.line(i)))
            elif arrow:
                params = _js_params(t, arrow[0]) if t.s(arrow[0]) == "(" else [t.s(arrow[0])]
                m.functions.append(_function(t.s(i + 1), t.line(i), t.end_line(end), params, [], None, t.calls(arrow[1], end + 1)))
            elif t.is_id(i + 1):
                m.variable(t.s(i + 1), t.line(i))
            i = end + 1
        else:
            if t.is_id(i) and t.s(i + 1) == "=" and i == start:
                m.variable(t.s(i), t.line(i))
            i = max(_js_end(t, i) + 1, i + 1)
            i = t.past(i, "{") if t.s(i) == "{" else i
    return m


# Java -------------------------------------------------------------------------------------------------------------------


def _typed_params(t: Tokens, i: int) -> list[str]:
    """Parameter names of a typed list: the last word of each, before a default and array brackets."""
    out = []
    for a, b in t.split(i + 1, t.pair.get(i, i)):
        stop = next((k for k in range(a, b) if t.s(k) in ("=", "[")), b)
        ids = [k for k in range(a, stop) if t.is_id(k)]
        if t.lang in ("c", "cpp"):
            if any(t.s(k) == "[" for k in range(a, b)) or any(t.s(k) == "(" for k in range(a, stop)) or any(t.s(k) in ("&", "&&") for k in range(a, stop)) and t.lang == "c":
                continue
            if len(ids) < 2 or sum(t.s(k) == "*" for k in range(a, stop)) > 1 or any(t.s(k) in ("&", "&&") for k in range(a, stop)):
                continue
            if t.s(ids[-1]) in ("const", "int", "char", "void", "long", "short", "double", "float", "unsigned", "signed", "bool"):
                continue
        if ids:
            out.append(t.s(ids[-1]))
    return out


def _java_member(t: Tokens, i: int, end: int) -> tuple[dict | None, int]:
    """A method that begins at ``i`` (annotations and modifiers first), and the index after the member."""
    start = i
    deco: list[str] = []
    while i < end:
        if t.s(i) == "@" and t.s(i + 1) != "interface":
            d, i = _decorators(t, i)
            deco += d
        elif t.s(i) in _MODIFIERS or t.s(i) == "-":
            i += 1
        else:
            break
    i = t.past_angle(i)
    j = i
    while j < end:
        x = t.s(j)
        if x == "(":
            name = t.s(j - 1) if t.is_id(j - 1) else "<constructor>"
            k = t.pair.get(j, j) + 1
            while k < end and t.s(k) not in ("{", ";", "="):
                k += 1
            close = t.pair.get(k, k) if t.s(k) == "{" else k
            if t.s(k) == "=":
                while close < end and t.s(close) != ";":
                    close += 1
            return _function(name, t.line(start), t.end_line(close), _typed_params(t, j), deco, None, t.calls(k, close) if t.s(k) == "{" else []), close + 1
        if x in ("class", "interface", "enum", "record") and t.is_id(j + 1):
            while j < end and t.s(j) != "{":
                j += 1
            return None, t.pair.get(j, j) + 1
        if x == "=" or x == ";":
            while j < end and t.s(j) != ";":
                j = t.pair[j] + 1 if t.t[j][0] == "open" and j in t.pair else j + 1
            return None, j + 1
        if x == "{":
            return None, t.pair.get(j, j) + 1
        j = t.past_angle(j) if x == "<" else j + 1
    return None, max(j, start + 1)


def parse_java(text: str) -> Module:
    t, m = Tokens(text, "java"), Module()
    m.error = t.error
    i, n = 0, len(t)
    while i < n:
        start = i
        deco: list[str] = []
        while i < n and (t.s(i) == "@" and t.s(i + 1) != "interface" or t.s(i) in _MODIFIERS):
            if t.s(i) == "@":
                d, i = _decorators(t, i)
                deco += d
            else:
                i += 1
        word = t.s(i)
        if word == "package":
            while i < n and t.s(i) != ";":
                i += 1
            i += 1
        elif word == "import":
            j = i + 1 + (t.s(i + 1) == "static")
            k = j
            while k < n and t.s(k) != ";":
                k += 1
            parts = "".join(t.s(x) for x in range(j, k)).rsplit(".", 1)
            m.imports.append(_import(parts[0] if len(parts) == 2 else None, [parts[-1]], t.line(i)))
            i = k + 1
        elif word in ("class", "interface", "enum", "record") and t.is_id(i + 1):
            name, j = t.s(i + 1), t.past_angle(i + 2)
            j = t.past(j, "(")
            bases = []
            while j < n and t.s(j) != "{":
                if t.is_id(j) and t.s(j) not in ("extends", "implements", "permits") and t.s(j - 1) != ".":
                    bases.append(t.s(j))
                if t.s(j) == "permits":
                    while j < n and t.s(j) != "{":
                        j += 1
                    break
                j = t.past_angle(j) if t.s(j) == "<" else j + 1
            end = t.pair.get(j, n - 1)
            k = j + 1
            if word == "enum":
                while k < end and t.s(k) != ";":
                    k = t.pair[k] + 1 if t.t[k][0] == "open" and k in t.pair else k + 1
                k += 1
            methods = []
            while k < end:
                got, k = _java_member(t, k, end)
                if got:
                    methods.append(got)
            m.classes.append(_class(name, t.line(start), t.end_line(end), bases, deco, None, methods))
            i = end + 1
        elif word in (";", "}"):
            i += 1
        else:
            got, i = _java_member(t, start, n)
            if got:
                m.functions.append(got)
    return m


# C and C++ --------------------------------------------------------------------------------------------------------------


def _c_function(t: Tokens, a: int, brace: int) -> dict | None:
    """The function whose head is a..brace, or None if the head has no parameter list."""
    p = next((k for k in range(a, brace) if t.s(k) == "(" and (t.is_id(k - 1) or t.s(k - 1) in ("]", "=", "+", "-", "*", "<", ">", ")"))), None)
    if p is None or any(t.s(k) == "=" and t.s(k - 1) != "operator" for k in range(a, p)):
        return None
    q = p - 1
    while q - 2 >= a and t.s(q - 1) in ("::", "~"):
        q -= 1 if t.s(q - 1) == "~" else 2
    first = t.t[q][2]
    stars = sum(t.s(k) == "*" for k in range(a, q))
    close = t.pair.get(brace, len(t) - 1)
    name = t.text[first : t.t[p][2]].strip() if stars < 2 and t.is_id(p - 1) else "unknown"
    return _function(name, t.line(a), t.end_line(close), _typed_params(t, p), [], None, t.calls(brace, close))


def _c_class(t: Tokens, i: int, start: int, brace: int) -> dict:
    name = t.s(i + 1) if t.is_id(i + 1) else "anonymous"
    bases, colon = [], next((k for k in range(i, brace) if t.s(k) == ":"), None)
    if colon is not None:
        for a, b in t.split(colon + 1, brace):
            ids = [k for k in range(a, b) if t.is_id(k) and t.s(k) not in ("public", "private", "protected", "virtual")]
            if len(ids) == 1 or ids and not any(t.s(k) == "::" for k in range(a, b)) and t.s(ids[0] + 1) != "<":
                bases.append(t.s(ids[0]))
    end = t.pair.get(brace, len(t) - 1)
    methods = []
    j = brace + 1
    while j < end:
        if t.s(j) in ("public", "private", "protected") and t.s(j + 1) == ":":
            j += 2
            continue
        stop = _c_stop(t, j, end)
        if t.s(stop) == "{":
            f = None if t.s(j) in ("class", "struct", "enum", "union") else _c_function(t, j, stop)
            if f:
                methods.append(f)
            j = t.pair.get(stop, stop) + 1
        else:
            j = stop + 1
    return _class(name, start, t.end_line(end), bases, [], None, methods)


def _c_stop(t: Tokens, i: int, end: int) -> int:
    """Index of the ``;`` or ``{`` that ends the head of the declaration at ``i``; initialisers in braces are passed over."""
    while i < end:
        x = t.s(i)
        if x == ";" or x == "{" and t.s(i - 1) not in ("=", ",", "return") and not (t.is_id(i - 1) and t.s(i - 2) in (",", ":") and ")" in {t.s(k) for k in range(max(0, i - 40), i)} and t.s(t.pair.get(i, i) + 1) in (",", "{")):
            return i
        if t.t[i][0] == "pre":
            return i
        i = t.pair[i] + 1 if t.t[i][0] == "open" and i in t.pair else i + 1
    return end


def parse_c(text: str, lang: str) -> Module:
    t, m = Tokens(text, lang), Module()
    m.error = t.error
    _c_scope(t, m, 0, len(t), True)
    return m


def _c_scope(t: Tokens, m: Module, i: int, n: int, top: bool) -> None:
    while i < n:
        kind, body, _ = t.t[i]
        if kind == "pre":
            inc = re.match(r"#\s*include\s*[<\"]([^>\"]+)[>\"]", body)
            if inc and top:
                m.imports.append(_import(inc[1], [inc[1]], t.line(i)))
            i += 1
            continue
        if body in (";", "}"):
            i += 1
            continue
        start = i
        if body == "extern" and i + 1 < n and t.t[i + 1][0] == "str" and t.s(i + 2) == "{":
            _c_scope(t, m, i + 3, t.pair.get(i + 2, n), top)
            i = t.pair.get(i + 2, n) + 1
            continue
        if body == "template":
            i = t.past_angle(i + 1)
        word = t.s(i)
        if word in ("namespace", "inline") and t.lang == "cpp" and (word == "namespace" or t.s(i + 1) == "namespace"):
            j = i
            while j < n and t.s(j) not in ("{", ";"):
                j += 1
            if t.s(j) == "{" and top:
                _c_scope(t, m, j + 1, t.pair.get(j, n), False)
            i = t.pair.get(j, j) + 1
            continue
        stop = _c_stop(t, i, n)
        typedef = word == "typedef"
        k = i + typedef
        if t.s(k) in ("struct", "class", "union", "enum") and t.s(stop) == "{" and not any(t.s(x) == "(" for x in range(k, stop)):
            close = t.pair.get(stop, n - 1)
            after = close + 1
            while after < n and t.s(after) != ";" and t.t[after][0] != "pre":
                after += 1
            if t.s(k) == "class" and t.lang == "cpp" and not typedef:
                m.classes.append(_c_class(t, k, t.line(start), stop))
            elif t.s(k) == "struct" and (top or t.lang == "cpp"):
                c = _class(t.s(k + 1) if t.is_id(k + 1) else "anonymous", t.line(k), t.end_line(close))
                names = [x for x in range(close + 1, after) if t.is_id(x)]
                if typedef and names:
                    c["name"] = t.s(names[0])
                m.classes.append(c)
            i = after + 1
            continue
        if t.s(stop) == "{":
            f = _c_function(t, i, stop)
            if f:
                f["start_line"] = t.line(start)
                m.functions.append(f)
            i = t.pair.get(stop, stop) + 1
            continue
        if top and t.s(stop) == ";" and word not in ("typedef", "using", "struct", "class", "enum", "union", "extern") or top and t.s(stop) == ";" and word in ("struct", "enum", "extern") and stop - i > 2:
            eq = next((x for x in range(i, stop) if t.s(x) == "="), stop)
            if not any(t.s(x) in ("(", "*", "&", "[") for x in range(i, eq)) and t.is_id(eq - 1) and eq - i >= 2:
                m.variable(t.s(eq - 1), t.line(start))
        i = stop + 1 if t.t[min(stop, n - 1)][0] != "pre" else max(stop, i + 1)


# Markup and configuration -------------------------------------------------------------------------------------------------


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.m = Module()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a, line = dict(attrs), self.getpos()[0]
        if tag == "link" and a.get("rel") == "stylesheet" and a.get("href"):
            self.m.imports.append(_import(a["href"], [a["href"]], line))
        elif tag == "script" and a.get("src"):
            self.m.imports.append(_import(a["src"], [a["src"]], line))
        if a.get("id"):
            self.m.variable(f"#{a['id']}", line)


def parse_html(text: str) -> Module:
    p = _Html()
    p.feed(text)
    p.close()
    return p.m


def parse_css(text: str) -> Module:
    t, m = Tokens(text, "css"), Module()
    m.error = t.error
    i, n = 0, len(t)
    while i < n:
        j = i
        while j < n and t.s(j) not in ("{", ";"):
            j = t.pair[j] + 1 if t.s(j) in ("(", "[") and j in t.pair else j + 1
        if t.s(i) == "@import":
            head = text[t.t[i][2] : t.t[j][2] if j < n else len(text)]
            if path := re.search(r"[\"']([^\"']+)[\"']|url\(\s*([^)\"'\s]+)\s*\)", head):
                p = path[1] or path[2]
                m.imports.append(_import(p, [p], t.line(i)))
        elif t.s(j) == "{" and not t.s(i).startswith("@") and j > i:
            m.classes.append(_class(text[t.t[i][2] : t.t[j][2]].strip(), t.line(i), t.end_line(t.pair.get(j, n - 1))))
        i = t.pair.get(j, j) + 1 if t.s(j) == "{" else j + 1
    return m


def parse_json(text: str) -> Module:
    t, m = Tokens(text, "json"), Module()
    m.error = t.error
    todo = [(0, "")] if t.s(0) == "{" else []
    while todo:
        i, prefix = todo.pop()
        inner = []
        for a, b in t.split(i + 1, t.pair.get(i, len(t))):
            if t.t[a][0] != "str" or t.s(a + 1) != ":":
                continue
            name = prefix + t.s(a)[1:-1]
            if t.s(a + 2) == "{":
                m.classes.append(_class(name, t.line(a), t.end_line(t.pair.get(a + 2, b - 1))))
                inner.append((a + 2, name + "."))
            else:
                m.variable(name, t.line(a))
        todo += reversed(inner)
    return m


def parse_yaml(text: str) -> Module:
    m = Module()
    try:
        import yaml
    except ImportError:
        m.error = "no YAML reader installed"
        return m

    def walk(node, prefix: str) -> None:
        for k, v in node.value:
            name = prefix + (k.value if isinstance(k.value, str) else text[k.start_mark.index : k.end_mark.index])
            if isinstance(v, yaml.MappingNode) and not v.flow_style:
                last = text.rfind("\n", 0, v.end_mark.index)
                end = max(k.start_mark.line + 1, text[: v.end_mark.index].rstrip().count("\n") + 1) if last >= 0 else k.start_mark.line + 1
                m.classes.append(_class(name, k.start_mark.line + 1, end))
                walk(v, name + ".")
            else:
                m.variable(name, k.start_mark.line + 1)

    try:
        for doc in yaml.compose_all(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
            if isinstance(doc, yaml.MappingNode) and not doc.flow_style:
                walk(doc, "")
    except (yaml.YAMLError, RecursionError) as x:
        m.error = str(x).split("\n")[0][:200]
    return m


def parse_toml(text: str) -> Module:
    t, m = Tokens(text, "toml"), Module()
    m.error = t.error
    i, n = 0, len(t)
    prefix: str | None = ""
    table: dict | None = None
    while i < n:
        line = t.line(i)
        if t.s(i) == "[" and t.fresh[i]:
            close = t.pair.get(i, i)
            if t.s(i + 1) == "[":
                prefix, table = None, None
            else:
                prefix = text[t.t[i][2] + 1 : t.t[close][2]].strip()
                table = _class(prefix, line, line)
                m.classes.append(table)
            i = close + 1
            continue
        eq = i
        while eq < n and t.s(eq) != "=" and (eq == i or not t.fresh[eq]):
            eq += 1
        j = eq + 1
        while j < n and not t.fresh[j]:
            j = t.pair[j] + 1 if t.t[j][0] == "open" and j in t.pair else j + 1
        if t.s(eq) == "=" and prefix is not None:
            key = text[t.t[i][2] : t.t[eq][2]].strip()
            m.variable(f"{prefix}.{key}" if prefix else key, line)
        if table:
            table["end_line"] = t.end_line(j - 1)
        i = max(j, i + 1)
    return m


def parse(path: str, text: str | None) -> dict:
    """The record of one file. An unknown extension or a null text gives empty lists and a parse_error; nothing raises."""
    lang = LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
    m = Module()
    if lang is None:
        m.error = "unsupported file extension"
    elif text is None:
        m.error = "no content"
    else:
        try:
            m = {
                "py": parse_python, "js": lambda x: parse_script(x, "js"), "ts": lambda x: parse_script(x, "ts"), "java": parse_java, "c": lambda x: parse_c(x, "c"), "cpp": lambda x: parse_c(x, "cpp"),
                "html": parse_html, "css": parse_css, "json": parse_json, "yaml": parse_yaml, "toml": parse_toml,
            }[lang](text.replace("\x00", ""))
        except Exception as x:  # a file must never end the run
            m.error = f"{type(x).__name__}: {x}"[:200]
    return {"path": path, "language": lang, "functions": m.functions, "classes": m.classes, "imports": m.imports, "variables": m.variables, "parse_error": m.error}


def parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas function from (path, content) to :data:`structgraph.model.PARSED`."""
    for pdf in batches:
        yield pd.DataFrame([parse(p or "", c) for p, c in zip(pdf["path"], pdf["content"])], columns=["path", "language", "functions", "classes", "imports", "variables", "parse_error"])
