"""Source files that do not parse (problem 1): lexers with a pushdown stack, then a grammar check where Python has one."""

import ast
import json
import re
import tomllib
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.functions.lexers import LANGUAGES, Token, tokens

PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Merge-conflict markers as version control writes them.
_MARKER = re.compile(r"^(<{7}|>{7}|\|{7})(?: [^\r\n]*)?\r?$|^={7}\r?$", re.M)

#: Words that take part in statements and never stand for a value before another word; fixed by the language definitions.
_JS_WORDS = set("""break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new
return super switch this throw try typeof var void while with yield let static async await of get set from as enum null true false""".split())
_TS_WORDS = _JS_WORDS | set("""type interface namespace module declare abstract public private protected readonly implements keyof infer is asserts override unique
satisfies accessor global out using""".split())
_JAVA_WORDS = set("""abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if
implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this
throw throws transient try void volatile while true false null non sealed permits record var yield module requires exports opens to uses provides with when""".split())
_C_WORDS = set("""auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short
signed sizeof static struct switch typedef union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex _Generic _Noreturn _Static_assert
_Thread_local alignas alignof bool constexpr nullptr static_assert thread_local typeof true false""".split())
_CPP_WORDS = _C_WORDS | set("""alignas and and_eq asm bitand bitor catch char8_t char16_t char32_t class co_await co_return co_yield compl concept
const_cast consteval constinit decltype delete dynamic_cast explicit export friend mutable namespace new noexcept not not_eq operator or or_eq override
final private protected public reinterpret_cast requires static_cast template this throw try typeid typename using virtual wchar_t xor xor_eq import module""".split())
_WORDS = {"js": _JS_WORDS, "ts": _TS_WORDS, "java": _JAVA_WORDS, "c": _C_WORDS, "cpp": _CPP_WORDS}
#: Words that an opening parenthesis must follow.
_PAREN = {"js": {"if", "while", "switch", "with"}, "ts": {"if", "while", "switch", "with"}, "java": {"if", "while", "switch", "for"}, "c": {"if", "while", "switch", "for"}, "cpp": {"while", "switch", "for"}}
#: Operators that may stand before an operand, and those that may follow one and end it.
_PREFIX = {"js": set("+ - ! ~ ++ -- ... @".split()), "java": set("+ - ! ~ ++ -- @ -> ?".split()), "c": set("+ - ! ~ ++ -- * & .".split()), "cpp": set("+ - ! ~ ++ -- * & && . :: ... ~".split())}
_PREFIX["ts"] = _PREFIX["js"] | {"<", "|", "&", "-?", "?"}
_BINARY = set("* / % & | ^ = == != === !== <= >= && || ?? += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= << >> >>> ** ? . ?. -> :: , => <=>".split())


class Fault(Exception):
    """The first thing in a text that its language does not allow."""


def balance(toks: list[Token], strict_end: bool = True) -> None:
    """Pushdown check: literals closed, delimiters paired, nothing open at the end."""
    stack: list[str] = []
    for kind, text, _ in toks:
        if kind == "err":
            raise Fault(text)
        if kind == "open":
            stack.append(PAIRS[text])
        elif kind == "close":
            if not stack or stack.pop() != text:
                raise Fault(f"unbalanced {text}")
    if stack and strict_end:
        raise Fault(f"premature end, {stack[-1]} missing")


def conflict_markers(text: str, toks: list[Token]) -> None:
    """Conflict markers at a line's start, outside literals and comments (those are ordinary text there)."""
    if "<<<<<<<" not in text and ">>>>>>>" not in text and "|||||||" not in text and "=======" not in text:
        return
    starts = {t[2] for t in toks if t[0] not in ("nl",)}
    for m in _MARKER.finditer(text):
        if m.start() in starts:
            raise Fault("merge-conflict marker")


def _is_value(t: Token | None, words: set[str]) -> bool:
    return t is not None and (t[0] in ("num", "str", "regex") or t[0] == "id" and (t[1] not in words or t[1] in ("this", "null", "true", "false", "super")))


def adjacency(toks: list[Token], lang: str) -> None:
    """Second pass of the pushdown: each frame knows what opened it; operands and operators must alternate within it."""
    words, prefix, must = _WORDS[lang], _PREFIX[lang], _PAREN[lang]
    script = lang in ("js", "ts")
    frames: list[list] = [["", "top"]]  # bracket, role
    seq: list[Token] = []
    first: list[bool] = []  # whether a token is the first of its line
    newline = False
    for t in toks:
        if t[0] == "nl":
            newline = True
        elif t[0] != "pre":
            seq.append(t)
            first.append(newline)
            newline = False
    prev: Token | None = None
    chain = 0  # words in a row
    ternary = [0]
    n = len(seq)
    for i, t in enumerate(seq):
        kind, text, _ = t
        pk, pt = (prev[0], prev[1]) if prev else ("", "")
        # the commonest neighbours, of which every language allows all
        if kind == "id":
            if (pk == "op" or pk == "open") and text not in words:
                chain = 1
                prev = t
                continue
        elif kind == "op":
            if lang != "c" and (text == "." or text == ",") and (pk == "close" or pk == "id" and pt not in words):
                chain = 0
                prev = t
                continue
        top = frames[-1]
        newline = first[i]
        nxt = seq[i + 1] if i + 1 < n else None
        if kind == "id" and text in must and pt not in (".", "?.", "->", "::") and not (nxt and nxt[1] in (":", ",", "=", "?")) and not (script and top[1] == "object"):
            if not nxt or nxt[1] != "(" and not (lang == "cpp" and nxt[1] in ("constexpr",)):
                raise Fault(f"{text} without (")
        if script and kind == "id" and text == "for" and pt not in (".", "?.") and nxt and nxt[1] not in ("(", "await", ":", ","):
            raise Fault("for without (")
        if kind in ("id", "num", "str", "regex"):
            joined = script and newline
            if _is_value(prev, words) and not joined:
                if script:
                    if not (pk == "id" and kind == "id" and text in words and text not in ("this", "null", "true", "false", "super")):
                        raise Fault(f"{pt[:20]} before {text[:20]}")
                elif lang == "java":
                    if not (pk == "id" and kind == "id"):
                        raise Fault(f"{pt[:20]} before {text[:20]}")
                elif not (pk == "id" or pk == "str" and kind in ("str", "id")):
                    raise Fault(f"{pt[:20]} before {text[:20]}")
                elif pk == "id" and kind == "num":
                    raise Fault(f"{pt[:20]} before {text[:20]}")
            if lang == "java" and kind == "id" and text in ("const", "goto") and pt != ".":
                raise Fault(f"{text} is reserved")
            chain = chain + 1 if kind == "id" and text not in words else 0
            if not script and chain > 2:
                raise Fault("words without an operator")
            if pk == "close" and pt == ")" and kind in ("num", "str") and not script and top[1] != "cond" and not (lang in ("c", "cpp")):
                raise Fault("value after )")
        elif kind == "op":
            chain = 0
            if not script and text == "=" and nxt and nxt[1].startswith(">") and nxt[2] == t[2] + 1 and pt != "operator":
                raise Fault("=> is no operator")
            if lang == "c" and text == "::" and top[0] != "[":
                raise Fault(":: is no operator")
            if lang == "c" and text == "." and top[1] == "top" and not _head(seq, i, ("=",)):
                raise Fault(". outside an expression")
            at_value = prev is not None and (pk in ("num", "str", "regex") or pk == "close" or pk == "id" and (pt not in words or pt in ("this", "null", "true", "false", "super")))
            if text in (",", ".") and pk == "op" and pt in ("=", "+", "-", "*", "/", "%", "==", "&&", "||", ",", ".", "=>", "->") and not (text == "," and top[1] in ("array",) or lang in ("c", "cpp") and text == "." and pt == ","):
                if not (script and top[0] == "[") and not (text == "," and pt == "*" or lang == "cpp" and pt == "&&") and not (script and pt == "*"):
                    raise Fault(f"{pt} before {text}")
            if text == ";" and pk == "op" and pt not in (";", "++", "--", "*", ">", ">>", "&", ":", "?", "...", "!"):
                raise Fault(f"{pt} before ;")
            if text in _BINARY and text not in prefix and not at_value and text not in (",", "::", "?", "=>"):
                if pk in ("", "op", "open") and not _allowed(pk, pt, text, lang, nxt):
                    raise Fault(f"{text} without a value before it")
            if text in ("<", ">") and pk in ("", "open") and lang != "ts" and pt in ("", "{", "(", "["):
                if not (pt == "(" and lang == "java" or pt == "{" and lang == "java" and text == "<"):
                    raise Fault(f"{text} without a value before it")
            if text in ("<", ">") and pt in (";",) and lang not in ("ts", "java"):
                raise Fault(f"{text} without a value before it")
            if script and text == "?":
                ternary[-1] += 1
            if script and text == ":":
                if ternary[-1]:
                    ternary[-1] -= 1
                elif lang == "js" and top[1] in ("paren", "array", "params"):
                    raise Fault("type annotation")
                elif lang == "js" and top[1] in ("block", "top", "class") and not top[2:3] == ["case"] and not (pk == "id" and pt == "default"):
                    before = seq[i - 2] if i > 1 and not first[i - 1] else None
                    label = pk == "id" and (before is None or before[1] in (";", "{", "}", ")"))
                    if not label or before is not None and before[1] == ")":
                        raise Fault("type annotation")
                if len(top) > 2:
                    del top[2:]
            if script and text == ";" and top[1] == "paren" and not top[2:3] == ["for"]:
                raise Fault("; in parentheses")
        if kind == "id" and script and text == "case" and pt not in (".",) and top[1] in ("block", "top"):
            top[2:] = ["case"]
        if script and kind == "id" and not (pk == "op" and pt in (".", "?.")):
            follow = nxt[1] if nxt else ""
            fresh = prev is None or newline or pt in (";", "}", "{")
            if text == "import" and fresh and top[1] == "top" and nxt and nxt[0] == "id":
                ahead = [x[1] for x in seq[i + 1 : i + 5]]
                if "from" not in ahead[1:4] and "," not in ahead[1:2] and follow not in ("type", "defer") and "=" not in ahead[1:2]:
                    raise Fault("import without from")
            if text in ("function", "class") and nxt and nxt[0] in ("num", "str"):
                raise Fault(f"{text} without a name")
            if lang == "js" and text in ("const", "let", "var") and nxt and nxt[0] == "id" and fresh:
                ahead = seq[i + 1 : i + 3]
                if len(ahead) > 1 and ahead[1][1] == ":":
                    raise Fault("type annotation")
            if lang == "js" and text == "interface" and fresh and nxt and nxt[0] == "id" or lang == "js" and text in ("public", "private", "protected", "readonly", "abstract") and nxt and nxt[0] == "id":
                raise Fault("type declaration")
            if text == "const" and fresh and nxt and nxt[0] == "id" and top[1] != "class":
                ahead = seq[i + 1 : i + 3]
                if len(ahead) > 1 and (ahead[1][1] in (";", ",", "(")):
                    raise Fault("const without a value")
        if kind == "open":
            chain = 0
            if text == "{":
                if script:
                    role = "object" if pk == "op" and pt in ("=", "(", ",", ":", "?", "=>", "[", "&&", "||", "??", "...", "+") and pt != "=>" or pk == "open" and pt in ("(", "[") or pk == "id" and pt in ("return", "import", "export", "default", "const", "let", "var", "type", "yield", "throw", "case", "typeof", "in", "of", "await") else "block"
                    if pk == "op" and pt == ":" and top[1] in ("block", "top") and top[1] != "class":
                        role = "object" if lang == "ts" or ternary[-1] else "block"
                    if role == "block" and _opens_class(seq, i):
                        role = "class"
                    if role == "block" and pk == "id" and pt not in words and not newline:
                        # a word right before a block: only a class or type head has that
                        if lang == "js":
                            raise Fault(f"{pt[:20]} before {{")
                    if role == "block" and pk in ("num", "str") and not newline:
                        raise Fault(f"{pt[:20]} before {{")
                else:
                    role = "block"
                    if lang != "cpp" and pk == "id" and pt not in words and lang == "c" and not _head(seq, i, ("struct", "union", "enum")):
                        raise Fault(f"{pt[:20]} before {{")
                    if lang == "java" and pk == "id" and pt not in words and not _head(seq, i, ("class", "interface", "enum", "record", "module", "implements", "extends", "throws", "permits")) and not (frames[-1][1] == "block" and _head(seq, i, (",",))):
                        # an enum constant with a body, or a compact record constructor
                        if _word_before(seq, i) is not None and _word_before(seq, i) not in (",", ";", "{", "}", "public", "private", "protected", ">"):
                            raise Fault(f"{pt[:20]} before {{")
                    if lang == "java" and pt in ("import", "export", "from"):
                        raise Fault(f"{pt} before {{")
                    if lang in ("c", "cpp") and pk == "id" and pt in ("import", "from", "export") and lang == "c":
                        raise Fault(f"{pt} before {{")
                    if lang == "cpp" and pk == "id" and pt == "import":
                        raise Fault("import before {")
            elif text == "(":
                role = "paren"
                if _is_value(prev, words) and pk in ("num",) and not (script and newline):
                    raise Fault(f"{pt[:20]} before (")
            else:
                role = "array"
            frames.append([text, role] + (["for"] if text == "(" and pt in ("for", "await") else []))
            ternary.append(0)
        elif kind == "close":
            chain = 0
            frame = frames.pop()
            ternary.pop()
            if pk == "op" and pt in ("=", "+", "-", "/", "%", "==", "===", "!=", "!==", "&&", "||", "??", "+=", "-=", ".", "=>", "->"):
                if not (lang in ("c", "cpp") and pt in ("&&",) or lang == "cpp" and pt == "=" and text == "]" or lang == "cpp" and text == ")" and pt in ("+", "-", "/", "%", "==", "!=", "||")):
                    raise Fault(f"{pt} before {text}")
            if pk == "op" and pt == "," and text == ")" and not script:
                raise Fault(", before )")
            if not script and text == "}" and frame[1] == "block" and pk in ("num", "str", "id") and lang == "java" and not _enum_like(seq, i, lang == "cpp"):
                raise Fault("statement without ;")
            if lang in ("c", "cpp") and text == "}" and pk in ("num", "str", "id") and not _enum_like(seq, i, lang == "cpp"):
                raise Fault("statement without ;")
            if not script and text == "}" and pk == "close" and pt == ")" and not _enum_like(seq, i, lang == "cpp"):
                raise Fault("statement without ;")
            if script and text == "}" and frame[1] == "object" and pk == "op" and pt == ";" and lang == "js":
                raise Fault("; in an object")
        prev = t
    if prev and prev[0] == "op" and prev[1] not in (";", ">", "++", "--", "*", "!", ")"):
        raise Fault(f"premature end after {prev[1]}")
    if prev and prev[0] == "op" and prev[1] in ("*",) and not script:
        raise Fault("premature end")
    if not script and prev and prev[0] in ("id", "num", "str") or not script and prev and prev[0] == "close" and prev[1] in (")", "]"):
        if lang == "java" or prev[0] != "close" or n:
            raise Fault("premature end, ; missing")
    if script and prev and prev[0] == "id" and prev[1] in ("function", "class", "const", "let", "var", "new", "if", "else", "for", "while", "import", "export", "case", "throw", "typeof", "extends", "try", "switch", "async", "do"):
        raise Fault(f"premature end after {prev[1]}")


def _allowed(pk: str, pt: str, text: str, lang: str, nxt: Token | None) -> bool:
    """Operators that stand without a value before them in a few forms of a language."""
    if lang in ("js", "ts"):
        return text == "*" and pt in ("{", "(", ",", ";", "}") or text == "/" or text == "=" and pt in (">", "]", "}", "?", "!", "*") or lang == "ts" and (pt in (">", "?", "!", "]", ":", "=", "|", "(", "<", ",") or text in ("|", "&")) or pt in ("++", "--") or pt == ">" and lang == "ts"
    if lang == "java":
        return pt in (">", "?", "++", "--", "*", ">>", "...") or text in ("->",) and pt in (")",) or text == "&" and pt == ">"
    return pt in (">", "*", "&", "&&", "...", "++", "--", ">>", "operator", "->", ":", "=", ",") and text in ("=", "*", "&", "&&", "...", ",", "::", ".", "->", ">", "==", "!=", "+", "-", "<=", ">=", "||") or text in (".",) or pt in ("(", "[", "<", "{") and text in ("=", "&", "*", "::", "&&", ".", "...") or text == "->"


def _opens_class(seq: list[Token], i: int) -> bool:
    for j in range(i - 1, -1, -1):
        t = seq[j]
        if t[1] in (";", "{", "}", ")", "=>"):
            return False
        if t[0] == "id" and t[1] in ("class", "interface", "enum", "namespace", "module", "type", "declare", "extends", "implements"):
            return True
    return False


def _head(seq: list[Token], i: int, heads: tuple[str, ...]) -> bool:
    for j in range(i - 1, -1, -1):
        if seq[j][1] in (";", "{", "}"):
            return False
        if seq[j][1] in heads:
            return True
    return False


def _word_before(seq: list[Token], i: int) -> str | None:
    return seq[i - 2][1] if i > 1 else None


def _enum_like(seq: list[Token], i: int, cpp: bool = False) -> bool:
    """Whether the block that closes at i is a list of values: an enum body or an array initialiser."""
    depth = 0
    for j in range(i - 1, -1, -1):
        t = seq[j]
        if t[0] == "close":
            depth += 1
        elif t[0] == "open":
            if depth:
                depth -= 1
            else:
                before = seq[j - 1 : j] if j else []
                if before and (before[-1][1] in ("=", "{", ",", "]", "(", "return", ">") or before[-1][0] == "id" and _head(seq, j, ("enum", "=", "return", "new", "export"))):
                    return True
                if before and before[-1][1] == ")":
                    # a compound literal follows a cast, a body follows the parameters of a name
                    k, level = j - 1, 0
                    while k >= 0:
                        level += (seq[k][0] == "close") - (seq[k][0] == "open")
                        if level == 0:
                            break
                        k -= 1
                    ahead = seq[k - 1] if k > 0 else None
                    return ahead is not None and ahead[0] not in ("id", "close") and ahead[1] not in (">", "*", "&", "~", "=", "+", "-", "<", "!", "|", "/", "%", "^", "==", "->", ",", "&&", "||", "++", "--")
                if before and before[-1][0] == "id" and cpp and before[-1][1] not in ("const", "noexcept", "override", "final", "try", "else", "do", "mutable", "volatile") and not _head(seq, j, ("class", "struct", "union", "namespace", "concept", "extern")):
                    return True
                return _head(seq, j, ("enum", "@interface")) or bool(before) and before[-1][0] == "id" and _head(seq, j, ("@",))
        elif t[1] == ";" and not depth:
            return False
    return False


def check_css(toks: list[Token]) -> None:
    """Rules are a prelude and a block; a block holds declarations ``name: value`` and nested rules."""
    depth, run, skip = 0, [], 0
    for t in toks:
        if t[0] == "nl":
            continue
        if skip or t[1] == "{" and len(run) > 1 and run[0][1].startswith("--") and run[1][1] == ":":
            # the value of a custom property may be any balanced block
            skip += (t[0] == "open") - (t[0] == "close")
            run = run[:2] + [("id", "block", t[2])]
            continue
        if t[0] == "open" and t[1] == "{":
            if not run or run[0][0] == "op" and run[0][1] in ("=", ";", ",", "<", "!", "/", "%", "$", "^"):
                raise Fault("rule without a selector")
            if run[0][0] == "num" and not run[0][1].endswith("%"):
                raise Fault("rule without a selector")
            if any(x[1] in ("=", "/", "%", "!", "^", "$") and x[0] == "op" for x in run) and not any(x[1] == "[" for x in run) and not run[0][1].startswith("@"):
                raise Fault("not a selector")
            if run[-1][0] == "op" and run[-1][1] in (",", ">", "+", "~", ".", ":"):
                raise Fault("selector ends early")
            if any(x[1] == "(" for x in run) and not run[0][1].startswith("@"):
                for a, b in zip(run, run[1:]):
                    if b[1] == "(" and (a[0] != "id" or a[2] + len(a[1]) != b[2]):
                        raise Fault("not a selector")
                    if b[1] == "(" and not _pseudo(run, a):
                        raise Fault("not a selector")
            depth += 1
            run = []
        elif t[0] == "close" and t[1] == "}":
            if run:
                _declaration(run)
            depth -= 1
            run = []
        elif t[1] == ";" and _level(run) == 0:
            if run:
                if depth == 0 and not run[0][1].startswith("@"):
                    raise Fault("declaration outside a rule")
                _declaration(run)
            run = []
        else:
            run.append(t)
    if run:
        raise Fault("premature end")


def _pseudo(run: list[Token], a: Token) -> bool:
    k = run.index(a)
    return k > 0 and run[k - 1][1] == ":"


def _level(run: list[Token]) -> int:
    return sum((t[0] == "open") - (t[0] == "close") for t in run)


def _declaration(run: list[Token]) -> None:
    if run[0][1].startswith("@"):
        return
    if run[0][1] in ("*",) and len(run) > 1:
        run = run[1:]
    if len(run) < 2 or run[0][0] != "id" or run[1][1] != ":":
        raise Fault("declaration without a colon")
    if len(run) < 3 and not run[0][1].startswith("--"):
        raise Fault("declaration without a value")
    if run[0][1][0] in "#" or any(t[1] == ":" for t in run[2:]) and not run[0][1].startswith("--") and _level(run) == 0 and not any(t[1] == "(" for t in run):
        raise Fault("declaration runs on")


#: Words that begin a block of Python, those that expect or join operands, and those that do so only at the start of a statement.
_PY_HEADS = {"if", "elif", "else", "for", "while", "try", "except", "finally", "with", "def", "class"}
_PY_JOINS = "if|else|elif|for|while|in|is|not|and|or|lambda|def|class|return|yield|from|import|as|assert|del|raise|global|nonlocal|await|async|with|except"
_PY_SOFT = {"match", "case", "type"}
#: An operand right before another one.
_PY_ADJACENT = re.compile(rf"(?<!\w)(?!(?:{_PY_JOINS})\b)(?P<a>\w+)[ \t]+(?!(?:{_PY_JOINS})\b)(?P<b>\w+|\"\")")
#: What the line lexer of Python stops at; words and signs between are water.
_PY_STOPS = re.compile(
    r"(?:\w++(?![\"'])|[^\w\n\r()\[\]{}#\\\"'$?`!\x80-\U0010FFFF]++|!=)*+(?:(?P<nl>\r?\n|\r)|(?P<open>[\[({])|(?P<close>[\])}])|(?P<comment>#[^\r\n]*)|(?P<join>\\\r?\n)|"
    r"(?P<str>(?i:rb|br|rf|fr|rt|tr|[rbuft])?(?:\"\"\"(?:\\[\s\S]|(?!\"\"\")[^\\])*\"\"\"|'''(?:\\[\s\S]|(?!''')[^\\])*'''|(?!\"\"\"|''')(?:\"(?:\\(?:\r\n|[\s\S])|[^\\\r\n\"])*\"|'(?:\\(?:\r\n|[\s\S])|[^\\\r\n'])*')))|"
    r"(?P<word>\w+)|(?P<bad>[\"'])|(?P<stray>[\s\S]))?+"
)
_PY_LEAD = re.compile(r"[ \t\f]*")
_PY_WORD = re.compile(r"(?:async\s+)?([^\W\d]\w*)")


def check_python(text: str) -> None:
    """Lexer for Python on two stacks, of brackets and of indentation: conflict markers, open literals, unbalanced delimiters, premature
    ends, lines that fit no block, missing blocks, heads without a colon, operands without an operator between them.

    From a formatted string whose quotes may nest on, everything is left to the grammar.
    """
    brackets: list[str] = []
    indents = [0]
    due = ""  # the head whose block is due
    begin = 1 if text.startswith("\ufeff") else 0  # of the logical line
    cuts: list[tuple[int, int, str]] = []  # literals, comments and joined line ends of this line, with what stands for them
    for m in _PY_STOPS.finditer(text, begin):
        kind = m.lastgroup
        if kind == "nl" or kind is None:
            if kind is None and m.end() < len(text) or brackets:
                continue
            end = m.start("nl") if kind else len(text)
            line = text[begin:end]
            if cuts:
                out, at = [], begin
                for a, b, put in cuts:
                    out += [text[at:a], put]
                    at = b
                line = "".join([*out, text[at:end]])
                cuts = []
            begin = m.end()
            code = line.strip()
            if not code:
                continue
            if code[0] in "<>|=" and _MARKER.match(line):
                raise Fault("merge-conflict marker")
            lead = _PY_LEAD.match(line).group()
            width = len(lead.rpartition("\f")[2].expandtabs(8)) if "\t" in lead or "\f" in lead else len(lead)
            if due:
                if width <= indents[-1]:
                    raise Fault(f"no block after {due}")
                indents.append(width)
                due = ""
            elif width != indents[-1]:
                if width > indents[-1]:
                    raise Fault("unexpected indentation")
                while indents[-1] > width:
                    indents.pop()
                if indents[-1] != width:
                    raise Fault("indentation that fits no block")
            w = _PY_WORD.match(code)
            word = w[1] if w else ""
            if code[-1] == ":":
                if word not in _PY_HEADS and word not in _PY_SOFT:
                    raise Fault("colon without a head")
                due = word
            if word in _PY_HEADS:
                flat = code if "(" not in code and "[" not in code and "{" not in code else _outside(code)
                if ":" not in flat:
                    raise Fault(f"{word} without a colon")
                if word == "except" and "," in flat.partition(":")[0]:
                    raise Fault("except with a bare list")
            for hit in _PY_ADJACENT.finditer(code):
                if hit.start() or word not in _PY_SOFT:
                    raise Fault(f"{hit['a'][:20]} before {hit['b'][:20]}")
        elif kind == "str":
            a, b = m.span("str")
            body = text[a:b]
            if body[0] not in "\"'" and any(c in "fFtT" for c in body[:2]) and body.count("{") != body.count("}"):
                return  # quotes nest here, perhaps
            cuts.append((a, b, '""'))
        elif kind == "comment" or kind == "join":
            cuts.append((*m.span(kind), " "))
        elif kind == "open":
            brackets.append(PAIRS[m["open"]])
        elif kind == "close":
            if not brackets or brackets.pop() != m["close"]:
                raise Fault(f"unbalanced {m['close']}")
        elif kind == "bad":
            raise Fault("unterminated literal")
        elif kind == "stray" and not f"a{m['stray']}".isidentifier():
            raise Fault(f"stray {m['stray']!r}")
    if brackets:
        raise Fault(f"premature end, {brackets[-1]} missing")
    if due:
        raise Fault(f"premature end, no block after {due}")


def _outside(code: str) -> str:
    """What stands outside all brackets."""
    out, depth = [], 0
    for part in re.split(r"([()\[\]{}])", code):
        if part in ("(", "[", "{"):
            depth += 1
        elif part in (")", "]", "}"):
            depth -= 1
        elif not depth:
            out.append(part)
    return "".join(out)


def check_json(toks: list[Token]) -> None:
    """The whole grammar of JSON as a pushdown automaton over its tokens, however deep they nest."""
    stack: list[str] = []
    want = "value"
    for kind, text, _ in toks:
        if kind == "nl":
            continue
        if want in ("value", "item"):
            if kind == "open":
                stack.append(PAIRS[text])
                if text == "(":
                    raise Fault("stray '('")
                want = "item" if text == "[" else "first key"
            elif kind in ("str", "num", "id"):
                want = "after"
            elif want == "item" and text == "]":
                stack.pop()
                want = "after"
            else:
                raise Fault(f"{text} for a value")
        elif want in ("first key", "key"):
            if kind == "str":
                want = ":"
            elif want == "first key" and text == "}":
                stack.pop()
                want = "after"
            else:
                raise Fault(f"{text} for a key")
        elif want == ":":
            if text != ":":
                raise Fault("key without a colon")
            want = "value"
        elif not stack:
            raise Fault(f"{text} after the end")
        elif text == "," and kind == "op":
            want = "value" if stack[-1] == "]" else "key"
        elif kind == "close" and text == stack[-1]:
            stack.pop()
        else:
            raise Fault(f"{text[:20]} without a comma")
    if stack or want != "after":
        raise Fault("premature end")


_TOML_SCALAR = re.compile(
    r"true|false|[+-]?(?:inf|nan)|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|"
    r"\d{4}-\d\d-\d\d(?:[Tt]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?"
)


def check_toml(toks: list[Token]) -> None:
    """Statements of TOML on a stack of open arrays and inline tables: headers, keys, values, separators, one statement a line."""
    stack: list[str] = []
    want = "statement"
    i, n = 0, len(toks)

    def key(i: int) -> int:
        """End of the dotted key at i."""
        j = i
        while j < n and toks[j][0] in ("id", "str"):
            if j > i and not toks[j - 1][1].endswith(".") and not toks[j][1].startswith("."):
                raise Fault("key in pieces")
            j += 1
        if j == i or any(t[0] == "id" and ("+" in t[1] or ":" in t[1]) for t in toks[i:j]):
            raise Fault("a key is missing")
        return j

    while i < n:
        kind, text, at = toks[i]
        if want == "statement":
            if kind == "nl":
                i += 1
            elif text == "[" and kind == "open":
                k = 2 if i + 1 < n and toks[i + 1][1:] == ("[", at + 1) else 1
                i = key(i + k)
                if [t[1] for t in toks[i : i + k]] != ["]"] * k:
                    raise Fault("header without an end")
                i += k
                want = "end"
            else:
                i = key(i)
                if i >= n or toks[i][1] != "=":
                    raise Fault("key without a value")
                i += 1
                want = "value"
        elif want == "end" or want == "after" and not stack:
            if kind != "nl":
                raise Fault(f"{text[:20]} after a value")
            want = "statement"
        elif kind == "nl" and stack:
            i += 1
        elif want in ("value", "item"):
            i += 1
            if kind == "open" and text != "(":
                stack.append(PAIRS[text])
                want = "item" if text == "[" else "entry"
            elif kind == "str":
                want = "after"
            elif want == "item" and text == "]":
                stack.pop()
                want = "after"
            elif kind == "id" and _TOML_SCALAR.fullmatch(text):
                if re.fullmatch(r"\d{4}-\d\d-\d\d", text) and i < n and toks[i][0] == "id" and toks[i][2] == at + len(text) + 1:
                    i += 1  # the time of a date may follow after a blank
                want = "after"
            else:
                raise Fault(f"{text[:20].strip() or 'line end'} for a value")
        elif want == "entry":
            if text == "}":
                stack.pop()
                i += 1
                want = "after"
            else:
                i = key(i)
                if i >= n or toks[i][1] != "=":
                    raise Fault("key without a value")
                i += 1
                want = "value"
        else:
            i += 1
            if text == "," and kind == "op":
                want = "item" if stack[-1] == "]" else "entry"
            elif kind == "close" and text == stack[-1]:
                stack.pop()
            else:
                raise Fault(f"{text[:20]} without a comma")
    if stack or want not in ("statement", "after", "end"):
        raise Fault("premature end")


def _exact(text: str, lang: str) -> None:
    """The grammar itself, for the languages for which the Python library has it; it confirms what lexer and stack let pass."""
    if lang == "py":
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                compile(text.removeprefix("\ufeff"), "f", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
            except (SyntaxError, ValueError) as x:
                raise Fault(str(x)[:80]) from None
            except (RecursionError, MemoryError):
                pass  # too deep for this parser, which is no fault of the file
    elif lang == "json":
        def no(c: str) -> None:
            raise ValueError(f"{c} is no JSON")

        try:
            json.loads(text.removeprefix("﻿"), parse_constant=no)
        except ValueError as x:
            raise Fault(str(x)[:80]) from None
        except RecursionError:
            pass
    elif lang == "toml":
        try:
            tomllib.loads(text.removeprefix("﻿"))
        except tomllib.TOMLDecodeError as x:
            raise Fault(str(x)[:80]) from None
        except RecursionError:
            pass
    elif lang == "yaml":
        import yaml  # without it the job fails, as else its verdicts would depend on the machine

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        try:
            for _ in yaml.parse(text, Loader=loader):
                pass
        except yaml.YAMLError as x:
            raise Fault(f"{getattr(x, 'context', '') or ''} {getattr(x, 'problem', '') or x}".strip()[:80]) from None


_QUOTED = {'"': re.compile(r'"(?:\\[\s\S]|[^"\\])*"'), "'": re.compile(r"'(?:''|[^'])*'")}
_YAML_PROPERTY = re.compile(r"[&!][^\s,\[\]{}]*(?=\s|\Z)")
_YAML_ALIAS = re.compile(r"\*(?:[^\s,\[\]{}:]|:(?!\s|\Z))*")
_YAML_BLOCK = re.compile(r"[|>](?:[1-9][+-]?|[+-][1-9]?)?[ \t]*(?:[ \t]#.*)?$", re.M)
_YAML_REST = re.compile(r"[ \t]*$|[ \t]+#", re.M)
_YAML_KEY = re.compile(r"[ \t]*:(?=\s|\Z)")
#: A plain scalar of one line, with the colon that makes it a key.
_YAML_PLAIN = re.compile(r"(?:[^\s:#]|(?<![ \t\n])#|:(?=\S)|[ \t]+(?![ \t#\n:]|\Z)|[ \t]+(?=:\S))+(?P<key>[ \t]*:(?=\s|\Z))?")


def _quoted(text: str, pos: int) -> int:
    m = _QUOTED[text[pos]].match(text, pos)
    if not m:
        raise Fault("unterminated literal")
    return m.end()


def _flow(text: str, pos: int) -> int:
    """End of the flow collection that opens at ``pos``: a stack of the brackets that are open."""
    stack: list[str] = []
    start = True  # whether a scalar may begin here
    while pos < len(text):
        c = text[pos]
        if c in "\"'" and start:
            pos = _quoted(text, pos)
            start = False
            continue
        if c == "#" and text[pos - 1] in " \t\n":
            end = text.find("\n", pos)
            pos = len(text) if end < 0 else end
            continue
        if c in "[{":
            stack.append(PAIRS[c])
        elif c in "]}":
            if stack.pop() != c:
                raise Fault(f"unbalanced {c}")
            if not stack:
                return pos + 1
        if start and (m := _YAML_PROPERTY.match(text, pos)):
            pos = m.end()
            continue
        if not c.isspace():
            start = c in "[{,:?"
        pos += 1
    raise Fault(f"premature end, {stack[-1]} missing")


def check_yaml(text: str) -> None:
    """Lexer for YAML on a stack of open block collections (kind, column) and flow brackets: conflict markers, tabs as indentation,
    open quotes and brackets, entries that fit no open collection, keys within values. Explicit keys, directives and documents
    that begin on the line of their marker are left to the grammar."""
    for m in _MARKER.finditer(text):
        if not m.group().startswith("=") or "<<<<<<<" in text:
            # in a block scalar a marker would be indented; at column 0 it is a conflict
            raise Fault("merge-conflict marker")
    text = re.sub(r"\r\n?", "\n", text).removeprefix("\ufeff")
    stack: list[tuple[str, int]] = []
    pending = True  # whether a value is due
    plain = False  # whether the last value was a plain scalar, which may go on
    pos, n = 0, len(text)
    while pos < n:
        line = pos
        end = text.find("\n", pos)
        end = n if end < 0 else end
        body = text[line:end]
        lead = len(body) - len(body.lstrip(" "))
        rest = body.strip()
        top = stack[-1][1] if stack else -1
        if not rest or rest.startswith("#"):
            pos = end + 1
            continue
        if re.match(r"(?:---|\.\.\.)(?:\s|\Z)", body):
            if body[3:].strip() and not body[3:].strip().startswith("#"):
                return
            stack, pending, plain = [], True, False
            pos = end + 1
            continue
        if body[lead] == "\t":
            if lead <= top:
                raise Fault("tab as indentation")
            return
        if plain and lead > top:
            m = _YAML_PLAIN.match(rest)
            if m and m["key"]:
                raise Fault("key within a value")
            pos = end + 1
            continue
        if body.startswith("%"):
            return
        plain = False
        popped = False
        while stack and stack[-1][1] > lead:
            stack.pop()
            popped = True
        pos = line + lead
        value = False  # whether the key of this value is on this line
        first = -1  # where the properties of what follows begin
        while pos < n:
            rest_of = _YAML_REST.match(text, pos)
            if rest_of and (pos == n or text[pos] in " \t\n#"):
                end = text.find("\n", pos)
                pos = n if end < 0 else end
                break
            c, col = text[pos], pos - line
            if c in " \t":
                pos += 1
                continue
            mark = text[pos + 1 : pos + 2]
            if c in "?:" and (not mark or mark.isspace()):
                return
            if c == "-" and (not mark or mark.isspace()):
                if value:
                    raise Fault("entry after a key")
                if first >= 0:
                    return
                _enter(stack, "seq", col, pending and not popped)
                pending, popped = True, False
                pos += 1
                continue
            if m := _YAML_PROPERTY.match(text, pos):
                first = col if first < 0 else first
                pos = m.end()
                continue
            at = col if first < 0 else first
            if m := _YAML_BLOCK.match(text, pos):
                if not pending:
                    raise Fault("a value that is not due")
                parent = stack[-1][1] if stack else -1
                pos = m.end() + 1
                while pos < n:
                    end = text.find("\n", pos)
                    end = n if end < 0 else end
                    inner = text[pos:end]
                    if inner.strip() and (len(inner) - len(inner.lstrip(" ")) <= parent or parent < 0 and re.match(r"(?:---|\.\.\.)(?:\s|\Z)", inner)):
                        break
                    pos = end + 1
                pending = False
                pos -= 1
                break
            if c in "@`%]},|>":
                raise Fault(f"stray {c!r}")
            start = pos
            scalar = False
            if c in "\"'":
                pos = _quoted(text, pos)
            elif c in "[{":
                pos = _flow(text, pos)
            elif c == "*":
                pos = _YAML_ALIAS.match(text, pos).end()
            else:
                m = _YAML_PLAIN.match(text, pos)
                if not m:
                    return
                scalar, pos = True, m.end() - len(m["key"] or "")
            if m := _YAML_KEY.match(text, pos):
                if value:
                    raise Fault("key within a value")
                if "\n" in text[start:pos]:
                    return
                _enter(stack, "map", at, pending and not popped)
                pending, popped, value, first = True, False, True, -1
                pos = m.end()
                continue
            if not _YAML_REST.match(text, pos):
                if scalar or text[pos] == "#":
                    return
                raise Fault("text after a value")
            if stack and not value and col <= stack[-1][1]:
                raise Fault("key without a colon")
            if not pending or popped:
                raise Fault("a value that is not due")
            pending, plain = False, scalar
            end = text.find("\n", pos)
            pos = n if end < 0 else end
            break
        pos += 1


def _enter(stack: list[tuple[str, int]], kind: str, col: int, due: bool) -> None:
    """An entry of a block collection at ``col``: of the innermost that is open, or of a new one where a value is due."""
    if kind == "map" and stack[-1:] == [("seq", col)] and stack[-2:-1] == [("map", col)]:
        stack.pop()  # entries may stand below the key that holds them
    if stack and stack[-1][1] == col and (stack[-1][0] == kind or not (kind == "seq" and due)):
        if stack[-1][0] != kind:
            raise Fault(f"{kind} within a collection of another kind")
    elif due and (not stack or stack[-1][1] < col or kind == "seq" and stack[-1] == ("map", col)):
        stack.append((kind, col))
    else:
        raise Fault("indentation that fits no collection")


def fault(text: str | None, lang: str | None) -> str | None:
    """Why ``text`` is not valid ``lang``, or None if it is. Null text or an unknown language is no fault; blank text is valid
    where the grammar allows an empty file, which JSON alone does not. No text breaks the grammar of HTML, whose standard says how
    each is read, so HTML files are never at fault. What nests deeper than the library's parser can follow is judged by lexer and stack.
    """
    if text is None or lang is None:
        return None
    try:
        if lang == "yaml":
            check_yaml(text)
        elif lang == "py":
            check_python(text)
        elif lang != "html":
            toks = tokens(text, lang)
            conflict_markers(text, toks)
            balance(toks)
            if lang in _WORDS:
                adjacency(toks, lang)
            elif lang == "css":
                check_css(toks)
            elif lang == "json":
                check_json(toks)
            elif lang == "toml":
                check_toml(toks)
        _exact(text, lang)
    except Fault as x:
        return str(x)
    return None


def language_of(path: str | None) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if path and "." in path else None


def file_faults(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``files`` with ``lang`` and ``fault`` (null: valid, null content or a language that is not checked). Other columns stay, but
    for those of these two names, which are replaced; a repeated row is judged again. No shuffle: the files go through Arrow batches where they lie.
    """

    @F.pandas_udf("struct<lang:string,fault:string>")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for paths, contents in batches:
            langs = [language_of(p) for p in paths]
            yield pd.DataFrame({"lang": langs, "fault": [fault(c, g) for c, g in zip(contents, langs)]}, dtype=object)

    # declared non-deterministic only so that a filter on the verdict does not make the planner judge twice
    judge = judge.asNondeterministic()
    rest = [F.col(f"`{c}`") for c in files.columns if c not in ("lang", "fault")]
    return files.select(*rest, judge(F.col(path), F.col(content)).alias("_judged")).select(*rest, F.col("_judged.lang").alias("lang"), F.col("_judged.fault").alias("fault"))


def indexer_view(runs: DataFrame) -> DataFrame:
    """What the indexer itself reports per repo: (repo, runs, files_indexed, reported, rate). ``reported`` counts the distinct
    files in errors that speak of syntax, in any of the indexer's wordings; other errors and null arrays count as none. Repeated
    runs (same run_id) count once; rate is null where nothing was indexed.
    """
    once = runs.dropDuplicates(["run_id"])
    totals = once.groupBy("repo").agg(F.count("*").alias("runs"), F.sum("files_indexed").alias("files_indexed"))
    about = r"(?i)syntax|unexpected end|could not parse|parse error|unterminated|unbalanced"
    path = F.regexp_replace(F.regexp_extract("e", r"^([^:]+):", 1), r"^(/builds/|\./)", "")
    said = once.select("repo", F.explode("errors").alias("e")).where(F.col("e").rlike(about)).select("repo", path.alias("path")).distinct()
    return totals.join(said.groupBy("repo").agg(F.count("*").alias("reported")), "repo", "left").select(
        "repo", "runs", "files_indexed", F.coalesce("reported", F.lit(0)).cast("bigint").alias("reported"), (F.coalesce("reported", F.lit(0)) / F.nullif("files_indexed", F.lit(0))).alias("rate")
    )
