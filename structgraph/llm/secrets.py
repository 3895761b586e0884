"""Credentials embedded in source code, found and redacted (problem 4).

Literals are segmented into dictionary words by Viterbi. What no word explains is residual; a long residual where something is
assigned is a secret, unless the value has the format of a digest, an id, a pattern or a reference. The dictionary is counted
from the corpus itself, outside what may be a secret.
"""

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.functions.lexers import line_of, line_starts
from structgraph.plans.lineage import stored

#: Share of the repositories that a word of the dictionary must be in.
WORD_SHARE = 0.1
#: Unexplained characters from which a value named as a secret is one.
NAMED_RESIDUAL = 5
#: ... the same where the name says password or passphrase, whose values may be words in part.
PHRASE_RESIDUAL = 3
#: ... and from which a value under any name is one, when it is a single unbroken token.
BARE_RESIDUAL = 16
_UNKNOWN = 4.2  # cost of a character that no word explains, in nats

#: Words of identifiers that announce a secret, in several languages; fixed list.
_SECRET_WORDS = set("""password passwd passwort pwd pass passphrase passcode secret secrets token credential credentials cred creds apikey kennwort geheimnis contrasena contraseña clave
senha motdepasse mdp parola haslo wachtwoord lösenord losenord pin otp bearer authorization privatekey accesskey secretkey signingkey encryptionkey authtoken jwt salt signer""".split())
#: Words that make a following "key" a secret.
_KEY_WORDS = set("api secret access signing signature encryption private auth master client service account shared session crypt crypto ssh hmac aes rsa jwt webhook deploy storage".split())
#: Last words of names for things about a secret that are not the secret; fixed list.
_NOT_SECRET = set("""pattern regex regexp re url uri endpoint host id ids name names path file filename dir digest hash checksum sum fingerprint length len size count limit ttl expiry expires
timeout header headers prefix suffix type kind field column env var ref reference label hint policy rule rules min max section format query sql message msg error text title placeholder
description help prompt algorithm alg mode enabled required index number position version date time at by""".split())
#: Values that stand for a secret without being one.
_PLACEHOLDER = re.compile(
    r"^(?:|\W*(?:change[_ -]?(?:me|it|this)|replace[_ -]?(?:me|this|with.*)|todo|tbd|fixme|none|null|nil|undefined|true|false|example|sample|dummy|fake|test|testing|placeholder|redacted|removed|hidden|"
    r"masked|secret|password|passwd|token|key|your[_ -].*|my[_ -]?(?:password|secret|token|key)|insert[_ -].*|enter[_ -].*|put[_ -].*|xxx+|n/?a|empty|default|string|value|foo|bar|foobar|\.\.\.|"
    r"env|environ)\W*|[*xX•.#_?-]{3,}|<[^<>]*>|\[[^\[\]]*\]|(.)\1{5,})$",
    re.I,
)
_REFERENCE = re.compile(
    r"^\s*(?:\$\{|\{\{|\$\(|\$[A-Za-z_]\w*\s*$|%[({]?\w+[)}]?%?\w?$|#\{|@\{|<%|env[:.]|vault[:.]|ssm:|arn:|aws-?sm|secretsmanager|secret[s]?[:/]|keyring:|op://|file:|sops:|ENC\[|!vault|data:|\w+://[^@\s]*$|os\.environ|process\.env|getenv|"
    r"System\.getenv|config\.|settings\.|self\.|this\.|args\.|kwargs|params\.)|\$\{[^}]*\}|\{\{[^}]*\}\}",
    re.I,
)
_DIGEST = re.compile(r"^(?:(?:sha-?\d{1,3}|md5|blake\w*|crc32|sri)[:=_-].*|(?:0x)?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|\{?[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\}?|\$(?:2[aby]|argon2\w*|5|6|1|pbkdf2\S*)\$.*)$", re.I)
_PATTERN = re.compile(r"^\^.*\$$|\(\?[=!:<]|\\[dwsbDWS]|\[[a-z]-[a-z]|\.\*|\{\d+,\d*\}|%[sd]|\{\w*\}")
_PUBLIC = re.compile(r"-----BEGIN (?:[A-Z0-9 ]*)(?:PUBLIC KEY|CERTIFICATE)|^ssh-(?:rsa|ed25519|dss)|^ecdsa-")
#: First bytes of images, fonts, archives, media, programs and certificates (published formats).
_FILE_FORMAT = re.compile(rb"\x89PNG|GIF8|\xff\xd8\xff|RIFF|wOF[F2]|OTTO|\x00\x01\x00\x00|\x00\x00\x01\x00|\x1f\x8b\x08|PK\x03\x04|BZh|\xfd7zXZ|7z\xbc\xaf|%PDF|\x00asm|\x7fELF|ID3|OggS|fLaC|\s*<(?:\?xml|svg|!doctype|html)|-----BEGIN (?:CERT|PUBLIC)|\x30\x82..\x30\x82", re.S | re.I)
#: Tokens whose issuer is known by their form (published formats).
PROVIDER = re.compile(
    r"(?<![\w-])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[\w-]{16,}|xox[abeoprs]-[A-Za-z0-9-]{16,}|(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}|AIza[\w-]{30,}|(?:sk|rk)_live_[A-Za-z0-9]{16,}|"
    r"sk-(?:proj-|ant-)?[\w-]{20,}|SG\.[\w-]{16,}\.[\w-]{16,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{40,}|dop_v1_[0-9a-f]{40,}|shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}|hf_[A-Za-z0-9]{30,}|EAAC[A-Za-z0-9]{30,}|ya29\.[\w-]{30,}|"
    r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{10,})"
)
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_USERINFO = re.compile(r"\b[a-z][a-z0-9+.-]*://[^\s:/@\"'`<>]*:(?P<v>[^\s@\"'`<>]+)@[\w.\[-]", re.I)
_DSN = re.compile(r"(?:^|[;\s?&\"'])(?:pwd|password|passwd)=(?P<v>[^;&\s\"'`]+)", re.I)
_BEARER = re.compile(r"\b(?:Bearer|Basic|Token)\s+(?P<v>[\w.~+/=-]{12,})", re.I)
_OPTION = re.compile(r"(?<![\w-])--?(?:password|passwd|pass|pwd|token|secret|api-key|apikey|access-key|secret-key|auth-token|passphrase)[= ](?P<v>[^\s\"'`,;]+)", re.I)
_CURL = re.compile(r"\b(?:curl|wget|http)\b[^\n]*?\s(?:-u|--user)[= ]\s*[\"']?[^\s:\"']+:(?P<v>[^\s\"'`]+)", re.I)

#: Prose that tells a credential: "login is NAME / VALUE", "password was VALUE".
_PROSE = re.compile(
    r"\b(?:logins?|credentials?|creds|account|user)\b[^\n/|:=]{0,24}?(?:is|are|was|were|[:=])\s+[\w.@-]+\s*(?:/|\||:|,|\s)\s*(?P<v>[^\s\"'`]{6,})|"
    r"\b(?:password|passwd|passwort|pw|pwd|passphrase|token|secret|api key|key)\s+(?:is|was|now|ist|es|est)\s*[:=]?\s+[\"'`]?(?P<w>[^\s\"'`]{6,})",
    re.I,
)
#: ... and the form "password: VALUE" in a comment.
_PROSE_NAMED = re.compile(r"\b(?:password|passwd|passwort|pw|pwd|passphrase|token|secret|key)\s*[:=]\s+(?P<x>[^\s\"'`]{6,})", re.I)
_COMMENT_LEAD = re.compile(r"(?:#|//|--|\*)[^:=]*\Z")

_LIT = r"(?:[bBuUrRfFL]{0,2})(?:\"\"\"(?P<t{n}>(?:\\.|(?!\"\"\")[^\\])*)\"\"\"|\"(?P<d{n}>(?:\\.|[^\"\\\n])*)\"|'(?P<s{n}>(?:\\.|[^'\\\n])*)'|`(?P<b{n}>(?:\\.|[^`\\])*)`)"
_LITERAL = re.compile(_LIT.replace("{n}", ""), re.S)
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.?)?[ \t]*(?:\\?\r?\n[ \t]*(?:#[^\n]*\n[ \t]*)?)?(?:\+[ \t]*)?(?=[\"'`bBuUrRfFL])")
_KEY = re.compile(r"[\"'`]?(?P<k>[^\W\d][\w$.\[\]\"'-]*?)[\"'`]?\]?\s*(?::\s*[\w<>\[\]|?. ]+?)?\s*(?:=>|:=|<-|(?<![=!<>])=(?!=)|:)\s*(?:new\s+\w+\s*)?[\[({]?\s*\Z")
_FALLBACK = re.compile(
    r"(?:getenv|environ\.get|environ|getProperty|getOrDefault|get_env|env|getEnv|fetch|setdefault|get)\(?\s*\(\s*[\"'](?P<a>[\w.-]+)[\"']\s*,\s*\Z|process\.env(?:\.(?P<b>\w+)|\[\s*[\"'](?P<c>\w+)[\"']\s*\])\s*\)?\s*(?:\|\||\?\?)\s*\Z|"
    r"(?:getenv|environ\.get|System\.getenv)\(\s*[\"'](?P<d>\w+)[\"']\s*\)\s*(?:or|\|\||\?\?|\?:)\s*\Z"
)
_BARE = re.compile(r"(?<![\w$.-])(?P<k>[^\W\d][\w$.-]*+)[ \t]*+[:=][ \t]++(?P<v>[^\s\"'`#|>&*!,\[{(][^\s\"'`,;]{2,}+)[ \t]*+(?:#.*|\*/|-->)?\r?$", re.M)
#: What may stand before such a key: list and comment marks and a few plain words.
_BARE_LEAD = re.compile(r"[ \t]*+(?:(?://+|#+|--|/?\*+|;+|<!--|-)[ \t]*+)*+(?:[\w$.-]+[ \t]+){0,4}\Z")
_BARE_TIGHT = re.compile(r"^[ \t]*(?:export[ \t]+|set[ \t]+|ENV[ \t]+)?(?P<k>[A-Za-z_][\w.-]*)=(?P<v>[^\s\"'`#|>&!,\[{(][^\s\"'`,;]{2,})[ \t]*\r?$", re.M)


def name_words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-ÿ]+|[A-ZÀ-Þ]+", name.split(".")[-1])] or [name.lower()]


@lru_cache(4096)
def names_secret(name: str) -> bool:
    """Whether an identifier announces a secret."""
    words = name_words(name)
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in _NOT_SECRET:
        return False
    flat = "".join(words)
    if any(w in _SECRET_WORDS for w in words) or flat in _SECRET_WORDS:
        # "token_batch", "rank_token": the word must be the head of the name, or be a plain password word
        return words[-1] in _SECRET_WORDS or words[-1] in ("key", "value", "val", "string", "str", "b", "base", "old", "new", "prod", "dev", "live", "raw", "plain", "default") or any(w in ("password", "passwd", "pwd", "passphrase", "kennwort", "secret") for w in words)
    if words[-1] in ("key", "keys") and len(words) > 1:
        return any(w in _KEY_WORDS for w in words[:-1])
    if name.isupper() and flat.endswith(("pass", "pwd", "passwd")) and not flat.endswith(("bypass", "compass", "surpass", "trespass", "overpass")):
        return True
    return any(flat.endswith(x) for x in ("secret", "password", "token","passphrase", "apikey", "secretkey", "privatekey", "accesstoken", "authtoken", "clientsecret", "contrasena", "kennwort", "mysqlpwd"))


class Dictionary:
    """Words with costs; :meth:`residual` is the Viterbi segmentation of a value."""

    def __init__(self, counts: dict[str, int]) -> None:
        total = sum(counts.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items() if len(w) >= 3}
        self.longest = min(24, max(map(len, self.cost), default=3))
        self._memo: dict[str, int] = {}

    def residual(self, value: str) -> int:
        """Characters that the cheapest segmentation into words leaves unexplained; punctuation and white space cost nothing
        and count only inside unexplained runs that mix letters, digits and signs."""
        hit = self._memo.get(value)
        if hit is not None:
            return hit
        left = 0
        for chunk in re.findall(r"[^\s/,;]+", value):
            runs = re.findall(r"[^\W\d_]+", chunk)
            here = sum(self._run(r) for r in runs)
            if not runs or here or re.search(r"\d", chunk) and re.search(r"[A-Za-z]", chunk):
                here += len(re.findall(r"\d", chunk))
            if here:
                here += len(re.findall(r"[!@#$%^&*+=~?|_-]", chunk.strip("-_=+*#!?.")))
            left += here
        if len(value) < 256:  # only short values are remembered, and not too many of them
            if len(self._memo) > 200_000:
                self._memo.clear()
            self._memo[value] = left
        return left

    def _run(self, run: str) -> int:
        # a run of letters may be camel case; case changes inside random runs do not help them
        s = run.lower()
        n = len(s)
        best = [0.0] + [math.inf] * n
        open_ = [0] * (n + 1)
        cost = self.cost
        for i in range(n):
            base = best[i]
            if base + _UNKNOWN < best[i + 1]:
                best[i + 1], open_[i + 1] = base + _UNKNOWN, open_[i] + 1
            for j in range(i + 3, min(n, i + self.longest) + 1):
                c = cost.get(s[i:j])
                if c is not None and (j - i > 3 or n <= 4) and base + c < best[j]:
                    best[j], open_[j] = base + c, open_[i]
        return open_[n]


class Candidate(NamedTuple):
    """What may be a secret by its place: the stretches of its pieces, the rule that proposed it, the value and the name it stands under."""

    starts: list[int]
    ends: list[int]
    rule: str
    value: str
    key: str


#: Letters of which a name of a secret has some, the words above without those that contain another; a cheap test before the exact ones.
_STEMS = [w for w in sorted(_SECRET_WORDS | {"key"}) if not any(v in w for v in (_SECRET_WORDS | {"key"}) - {w})]
#: Letters without which a form cannot occur in a text.
_NEEDS = {
    "_USERINFO": ("://",), "_DSN": ("pwd=", "password=", "passwd="), "_BEARER": ("bearer", "basic", "token"), "_OPTION": ("-pass", "-pwd", "-token", "-secret", "-api", "-access", "-auth"),
    "_CURL": ("curl", "wget", "http"), "PROVIDER": ("gh", "glpat-", "xox", "akia", "asia", "agpa", "aida", "aroa", "aiza", "k_live_", "sk-", "sg.", "npm_", "pypi-", "dop_v1_", "shp", "hf_", "eaac", "ya29.", "eyj"),
}
#: Words that hold sentences together, in several languages; fixed list.
_GLUE = set("the a an of to in is are was for and or when where that this with by from on at be it its as must may der die das und ist von zu mit le la les et de du des est el los y en que para por o os da do um uma".split())


def _classes(v: str) -> int:
    return bool(re.search(r"[a-z]", v)) + bool(re.search(r"[A-Z]", v)) + bool(re.search(r"\d", v)) + bool(re.search(r"[^\w\s]", v))


def _usable(value: str) -> bool:
    """Whether a value can be a secret at all: no placeholder, reference, pattern, digest or public key. A value of less than six
    characters must mix kinds of characters as only passwords do."""
    v = value.strip()
    if len(v) < 6 and (_classes(v) < 3 or " " in v):
        return False
    return not _PLACEHOLDER.match(v) and not _REFERENCE.search(v) and not _DIGEST.match(v) and not _PATTERN.search(v) and not _PUBLIC.search(v) and "EXAMPLE" not in v


def _prose(value: str) -> bool:
    """Whether a value is a sentence, by the words that hold sentences together; the length does not matter."""
    parts = [p.lower().strip(".,:;!?()") for p in value.split()]
    glue = [p for p in parts if p in _GLUE]
    return len(set(glue)) >= 2 and len(glue) >= 0.25 * len(parts)


def _blob(value: str) -> bool:
    """Whether a value is data by its content: a list, filler, or base64 of a file format or certificate."""
    v = re.sub(r"\s", "", value)
    if len(re.findall(r"[,;]", v)) >= 8 or max(map(v.count, set(v)), default=0) > max(8, 0.25 * len(v)):
        return True
    try:
        return bool(_FILE_FORMAT.match(base64.b64decode(v[: min(64, len(v) // 4 * 4)].replace("-", "+").replace("_", "/"))))
    except ValueError:
        return False


def _bare_form(v: str) -> bool:
    """The form of a token that needs no name: long, unbroken, mixing letters and digits."""
    if len(v) < 20 or re.search(r"[\s/\\(){}<>]|^https?:|\.\w{1,4}$", v) or not (re.search(r"\d", v) and re.search(r"[A-Za-z]", v)):
        return False
    return not re.fullmatch(r"[\d.,eExXa-fA-F+-]+", v) and not re.match(r"data:|urn:|[\w.-]+@", v) and not _blob(v)


def candidates(text: str | None) -> list[Candidate]:
    """Everything in a text that would be a secret if no word explained anything: places and forms only, no dictionary.

    Null and empty texts have none. No length, number of pieces or place in the text leaves anything out.
    """
    if not text:
        return []
    found: list[Candidate] = []
    low = text.lower()

    def add(a: int, b: int, rule: str, key: str = "") -> None:
        found.append(Candidate([a], [b], rule, text[a:b], key))

    def matches(name: str) -> Iterator[re.Match]:
        return globals()[name].finditer(text) if any(x in low for x in _NEEDS[name]) else iter(())

    if "private key" in low:
        for m in _BLOCK.finditer(text):
            end = _BLOCK_END.search(text, m.end())
            again = _BLOCK.search(text, m.end())
            if end and again and again.start() < end.start():
                end = None
            # a block without an end goes on as far as its characters do
            stop = end.end() if end else m.end() + len(re.match(r"(?:\\r|\\n|[A-Za-z0-9+/=\s\"'+\;`,:-])*", text[m.end() : again.start() if again else None]).group().rstrip())
            if len(re.findall(r"[A-Za-z0-9+/=]", text[m.end() : end.start() if end else stop])) >= 40:
                add(m.start(), stop, "block")
    for name in ("_USERINFO", "_DSN", "_BEARER", "_OPTION", "_CURL"):
        for m in matches(name):
            v = m["v"]
            if _PLACEHOLDER.match(v) or _REFERENCE.search(v) or len(v) < 6 and _classes(v) < 3 or _DIGEST.match(v) and name != "_BEARER":
                continue
            add(m.start("v"), m.end("v"), "bearer" if name == "_BEARER" else "form")
    stems = [w for w in _STEMS if w in low]
    if stems or "login" in low or "account" in low or "user" in low:
        for m in _PROSE.finditer(text):
            v = m[m.lastgroup]
            if re.search(r"\d", v) and _usable(v) and not re.search(r"[(){}]|^\w+\.\w+$", v):
                add(m.start(m.lastgroup), m.end(m.lastgroup), "prose")
        for m in _PROSE_NAMED.finditer(text) if stems else ():
            v = m["x"]
            if re.search(r"\d", v) and _COMMENT_LEAD.search(text[text.rfind("\n", 0, m.start()) + 1 : m.start()]) and _usable(v) and not re.search(r"[(){}]|^\w+\.\w+$", v):
                add(m.start("x"), m.end("x"), "prose")
    for m in matches("PROVIDER"):
        if "EXAMPLE" not in m.group() and not re.search(r"(.)\1{7,}", m.group()):
            add(m.start(), m.end(), "provider")
    # literals, joined where a value is written in pieces
    pos, size = 0, len(text)
    while True:
        m = _LITERAL.search(text, pos)
        if not m:
            break
        pieces = [m]
        end = m.end()
        while end < size and text[end] in " \t\r\n+.\\":
            j = _JOIN.match(text, end)
            nxt = _LITERAL.match(text, j.end()) if j else None
            if not nxt or j.group().strip() in ("", ".") and "\n" in j.group() and not text[j.end() - 1 :].startswith((" ", "\t", '"', "'", "\n")):
                break
            pieces.append(nxt)
            end = nxt.end()
        pos = end
        start = m.start()
        line = text.rfind("\n", 0, start) + 1
        lead = text[line:start]
        if not lead.strip() and line:
            lead = text[text.rfind("\n", 0, line - 1) + 1 : start]
        said = lead.lower() if stems else ""
        named = any(w in said for w in stems)
        if not named and end - start < 20:
            continue  # neither a name nor the length of a token that needs none
        if len(pieces) == 1 and re.match(r"\s*(?:=>|:=|:)(?!:)", text[end : end + 4]) and not re.search(r"[=(]\s*$", lead):
            continue  # a key, not a value
        value = "".join(p[p.lastgroup] for p in pieces)
        if not _usable(value):
            continue
        key = ""
        if named:
            k = _FALLBACK.search(lead)
            key = next((g for g in k.groups() if g), "") if k else ""
            if not k:
                k = _KEY.search(lead)
                parts = re.sub(r"[\"'\[\]]", " ", k["k"]).split() if k else []
                key = parts[-1] if parts else ""
        if key and names_secret(key):
            rule = "phrase" if any(x in key.lower() for x in ("pass", "pwd", "kennwort", "contras", "senha")) else "named"
            if _prose(value) or len(value) > 64 and _blob(value):
                continue
        elif len(pieces) > 1 and PROVIDER.search(value):
            rule = "provider"
        elif _bare_form(value.strip()):
            rule = "bare"
        else:
            continue
        at = [(p.start(p.lastgroup), p.end(p.lastgroup)) for p in pieces]
        at = [(a, b) for a, b in at if b > a]
        found.append(Candidate([a for a, _ in at], [b for _, b in at], rule, value, key))
    for rx in (_BARE, _BARE_TIGHT):
        for m in rx.finditer(text):
            v, key = m["v"], m["k"]
            secret = names_secret(key)
            if not secret and len(v) < 20:
                continue
            if rx is _BARE and not _BARE_LEAD.match(text[text.rfind("\n", 0, m.start()) + 1 : m.start()]):
                continue
            if not _usable(v) or re.search(r"\w\(|[({\[]$|->|::", v):
                continue
            if secret:
                add(m.start("v"), m.end("v"), "plain", key)
            if _bare_form(v) and not re.search(r"[=;]$", v):
                add(m.start("v"), m.end("v"), "bare", key)
    return found


def is_secret(rule: str, value: str, words: Dictionary) -> bool:
    """Whether a candidate is a secret: what the words of the dictionary leave of its value, against the bound of its rule."""
    if rule == "block":
        return words.residual(re.sub(r"-----[^-]*-----|\\[rn]|[^A-Za-z0-9]", "", value)) >= BARE_RESIDUAL
    left = words.residual(value)
    if rule in ("form", "phrase"):
        return left >= PHRASE_RESIDUAL
    if rule == "named":
        return left >= NAMED_RESIDUAL
    if rule == "prose":
        return left >= 7
    if rule in ("bearer", "provider"):
        return left >= 8
    if rule == "plain":
        return left >= NAMED_RESIDUAL and (re.search(r"\d", value) is not None or left >= 10) and (left >= 10 or not re.search(r"^[A-Za-z_]\w*\.[A-Za-z_]\w*$", value))
    return left >= BARE_RESIDUAL and left >= 0.7 * len(re.sub(r"[.:]", "", value.strip()))


def _kind(rule: str, key: str) -> str:
    if rule == "block":
        return "private_key"
    return "password" if rule in ("form", "prose") or rule in ("phrase", "named", "plain") and re.search(r"(?i)pass|pwd|kenn|contras|senha", key) else "token"


def judge(found: list[Candidate], words: Dictionary) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every stretch of a secret's value among candidates, in order, without overlaps, the earlier candidate
    first; a value in pieces gives one stretch per piece, those after the first with kind '+'."""
    out: list[tuple[int, int, str]] = []
    for c in found:
        if is_secret(c.rule, c.value, words):
            for i, (a, b) in enumerate(zip(c.starts, c.ends)):
                if all(b <= x or a >= y for x, y, _ in out):
                    out.append((a, b, _kind(c.rule, c.key) if i == 0 else "+"))
    return sorted(out)


def find_secrets(text: str | None, words: Dictionary) -> list[tuple[int, int, str]]:
    """:func:`judge` of the :func:`candidates` of a text."""
    return judge(candidates(text), words)


_BLANK = Dictionary({})


@lru_cache(200_000)
def _split(run: str) -> tuple[str, ...]:
    """Words of a run of letters and digits, parted where the case changes; none of one with digits, which is a code."""
    return () if re.search(r"\d", run) else tuple(re.findall(r"[a-z]{3,24}", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", run).lower()))


def words_outside(text: str | None, found: list[Candidate] | None = None) -> set[str]:
    """Words of ``text`` outside everything that would be a secret if no word explained anything, and outside runs of letters and
    digits, which are codes. Case changes and signs part words; words of one or two letters are left out."""
    if not text:
        return set()
    out, at = [], 0
    for a, b, _ in judge(candidates(text) if found is None else found, _BLANK):
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return {w for run in set(re.findall(r"[A-Za-z\d]+", " ".join(out))) for w in (_split(run) if len(run) < 64 else _split.__wrapped__(run))}  # only short runs are remembered


_SCANNED = "file_id bigint, repo string, words array<string>, found array<struct<line_no:bigint,starts:array<bigint>,ends:array<bigint>,rule:string,value:string,key:string>>"


def scanned(files: DataFrame) -> DataFrame:
    """One pass over all contents of ``files`` (file_id, repo, content), stored: rows with ``found``, the candidates of a file, and rows
    with ``words``, the words outside candidates of the files of a repository in one batch. The empty word stands for the repository itself.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            seen: dict[str | None, set[str]] = {}
            for i, r, c in zip(pdf["file_id"], pdf["repo"], pdf["content"]):
                if c is None:
                    continue
                found = [x for x in candidates(c) if is_secret(x.rule, x.value, _BLANK)]
                seen.setdefault(r, {""}).update(words_outside(c, found))
                if found:
                    lines = line_starts(c)
                    rows.append((i, r, None, [{"line_no": line_of(lines, x.starts[0]), **x._asdict()} for x in found]))
            rows += [(None, r, list(w), None) for r, w in seen.items()]
            out = pd.DataFrame(rows, columns=["file_id", "repo", "words", "found"], dtype=object)
            yield out.assign(file_id=out["file_id"].astype("Int64"))

    key = F.col("file_id") if "file_id" in files.columns else F.lit(None).cast("bigint")  # a dictionary alone needs no ids
    return stored(files.select(key.alias("file_id"), "repo", "content").mapInPandas(scan, _SCANNED), "scanned")


def word_counts(files: DataFrame, min_repos: int = 2, min_share: float = WORD_SHARE, scan: DataFrame | None = None) -> dict[str, int]:
    """Dictionary of the corpus: words outside candidate secrets in at least ``min_repos`` repositories and ``min_share`` of all that
    have contents, with their number of repositories. Shares stay as they are when the corpus grows or is copied, so noise
    does not become words. Counted over all contents, on distinct (word, repository) pairs combined before the shuffle.

    The share bounds the result: every word takes min_share x repositories of the (word, repository) pairs, so there are at most
    1 / min_share = ten times as many words as a repository has on average, however many repositories and rows there are. This
    many rows come to the driver and go to the executors.
    """
    scan = scanned(files) if scan is None else scan
    words = scan.where("words IS NOT NULL").select(F.coalesce("repo", F.lit("")).alias("repo"), F.explode("words").alias("word"))
    counted = words.distinct().groupBy("word").count()
    total = counted.where("word = ''").agg(F.max("count")).first()[0] or 0
    return {r["word"]: r["count"] for r in counted.where((F.col("word") != "") & (F.col("count") >= max(min_repos, min_share * total))).collect()}


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """``text`` with every stretch replaced by a placeholder of its kind; quotes and everything around stay. Later pieces of a
    value become empty, and the line ends inside a key block stay, so that line numbers and syntax hold."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in spans:
        out.append(text[at:a])
        if kind == "private_key":
            # keep the frame of literals: only the characters of the key itself go
            block = re.sub(r"-----(?:BEGIN|END)[^-]*-----", "", text[a:b])
            out.append("<PRIVATE_KEY>" + re.sub(r"(?<!\\)[A-Za-z0-9/=]+(?=(?:\\n|[\s\"'`+\;,]|\Z))|(?<=[\"'\s])[A-Za-z0-9+/=]{8,}", "", re.sub(r"[A-Za-z0-9+/=]{16,}", "", block)))
        elif kind != "+":
            out.append(f"<{kind.upper()}>")
        at = b
    out.append(text[at:])
    return "".join(out)


def secrets_in_files(files: DataFrame, words: dict[str, int], redacted: bool = False, scan: DataFrame | None = None) -> DataFrame:
    """Secrets of ``files`` (file_id, repo, content): rows (file_id, line_no, kind), or (file_id, content, secrets) with redacted
    contents of all files. ``words`` comes from :func:`word_counts`, which bounds its size, and travels as a broadcast variable.
    Null contents give no secrets and stay null. Candidates of :func:`scanned` are judged without reading the texts again; redaction reads them.
    No shuffle.
    """
    shared = files.sparkSession.sparkContext.broadcast(words)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = _dictionary(shared)
        for pdf in batches:
            rows = []
            for i, found in zip(pdf["file_id"], pdf["found"]):
                cs = [Candidate(list(x["starts"]), list(x["ends"]), x["rule"], x["value"], x["key"]) for x in found]
                line = {x["starts"][0]: x["line_no"] for x in found}
                rows += [(i, line[a], k) for a, _, k in judge(cs, d) if k != "+" and a in line]
            yield pd.DataFrame(rows, columns=["file_id", "line_no", "kind"]).astype({"file_id": "int64", "line_no": "int64", "kind": object})

    def cleaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = _dictionary(shared)
        for pdf in batches:
            spans = [find_secrets(c, d) for c in pdf["content"]]
            yield pd.DataFrame({"file_id": pdf["file_id"], "content": pd.Series([redact(c, s) for c, s in zip(pdf["content"], spans)], dtype=object), "secrets": [sum(k != "+" for _, _, k in s) for s in spans]})

    if redacted:
        return files.select("file_id", "content").mapInPandas(cleaned, "file_id bigint, content string, secrets bigint")
    scan = scanned(files) if scan is None else scan
    return scan.where("found IS NOT NULL").select("file_id", "found").mapInPandas(judged, "file_id bigint, line_no bigint, kind string")


_CACHE: dict[int, Dictionary] = {}


def _dictionary(shared) -> Dictionary:
    """The dictionary of a broadcast, built once per worker."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else id(shared.value)
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Dictionary(shared.value)
    return _CACHE[key]
