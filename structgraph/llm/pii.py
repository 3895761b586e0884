"""Personal information in free text, found and replaced by typed placeholders (problem 10).

A semi-Markov conditional random field over a lattice of candidate segments: features look at a whole span (its form, its words, what
stands around it), a segment's score is their weighted sum, and dynamic programming chooses boundaries and types of all
segments of a text at once. Text outside segments scores zero. The weights of all features are fitted on labelled rows, made by
planting values of every kind, and look-alikes, into lines of the corpus; the priors below are the mean from which they start.
"""

import math
import random
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of the corpus that carry planted values, and rows made of them, on which the weights are fitted; documented bounds of the
#: fit alone, all documents are then labelled whole.
FIT_CARRIERS = 1_000
FIT_ROWS = 3_000
#: Names that are sent to the executors at most.
MOST_NAMES = 200_000

Segment = tuple[int, int, str, tuple[str, ...]]  # start, end, kind, features

#: Local parts of addresses that no person stands behind; fixed list.
_ROLES = set("""noreply no-reply donotreply do-not-reply postmaster mailer-daemon mailer daemon security abuse admin administrator root webmaster hostmaster info contact support help helpdesk service
services sales billing office team hello hr jobs careers press media marketing news newsletter notifications notification notify alerts alert monitoring monitor builds build ci cd deploy deployment release releases
release-bot depbot dependabot renovate renovate-bot bot robot git svn hg github gitlab jenkins travis circleci buildbot automation system sys ops devops oncall on-call pager pagerduty cron nobody
list lists all everyone dev developers maintainers owners core users announce commits bugs issues security-team infra platform qa test testing staging api feedback privacy legal compliance accounts registry packages sre""".split())
_SERVICE_HOST = regex.compile(r"^(?:ci|pager|bot|bots|git|svn|build|builds|alerts?|notifications?|noreply|lists?|mailer|bounce|users\.noreply|jenkins)\.", regex.I)

def _ranges(test: Callable[[str], bool], top: int = 0x2C80) -> str:
    """The characters below ``top`` and among the presentation and full-width forms that pass a test, as the inside of a class."""
    out, start = [], None
    for cp in [*range(top), *range(0xA720, 0xA800), *range(0xFB00, 0xFB07), *range(0xFF21, 0xFF5B), 0x10FFFF]:
        ok = cp != 0x10FFFF and test(chr(cp))
        if start is not None and (not ok or cp != last + 1):
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(last))}")
            start = None
        if ok and start is None:
            start = cp
        last = cp
    return "".join(out)


_LATIN = _ranges(lambda c: regex.match(r"\p{Latin}", c) is not None)
_UPPER = _ranges(lambda c: c.isupper() and regex.match(r"\p{Latin}", c) is not None)
_MARKS = _ranges(lambda c: unicodedata.category(c)[0] == "M", 0x370)

#: Forms of telephone numbers, by name; a number matches the first that fits it whole.
_PHONE_FORMS = [
    ("plus", regex.compile(r"\+\d{1,3}(?:[\s.()/-]{0,3}\d){6,13}")),
    ("idd", regex.compile(r"00[1-9]\d(?:[\s./-]?\d){7,12}")),
    ("tollfree", regex.compile(r"1[-. ]8\d\d[-. ]\d{3}[-. ]\d{4}")),
    ("paren", regex.compile(r"\(0?\d{2,5}\)[\s-]?\d{3,4}[\s.-]?\d{3,4}")),
    ("nanp", regex.compile(r"(?:1[-. ])?[2-9]\d\d([-. ])\d{3}\1\d{4}")),
    ("slash", regex.compile(r"0\d{1,4}/\d{3,8}(?:-\d{1,5})?")),
    ("trunk", regex.compile(r"0\d{2,4}(?:[ -]\d{2,4}){2,4}")),
    ("local", regex.compile(r"\d{3,4}[ -]\d{4}")),
]
_PHONE = regex.compile(r"(?<![\p{Latin}\p{N}_.,/:#@=-])(?<!\d[\s])[+(]?\d(?:(?:[().\/-]|[^\S\r\n]){0,3}\d){6,15}(?![\p{Latin}\p{N}_]|[./:-]\d)")
#: Forms of personal numbers: social security, insurance, tax, identity and passport numbers.
_ID_FORMS = [
    ("nino", regex.compile(r"[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]")),
    ("ssn", regex.compile(r"\d{3}([- ])\d{2}\1\d{4}")),
    ("cpf", regex.compile(r"\d{3}\.\d{3}\.\d{3}-\d{2}")),
    ("dni", regex.compile(r"\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]")),
    ("pass1", regex.compile(r"[A-Z]\d{7,8}")),
    ("pass2", regex.compile(r"[A-Z]{2}\d{6,7}")),
    ("long", regex.compile(r"\d(?:[ -]?\d){8,13}")),
]
_ID = re.compile(rf"(?<![{_LATIN}\d_./#@=-])(?:[A-Z]{{1,2}}[ \xa0]?\d[\d \xa0.-]{{4,14}}[\dA-Z]|\d[\d \xa0.-]{{6,16}}[\dA-Z])(?![{_LATIN}\d_]|[./]\d)")

_CAP = r"\p{Lu}[\p{L}\p{M}'’]+(?:-\p{Lu}[\p{L}\p{M}'’]+)*"
_CITY = rf"(?:\d{{4,5}}\s)?{_CAP}(?:[ ]{_CAP}){{0,1}}(?:\s\d{{5}})?"
_TYPE = r"(?:Street|St\b\.?|Lane|Ln\b\.?|Road|Rd\b\.?|Avenue|Ave\b\.?|Court|Ct\b\.?|Close|Drive|Way|Place|Pl\b\.?|Square|Sq\b\.?|Terrace|Boulevard|Blvd\b\.?|Hill|Gate|Quay|Crescent|Row|Mews|Parade|Grove|Walk|Highway|Parkway)"
#: Forms of addresses; each begins with the number, or with the street or box where the number follows.
_ADDRESS_FORMS = [
    ("english", regex.compile(rf"(?<![\p{{L}}\p{{N}}.,:/#-])\d{{1,5}}[a-zA-Z]?\s(?:(?:North|South|East|West|N\.|S\.|E\.|W\.|Old|New|Upper|Lower)\s)?{_CAP}(?:\s{_CAP}){{0,2}}?\s{_TYPE}(?:,?\s(?:Apt\.?|Apartment|Unit|Suite|Flat|No\.|#)\s?\w{{1,5}})?(?:,\s{_CITY})?")),
    ("german", regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{_CAP}[ -])?\p{{Lu}}[\p{{L}}\p{{M}}]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig)\s\d{{1,4}}\s?[a-z]?(?![\p{{L}}\p{{N}}])(?:,\s{_CITY})?")),
    ("french", regex.compile(rf"(?<![\p{{L}}\p{{N}}.:/#-])\d{{1,4}}(?:\s?(?:bis|ter))?,?\s(?:rue|avenue|av\.|boulevard|bd\.?|place|impasse|chemin|allée|quai|cours|passage)\s(?:d[eu]s?\s|de la\s|d['’]|l['’])?{_CAP}(?:[ -]{_CAP}){{0,2}}(?:,\s{_CITY})?")),
    ("iberian", regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:Calle|C/|Avenida|Avda\.|Av\.|Plaza|Paseo|Carrer|Camino|Rua|Travessa|Praça|Alameda|Via|Viale|Piazza|Corso)\s(?:d[aeo]s?\s|de la\s|del\s)?{_CAP}(?:\s{_CAP}){{0,2}},?\s(?:n[º°.]\s?)?\d{{1,4}}[a-z]?(?![\p{{L}}\p{{N}}])(?:,\s{_CITY})?")),
    ("box", regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:P\.?\s?O\.?\s?Box|Post Office Box|Postfach|Apartado(?: de Correos)?|Caixa Postal|Casella Postale|B\.?P\.?)\s\d{{1,6}}(?:,\s{_CITY})?")),
]

_NOT_NAME_NEXT = regex.compile(r"[ ]+(?:Cluster|Release|Server|Project|Module|Pipeline|Queue|Bot|Branch|Build|Edition|Award|Street|Lane|Road|Rd\b|Avenue|Ave\b|Court|Inc|Ltd|GmbH|Corp)\b")

#: Words before a span that speak for a kind, in the languages of the corpus, read from the span to the left; fixed lists.
_CUES = {
    "name": regex.compile(r"(?r)(?:reviewed-by|signed-off-by|co-authored-by|acked-by|tested-by|reported-by|reported by|suggested-by|authored? by|@author|author:|contact|on call this week|pairing with|thanks to|cc|todo\(|fixme\(|signalé par|gemeldet von|lo informó|relatado por|informado por|customer \(|client \(|\bof|\bby|from|ms|mr|mrs|miss|dr|prof|frau|herr|mme|sra?|don|doña|monsieur|madame|assigned to|owner|attn|dear|hi|hello|merci à|danke an|gracias a|obrigado a|担当|作者|联系人)[\s:.*]*", regex.I),
    "phone": regex.compile(r"(?r)(?:phone|tel|téléphone|telefon|telefone|teléfono|telephone|mobile|mobil|cell|handy|fax|call(?: me)?(?: at| on)?|reach(?:able|ed)?(?: me)?(?: at| on| under)?|erreichbar unter|whatsapp|sms|dial|hotline|movil|móvil|celular|携帯|电话|電話)[\s:.\"'(/]*(?:is|ist|est|es|at|unter|no\.?|number)?[\s:.\"'(]*", regex.I),
    "id_number": regex.compile(r"(?r)(?:passport|passeport|pasaporte|passaporte|reisepass|ausweis|ssn|social security|national insurance|nino|nin|tax id|tax number|tin|steuer-?id|steuernummer|cpf|dni|nie|nif|id card|identity|identité|identidad|identidade|personalausweis|ausweisnummer|insurance|sozialversicherung\w*|numéro de sécurité sociale|\bid|personnummer|身份证|护照|パスポート|マイナンバー)(?:\s?(?:number|no\.?|nr\.?|num\.?|numéro|número|card|de identidad|号|番号))*[\s:#.\"']*(?:is|ist|est|es|é)?[\s:\"']*", regex.I),
    "address": regex.compile(r"(?r)(?:lives? at|living at|resid\w+ (?:at|in)|wohnt(?: in)?|address(?: is)?|adresse|dirección|endereço|go(?:es)? to|sent? to|ship(?:ped)? to|deliver(?:y|ed)? to|lieferung an|livrer au?|enviar a|entregar em|register at|located at|moved to|mail to|住所|地址)[\s:(]*", regex.I),
}
#: Words right before a number that make it something else.
_OTHER = regex.compile(r"(?r)(?:error|part|order|build|ids?|key|row|port|host|line|zeile|ligne|línea|linha|page|table|step|board|version|v|commit|issue|ticket|rev|revision|release|pin|serial|sku|code|limit|took|in|#|isbn|doi|depth|timestamps? are|at|nos?\.)\s*[:#]?\s*", regex.I)
_ID_STRICT = regex.compile(r"(?r)(?:^|[^\p{L}])(?:row|sample|build|order|part|trace|commit|test|record|job|run|task|event|session|user|doc|file|message)\s+ids?\s*[:#]?\s*|(?:^|[^\p{L}])ids\s*", regex.I)

#: Lines that name people by convention.
_TRAILER = regex.compile(r"(?r)(?:(?:reviewed|signed-off|co-authored|acked|tested|reported|suggested)-by|@author)[\s:]*", regex.I)

#: Mean of the prior of the weights of span features; :func:`fit` moves them. Positive scores make a segment; each kind has a bias against segments.
PRIOR = {
    "email:bias": 2.0, "email:role": -6.0, "email:service_host": -3.0, "email:repo": -8.0, "email:spelled": -0.6, "email:spelled_marked": 1.2, "email:words_at": -2.4, "email:spelled_dot": 1.4, "email:localish": 1.2, "email:bracket": 0.3,
    "email:in_code": -2.0, "email:known_tld": 0.5, "email:numeric_host": -8.0,
    "phone:bias": -1.6, "phone:cue": 4.0, "phone:other": -4.0, "phone:id_cue": -5.0, "phone:plus": 3.2, "phone:idd": 2.4, "phone:tollfree": 2.6, "phone:paren": 2.6, "phone:nanp": 2.0, "phone:slash": 2.6, "phone:trunk": 2.0, "phone:local": -1.0,
    "phone:none": -4.0, "phone:date": -8.0, "phone:near_person": 1.0, "phone:ext": 1.0, "phone:length": -4.0,
    "id_number:bias": -2.0, "id_number:cue": 4.5, "id_number:other": -5.0, "id_number:nino": 2.5, "id_number:ssn": 2.3, "id_number:cpf": 2.8, "id_number:dni": 0.4, "id_number:pass1": -0.5, "id_number:pass2": -0.5, "id_number:long": -2.5, "id_number:none": -6.0,
    "id_number:phone_cue": -4.0, "id_number:date": -8.0,
    "address:bias": 0.6, "address:cue": 2.5, "address:english": 1.0, "address:german": 1.0, "address:french": 1.2, "address:iberian": 0.8, "address:box": 1.4, "address:city": 1.0, "address:zip": 0.6,
    "name:bias": -3.0, "name:cue": 2.2, "name:given": 1.6, "name:surname": 1.8, "name:known": 2.0, "name:both": 1.2, "name:order": 0.6, "name:comma": -0.9, "name:initial_form": 0.2, "name:lower": -0.6, "name:upper": -0.2, "name:thing": -7.0, "name:handle": -6.0, "name:stop": -6.0,
    "name:unknown_words": -1.2, "name:two_given": -3.5, "name:two_surnames": -2.0, "name:after": 1.2, "name:tokens": 0.15, "name:newline": -5.0, "name:middle": 0.6, "name:trailer": 1.0,
}
_STOP = set("the a an this that these those in on at of to for and or but not is are was were be been has have had it its as by with from if when where what who why how all any each every no yes ok please could would should can may might must will after before since until while during over under again once here there then than so such only own same too very just also".split())


@lru_cache(100_000)
def fold(s: str) -> str:
    """Lower case without marks, for comparison of names; words come again and again, so they are remembered."""
    if s.isascii():
        return s.lower()
    t = unicodedata.normalize("NFKD", s.replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("ß", "ss").replace("’", "'"))
    return "".join(c for c in t if not unicodedata.combining(c)).casefold()


class _Codes(dict):
    """Word as written -> 1 for a given name, 2 for a surname, 3 for both, 0 for others; looked up once a worker."""

    def __init__(self, given: set[str], surname: set[str]) -> None:
        self.given, self.surname = given, surname

    def __missing__(self, word: str) -> int:
        f = fold(word)
        c = (f in self.given) + 2 * (f in self.surname)
        if len(word) < 64:  # only words are remembered, and not too many of them
            if len(self) > 500_000:
                self.clear()
            self[word] = c
        return c


class Lexicon:
    """Given names, surnames and whole names that are known, folded; a single word is a given name."""

    def __init__(self, full_names: list[str]) -> None:
        self.given: set[str] = set()
        self.surname: set[str] = set()
        self.known: set[tuple[str, str]] = set()
        for full in full_names:
            parts = fold(full).split()
            if len(parts) == 1:
                self.given.add(parts[0])
            elif parts:
                self.given.add(parts[0])
                self.surname.add(parts[-1])
                self.known.add((parts[0], parts[-1]))
        self.codes = _Codes(self.given, self.surname)


def _around(text: str, a: int, b: int) -> tuple[str, str]:
    return text[max(0, a - 48) : a], text[b : b + 32]


def _first(forms: list, s: str) -> str:
    return next((n for n, rx in forms if rx.fullmatch(s)), "none")


_WORD = re.compile(rf"[{_LATIN}][{_LATIN}{_MARKS}'’]*+(?:-[{_LATIN}][{_LATIN}{_MARKS}'’]*+)*+")
#: Two words with capitals: where a cue stands before them they may be a name that nobody knows.
_CAP_PAIR = re.compile(rf"(?<![{_LATIN}'’])[{_UPPER}][{_LATIN}{_MARKS}'’-]*+[ ,.]{{1,3}}(?=[{_UPPER}])")

#: Marks of an address, by spelling: the sign itself, in brackets, as a word.
_AT_SIGN = re.compile(r"[@＠﹫]|%40|&#64;|&commat;")
_AT_MARKED = re.compile(r"\(\s?at\s?\)|\[\s?at\s?\]|\{\s?at\s?\}|<at>|_at_", re.I)
_AT_WORD = re.compile(r"(?<=\s)(?:at|AT)(?=\s)")
_SPELLED_DOT = r"\s?(?:\(\s?dot\s?\)|\[\s?dot\s?\]|\{\s?dot\s?\}|<dot>|_dot_)\s?"
_DOT = rf"(?:\.|．|{_SPELLED_DOT}|\s+(?:dot|DOT)\s+)"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
_HOST = regex.compile(rf"(?P<host>{_LABEL}(?:{_DOT}{_LABEL})*?(?P<tld>{_DOT}\p{{L}}{{2,24}}))(?![\p{{L}}\p{{N}}_-]|[.．]\p{{L}}|\s?[\[({{<]\s?(?:dot|at)|\s(?:dot|DOT)\s|@)")
_HOST_PLAIN = regex.compile(r"[\p{Latin}\p{Nd}](?:[\p{Latin}\p{Nd}-]*[\p{Latin}\p{Nd}])?(?:\.[\p{Latin}\p{Nd}](?:[\p{Latin}\p{Nd}-]*[\p{Latin}\p{Nd}])?)*\.\p{Latin}{2,24}(?![\p{Latin}\p{Nd}_-])")
# local parts are read from the mark to the left
_LOCAL = regex.compile(rf"(?r)(?<![\p{{L}}\p{{N}}_.+%-])[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{M}}\p{{N}}_+%'-]|(?:\.|．|{_SPELLED_DOT}|\s(?:dot|DOT)\s)(?=[\p{{L}}\p{{N}}]))*")
_LOCAL_PLAIN = regex.compile(r"(?r)(?<![\p{L}\p{N}_.+%-])[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}_.+%'-]*[\p{L}\p{M}\p{N}_])?")
_DOTS_OF_HOST = regex.compile(r"\s?[\[({<_]?\s?dot\s?[\])}>_]?\s?", regex.I)
_DOTS_OF_LOCAL = regex.compile(r"\s?[\[({<_]\s?dot\s?[\])}>_]\s?|\sdot\s", regex.I)
_REPO_PATH = re.compile(r"[:/][\w.~-]+/")
_IN_CODE = re.compile(r"\s*\(|\.\w+\(")
_FILE_LIKE = re.compile(r"(?:py|js|ts|java|c|cpp|h|md|txt|json|yaml|yml|toml|css|html)$")
_LOCALISH = re.compile(r"[._+\d-]")
_OPERAND = re.compile(r"[\w)]\s*$")


def _at_marks(text: str) -> Iterator[tuple[int, int, str]]:
    """(end of the local part, start of the host, spelling) of every mark."""
    for m in _AT_SIGN.finditer(text):
        a, b = m.span()
        yield a, b, "sign"
        if text[a - 1 : a].isspace():
            yield a - 1, b, "gap"
        if text[b : b + 1].isspace():
            yield a, b + 1, "gap"
    low = text.lower()
    if "at" in low:
        if any(x in low for x in ("at)", "at]", "at}", "at>", "_at_", "at )", "at ]", "at }")):
            for m in _AT_MARKED.finditer(text):
                a, b = m.span()
                yield a - text[a - 1 : a].isspace() if a else a, b + text[b : b + 1].isspace(), "marked"
        for m in _AT_WORD.finditer(text):
            a, b = m.span()
            while a and text[a - 1].isspace():
                a -= 1
            while text[b : b + 1].isspace():
                b += 1
            yield a, b, "word"


def email_segments(text: str) -> Iterator[Segment]:
    seen = set()
    for left, right, spelling in _at_marks(text):
        forms = [(_LOCAL, _HOST)] if spelling != "sign" else [(_LOCAL_PLAIN, _HOST_PLAIN), (_LOCAL, _HOST)]
        for rx_local, rx_host in forms:
            h = rx_host.match(text, right)
            n = h and rx_local.match(text, 0, left)
            if not n:
                continue
            a, b = n.start(), h.end()
            if (a, b) in seen:
                continue
            seen.add((a, b))
            raw = h.group()
            host = _DOTS_OF_HOST.sub(".", raw) if "dot" in raw.lower() else raw
            local = _DOTS_OF_LOCAL.sub(".", n.group()) if "dot" in n.group().lower() else n.group()
            before, after = _around(text, a, b)
            fs = ["email:bias"]
            base = local.casefold().split("+")[0]
            if base in _ROLES or _FIRST_PART.split(base, maxsplit=1)[0] in ("noreply", "no", "bot", "donotreply") or base.endswith(("-bot", "bot", "-team")):
                fs.append("email:role")
            if _SERVICE_HOST.match(host):
                fs.append("email:service_host")
            if _REPO_PATH.match(after) or before.endswith(("://", "ssh://", "git+")) and after[:1] in (":", "/"):
                fs.append("email:repo")
            if spelling in ("marked", "word") or spelling != "gap" and text[left:right].strip() not in ("@", "＠", "﹫"):
                fs.append("email:spelled")
                if spelling == "word":
                    fs.append("email:words_at")
                    # "x at y.z" is an address only if the local part looks like one or the dots are spelled as well
                    if _LOCALISH.search(local):
                        fs.append("email:localish")
                else:
                    fs.append("email:spelled_marked")
                if host != raw:
                    fs.append("email:spelled_dot")
            elif spelling == "gap":
                fs.append("email:words_at")
            if before.endswith(("<", "(", "mailto:")):
                fs.append("email:bracket")
            if not host.rsplit(".", 1)[0].strip("0123456789."):
                fs.append("email:numeric_host")
            if _IN_CODE.match(after) or _OPERAND.search(before) and _FILE_LIKE.search(host):
                fs.append("email:in_code")
            yield a, b, "email", tuple(fs)


_FIRST_PART = re.compile(r"[.+_-]")
_DATE = re.compile(r"(?:19|20)\d\d[-./]\d{1,2}[-./]\d{1,2}(?:\D|$)")
_PERSON_AFTER = regex.compile(r"\s*/\s*[\w.+-]+(?:@|\s?[\[(]at)")
_EXTENSION = regex.compile(r"\s*(?:ext\.?|x|extension|Durchwahl)\s?\d")


def number_segments(text: str) -> Iterator[Segment]:
    for rx, kind, forms in ((_PHONE, "phone", _PHONE_FORMS), (_ID, "id_number", _ID_FORMS)):
        for m in rx.finditer(text):
            for a, b in _trims(text, m.start(), m.end(), forms):
                s = text[a:b]
                if "\n" in s:
                    continue
                fs = [f"{kind}:bias", f"{kind}:{_first(forms, s)}"]
                if _DATE.match(s):
                    fs.append(f"{kind}:date")
                phone_cue = kind == "phone" and _cue("phone", text, a)
                id_cue = not phone_cue and _cue("id_number", text, a) and not _ID_STRICT.match(text, 0, a)
                if kind == "phone":
                    n = sum(map(str.isdigit, s))
                    if phone_cue:
                        fs.append("phone:cue")
                    elif id_cue:
                        fs.append("phone:id_cue")
                    elif _OTHER.match(text, 0, a):
                        fs.append("phone:other")
                    if not 7 <= n <= 15:
                        fs.append("phone:length")
                    if text[:a].endswith(("/", "/ ")) if a < 3 else text[a - 1] == "/" or text[a - 1].isspace() and text[a - 2] == "/" or _PERSON_AFTER.match(text, b):
                        fs.append("phone:near_person")
                    if _EXTENSION.match(text, b):
                        fs.append("phone:ext")
                elif id_cue:
                    fs.append("id_number:cue")
                elif _cue("phone", text, a):
                    fs.append("id_number:phone_cue")
                elif _OTHER.match(text, 0, a):
                    fs.append("id_number:other")
                yield a, b, kind, tuple(fs)


def _cue(kind: str, text: str, a: int) -> bool:
    """Whether a cue of a kind stands right before ``a``: read from there to the left, whatever is further left."""
    return _CUES[kind].match(text, 0, a) is not None


_GROUPS = re.compile(r"\s+")


def _trims(text: str, a: int, b: int, forms: list) -> list[tuple[int, int]]:
    """The stretch itself and, where it has no known form, the longest pieces of it from its groups that have one."""
    s = text[a:b]
    if _first(forms, s) != "none":
        return [(a, b)]
    cuts = [0, *(m.end() for m in _GROUPS.finditer(s)), len(s) + 1]
    out = []
    for i in range(len(cuts) - 1):
        for j in range(len(cuts) - 1, i, -1):
            piece = s[cuts[i] : cuts[j]].rstrip()
            if len(piece) >= 7 and piece != s and _first(forms, piece) != "none":
                out.append((a + cuts[i], a + cuts[i] + len(piece)))
                break
    return out or [(a, b)]


_IN_CITY = regex.compile(r",\s(?:\d{4,5}\s)?\p{Lu}")
_ZIP = re.compile(r"\b\d{5}\b")


#: What every German address holds; a cheap test, as the form itself begins with any word.
_GERMAN_HINT = re.compile(r"(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig)\s\d")


def address_segments(text: str) -> Iterator[Segment]:
    for form, rx in _ADDRESS_FORMS:
        if form == "german" and not _GERMAN_HINT.search(text):
            continue
        for m in rx.finditer(text):
            a, b = m.span()
            if "\n" in m.group():
                b = a + m.group().index("\n")
                if not rx.fullmatch(text[a:b].rstrip(" ,")):
                    continue
            fs = ["address:bias", f"address:{form}"]
            if _cue("address", text, a):
                fs.append("address:cue")
            if _IN_CITY.search(m.group()):
                fs.append("address:city")
            if _ZIP.search(m.group()):
                fs.append("address:zip")
            yield a, b, "address", tuple(fs)


_NAME_AFTER = regex.compile(r"\s*(?:[<(]|wrote|confirmed|said|asks?|asked|thinks|lives|hat |has |schrieb|a confirmé|confirmó|confirmou|,\s(?:phone|tel|reachable|erreichbar))")
_HANDLE_AFTER = regex.compile(r"[@_/=\\\d]|\.\p{L}|\(\)|-\p{L}")


def name_segments(text: str, lex: Lexicon) -> Iterator[Segment]:
    """Spans of two to four name parts in any order and case; at least one part is a known name or a cue stands before."""
    codes = list(map(lex.codes.__getitem__, _WORD.findall(text)))
    cued_at = {m.start() for m in _CAP_PAIR.finditer(text) if _cue("name", text, m.start())}
    if not cued_at and not any(codes):
        return
    words = list(_WORD.finditer(text))
    given, surname = [c & 1 for c in codes], [c & 2 for c in codes]
    # a span begins at most three words before a known part, or at words with capitals behind a cue
    starts = {i for x, c in enumerate(codes) if c for i in range(max(0, x - 3), x + 1)}
    if cued_at:
        starts |= {i for i, w in enumerate(words) if w.start() in cued_at}
    folded = _Folded(words)
    n = len(words)
    for i in sorted(starts):
        w = words[i].group()
        a = words[i].start()
        cued = None
        for k in (1, 2, 3):
            j = i + k
            if j >= n:
                break
            span = range(i, j + 1)
            if not any(codes[i : j + 1]):
                if k > 1 or not w[0].isupper() or not words[j].group()[0].isupper():
                    break
                if cued is None:
                    cued = _cue("name", text, a)
                if not cued:
                    break
            gaps = [text[words[x].end() : words[x + 1].start()] for x in range(i, j)]
            if any(len(g) > 3 for g in gaps):
                break
            fs = _name_form(words, folded, given, surname, i, j, gaps, lex)
            if not fs:
                continue
            b = words[j].end()
            if len(folded[j]) == 1 and text[b : b + 1] == ".":
                b += 1
            if cued is None:
                cued = _cue("name", text, a)
            if cued:
                fs.append("name:cue")
                if _TRAILER.match(text, 0, a):
                    fs.append("name:trailer")
            if _NAME_AFTER.match(text, b):
                fs.append("name:after")
            if _NOT_NAME_NEXT.match(text, b) and "name:both" not in fs:
                fs.append("name:thing")
            if text[a - 1 : a] in ("@", "/", "_", "=") and a and text[max(0, a - 8) : a].lower() != "@author " or _HANDLE_AFTER.match(text, b):
                fs.append("name:handle")
            if any(len(folded[x]) > 1 and folded[x] in _STOP for x in span):
                fs.append("name:stop")
            yield a, b, "name", tuple(fs)


class _Folded:
    """Folded words of a text, each folded when it is asked for."""

    def __init__(self, words: list) -> None:
        self.words = words

    def __getitem__(self, i: int) -> str:
        return fold(self.words[i].group())


def _name_form(words: list, folded: list[str], given: list[bool], surname: list[bool], i: int, j: int, gaps: list[str], lex: Lexicon) -> list[str] | None:
    """Features of a span by the form in which its words stand, or None if names have no such form."""
    parts = list(range(i, j + 1))
    initial = [len(folded[x]) == 1 for x in parts]
    dotted = [initial[x - i] and (x == j or gaps[x - i].startswith(".")) for x in parts]
    comma = [g.strip() == "," for g in gaps]
    if any("\n" in g for g in gaps) or any(g.strip() not in ("", ",", ".") for g in gaps):
        return None
    fs = ["name:bias"]
    k = len(parts)
    if sum(comma) > 1 or any(g.strip() == "" and not g for g in gaps):
        return None
    if any(g.strip() == "." and not initial[x] for x, g in enumerate(gaps)):
        return None
    if sum(comma) == 1:
        if not comma[0] or k > 3 or not gaps[0].startswith(","):
            return None
        first, last = i + 1, i  # Surname, Given [I.]
        if k == 3 and not initial[2]:
            return None
        fs.append("name:comma")
        if initial[1]:
            if not dotted[1] and not words[j].group().isupper():
                return None
            fs.append("name:initial_form")
    elif k == 2:
        first, last = i, j
        if initial[1]:
            return None
        if initial[0]:
            if not dotted[0]:
                return None
            fs.append("name:initial_form")
    elif k == 3:
        first, last = i, j
        if initial[2]:
            return None
        if initial[1]:
            fs.append("name:middle")
        elif initial[0] and initial[1]:
            fs.append("name:initial_form")
        elif not (given[i] and surname[j] and (given[i + 1] or surname[i + 1])):
            return None
    else:
        first, last = i, j
        if not (initial[1] and initial[2] and given[i] and surname[j]):
            return None
        fs.append("name:middle")
    if len(folded[first]) == 1 and not surname[last]:
        if not words[last].group()[0].isupper():
            return None
    g, s = given[first], surname[last]
    if g:
        fs.append("name:given")
    if s:
        fs.append("name:surname")
    if g and s:
        fs += ["name:both", "name:order"]
    if (folded[first], folded[last]) in lex.known:
        fs.append("name:known")
    if not g and not s:
        # two words whose order is turned, or that nobody knows
        if given[last] and surname[first]:
            fs += ["name:given", "name:surname", "name:both"]
        elif given[last] and not surname[first] or surname[first] and not given[last]:
            fs.append("name:unknown_words")
            return fs if "name:comma" in fs else None
        else:
            fs.append("name:unknown_words")
    elif not (g and s) and len(folded[first]) > 1:
        fs.append("name:unknown_words")
        if g and given[last]:
            fs.append("name:two_given")
        if s and surname[first] and not given[first]:
            fs.append("name:two_surnames")
    letters = [words[x].group() for x in parts if len(folded[x]) > 1]
    if all(x.islower() for x in letters):
        if not (g and s) and not (given[last] and surname[first]) and not (s and len(folded[first]) == 1):
            return None
        fs.append("name:lower")
    elif all(x.isupper() for x in letters):
        fs.append("name:upper")
    elif not all(x[0].isupper() for x in letters):
        fs.append("name:lower")
        if not (g and s):
            return None
    fs += ["name:tokens"] * k
    return fs


def candidates(text: str, lex: Lexicon) -> list[Segment]:
    """The lattice of a text: all candidate segments with features."""
    return [*email_segments(text), *number_segments(text), *address_segments(text), *name_segments(text, lex)]


_PREV_WORD = regex.compile(r"(?r)(\p{L}+)\P{L}{0,4}")
_NEXT_WORD = regex.compile(r"\P{L}{0,4}(\p{L}+)")


def context_features(text: str, seg: Segment) -> tuple[str, ...]:
    """Fitted features: the word before and the one after the span, by kind."""
    a, b, kind, _ = seg
    prev, nxt = _PREV_WORD.match(text, 0, a), _NEXT_WORD.match(text, b)
    return (f"{kind}<{prev[1].casefold() if prev else ''}", f"{kind}>{nxt[1].casefold() if nxt else ''}")


def decode(segs: list[Segment], scores: list[float]) -> list[Segment]:
    """Best set of disjoint segments: semi-Markov Viterbi over the boundaries of the lattice. Ties go to the earlier, longer segment."""
    order = sorted((s for s in zip(segs, scores) if s[1] > 0), key=lambda x: (x[0][1], x[0][0]))
    if not order:
        return []
    ends = [s[1] for s, _ in order]
    from bisect import bisect_right

    best = [0.0] * (len(order) + 1)
    take: list[int | None] = [None] * (len(order) + 1)
    for i, (s, v) in enumerate(order, 1):
        p = bisect_right(ends, s[0], 0, i - 1)
        best[i], take[i] = (best[p] + v, p) if best[p] + v > best[i - 1] else (best[i - 1], None)
    out, i = [], len(order)
    while i:
        if take[i] is None:
            i -= 1
        else:
            out.append(order[i - 1][0])
            i = take[i]
    return out[::-1]


def marginals(segs: list[Segment], scores: list[float]) -> list[float]:
    """Probability of each segment under the field: forward and backward sums over the boundaries."""
    points = sorted({p for s in segs for p in s[:2]})
    at = {p: i for i, p in enumerate(points)}
    n = len(points)
    fwd = [-math.inf] * n
    bwd = [-math.inf] * n

    def add(x: float, y: float) -> float:
        if x == -math.inf:
            return y
        if y == -math.inf:
            return x
        m = max(x, y)
        return m + math.log(math.exp(x - m) + math.exp(y - m))

    ending: list[list[int]] = [[] for _ in range(n)]
    starting: list[list[int]] = [[] for _ in range(n)]
    for k, s in enumerate(segs):
        starting[at[s[0]]].append(k)
        ending[at[s[1]]].append(k)
    fwd[0] = 0.0
    for i in range(n):
        if i:
            fwd[i] = fwd[i - 1]
        for k in ending[i]:
            fwd[i] = add(fwd[i], fwd[at[segs[k][0]]] + scores[k])
    bwd[n - 1] = 0.0
    for i in range(n - 1, -1, -1):
        if i < n - 1:
            bwd[i] = bwd[i + 1]
        for k in starting[i]:
            bwd[i] = add(bwd[i], bwd[at[segs[k][1]]] + scores[k])
    z = fwd[n - 1]
    return [math.exp(min(0.0, fwd[at[s[0]]] + v + bwd[at[s[1]]] - z)) for s, v in zip(segs, scores)]


#: Sentences into which values are planted, in the languages of the corpus, by the kind in braces. Fixed list.
_PLANTS = [
    "Ping {email} if it breaks.", "cc {email}", "mail: {email}", "Escribid a {email}.", "Schreibt an {email}, bitte.", "Contact ({email}) for access", "écrire à {email}", "{email} wrote this", "reach me via {email}, thanks", "联系 {email} 。",
    "call me at {phone} after lunch", "phone {phone}.", "tel: {phone}", "Mobile is {phone}, thanks", "erreichbar unter {phone}", "Téléphone : {phone}", "mi teléfono es {phone}.", "telefone {phone}", "WhatsApp {phone}", "fax {phone} is gone", "(phone {phone})", "電話 {phone}", "hotline: {phone} ext. 12",
    "SSN {id_number} shows up in the dump", "passport number {id_number} of the customer", "ID: {id_number}", "El DNI {id_number} aparece", "Steuer-ID {id_number} steht im Log", "CPF {id_number}", "national insurance {id_number}", "Reisepass {id_number}", "numéro de sécurité sociale {id_number}", "identity card {id_number}", "pasaporte {id_number}",
    "lives at {address} and", "please send it to {address}.", "Lieferung an {address}", "Livrer au {address}.", "Enviar a {address}.", "address: {address}", "moved to {address}, so", "My laptop should go to {address}, please.", "entregar em {address}", "the office is {address}", "{address}\n",
    "Reviewed-by: {name}", "Reported by {name}.", "@author {name}", "thanks to {name} for this", "On call this week: {name}", "pairing with {name} today", "{name} confirmed it", "Ms {name} said so", "Signalé par {name}", "gemeldet von {name}", "lo informó {name}", "cc {name}", "TODO({name})", "assigned to {name}", "ask {name}", "{name}\n",
    "Signed-off-by: {name} <{email}>", "Co-authored-by: {name} <{email}>", "Contact: {name} / {phone} / {email}", "{name}, phone {phone}", "{name} <{email}> tel: {phone}", "customer ({name}, {address})", "{name} lives at {address}", "{name}, {id_number}", "{name} ({email})", "{phone} / {email}",
]
_SLOT = re.compile(r"\{(\w+)\}")
#: Sentences with values that only look like one; ``{}`` is such a value. Fixed list.
_DECOYS = {
    "email": ["muted mails from {}", "git clone {}:team/repo.git", "npm i {} now", "built by {}", "decorators such as {} and others", "uses {} and more", "see {} for it"],
    "phone": ["Error {} again", "order {} shipped", "build {}", "part {} of it", "see line {}", "ids {}", "row {}", "took {} ms", "timestamps are {}", "version {}", "at {} in the trace", "offset {}"],
    "id_number": ["The key {} is only a row id.", "order {} is late", "sample id {}", "commit {}", "build {}", "trace id {}", "serial {}", "table {} for codes"],
    "address": ["{} keeps both apart.", "see {} of the plan"],
    "name": ["Deployed to {}, next.", "{} was stuck again", "Why does {} inherit", "{} and more show up in the plan.", "the {} branch", "docs/{}/index"],
}
_STREETS = ["Harrow", "Osprey", "Tannery", "Miller", "Quarry", "Linden", "Foundry", "Chapel"]
_CITIES = ["Vellaport", "Denmoor", "Brackstadt", "Quarrington"]
_THINGS = ["Cluster", "Release", "Server", "Project", "Module", "Pipeline", "Queue", "Branch", "Street", "Award"]
_PAIRS = ["Merge Queue", "Hash Join", "Silver Heron", "Table Scan", "Event Loop", "Blue Harbor", "Data Frame", "Lane Changes"]


class Planter:
    """Labelled rows for :func:`fit`: sentences with planted values of every kind and form, and with values that only look like them."""

    def __init__(self, lex: Lexicon, seed: int = 17) -> None:
        self.rnd = random.Random(seed)
        self.given = sorted(lex.given) or ["ines"]
        self.surname = sorted(lex.surname) or ["varnholt"]

    def digits(self, form: str) -> str:
        """A text with each ``#`` as a digit, each ``%`` as a digit from 2 on, each ``A`` as a capital."""
        r = self.rnd
        return "".join(r.choice("0123456789") if c == "#" else r.choice("23456789") if c == "%" else r.choice("ABCDEFGHKLMNPRSTWXYZ") if c == "A" else c for c in form)

    def coined(self) -> str:
        r = self.rnd
        return "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.choice((2, 3)))) + r.choice(("n", "sk", "ller", "tti", "wick"))

    def value(self, kind: str) -> str:
        r = self.rnd
        if kind == "email":
            a, b = r.choice(self.given), r.choice(self.surname)
            local = r.choice([f"{a}.{b}", f"{a[0]}{b}", f"{a}_{b}{r.randrange(99)}", f"{b}+x", f"{a}{r.randrange(9)}"]).replace("'", "").replace(" ", "")
            host = r.choice(["nord.test", "mail.example", "quillfork.invalid", "post.co.example"])
            local = local.upper() if r.random() < 0.08 else local
            return r.choice(["{}@{}"] * 5 + ["{} (at) {}", "{} [at] {}", "{}[at]{}", "{}%40{}"]).format(local, host) if r.random() < 0.8 else f"{local} {r.choice(['at', '(at)', '[at]'])} {host.replace('.', r.choice([' dot ', ' [dot] ', ' (dot) ']))}"
        if kind == "phone":
            return self.digits(r.choice(["+## ### #######", "+## ## ########", "+1 (%##) 555-####", "(%##) 555-####", "(0##) #######", "%##-555-####", "%##.555.####", "1-800-555-####", "00## ### #######", "0##/#######", "0##/#####-###", "0## ### ####", "0### ## ## ##", "555-####"]))
        if kind == "id_number":
            return self.digits(r.choice(["###-##-####", "###.###.###-##", "AA ## ## ## C", "AA######B", "########A", "A########", "A#######", "AA#######", "## ### ### ###", "X#######A", "###########"]))
        if kind == "address":
            st, city, n = r.choice(_STREETS), r.choice(_CITIES), r.randrange(1, 240)
            form = r.choice([f"{n} {st} {r.choice(['Street', 'Lane', 'Road', 'Avenue', 'Court'])}", f"{st}straße {n}", f"{st}weg {n}", f"{n}, rue {st}", f"Calle {st} {n}", f"Rua {st}, {n}", f"P.O. Box {self.digits('%###')}", f"Postfach {self.digits('%###')}"])
            return form + r.choice(["", f", {city}", f", {self.digits('%####')} {city}"])
        a, b = r.choice(self.given).title(), r.choice(self.surname).title()
        new = r.random()
        a, b = (self.coined().title(), b) if new < 0.15 else (a, self.coined().title()) if new < 0.3 else (a, b)
        out = r.choice([f"{a} {b}"] * 6 + [f"{b}, {a}", f"{a[0]}. {b}", f"{a} {r.choice('BKMT')}. {b}", f"{a} {b}".upper(), f"{b} {a}"])
        return out.lower() if new > 0.9 and "," not in out else out

    def decoy(self, kind: str) -> str:
        r = self.rnd
        if kind == "email":
            return r.choice(["noreply@ci.corp.example", "release-bot@pager.corp.example", "git@git.corp.example", "@corp/ui@5.6.21", "security@corp.example", "root at noon.", "build at 5.6.x", "git@10.0.0.7", "@app.get", "@retry.on", "a@decorator(x)", "team@lists.corp.example"])
        if kind == "phone":
            return self.digits(r.choice(["555-###", "##-###-####", "####-####-###", "###-##-#", "2025-08-1# 18:##:##", "1265###", "10.0.%.%:####", "#######", "########", "%## ####", "20240#1#-####", "##.###.##"]))
        if kind == "id_number":
            return self.digits(r.choice(["########A", "###-##-##", "2024-0#-##", "A#######", "##########", "AA######", "##.####.##", "#### #### ####"]))
        if kind == "address":
            return r.choice(["3 Way Merge", "5 Lane Changes", "Step 4, Court", "Drive 87 Road map", "2 Hill Climb"])
        g = r.choice(self.given).title()
        return r.choice([f"{g} {r.choice(_THINGS)}", f"the {g} {r.choice(_THINGS)}", r.choice(_PAIRS), f"{self.coined().title()} {self.coined().title()}", f"{g}_{r.choice(self.surname)}", f"{g} {r.choice(self.given).title()}"])

    def row(self, carrier: str) -> tuple[str, set[tuple[int, int, str]]]:
        """A text, with one to three planted sentences around ``carrier``, and the planted (start, end, kind)."""
        r = self.rnd
        parts: list[tuple[str, list[tuple[int, int, str]]]] = [(carrier, [])] if carrier else []
        for _ in range(r.randrange(1, 4)):
            if r.random() < 0.6:
                sentence, spans, at = "", [], 0
                plant = r.choice(_PLANTS)
                for m in _SLOT.finditer(plant):
                    sentence += plant[at : m.start()]
                    at, value = m.end(), self.value(m[1])
                    spans.append((len(sentence), len(sentence) + len(value), m[1]))
                    sentence += value
                sentence += plant[at:]
            else:
                kind = r.choice(list(_DECOYS))
                sentence, spans = r.choice(_DECOYS[kind]).replace("{}", self.decoy(kind)), []
            parts.insert(r.randrange(len(parts) + 1), (sentence, spans))
        text, gold = "", set()
        for t, spans in parts:
            gold |= {(len(text) + a, len(text) + b, k) for a, b, k in spans}
            text += t + r.choice(["\n", " ", "\n\n"])
        return text, gold


def labelled(carriers: list[str], lex: Lexicon, rows: int = FIT_ROWS, seed: int = 17) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """``rows`` planted rows. Carriers are texts of the corpus in which nothing could be a mention, so that all labels are known; others
    are left out, and some rows have none."""
    clean = [c for c in carriers if c and not candidates(c, lex)]
    p = Planter(lex, seed)
    return [p.row(clean[i % (2 * len(clean))] if clean and i % (2 * len(clean)) < len(clean) else "") for i in range(rows)]


def fit(carriers: list[str], lex: Lexicon, rows: int = FIT_ROWS, epochs: int = 6, rate: float = 0.1, pull: float = 0.2, seed: int = 17) -> dict[str, float]:
    """Weights of all span features and context words, fitted on planted rows by gradient ascent on the likelihood of their true
    segmentations under the field; the priors of :data:`PRIOR` are the mean of a Gaussian prior to which ``pull`` draws the
    weights of forms, and context words are drawn to zero. Deterministic for a seed.
    """
    data = []
    for text, gold in labelled(carriers, lex, rows, seed):
        segs = candidates(text, lex)
        if segs:
            feats = [s[3] + context_features(text, s) for s in segs]
            data.append((segs, feats, [float(s[:3] in gold) for s in segs]))
    w = dict(PRIOR)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for segs, feats, truth in data:
            scores = [sum(w.get(f, 0.0) for f in fs) for fs in feats]
            for p, y, fs in zip(marginals(segs, scores), truth, feats):
                d = y - p
                if abs(d) > 1e-3:
                    for f in fs:
                        v, mean = w.get(f, 0.0), PRIOR.get(f, 0.0)
                        w[f] = v + step * d - step * pull * (v - mean)
    return w


def context_bound(weights: dict[str, float]) -> float:
    """The most that the words around a span can add to its score."""
    own = [(f, w) for f, w in weights.items() if f not in PRIOR]
    return sum(max((w for f, w in own if side in f), default=0.0) for side in "<>")


def find_personal(text: str | None, lex: Lexicon, weights: dict[str, float], bound: float | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every mention in a text, in order, in code points. Null and empty texts have none. The words around a span
    are only looked at where they could make it a mention, ``bound`` being :func:`context_bound`."""
    if not text:
        return []
    bound = max(0.0, context_bound(weights) if bound is None else bound)
    segs, scores = [], []
    for s in candidates(text, lex):
        v = sum(weights.get(f, 0.0) for f in s[3])
        if v > -bound:
            segs.append(s)
            scores.append(v + sum(weights.get(f, 0.0) for f in context_features(text, s)))
    return [s[:3] for s in decode(segs, scores)]


def replace_personal(text: str | None, mentions: list[tuple[int, int, str]]) -> str | None:
    """``text`` with each mention replaced by ``[KIND]``, the rest unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in mentions:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


@lru_cache(2)
def _ready(names: tuple[str, ...]) -> Lexicon:
    return Lexicon(list(names))


def known_names(people: DataFrame, most: int = MOST_NAMES) -> tuple[str, ...]:
    """Distinct full names of ``people`` (full_name), at most ``most``: more are an error, as the lexicon goes to every executor."""
    rows = people.where(F.col("full_name").isNotNull()).select("full_name").distinct().orderBy("full_name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} names")
    return tuple(r["full_name"] for r in rows)


#: Words before a surname that are no given names; fixed list.
_TITLES = set("ms mr mrs miss dr prof frau herr mme m sr sra don doña senhor senhora the and by with from of to".split())


def learned_given(docs: DataFrame, names: tuple[str, ...], min_docs: int = 3, most: int = MOST_NAMES) -> tuple[str, ...]:
    """Given names that the list lacks: capitalised words right before a known surname in at least ``min_docs`` documents, counted over
    all documents by the JVM. Pairs of capitalised words are taken from the texts, their second words are looked up among the
    surnames by a broadcast join, whose size :data:`MOST_NAMES` bounds, and (word, document) pairs are combined before the shuffle. More than ``most`` are an error, none is dropped.
    """
    lex = _ready(names)
    surnames = sorted({n.split()[-1] for n in names if " " in n})
    if not surnames:
        return ()
    known = docs.sparkSession.createDataFrame([(s,) for s in surnames], "surname string")
    pair = r"(?=\p{Lu})(?<![\p{L}@])(?=(\p{Lu}[\p{L}\p{M}'’-]++ (?:\p{Lu}\. ?)?[\p{L}\p{M}'’-]++)(?![\p{L}\p{M}\p{N}'’@_+%-]|\.\p{L}))"
    pairs = docs.where(F.col("text").isNotNull()).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pair), F.lit(1)))).alias("pair"))
    words = pairs.select("doc_id", F.substring_index("pair", " ", 1).alias("word"), F.regexp_extract("pair", r"([^ .]+)$", 1).alias("surname")).join(F.broadcast(known), "surname", "left_semi")
    counted = words.select("doc_id", "word").distinct().groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).orderBy(F.desc("n"), "word").limit(most + 1).collect()
    if len(counted) > most:
        raise ValueError(f"more than {most} names")
    return tuple(r["word"] for r in counted if fold(r["word"]) not in lex.given and fold(r["word"]) not in lex.surname and fold(r["word"]) not in _TITLES and fold(r["word"]) not in _STOP)


def fitted(docs: DataFrame, names: tuple[str, ...], carriers: int = FIT_CARRIERS) -> dict[str, float]:
    """Weights fitted on rows planted into one line each of the ``carriers`` documents of smallest id hash; which line, the hash says."""
    h = F.xxhash64("doc_id")
    lines = F.split("text", r"\r?\n")
    chosen = docs.where(F.col("text").isNotNull()).select(h.alias("h"), "doc_id", "text").orderBy("h", "doc_id").limit(carriers)
    rows = chosen.select(F.element_at(lines, (F.pmod("h", F.size(lines)) + 1).cast("int")).alias("line")).collect()
    return fit([r["line"] for r in rows], _ready(names))


def personal_mentions(docs: DataFrame, names: tuple[str, ...], weights: dict[str, float], replaced: bool = False) -> DataFrame:
    """Mentions of ``docs`` (doc_id, text): rows (doc_id, kind, start_char), or (doc_id, text, mentions) with placeholders.

    Names and weights are bounded (:data:`MOST_NAMES`, the context words of :data:`FIT_ROWS` rows) and travel as one broadcast.
    Whole texts are read whatever their length. Rows with equal doc_id are labelled independently. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((names, weights))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, w = _ready(shared.value[0]), shared.value[1]
        bound = context_bound(w)
        for pdf in batches:
            found = [find_personal(t, lex, w, bound) for t in pdf["text"]]
            if replaced:
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": pd.Series([replace_personal(t, f) for t, f in zip(pdf["text"], found)], dtype=object), "mentions": [len(f) for f in found]})
            else:
                rows = [(d, k, a) for d, f in zip(pdf["doc_id"], found) for a, _, k in f]
                yield pd.DataFrame({"doc_id": pd.Series([r[0] for r in rows], dtype="int64"), "kind": pd.Series([r[1] for r in rows], dtype=object), "start_char": pd.Series([r[2] for r in rows], dtype="int64")})

    return docs.select("doc_id", "text").mapInPandas(label, "doc_id bigint, text string, mentions bigint" if replaced else "doc_id bigint, kind string, start_char bigint")
