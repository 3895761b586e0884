"""Questions in words to SPARQL, through any function from prompt to text."""

import json
import re
import urllib.request
from collections.abc import Callable

from structgraph.model import RDF_TYPE, VOCAB, XSD

PREFIXES = {"code:": VOCAB, "rdf:": RDF_TYPE.split("#")[0] + "#", "xsd:": XSD}
_FORMS = ("PREFIX", "SELECT", "ASK", "CONSTRUCT", "DESCRIBE")


def extract_sparql(answer: str) -> str:
    """The query in an answer: its first fenced block, else everything from the first line that begins a query; repaired."""
    block = re.search(r"```(?:sparql)?[ \t]*\n(.*?)```", answer, re.S | re.I)
    if block:
        return repair_sparql(block[1].strip())
    lines = answer.strip().splitlines()
    start = next((i for i, x in enumerate(lines) if x.strip().upper().startswith(_FORMS)), 0)
    return repair_sparql("\n".join(lines[start:]).strip())


def repair_sparql(query: str) -> str:
    """A query with each prefix declared once, the vocabulary's own prefix bound to the vocabulary, and missing prefixes added."""
    declared: dict[str, str] = {}
    body = []
    for line in query.splitlines():
        m = re.match(r"\s*PREFIX\s+(\S*:)\s*<([^>]*)>\s*$", line, re.I)
        if m:
            declared.setdefault(m[1], m[2])
        else:
            body.append(line)
    rest = "\n".join(body).strip()
    if "code:" in declared:
        declared["code:"] = VOCAB
    for p, iri in PREFIXES.items():
        if p not in declared and re.search(rf"(?<![\w:]){p}\w", rest):
            declared[p] = iri
    head = "".join(f"PREFIX {p} <{iri}>\n" for p, iri in declared.items())
    return head + rest


def nl_to_sparql(question: str, complete: Callable[[str], str]) -> dict:
    """{'sparql': ...} for a question, or {'error': ...}; ``complete`` is the model call, such as a :func:`chat_client`."""
    prompt = (
        "Translate the question into one SPARQL SELECT query over a code graph.\n"
        f"PREFIX code: <{VOCAB}>\nClasses: Module Class Function Method Parameter Variable.\n"
        "Properties: name filePath startLine endLine docstring hasDecorator defines calls resolvedCalls inheritsFrom imports hasParameter tag note linksTo.\n"
        f"calls, inheritsFrom and imports hold texts.\nQuestion: {question}\nAnswer with the query only."
    )
    try:
        return {"sparql": extract_sparql(complete(prompt))}
    except Exception as x:
        return {"error": f"{type(x).__name__}: {x}"}


def chat_client(url: str, model: str, key: str | None = None, timeout: float = 60.0, max_tokens: int = 1024) -> Callable[[str], str]:
    """A completion function over a chat-completions endpoint, at temperature 0: one POST of the prompt as the user's message to ``url``."""

    def complete(prompt: str) -> str:
        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "max_tokens": max_tokens}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]

    return complete
