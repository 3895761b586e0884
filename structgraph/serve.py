"""Tool server: the verbs of an engine over JSON-RPC, on standard streams or HTTP."""

import inspect
import json
import queue
import sys
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame

from structgraph.engine import VERBS, Engine

#: Rows that an answer shows; the count of all rows is told.
SHOWN = 200


def tools() -> list[dict]:
    """Description of every verb with the names and types of its arguments."""
    kinds = {str: "string", int: "integer", float: "number", bool: "boolean"}
    out = []
    for v in VERBS:
        params = {n: p for n, p in inspect.signature(getattr(Engine, v)).parameters.items() if n != "self" and n != "extensions"}
        props = {n: {"type": next((k for t, k in kinds.items() if str(p.annotation).startswith(t.__name__) or p.annotation is t), "string")} for n, p in params.items()}
        out.append({"name": v, "description": (getattr(Engine, v).__doc__ or v.replace("_", " ")).strip(), "inputSchema": {"type": "object", "properties": props, "required": [n for n, p in params.items() if p.default is p.empty]}})
    return out


def shown(result) -> str:
    """A result as JSON text."""
    if isinstance(result, DataFrame):
        rows = result.limit(SHOWN + 1).toJSON().collect()
        return "[" + ",\n".join(rows[:SHOWN]) + "]" + (f"\n... more than {SHOWN} rows" if len(rows) > SHOWN else "")
    return json.dumps({"ok": True} if result is None else result, default=str)


def answer(engine: Engine, request: dict) -> dict | None:
    """The response to one request; None for notifications."""
    rid, method, params = request.get("id"), request.get("method", ""), request.get("params") or {}
    if rid is None:
        return None
    try:
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "structgraph", "version": "0.1.0"}}
        elif method == "tools/list":
            result = {"tools": tools()}
        elif method == "tools/call":
            if params.get("name") not in VERBS:
                raise ValueError(f"no tool {params.get('name')!r}")
            result = {"content": [{"type": "text", "text": shown(getattr(engine, params["name"])(**(params.get("arguments") or {})))}]}
        elif method == "ping":
            result = {}
        else:
            return {"jsonrpc": "2.0", "id": rid, "error": {"code": -32601, "message": f"no method {method}"}}
        return {"jsonrpc": "2.0", "id": rid, "result": result}
    except Exception as x:
        return {"jsonrpc": "2.0", "id": rid, "result": {"isError": True, "content": [{"type": "text", "text": f"{type(x).__name__}: {x}"[:2000]}]}}


def serve_streams(engine: Engine, source=sys.stdin, sink=sys.stdout) -> None:
    """One JSON request per line in, one response per line out."""
    for line in source:
        if line.strip():
            reply = answer(engine, json.loads(line))
            if reply is not None:
                sink.write(json.dumps(reply) + "\n")
                sink.flush()


def serve_http(engine: Engine, port: int = 8765, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server of sessions: GET opens a stream of server-sent events, whose first names the address for requests; what is POSTed there is
    answered on the stream. A POST to any other address is answered at once. The caller runs the server; requests are answered one at a time.
    """
    sessions: dict[str, queue.Queue] = {}
    turn = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            name = uuid.uuid4().hex
            sessions[name] = queue.Queue()
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.send_header("Cache-Control", "no-cache")
            self.end_headers()
            try:
                self._event("endpoint", f"/messages?session={name}")
                while (reply := self._next(sessions[name])) is not None:
                    self._event("message", reply)
            except OSError:
                pass  # the client has gone
            finally:
                del sessions[name]

        def _next(self, replies: queue.Queue) -> str | None:
            while True:
                try:
                    return replies.get(timeout=15)
                except queue.Empty:
                    self.wfile.write(b": still here\n\n")
                    self.wfile.flush()

        def _event(self, kind: str, data: str) -> None:
            self.wfile.write(f"event: {kind}\ndata: {data}\n\n".encode())
            self.wfile.flush()

        def do_POST(self) -> None:
            request = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
            with turn:
                reply = json.dumps(answer(engine, request)) if request else None
            name = parse_qs(urlparse(self.path).query).get("session", [""])[0]
            body = b"" if name in sessions else (reply or "{}").encode()
            if name in sessions and reply not in (None, "null"):
                sessions[name].put(reply)
            self.send_response(202 if name in sessions else 200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    server.daemon_threads = True
    return server
