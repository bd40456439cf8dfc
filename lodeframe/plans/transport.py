"""The service as a JSON-RPC server: lines or framed messages on stdio, HTTP with event streams, a proxy.

One dispatcher answers all transports. Spark plans run in the calling thread, so that HTTP requests
are served side by side by one session.
"""

from __future__ import annotations

import hmac
import ipaddress
import json
import queue
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any, BinaryIO
from urllib.parse import parse_qs, urlsplit

from lodeframe.plans.service import Service

# Fixed values of the protocol: version, error codes, tool and argument names.
PROTOCOL = "2024-11-05"
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, FAILED = -32700, -32600, -32601, -32000
_TEXT, _WHOLE, _FLAG, _NUMBERS = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}, {"type": "array", "items": {"type": "number"}}
_SEARCH = {
    "query_text": _TEXT, "query_embedding": _NUMBERS, "project_id": _TEXT, "top_k": _WHOLE, "path_prefix": _TEXT, "file": _TEXT,
    "auto_scope": _FLAG, "max_chars": _WHOLE, "doc_type": _TEXT, "language": _TEXT, "format": _TEXT,
}
_PROJECT = {"project_id": _TEXT}
#: name: the service's method, whether it takes arguments, a description, the arguments' types.
TOOLS: dict[str, tuple[str, bool, str, dict[str, dict]]] = {
    "rag_context": ("context", True, "Passages and symbols for a question, assembled by file.", _SEARCH),
    "rag_search": ("search", True, "Raw matches of a question, grouped by file.", _SEARCH),
    "rag_full_context": ("full_context", True, "Context with callers of its entry points and a confidence.", _SEARCH | {"include_symbols": _FLAG, "explain": _FLAG}),
    "map_work_item_to_codebase": ("map_work_item", True, "Where in a project a work item belongs.", _PROJECT | {"ticket_key": _TEXT, "summary": _TEXT, "description": _TEXT, "product_target_hint": _TEXT}),
    "context_info": ("context_info", False, "Tools, limits and readiness.", {}),
    "symbol_search": ("symbol_search", True, "Symbols by name or by its beginning.", _PROJECT | {"name": _TEXT, "kind": _TEXT, "language": _TEXT, "exact": _FLAG, "limit": _WHOLE}),
    "list_projects": ("list_projects", False, "Registered projects and their integrity.", {}),
    "get_project_info": ("project_info", True, "A project's settings and counts.", _PROJECT),
    "get_project_snapshot": ("snapshot", True, "A part of an exported snapshot.", _PROJECT | {"part": _TEXT}),
}
#: Answers that do not depend on the arguments.
_PLAIN: dict[str, Any] = {
    "initialize": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {"listChanged": False}, "resources": {}, "prompts": {}}, "serverInfo": {"name": "lodeframe", "version": "1"}},
    "tools/list": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p}} for n, (_, _, d, p) in TOOLS.items()]},
    "resources/list": {"resources": []},
    "resources/templates/list": {"resourceTemplates": []},
    "prompts/list": {"prompts": []},
    "ping": {},
    "shutdown": None,
}
_PYTHON = {"string": str, "integer": int, "boolean": bool, "array": list}


def encoded(value: Any) -> bytes:
    return json.dumps(value, ensure_ascii=False, default=str).encode()


def failure(code: int, message: str, of: Any = None) -> dict[str, Any]:
    return {"jsonrpc": "2.0", "id": of, "error": {"code": code, "message": message}}


class Dispatcher:
    """Answers messages with a service; ``snapshots`` holds a folder for each exported project."""

    def __init__(self, service: Service, snapshots: str | Path = "snapshots") -> None:
        self.service, self.snapshots = service, Path(snapshots)

    def call(self, name: str, args: dict[str, Any]) -> str:
        """A tool's result as text: a context as it reads (``format`` json: whole), all else as JSON."""
        if name not in TOOLS:
            raise ValueError(f"Unknown tool: {name}")
        method, takes, _, _ = TOOLS[name]
        run = getattr(self.service, method)
        if name == "get_project_snapshot":
            project = self.service.registry.get(str(args.get("project_id") or ""))
            found = run(args, self.snapshots / project.project_id)
        else:
            found = run(args) if takes else run()
        if isinstance(found, str):
            return found
        if name == "rag_context" and args.get("format", "text") != "json":
            return found["functional_context"]["assembled_context"]
        return encoded(found).decode()

    def answer(self, message: Any) -> dict[str, Any] | None:
        """The response to a message; None to a notification."""
        if not isinstance(message, dict):
            return failure(INVALID_REQUEST, "Invalid Request")
        method, of = message.get("method"), message.get("id")
        if method == "initialized" or ("id" not in message and method != "tools/call"):
            return None
        if isinstance(method, str) and method in _PLAIN:
            return {"jsonrpc": "2.0", "id": of, "result": _PLAIN[method]}
        if method != "tools/call":
            return failure(NO_METHOD, f"Method not found: {method}", of)
        params = message.get("params") or {}
        try:
            text = self.call(params.get("name"), params.get("arguments") or {})
        except Exception as e:  # noqa: BLE001  a tool's failure is the client's answer, not the server's end
            return failure(FAILED, str(e), of)
        return {"jsonrpc": "2.0", "id": of, "result": {"content": [{"type": "text", "text": text}]}}


# --- stdio ----------------------------------------------------------------------------------


def lines(stream: BinaryIO) -> Iterator[bytes]:
    """Message bodies, one to a line; empty lines are none."""
    yield from filter(None, map(bytes.strip, iter(stream.readline, b"")))


def framed(stream: BinaryIO) -> Iterator[bytes]:
    """Message bodies behind headers that give their length; a header without one yields an empty body."""
    size, open_ = 0, False
    for line in iter(stream.readline, b""):
        name, _, value = line.strip().partition(b":")
        if name.lower() == b"content-length":
            size, open_ = int(value) if value.strip().isdigit() else 0, True
        elif name:
            open_ = True
        elif open_:
            yield stream.read(size)
            size, open_ = 0, False


def serve_stdio(dispatcher: Dispatcher, source: BinaryIO, sink: BinaryIO, headers: bool = False) -> None:
    """Answer messages until the stream ends; a malformed one is answered with a parse error."""
    for body in (framed if headers else lines)(source):
        try:
            found = dispatcher.answer(json.loads(body))
        except ValueError as e:
            found = failure(PARSE_ERROR, f"Parse error: {e}")
        if found is not None:
            out = encoded(found)
            sink.write(b"Content-Length: %d\r\n\r\n%s" % (len(out), out) if headers else out + b"\n")
            sink.flush()


def proxy(source: BinaryIO, sink: BinaryIO, url: str, token: str | None = None) -> None:
    """Send each line of ``source`` to an HTTP server and write its answers; a lost server is answered for."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    for body in lines(source):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers)) as response:  # noqa: S310
                out = response.read()
        except urllib.error.URLError as e:
            try:
                asked = json.loads(body)
            except ValueError:
                continue
            out = encoded(failure(FAILED, f"the server behind the proxy does not answer: {e}", asked["id"])) if isinstance(asked, dict) and "id" in asked else b""
        if out:
            sink.write(out + b"\n")
            sink.flush()


# --- HTTP -----------------------------------------------------------------------------------


def loopback(host: str) -> bool:
    try:
        return host == "localhost" or ipaddress.ip_address(host.strip("[]")).is_loopback
    except ValueError:
        return False


def raw_call(body: dict[str, Any]) -> dict[str, Any]:
    """A message; an object without a method holds the arguments of rag_context, checked by type."""
    if "method" in body or "jsonrpc" in body:
        if not isinstance(body.get("method"), str) or not isinstance(body.get("params", {}), dict):
            raise ValueError("a request needs a method, and params must be an object")
        return body
    if unknown := sorted(set(body) - set(_SEARCH)):
        raise ValueError(f"Unsupported arguments: {', '.join(unknown)}")
    for name, value in body.items():
        kind = _SEARCH[name]["type"]
        if not isinstance(value, _PYTHON[kind]) or (kind == "integer" and isinstance(value, bool)):
            raise ValueError(f"{name} must be of type {kind}")
    return {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "rag_context", "arguments": body}}


def server(
    dispatcher: Dispatcher,
    host: str = "127.0.0.1",
    port: int = 8765,
    token: str | None = None,
    hosts: tuple[str, ...] = ("localhost", "127.0.0.1", "::1"),
    origins: tuple[str, ...] = ("http://localhost:*", "http://127.0.0.1:*", "https://localhost:*", "https://127.0.0.1:*"),
    most: int = 1_000_000,
    wait: float = 30.0,
) -> ThreadingHTTPServer:
    """An HTTP server, not yet serving: POST /rpc and /mcp answer at once, GET /sse opens an event stream
    that POST /message?session_id= feeds, GET /health tells the readiness.

    An address that others can reach needs a token. Bodies over ``most`` bytes are refused; an idle
    event stream gets a comment every ``wait`` seconds."""
    if not token and not loopback(host):
        raise ValueError(f"{host} can be reached by others: give a token")
    sessions: dict[str, queue.Queue] = {}

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *_: Any) -> None:
            """Stdout and stderr stay the caller's."""

        def reply(self, status: int, value: Any = None, **headers: str) -> None:
            out = b"" if value is None else encoded(value)
            self.send_response(status)
            for name, content in headers.items():
                self.send_header(name.replace("_", "-"), content)
            if out:
                self.send_header("Content-Type", "application/json")
            if status != 204:
                self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def refused(self, path: str) -> bool:
            """Answer a request that may not pass: token, then the host it names, then its origin."""
            scheme, _, given = (self.headers.get("Authorization") or "").partition(" ")
            if token and not (scheme.lower() == "bearer" and hmac.compare_digest(given.strip().encode(), token.encode())):
                self.close_connection = True
                self.reply(401, failure(FAILED, "Unauthorized"), WWW_Authenticate="Bearer")
                return True
            named, origin = urlsplit(f"//{self.headers.get('Host') or ''}").hostname, self.headers.get("Origin")
            wrong = "Host" if named not in hosts else "Origin" if origin and not any(fnmatchcase(origin, o) for o in origins) else ""
            if wrong and path != "/health":
                self.close_connection = True
                self.reply(403, failure(FAILED, f"Forbidden: {wrong} not allowed"))
                return True
            return False

        def body(self) -> Any:
            """The request's JSON, or None when it was answered with an error."""
            given = self.headers.get("Content-Length") or ""
            size = int(given) if given.isdigit() else 0
            if not 0 < size <= most:
                self.close_connection = True
                self.reply(413 if size else 400, failure(FAILED, f"a request may have {most} bytes, this one has {size}" if size else "a request needs a body"))
                return None
            try:
                found = json.loads(self.rfile.read(size))
            except ValueError:
                found = None
            if found is None:
                self.reply(400, failure(PARSE_ERROR, "Parse error"))
            return found

        def do_POST(self) -> None:
            at = urlsplit(self.path)
            if self.refused(at.path) or (message := self.body()) is None:
                return
            if at.path == "/message":
                stream = sessions.get(parse_qs(at.query).get("session_id", [""])[0])
                if stream is None:
                    return self.reply(400, {"error": "no such session"})
                if (found := dispatcher.answer(message)) is not None:
                    stream.put(found)
                return self.reply(202)
            if at.path == "/rpc":
                try:
                    message = raw_call(message if isinstance(message, dict) else {"method": None})
                except ValueError as e:
                    return self.reply(400, {"error": str(e)})
            elif at.path not in ("/mcp", "/sse"):
                return self.reply(404, {"error": "Not found"})
            found = dispatcher.answer(message)
            if found is None:
                return self.reply(204 if at.path == "/rpc" else 202)
            return self.reply(200, found)

        def do_DELETE(self) -> None:
            path = urlsplit(self.path).path
            if not self.refused(path):
                self.reply(200 if path in ("/mcp", "/sse") else 404)

        def do_GET(self) -> None:
            path = urlsplit(self.path).path
            if self.refused(path):
                return
            if path == "/health":
                cache = dispatcher.service.cache
                self.reply(200, dispatcher.service.readiness() | {"query_cache": {"entries": len(cache.held), "max_entries": cache.entries, "ttl_seconds": cache.seconds}})
            elif path == "/mcp":
                self.reply(405, Allow="POST, DELETE")
            elif path != "/sse":
                self.reply(404, {"error": "Not found"})
            else:
                self.stream()

        def stream(self) -> None:
            """Events of one session until its client goes."""
            name, mine = uuid.uuid4().hex, queue.Queue()
            sessions[name] = mine
            self.close_connection = True
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.send_header("Cache-Control", "no-cache")
            self.end_headers()
            out = f"event: endpoint\ndata: http://{self.headers['Host']}/message?session_id={name}\n\n".encode()
            try:
                while True:
                    self.wfile.write(out)
                    self.wfile.flush()
                    try:
                        out = b"event: message\ndata: " + encoded(mine.get(timeout=wait)) + b"\n\n"
                    except queue.Empty:
                        out = b": keepalive\n\n"
            except OSError:
                return
            finally:
                del sessions[name]

    return ThreadingHTTPServer((host, port), Handler)
