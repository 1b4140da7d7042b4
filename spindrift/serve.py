"""The engine behind two interfaces: JSON over HTTP, and tool calls as JSON lines over stdin and stdout.

Both are thin: a request becomes one engine call whose result is already limited, and its rows become JSON.
"""

from __future__ import annotations

import json
import sys
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import functions as F

from .functions.paths import extension
from .operators import symbols as lookup
from .plans import render
from .plans.engine import Engine

VERSION = "0.1.0"
_PAGE = b"""<!DOCTYPE html><meta charset=utf-8><title>Search</title><form id=f><input id=q size=60 autofocus></form><pre id=o></pre>
<script>f.onsubmit=async e=>{e.preventDefault();let r=await fetch('/api/search',{method:'POST',body:JSON.stringify({query:q.value})});
o.textContent=(await r.json()).results.map(x=>x.file_path+':'+x.start_line+'\\n'+x.content).join('\\n\\n')}</script>"""


class Api:
    """Requests as (method, path, query, body) -> (status, content type, bytes)."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def search(self, body: dict) -> dict:
        began = time.time()
        mode = body.get("mode") or self.engine.config.search.mode
        found = self.engine.search(body["query"], body.get("limit"), mode).collect()
        names = ("file_path", "start_line", "end_line", "content", "score", "file_header")
        self.engine.metrics.observe("search_latency_seconds", time.time() - began)
        self.engine.metrics.observe("search_results_count", len(found))
        rows = [{n: r[n] if n in r else None for n in names} for r in (x.asDict() for x in found)]
        return {"results": rows, "query": body["query"], "mode": mode, "took_ms": int((time.time() - began) * 1000)}

    def files(self, pattern: str | None = None) -> list[dict]:
        rows = self.engine.list_files(pattern).select("file_path", extension(F.col("file_path")).alias("ext")).collect()
        return [{"path": r["file_path"], "extension": r["ext"]} for r in rows]

    def stats(self) -> dict:
        s = self.engine.stats()
        return {"files": s["files"], "chunks": s["chunks"], "index_size": s["index_size_bytes"], "search_mode": s["mode"], "root_path": s["root"]}

    def handle(self, method: str, target: str, body: bytes = b"") -> tuple[int, str, bytes]:
        url = urlsplit(target)
        path, asked = unquote(url.path), parse_qs(url.query)
        as_json = lambda value, status=200: (status, "application/json", json.dumps(value).encode())
        try:
            match method, path:
                case "GET", "/":
                    return 200, "text/html; charset=utf-8", _PAGE
                case "GET", "/health":
                    return as_json({"status": "healthy", "version": VERSION})
                case "GET", "/metrics":
                    return 200, "text/plain; version=0.0.4", self.engine.metrics.text().encode()
                case "GET", "/api/stats":
                    return as_json(self.stats())
                case "GET", "/api/files":
                    return as_json(self.files(asked.get("pattern", [None])[0]))
                case "POST", "/api/search":
                    return as_json(self.search(json.loads(body)))
                case "POST", "/api/reindex":
                    return as_json({"success": True, "message": json.dumps(self.engine.index())})
            if method == "GET" and path.startswith("/api/files/"):
                return 200, "text/plain; charset=utf-8", self.engine.get_file(path.removeprefix("/api/files/")).encode()
        except PermissionError as e:
            return as_json({"error": str(e)}, 403)
        except FileNotFoundError as e:
            return as_json({"error": str(e)}, 404)
        except (KeyError, ValueError) as e:
            return as_json({"error": f"{type(e).__name__}: {e}"}, 400)
        return as_json({"error": f"no such route: {method} {path}"}, 404)


def http_server(engine: Engine, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``."""
    api = Api(engine)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, kind, data = api.handle(self.command, self.path, self.rfile.read(size))
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, format, *args):
            return

    return ThreadingHTTPServer((host, port), Handler)


_TEXT, _NUMBER, _LIST = {"type": "string"}, {"type": "integer"}, {"type": "array", "items": {"type": "string"}}
#: name: (description, properties, required)
TOOLS = {
    "search": ("Search the indexed chunks", {"query": _TEXT, "limit": _NUMBER, "mode": _TEXT}, ["query"]),
    "list_files": ("List indexed files", {"pattern": _TEXT}, []),
    "get_file": ("Text of a file", {"path": _TEXT}, ["path"]),
    "find_symbol": ("Find definitions by name", {"query": _TEXT, "mode": _TEXT, "kind": _TEXT, "file_pattern": _TEXT, "language": _TEXT, "limit": _NUMBER}, ["query"]),
    "list_symbols": ("List definitions", {"file_path": _TEXT, "kinds": _LIST, "visibility": _TEXT}, []),
    "find_references": ("Find uses of a name", {"symbol_name": _TEXT, "definition_file": _TEXT, "mode": _TEXT, "limit": _NUMBER}, ["symbol_name"]),
}


def call_tool(engine: Engine, name: str, args: dict) -> str:
    """The result of one tool as text."""
    limit = args.get("limit")
    if name == "search":
        return render.search_results(args["query"], engine.search(args["query"], limit or 10, args.get("mode")))
    if name == "list_files":
        return render.file_list(engine.list_files(args.get("pattern")), args.get("pattern"))
    if name == "get_file":
        return engine.get_file(args["path"])
    if name == "find_symbol":
        found = engine.find_symbol(
            args["query"], mode=args.get("mode", "fuzzy"), kind=args.get("kind"), file_glob=args.get("file_pattern"),
            language=args.get("language"), limit=limit or lookup.FIND_LIMIT,
        )
        return render.symbol_list(found)
    if name == "list_symbols":
        return render.symbol_list(engine.list_symbols(file_path=args.get("file_path"), kinds=args.get("kinds"), visibility=args.get("visibility")))
    if name == "find_references":
        found = engine.find_references(args["symbol_name"], args.get("definition_file"), limit or lookup.REFERENCE_LIMIT, args.get("mode", "vector"))
        return render.references(args["symbol_name"], found)
    raise KeyError(f"no such tool: {name}")


def answer(engine: Engine, request: dict) -> dict | None:
    """The JSON-RPC answer to one request; notifications have none."""
    method, params = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    out = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        info = {"name": "spindrift", "version": VERSION}
        return out | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": info}}
    if method == "ping":
        return out | {"result": {}}
    if method == "tools/list":
        tools = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]
        return out | {"result": {"tools": tools}}
    if method == "tools/call":
        try:
            text, failed = call_tool(engine, params["name"], params.get("arguments") or {}), False
        except Exception as e:  # noqa: BLE001  the caller gets the failure as the tool's result
            text, failed = f"{type(e).__name__}: {e}", True
        return out | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return out | {"error": {"code": -32601, "message": f"unknown method: {method}"}}


def serve_lines(engine: Engine, source=sys.stdin, sink=sys.stdout) -> None:
    """One JSON-RPC message a line until the input ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            reply = answer(engine, json.loads(line))
        except ValueError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            sink.write(json.dumps(reply) + "\n")
            sink.flush()
