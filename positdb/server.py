"""HTTP front: POST /v1/query with {"script", "stream", "timeout_ms"} gives JSON, or server-sent events.

Plain replies: ``status``, ``elapsed_ms`` and, for one search, ``columns``, ``rows``, ``row_types``, ``row_count`` and
``limited``; for several, ``result_sets`` with these and ``search`` each, and the total ``row_count``.

Each event is one JSON object.  One search: ``meta`` (columns), ``row`` (row, types) ..., ``end`` (row_count, limited).
Several: ``result_set_start`` (index, columns, search), ``row`` with its index ..., ``result_set_end`` (index, row_count,
limited), ``multi_end`` (total_rows), ``end``.  Errors: ``error``, then ``end``.  A script that takes longer than
``timeout_ms`` is cancelled, whichever way it is asked.
"""

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from positdb.engine import Engine
from positdb.errors import Cancelled, ParseError, PositError
from positdb.plans.syntax import Search, parse
from positdb.streaming.rows import Running


def searches(request: dict) -> int:
    return sum(isinstance(c, Search) for c in parse(request["script"]))


def running(engine: Engine, request: dict) -> Running:
    limit = request.get("timeout_ms")
    return Running(engine, request["script"], None if limit is None else limit / 1000)


def answer(engine: Engine, request: dict) -> tuple[int, dict]:
    """Status and reply to a request that isn't streamed."""
    began = time.monotonic()
    try:
        found: list[dict] = []
        several = searches(request) > 1
        for kind, _, *rest in running(engine, request).events():
            if kind == "start":
                found.append({"columns": rest[0].columns, "rows": [], "row_types": [], "search": rest[0].search})
            elif kind == "row":
                found[-1]["rows"].append(rest[0]), found[-1]["row_types"].append(rest[1])
            else:
                found[-1] |= {"row_count": rest[0], "limited": rest[1]}
        if several:
            body = {"result_sets": found, "row_count": sum(f["row_count"] for f in found)}
        else:
            body = {k: v for k, v in found[0].items() if k != "search"} if found else {"columns": [], "rows": [], "row_types": [], "row_count": 0, "limited": False}
        status, body = 200, {"status": "ok"} | body
    except (PositError, KeyError) as e:
        status = 400 if isinstance(e, ParseError) else 504 if isinstance(e, Cancelled) else 500
        body = {"status": "error", "error": str(e)}
    return status, body | {"elapsed_ms": round(1000 * (time.monotonic() - began), 2)}


def told(engine: Engine, request: dict):
    """The events of a streamed request."""
    try:
        several, total = searches(request) > 1, 0
        last: dict = {"event": "end"}
        for kind, k, *rest in running(engine, request).events():
            index = {"index": k} if several else {}
            if kind == "start":
                more = {"search": rest[0].search} if several else {"row_types": [], "row_count": 0, "limited": False}
                yield {"event": "result_set_start" if several else "meta"} | index | {"columns": rest[0].columns} | more
            elif kind == "row":
                total += 1
                yield {"event": "row"} | index | {"row": rest[0], "types": rest[1]}
            elif several:
                yield {"event": "result_set_end"} | index | {"row_count": rest[0], "limited": rest[1]}
            else:
                last |= {"row_count": rest[0], "limited": rest[1]}
        if several:
            yield {"event": "multi_end", "total_rows": total}
        yield last
    except (PositError, KeyError) as e:
        yield {"event": "error", "error": str(e)}
        yield {"event": "end"}


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that isn't started yet; ``serve_forever`` starts it."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            if self.path != "/v1/query":
                self.send_error(404)
                return
            try:
                request = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
            except ValueError:
                self.send_error(400)
                return
            if request.get("stream"):
                self.send_response(200)
                self.send_header("Content-Type", "text/event-stream")
                self.send_header("Cache-Control", "no-cache")
                self.end_headers()
                try:
                    for event in told(engine, request):
                        self.wfile.write(f"data: {json.dumps(event)}\n\n".encode())
                        self.wfile.flush()
                except (BrokenPipeError, ConnectionResetError):
                    return  # the reader has gone
                return
            status, body = answer(engine, request)
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            return

    return ThreadingHTTPServer((host, port), Handler)
