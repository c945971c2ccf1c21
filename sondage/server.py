"""HTTP endpoints over a catalog: /health, /status, /search, /search/stream (events) and /index.

Meant for one machine: only local host names and origins are answered, bodies are JSON, a bearer token and a limit of
requests a minute for each client can be set. Searches run one at a time in Spark's own scheduler.
"""

from __future__ import annotations

import hmac
import json
import os
import threading
import time
from collections import defaultdict, deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from sondage.errors import EngineError, InvalidInput
from sondage.sources.files import restrict_to

LOCAL_HOSTS = frozenset(("localhost", "127.0.0.1", "[::1]", "::1"))
MOST_BODY = 1 << 20
MOST_HITS = 100
HEARTBEAT_SECONDS = 2.0


@dataclass
class Guard:
    """Who may ask, and how often."""

    token: str = ""
    per_minute: int = 120
    clock: Callable[[], float] = time.monotonic
    seen: dict[str, deque] = field(default_factory=lambda: defaultdict(deque))
    lock: threading.Lock = field(default_factory=threading.Lock)

    def refuse(self, client: str, method: str, headers) -> tuple[int, str] | None:
        """(status, reason) of a request that isn't answered."""
        host = (headers.get("Host") or "").rsplit(":", 1)[0] if not (headers.get("Host") or "").endswith("]") else headers.get("Host")
        if host not in LOCAL_HOSTS:
            return 403, "unknown host"
        origin = headers.get("Origin")
        if origin and (urlsplit(origin).hostname or "") not in LOCAL_HOSTS:
            return 403, "unknown origin"
        if method == "POST" and (headers.get("Content-Type") or "").split(";")[0].strip() != "application/json":
            return 415, "the body must be application/json"
        if self.token and not hmac.compare_digest((headers.get("Authorization") or "").encode(), f"Bearer {self.token}".encode()):
            return 401, "no valid token"
        with self.lock:
            now, times = self.clock(), self.seen[client]
            while times and now - times[0] >= 60:
                times.popleft()
            if len(times) >= self.per_minute:
                return 429, "too many requests"
            times.append(now)
        return None


class Service:
    """What the endpoints do, without HTTP."""

    def __init__(self, catalog, home: str, guard: Guard | None = None):
        self.catalog, self.home, self.guard = catalog, os.path.realpath(home), guard or Guard()
        self.jobs = ThreadPoolExecutor(1)

    def status(self) -> dict:
        return self.catalog.status().first().asDict()

    def search(self, query: str, limit: int = 5, prefix: str | None = None) -> list[dict]:
        if not query.strip():
            raise InvalidInput("the query is empty")
        return [r.asDict(True) for r in self.catalog.search(query, min(MOST_HITS, max(1, limit)), prefix).collect()]

    def index(self, path: str) -> dict:
        full = restrict_to(path, self.home)
        if os.path.isdir(full):
            indexed, removed, rejects = self.catalog.index_directory(full)
        else:
            (indexed, rejects), removed = self.catalog.index_file(full), 0
        return {"indexed": indexed, "removed": removed, "rejects": [r.asDict() for r in rejects.collect()]}


def _whole(value: str | int | None, default: int) -> int:
    try:
        return int(value) if value is not None else default
    except (TypeError, ValueError):
        raise InvalidInput(f"{value!r} is no whole number") from None


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _send(self, status: int, body) -> None:
            data = json.dumps(body, default=str, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _stream(self, job) -> None:
            """Comments while the search runs, then an event a hit and one at the end."""
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.send_header("Connection", "close")
            self.end_headers()
            event = lambda name, body: self.wfile.write(f"event: {name}\ndata: {json.dumps(body, default=str, ensure_ascii=False)}\n\n".encode())
            while True:
                try:
                    hits = job.result(HEARTBEAT_SECONDS)
                    break
                except TimeoutError:
                    self.wfile.write(b": waiting\n\n")
                    self.wfile.flush()
                except EngineError as e:
                    return event("error", {"error": str(e)})
            for hit in hits:
                event("result", hit)
            event("done", {"count": len(hits)})
            self.close_connection = True

        def _answer(self, method: str) -> None:
            refused = service.guard.refuse(self.client_address[0], method, self.headers)
            if refused:
                self.close_connection = True
                return self._send(refused[0], {"error": refused[1]})
            url = urlsplit(self.path)
            asked = {k: v[-1] for k, v in parse_qs(url.query).items()}
            try:
                if method == "POST":
                    size = _whole(self.headers.get("Content-Length"), 0)
                    if size > MOST_BODY:
                        self.close_connection = True
                        return self._send(413, {"error": "the body is too large"})
                    body = json.loads(self.rfile.read(size) or b"{}")
                    if not isinstance(body, dict):
                        raise InvalidInput("the body is no object")
                    asked |= body
                if url.path == "/health":
                    return self._send(200, {"status": "ok"})
                if url.path == "/status":
                    return self._send(200, service.jobs.submit(service.status).result())
                if url.path in ("/search", "/search/stream"):
                    job = service.jobs.submit(service.search, str(asked.get("query") or asked.get("q") or ""), _whole(asked.get("limit"), 5), asked.get("prefix"))
                    return self._stream(job) if url.path.endswith("/stream") else self._send(200, {"results": job.result()})
                if url.path == "/index" and method == "POST":
                    return self._send(200, service.jobs.submit(service.index, str(asked.get("path") or "")).result())
                self._send(404, {"error": "no such path"})
            except (EngineError, ValueError) as e:
                self._send(400, {"error": str(e)})

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

        def log_message(self, *_) -> None:
            pass

    return Handler


def serve(service: Service, port: int = 8420) -> ThreadingHTTPServer:
    """A server on the loopback address; the caller runs ``serve_forever``."""
    return ThreadingHTTPServer(("127.0.0.1", port), handler(service))
