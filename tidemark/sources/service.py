"""The run store over HTTP, read only: JSON answers from the same queries that a session uses."""

from __future__ import annotations

import hmac
import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame

from tidemark.sources.tables import RunStore

#: Paths that need no key.
OPEN = ("/", "/health")


def _points(df: DataFrame) -> list[dict]:
    return [{"timestamp": str(r["ts"]), "value": r["value"]} for r in df.select("ts", "value").toLocalIterator()]


def answer(store: RunStore, path: str, key: str | None, given: str | None) -> tuple[int, Any]:
    """(status, body) of a GET. Without a configured key everything but OPEN is refused; keys are compared in constant time."""
    parts = urlsplit(path)
    where = parts.path.rstrip("/") or "/"
    channel = parse_qs(parts.query).get("channel", ["value"])[0]
    if where.lower() in OPEN:
        return 200, {"status": "ok"} | ({"service": "tidemark"} if where == "/" else {})
    if not key or not given or not hmac.compare_digest(given.encode(), key.encode()):
        return 401, {"error": "API key missing or wrong"}
    if where == "/runs":
        return 200, [{"run_id": r["run_id"], "source": r["source"], "started_at": str(r["started_at"])} for r in store.runs().collect()]
    routes: dict[str, Callable[..., Any]] = {
        r"/runs/(\d+)": lambda run: _summary(store, run),
        r"/runs/(\d+)/signals": lambda run: [r["signal_name"] for r in store.signal_names(run, channel).collect()],
        r"/runs/(\d+)/signals/([^/]+)": lambda run, name: _points(store.signal(run, unquote(name), channel)),
        r"/runs/(\d+)/stream": lambda run: _points(store.stream(run, channel)),
    }
    for pattern, f in routes.items():
        if m := re.fullmatch(pattern, where):
            run, *rest = m.groups()
            try:
                return 200, f(int(run), *rest)
            except KeyError:
                return 404, {"error": f"unknown run {run}"}
    return 404, {"error": "no such path"}


def _summary(store: RunStore, run: int) -> dict:
    """The run with its channels, signals, numbers of rows and first and last time."""
    r = store.summary(run).first()
    about = store.runs().where(f"run_id = {run}").first()
    held = r.asDict() if r is not None else {"stream_points": 0, "channels": [], "signals": [], "first_ts": None, "last_ts": None}
    times = {k: None if held[k] is None else str(held[k]) for k in ("first_ts", "last_ts")}
    return {"run_id": run, "source": about["source"], "started_at": str(about["started_at"]), "channels": held["channels"], "signals": held["signals"] or [], "stream_points": held["stream_points"], "signal_rows": store.signal_rows(run), **times}


def serve(store: RunStore, key: str | None, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready for ``serve_forever``; port 0 takes a free one."""
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = answer(store, self.path, key, self.headers.get("X-API-Key"))
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
