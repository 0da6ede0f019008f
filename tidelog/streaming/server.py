"""HTTP beside a running connector: health, status, metrics, signals, and a listener that lands documents."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from .runtime import Connector
from .signal_queue import SignalQueue

#: Paths of the management interface.
LIVE, READY, STATUS, STOP, SIGNALS, METRICS = "/health/live", "/health/ready", "/v1/connector/status", "/v1/connector/stop", "/v1/connector/signals", "/metrics"
#: A document is refused beyond this.
MAX_BODY = 16 << 20
Answer = tuple[int, object]


class Server:
    """Routes by (method, path): each takes the body and the headers and gives a status with a JSON object, a text, or nothing."""

    def __init__(self, routes: dict[tuple[str, str], Callable[[bytes, dict], Answer]], host: str = "127.0.0.1", port: int = 0, max_body: int = MAX_BODY):
        class Handler(BaseHTTPRequestHandler):
            def answer(self) -> None:
                size = int(self.headers.get("Content-Length") or 0)
                route = routes.get((self.command, self.path.partition("?")[0]))
                if size > max_body:
                    status, body = 413, {"error": "the body is too large"}
                    self.close_connection = True
                elif route is None:
                    status, body = (405 if any(p == self.path for _, p in routes) else 404), {"error": "no such resource"}
                else:
                    try:
                        status, body = route(self.rfile.read(size), {k.lower(): v for k, v in self.headers.items()})
                    except (ValueError, KeyError, TypeError) as e:
                        status, body = 400, {"error": str(e)}
                data = b"" if body is None else body.encode() if isinstance(body, str) else json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Type", "text/plain; version=0.0.4" if isinstance(body, str) else "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = answer

            def log_message(self, *_) -> None:
                pass

        self.http = ThreadingHTTPServer((host, port), Handler)
        self.http.daemon_threads = True

    @property
    def port(self) -> int:
        return self.http.server_address[1]

    def __enter__(self) -> Server:
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self.http.shutdown()
        self.http.server_close()


def management(connector: Connector, stop: Callable[[], None], signals: SignalQueue | None = None, mutations: bool = False, timeout_s: float = 30, **at) -> Server:
    """Stopping and signals change things, so they are refused unless ``mutations``. A signal is answered when its effect is stored."""

    def ready(*_) -> Answer:
        ok = connector.status.state in ("snapshotting", "streaming")
        return 200 if ok else 503, {"ready": ok, "state": connector.status.state}

    def stop_it(*_) -> Answer:
        if not mutations:
            return 403, {"error": "changes are not enabled"}
        threading.Thread(target=stop, daemon=True).start()
        return 202, {"status": "stopping"}

    def signal(body: bytes, _: dict) -> Answer:
        if not mutations or signals is None:
            return 403, {"error": "signals are not enabled"}
        s = json.loads(body)
        if not str(s.get("id") or "").strip() or not str(s.get("type") or "").strip():
            raise ValueError("a signal has an id and a type")
        data = s.get("data", {})
        stored = signals.send_and_wait(str(s["id"]), str(s["type"]), data if isinstance(data, str) else json.dumps(data), timeout_s)
        return (202, {"id": s["id"], "stored": True}) if stored else (504, {"id": s["id"], "stored": False})

    routes = {
        ("GET", LIVE): lambda *_: (200, {"status": "live"}),
        ("GET", READY): ready,
        ("GET", STATUS): lambda *_: (200, asdict(connector.status) | {"connector": connector.name, "source_lag_ms": connector.status.lag_ms()}),
        ("GET", METRICS): lambda *_: (200, connector.status.metrics(connector.name)),
        ("POST", STOP): stop_it,
        ("POST", SIGNALS): signal,
    }
    return Server(routes, **at)


def listener(landing: str, token: str = "", path: str = "/", **at) -> Server:
    """Lands posted documents (one, or an array of them) as a file of lines; 204 once they are on disk.

    A file is written aside and renamed, so the stream sees whole files. A document with the id of the one before
    it (the ``x-record-id`` header, or a hash) is a repeat and is not landed again.
    """
    folder, lock, last = Path(landing), threading.Lock(), [""]
    folder.mkdir(parents=True, exist_ok=True)

    def take(body: bytes, headers: dict) -> Answer:
        if token and not hmac.compare_digest(headers.get("authorization", ""), f"Bearer {token}"):
            return 401, {"error": "not authorized"}
        found = json.loads(body)
        documents = found if isinstance(found, list) else [found]
        if not all(isinstance(d, dict) for d in documents):
            raise ValueError("a document is an object")
        own = headers.get("x-record-id") if len(documents) == 1 else None
        with lock:
            lines = []
            for d in documents:
                line = json.dumps(d, ensure_ascii=False, separators=(",", ":"))
                number = own or hashlib.sha256(line.encode()).hexdigest()
                if number != last[0]:
                    lines.append(line)
                last[0] = number
            if lines:
                name = f"{uuid.uuid4().hex}.json"
                part = folder / f".{name}.part"
                with part.open("w") as f:
                    f.write("\n".join(lines) + "\n")
                    f.flush()
                    os.fsync(f.fileno())
                os.replace(part, folder / name)
        return 204, None

    return Server({("POST", path): take}, **at)
