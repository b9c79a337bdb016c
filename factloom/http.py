"""A small HTTP server over the service, and a client for it: standard library only."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from urllib import error, request

from factloom.errors import EngineError, NotFoundError, QueryError
from factloom.service import Service


def make_server(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server for the service's routes; requests write the log one at a time."""
    lock = Lock()

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
            except json.JSONDecodeError as problem:
                status, answer = 400, {"error": f"parse error: {problem}"}
            else:
                with lock:
                    status, answer = service.handle(self.command, self.path, body, dict(self.headers))
            plain = isinstance(answer, str)
            data = (answer if plain else json.dumps(answer, ensure_ascii=False)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain" if plain else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


class Client:
    """Calls a server; errors come back as the engine's."""

    def __init__(self, url: str, tenant: int | None = None, timeout: float = 600):
        self.url, self.tenant, self.timeout = url.rstrip("/"), tenant, timeout

    def _call(self, method: str, path: str, body: dict | None = None):
        headers = {"Content-Type": "application/json"} | ({"X-Tenant-Id": str(self.tenant)} if self.tenant is not None else {})
        call = request.Request(self.url + path, None if body is None else json.dumps(body).encode(), headers, method=method)
        try:
            with request.urlopen(call, timeout=self.timeout) as answer:
                data = answer.read().decode()
                return json.loads(data) if "json" in answer.headers["Content-Type"] else data
        except error.HTTPError as problem:
            kind = {400: QueryError, 404: NotFoundError}.get(problem.code, EngineError)
            raise kind(problem.read().decode()) from None

    def healthy(self) -> bool:
        return self._call("GET", "/healthz") == "ok"

    def add_memory(self, subject: str, predicate: str, obj: str, valid_from: int, doc: int = 0, chunk: int = 0, policy: str = "unique") -> int:
        body = {"subject": subject, "predicate": predicate, "object": obj, "valid_from": valid_from, "doc": doc, "chunk": chunk, "policy": policy}
        return self._call("POST", "/v1/memory", body)["edge_id"]

    def search(self, query: str) -> dict:
        return self._call("POST", "/v1/search", {"query": query})

    def communities(self) -> list[dict]:
        return self._call("GET", "/v1/communities")["communities"]

    def resolve(self, threshold: float, dry_run: bool = False) -> dict:
        return self._call("POST", "/v1/resolve", {"threshold": threshold, "dry_run": dry_run})
