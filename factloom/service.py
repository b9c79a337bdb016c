"""Request handling over an engine: REST-like routes and JSON-RPC tools, independent of any transport."""

from __future__ import annotations

import json
from typing import IO

from factloom.engine import Engine
from factloom.errors import EngineError
from factloom.schema import APPEND, DEFAULT_TENANT, UNIQUE

# Fixed values of the JSON-RPC protocol.
PARSE_ERROR, METHOD_NOT_FOUND, INVALID_PARAMS = -32700, -32601, -32602
PROTOCOL_VERSION = "2024-11-05"

#: Tool names with their arguments: (name, JSON type, required).
TOOLS = {
    "add_memory": [("subject", "string", True), ("predicate", "string", True), ("object", "string", True), ("valid_from", "integer", False), ("doc", "integer", False), ("chunk", "integer", False)],
    "search_memory": [("query", "string", True)],
    "list_communities": [],
    "resolve_entities": [("threshold", "number", False)],
}


def tenant_of(headers: dict[str, str]) -> int:
    """The tenant of a request; a missing or malformed header means the default tenant."""
    value = next((v for k, v in headers.items() if k.lower() == "x-tenant-id"), "")
    return int(value) if value.isascii() and value.isdigit() and int(value) < 1 << 64 else DEFAULT_TENANT


class Service:
    def __init__(self, engine: Engine):
        self.engine = engine

    def handle(self, method: str, path: str, body: dict | None = None, headers: dict[str, str] | None = None) -> tuple[int, object]:
        """(status, answer) of a request."""
        routes = {("GET", "/healthz"): self._health, ("POST", "/v1/memory"): self._memory, ("POST", "/v1/search"): self._search, ("GET", "/v1/communities"): self._communities, ("POST", "/v1/resolve"): self._resolve}
        route = routes.get((method.upper(), path))
        if not route:
            return 404, {"error": f"no such route: {method} {path}"}
        try:
            return 200, route(body or {}, tenant_of(headers or {}))
        except EngineError as error:
            return error.status, {"error": str(error)}
        except (KeyError, TypeError, ValueError) as error:
            return 422, {"error": f"bad request: {error!r}"}

    def _health(self, body: dict, tenant: int) -> str:
        return "ok"

    def _memory(self, body: dict, tenant: int) -> dict:
        policy = APPEND if body.get("policy") == "append" else UNIQUE
        edge = self.engine.add_memory(body["subject"], body["predicate"], body["object"], body["valid_from"], body["doc"], body["chunk"], policy, tenant)
        return {"edge_id": edge}

    def _search(self, body: dict, tenant: int) -> dict:
        return self.engine.answer(body["query"], tenant)

    def _communities(self, body: dict, tenant: int) -> dict:
        return {"communities": [r.asDict() for r in self.engine.communities(tenant).collect()]}

    def _resolve(self, body: dict, tenant: int) -> dict:
        found = self.engine.resolve(float(body["threshold"]), bool(body.get("dry_run", False)), tenant)
        return found | {"candidates": [r.asDict() for r in found["candidates"].collect()]}

    # -- JSON-RPC

    def rpc(self, request: dict) -> dict:
        """The response to one JSON-RPC 2.0 request."""
        request = request if isinstance(request, dict) else {}
        head = {"jsonrpc": "2.0", "id": request.get("id")}
        method = request.get("method", "")
        if method == "initialize":
            return head | {"result": {"protocolVersion": PROTOCOL_VERSION, "serverInfo": {"name": "factloom", "version": "0.1.0"}, "capabilities": {"tools": {}}}}
        if method == "tools/list":
            return head | {"result": {"tools": [_descriptor(name, args) for name, args in TOOLS.items()]}}
        if method != "tools/call":
            return head | {"error": {"code": METHOD_NOT_FOUND, "message": f"method not found: {method}"}}
        params = request.get("params") or {}
        try:
            text = self._tool(params.get("name", ""), params.get("arguments") or {})
        except (EngineError, ValueError) as error:
            return head | {"error": {"code": INVALID_PARAMS, "message": str(error)}}
        return head | {"result": {"content": [{"type": "text", "text": text}]}}

    def _tool(self, name: str, args: dict) -> str:
        if name not in TOOLS:
            raise ValueError(f"unknown tool: {name}")
        for arg, kind, required in TOOLS[name]:
            if required and not isinstance(args.get(arg), str):
                raise ValueError(f"missing {arg!r}")
        if name == "add_memory":
            numbers = {k: args[k] if isinstance(args.get(k), int) else 0 for k in ("valid_from", "doc", "chunk")}
            return f"ingested fact as edge {self.engine.add_memory(args['subject'], args['predicate'], args['object'], **numbers)}"
        if name == "search_memory":
            return self.engine.answer(args["query"])["text"]
        if name == "list_communities":
            return "\n".join(r["summary"] for r in self.engine.communities().collect()) or "no communities yet"
        threshold = args.get("threshold")
        merged = self.engine.resolve(float(threshold) if isinstance(threshold, (int, float)) else 0.9)["merged"]
        return f"merged {merged} entities"

    def serve(self, lines: IO[str], out: IO[str]) -> None:
        """Answer one JSON object per line until the input ends."""
        for line in lines:
            if line.strip():
                try:
                    answer = self.rpc(json.loads(line))
                except json.JSONDecodeError as error:
                    answer = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": f"parse error: {error}"}}
                out.write(json.dumps(answer, ensure_ascii=False) + "\n")
                out.flush()


def _descriptor(name: str, args: list[tuple[str, str, bool]]) -> dict:
    schema = {"type": "object", "properties": {a: {"type": kind} for a, kind, _ in args}}
    required = [a for a, _, needed in args if needed]
    return {"name": name, "description": name.replace("_", " "), "inputSchema": schema | ({"required": required} if required else {})}
