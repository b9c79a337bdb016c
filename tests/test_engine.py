"""The engine and the service, end to end."""

import io
import itertools
import json
import threading

import pytest

from factloom.engine import Engine
from factloom.errors import NotFoundError, QueryError
from factloom.functions.temporal import AsOf
from factloom.http import Client, make_server
from factloom.service import Service, tenant_of


@pytest.fixture
def engine(spark, tmp_path):
    clock = itertools.count(1_000_000)
    return Engine(spark, f"file://{tmp_path}/store", lambda: next(clock))


ASK = 'MATCH (n) WHERE SIMILAR(n, "Alice lives") RETURN CONTEXT(cite = true)'


def test_current_and_historical(engine):
    assert [engine.add_memory("Alice", "lives_in", city, at, doc, 1) for city, at, doc in (("Beijing", 1000, 10), ("Shanghai", 2000, 20))] == [1, 2]
    now = engine.answer(ASK)
    assert now["text"] == "- Alice lives_in Shanghai" and [c["doc"] for c in now["citations"]] == [20]
    then = engine.answer('WHERE SIMILAR(n, "Alice") AS OF VALID TIME 1500 RETURN CONTEXT(cite = true)')
    assert then["text"] == "- Alice lives_in Beijing" and then["citations"][0]["doc"] == 10
    assert engine.answer("AS OF TRANSACTION TIME 1000000 RETURN CONTEXT()") == {"text": "", "citations": []}
    assert engine.facts().count() == 2
    engine.add_memory("Bob", "works_in", "Tokyo", 500, 30, 1, "append")
    cut = engine.answer("MATCH (n) TRAVERSE SEMANTIC(budget = 3 tokens) RETURN CONTEXT(cite = false)")
    assert cut == {"text": "- Bob works_in Tokyo", "citations": []}
    part = engine.retrieve(None, 100)
    assert not part.is_empty() and engine.retrieve("nothing", 100).is_empty()
    assert part.edges.count() == 2 and [r.name for r in part.nodes.orderBy("position").collect()] == ["Bob", "Tokyo", "Alice", "Shanghai"]
    engine.retract(3, 5)
    assert "Bob" not in engine.answer("MATCH (n) RETURN CONTEXT()")["text"]
    with pytest.raises(NotFoundError):
        engine.get_fact(99)


def test_tenants_and_reopening(engine, spark):
    engine.add_memory("Alice", "lives_in", "Beijing", 1000, 10, tenant=1)
    engine.add_memory("Alice", "lives_in", "Tokyo", 2000, 20, tenant=2)
    again = Engine(spark, engine.log.path, engine.clock)
    assert [again.as_of(AsOf.now(), t).count() for t in (0, 1, 2)] == [0, 1, 1]
    assert again.add_memory("Bob", "works_at", "Acme", 1000) == 3


def test_communities(engine):
    assert engine.communities().count() == 0
    engine.add_memory("Alice", "lives_in", "Beijing", 1000, policy="append")
    engine.add_memory("Bob", "lives_in", "Tokyo", 1000, policy="append")
    assert engine.communities().count() == 2
    engine.add_memory("Alice", "knows", "Bob", 1500, policy="append")
    (found,) = engine.communities().collect()
    assert found.summary == "Community of 4 entities (Alice, Beijing, Bob, Tokyo). Current facts: Alice lives_in Beijing; Bob lives_in Tokyo; Alice knows Bob"


def test_resolution(engine):
    engine.add_memory("OpenAI Inc.", "based_in", "SF", 1000)
    engine.add_memory("OpenAI", "hires", "Researchers", 1000)
    engine.add_memory("OpenAI", "based_in", "SF", 1000)
    dry = engine.resolve(0.9, dry_run=True)
    assert dry["merged"] == 0 and [(c["keep"], c["drop"], c["score"]) for c in dry["candidates"].collect()] == [(1, 3, 1.0)]
    assert engine.resolve(0.9)["merged"] == 1
    assert {(r.subject, r.object) for r in engine.facts().collect()} == {("OpenAI Inc.", "SF"), ("OpenAI Inc.", "Researchers")}
    engine.add_memory("OpenAI", "makes", "Tools", 2000)
    assert "- OpenAI Inc. makes Tools" in engine.answer("")["text"]
    assert engine.resolve(0.9)["merged"] == 0


def test_batch_ingest(engine, spark):
    rows = spark.createDataFrame([(i, 0, f"s{i % 3}", "p", f"o{i}", i, 1, i, "unique") for i in range(30)], "at long, tenant long, subject string, predicate string, object string, valid_from long, doc long, chunk long, policy string")
    engine.ingest(rows)
    assert engine.as_of().count() == 3 and engine.facts().count() == 30


def test_routes(engine):
    service = Service(engine)
    body = {"subject": "Alice", "predicate": "lives_in", "object": "Beijing", "valid_from": 1000, "doc": 10, "chunk": 1}
    assert service.handle("GET", "/healthz") == (200, "ok")
    assert service.handle("POST", "/v1/memory", body, {"X-Tenant-Id": "7"}) == (200, {"edge_id": 1})
    assert service.handle("POST", "/v1/search", {"query": ASK}) == (200, {"text": "", "citations": []})
    assert "Beijing" in service.handle("POST", "/v1/search", {"query": ASK}, {"x-tenant-id": "7"})[1]["text"]
    assert service.handle("POST", "/v1/search", {"query": "MATCH ( <bad"})[0] == 400
    assert service.handle("GET", "/v1/communities", None, {"x-tenant-id": "7"})[1]["communities"][0]["members"] == ["Alice", "Beijing"]
    assert service.handle("POST", "/v1/resolve", {"threshold": 0.9, "dry_run": True})[1] == {"merged": 0, "candidates": []}
    assert service.handle("POST", "/v1/memory", {})[0] == 422 and service.handle("GET", "/nowhere")[0] == 404
    assert [tenant_of(h) for h in ({}, {"X-Tenant-Id": "x"}, {"X-TENANT-ID": "12"})] == [0, 0, 12]


def test_tools(engine):
    service = Service(engine)
    call = lambda name, **args: service.rpc({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": args}})
    text = lambda response: response["result"]["content"][0]["text"]
    assert [t["name"] for t in service.rpc({"id": 1, "method": "tools/list"})["result"]["tools"]] == ["add_memory", "search_memory", "list_communities", "resolve_entities"]
    assert text(call("list_communities")) == "no communities yet"
    assert text(call("add_memory", subject="Alice", predicate="lives_in", object="Shanghai")) == "ingested fact as edge 1"
    assert "Shanghai" in text(call("search_memory", query=ASK))
    assert "Alice" in text(call("list_communities"))
    assert text(call("resolve_entities")) == "merged 0 entities"
    assert call("add_memory", subject="x")["error"]["code"] == -32602
    assert call("nothing")["error"]["code"] == -32602
    assert service.rpc({"id": 2, "method": "what"})["error"]["code"] == -32601
    out = io.StringIO()
    service.serve(io.StringIO('{"id": 1, "method": "initialize"}\n\nnot json\n'), out)
    assert [("result" in a, a.get("error", {}).get("code")) for a in map(json.loads, out.getvalue().splitlines())] == [(True, None), (False, -32700)]


def test_http(engine):
    server = make_server(Service(engine), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        client = Client(url, tenant=3)
        assert client.healthy() and client.add_memory("Alice", "lives_in", "Beijing", 1000, 10, 1) == 1
        assert "Beijing" in client.search(ASK)["text"] and Client(url).search(ASK)["text"] == ""
        assert len(client.communities()) == 1 and client.resolve(0.9, dry_run=True)["merged"] == 0
        with pytest.raises(QueryError):
            client.search("MATCH ( <bad")
        with pytest.raises(NotFoundError):
            client._call("GET", "/nowhere")
    finally:
        server.shutdown()
        server.server_close()
