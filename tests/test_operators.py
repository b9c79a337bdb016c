"""Full text, vectors, retrieval, graph, entities, versions, provenance, streaming."""

import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom import queries
from factloom.config import ScoringWeights
from factloom.errors import StorageError
from factloom.functions import text
from factloom.operators import dictionary, fulltext, graph, provenance, resolution, retrieval, vector
from factloom.schema import OPS
from factloom.sources import version_log
from factloom.sources.oplog import OperationLog
from factloom.streaming import ingest


def corpus(spark):
    return spark.createDataFrame([(1, "the quick brown fox"), (2, "the lazy dog sleeps"), (3, "quick quick fox fox jumps")], "key long, text string")


def test_bm25(spark):
    found = [(r.key, round(r.score, 6)) for r in fulltext.search(corpus(spark), "quick fox", 5).collect()]
    assert found == [(3, 1.279591), (1, 0.973713)]
    stats, index = fulltext.corpus_stats(corpus(spark)), fulltext.postings(corpus(spark))
    assert sorted((r.key, round(r.score, 6)) for r in fulltext.bm25_postings(index, stats, "quick fox").collect()) == [(1, 0.973713), (3, 1.279591)]
    assert fulltext.bm25(corpus(spark), " ,").count() == 0 and fulltext.bm25(corpus(spark).limit(0), "fox").count() == 0
    one, two = (fulltext.bm25(corpus(spark), q).orderBy("key").collect() for q in ("fox", "fox fox"))
    assert [round(2 * a.score, 9) for a in one] == [round(b.score, 9) for b in two]


def test_reindex(spark):
    docs = spark.createDataFrame([(1, "apple banana"), (2, "pear")], "key long, text string")
    again = fulltext.reindex(docs, spark.createDataFrame([(1, "cherry"), (2, None)], "key long, text string"))
    assert fulltext.bm25(again, "apple").count() == 0 and fulltext.bm25(again, "cherry").count() == 1 and again.count() == 1


def test_names(spark):
    names = ["OpenAI, Inc.", "Open AI", "The Acme Corp", "", None, "!!"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    assert [r.f for r in rows.select("i", text.normalize_name(F.col("n")).alias("f")).orderBy("i").collect()] == ["openai", "open ai", "acme", "", "", ""]
    pairs = spark.createDataFrame([(3, "OpenAI Inc."), (1, "OpenAI"), (2, "Beijing")], "node_id long, name string")
    assert [tuple(r) for r in resolution.candidate_pairs(pairs, 0.9).collect()] == [(1, 3, 1.0)]
    assert resolution.candidates_of(pairs, 77).count() == 0
    with pytest.raises(ValueError):
        resolution.candidate_pairs(pairs, 0)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.9, 1.0])
def test_blocking_loses_no_pair(spark, threshold):
    draw = random.Random(3)
    names = [(i, " ".join(draw.choices("abcdefg", k=draw.randint(0, 5)))) for i in range(60)]
    want = set()
    for i, a in names:
        for j, b in names:
            x, y = set(a.split()), set(b.split())
            if i < j and x and y and (1.0 if a == b else len(x & y) / len(x | y)) >= threshold:
                want.add((i, j))
    rows = spark.createDataFrame(names, "node_id long, name string")
    assert {(r.lo, r.hi) for r in resolution.candidate_pairs(rows, threshold).collect()} == want
    groups = lambda pairs: {r.node: r.survivor for r in resolution.survivors(pairs).collect()}
    assert groups(resolution.candidate_pairs(rows, threshold)) == groups(resolution.resolution_links(rows, threshold))


def test_merge_keeps_untouched(spark):
    rows = [(1, 0, 5, 1, 9, 0), (2, 0, 3, 1, 9, 0), (3, 0, 3, 1, 9, 0), (256, 0, 5, 1, 8, 0)]
    facts = spark.createDataFrame(rows, "edge_id long, tenant long, subject_id long, predicate_id long, object_id long, valid_from long")
    labels = spark.createDataFrame([(3, 3), (5, 3)], "node long, survivor long")
    assert {r.edge_id for r in resolution.merge_facts(facts, labels).collect()} == {2, 3, 256}
    assert {r.edge_id for r in resolution.merge_facts(facts, labels, compat_scan_order=True).collect()} == {1, 2, 3, 256}
    nodes = spark.createDataFrame([(3, "a"), (5, "b")], "node_id long, name string")
    rest, alias = resolution.merge_names(nodes, labels)
    assert [tuple(r) for r in rest.collect()] == [(3, "a")] and [tuple(r) for r in alias.collect()] == [("b", 3)]
    assert resolution.merged_count(labels) == 1


@pytest.mark.parametrize("name", ["merge_facts", "merge_facts_scan_order"])
def test_merge_with_part_keys_in_the_brands_range(spark, tmp_path, name):
    """Part keys from 1,000,000 on once took the brands' ids for parts that gave way."""
    keys = [0, 1, 2, 255, 256, *range(1_000_000, 1_000_030)]
    rows = [(k, ("red bolt", "old ring")[k % 2], f"Brand#{k % 3 + 1}") for k in keys]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(queries.SQL[name]).fetchall()
    assert sorted(map(tuple, queries.SPARK[name](spark, str(tmp_path)).collect())) == sorted(want)


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, round(r.score, 6)) for r in vector.knn(rows, [1, 0], 2).collect()] == [(1, 1.0), (3, 0.993884)]
    assert vector.check_dimension(rows) == 2
    with pytest.raises(StorageError):
        vector.check_dimension(rows.union(spark.createDataFrame([(5, [1.0])], rows.schema)))


def edges_frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=40))
def test_components(spark, edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in graph.connected_components(edges_frame(spark, edges)).collect()}
    assert found == {x: root(x) for x in parent}


def test_incremental_and_levels(spark):
    labels = graph.connected_components(edges_frame(spark, [(1, 2), (3, 4)]))
    more = graph.extend_components(labels, edges_frame(spark, [(2, 3)]))
    assert [(r.id, list(r.members), r.level) for r in graph.communities(more).collect()] == [(1, [1, 2, 3, 4], 0)]
    assert graph.communities(more, 1).count() == 0


def test_context_and_budgets(spark):
    nodes = spark.createDataFrame([(i, "x") for i in range(1, 5)], "node_id long, name string")
    edges = spark.createDataFrame([(0, 1, 7, 2), (1, 3, 7, 4)], "pos long, subject_id long, predicate_id long, object_id long")
    kept, used = retrieval.greedy_budget(edges, nodes, 3)
    assert kept.count() == 1 and used.count() == 2
    named = spark.createDataFrame([(1, "Alice"), (2, "Shanghai")], "node_id long, name string")
    assert retrieval.serialize_edges(edges, named).first().text == "- Alice rel#7 Shanghai\n- ? rel#7 ?"
    assert retrieval.serialize_edges(edges.union(edges), named).first().text.count("Alice") == 1
    row = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 1.0)], "vector double, text double, structure double, recency double, validity double")
    assert round(row.select(retrieval.hybrid_score(ScoringWeights()).alias("s")).first().s, 6) == 3.6


def test_budget_is_a_prefix(spark):
    rows = [(i, 1.0, "w " * n, 0, 0) for i, n in ((5, 2), (4, 9), (3, 1))]
    ranked = spark.createDataFrame(rows, "edge_id long, score double, sentence string, doc long, chunk long")
    assert [r.edge_id for r in retrieval.within_budget(ranked, 4).collect()] == [5]
    assert retrieval.within_budget(ranked, 0).count() == 0


def test_dictionary(spark):
    ops = spark.createDataFrame([(2, "B", "p", "A"), (1, "A", "q", "C"), (3, "A", "p", "B")], "ingest_seq long, subject string, predicate string, object string")
    assert {r.name: r.node_id for r in dictionary.intern_nodes(ops).collect()} == {"A": 1, "C": 2, "B": 3}
    assert {r.name: r.predicate_id for r in dictionary.intern_predicates(ops).collect()} == {"q": 1, "p": 2}
    names = spark.createDataFrame([(1, "A")], "node_id long, name string")
    assert {tuple(r) for r in dictionary.put_names(names, spark.createDataFrame([(1, "Z"), (9, "N")], names.schema), "node_id").collect()} == {(1, "Z"), (9, "N")}
    numbered = dictionary.number_rows(spark.range(1000).select((-F.col("id")).alias("k")), "k", name="n", partitions=7)
    assert sorted((r.k, r.n) for r in numbered.collect()) == [(k, k + 1000) for k in range(-999, 1)]


def test_versions(spark, tmp_path):
    store = version_log.VersionStore(spark, f"file://{tmp_path}/kv", lambda: 77)
    first = store.begin()
    first.put(b"a1", b"x")
    first.put(b"b1", b"y")
    assert first.get(b"a1") == b"x" and first.commit() == 1 and first.tx_time == 77
    second = store.begin()
    second.put(b"a1", b"z")
    second.put(b"a2", b"w")
    second.delete(b"b1")
    assert [bytes(r.key) for r in second.scan_prefix(b"a").collect()] == [b"a1", b"a2"]
    old = store.begin()
    second.commit()
    assert old.get(b"a1") == b"x" and old.get(b"b1") == b"y" and store.begin().get(b"b1") is None
    assert [bytes(r.value) for r in version_log.scan_prefix(store.log(), 2, b"a").collect()] == [b"z", b"w"]
    assert version_log.prefix_end(b"a\xff") == b"b" and version_log.prefix_end(b"\xff") == b""


def test_access_and_provenance(spark):
    facts = spark.createDataFrame([(1, 0, "a", "b", 5, 1, None), (2, 0, "a", "c", 5, 2, 9)], "edge_id long, tenant long, subject string, object string, doc long, chunk long, tx_to long")
    acl = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c")], "principal string, node string")
    assert [r.edge_id for r in provenance.readable(facts, acl, "p").collect()] == [1]
    assert [r.retract_target for r in provenance.cascade_on_retract(facts, 5, 10).collect()] == [1]
    assert provenance.facts_from_chunk(facts, 5, 2).count() == 1 and tuple(provenance.provenance_of(facts, 2).first()) == (5, 2)


def test_streams(spark, tmp_path):
    rows = [(i, "upsert", i, 0, "s", "p", f"o{i}", i, i * 1000, 1, i, "unique" if i % 3 == 0 else "append", None, None) for i in range(1, 10)]
    spark.createDataFrame(rows, OPS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(OPS).parquet(f"{tmp_path}/in")
    log = OperationLog(spark, f"file://{tmp_path}/log")
    for _ in range(2):
        ingest.append_stream(stream, log, f"{tmp_path}/mark").awaitTermination()
    assert log.read().count() == 9
    out = ingest.closures(stream).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/mark2").start()
    out.awaitTermination()
    assert {r.edge_id: r.invalidated_by for r in spark.sql("select * from closed").collect()} == {1: 3, 2: 3, 3: 6, 4: 6, 5: 6, 6: 9, 7: 9, 8: 9}
    assert ingest.windowed_counts(stream).isStreaming


def test_pairs_above_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 7)
    draw = random.Random(5)
    rows = [(k, [draw.gauss(0, 1) for _ in range(draw.choice([3, 4]))]) for k in range(40)]
    rows += [(40, [0.0] * 4), (41, None), (42, [1.0, None, 2.0]), (43, [float("nan")] * 4), (44, [float("inf"), 1.0]), (45, []), (46, rows[0][1]), (None, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def cosine(a, b):
        length = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / length if length else 0.0

    whole = [r for r in rows if r[0] is not None and r[0] not in (41, 42, 43, 44)]
    for least in (0.6, -0.5):
        want = {(q, k): round(cosine(a, b), 9) for q, a in whole if q % 2 == 0 for k, b in whole if q != k and cosine(a, b) >= least}
        found = vector.pairs_above(table, table.filter("vec_id % 2 = 0"), least).collect()
        assert len(found) == len(want) and {(r["query"], r["vec_id"]): round(r["score"], 9) for r in found} == want
    assert vector.pairs_above(table.limit(0), table, 0.5).count() == 0
