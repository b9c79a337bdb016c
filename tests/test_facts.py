"""Spans against a step-by-step model, points in time, overlaps."""

import random

import pytest

from factloom.functions.temporal import AsOf, active_at, as_of
from factloom.operators import facts
from factloom.schema import OPS


def model(ops):
    """The store, one operation after the other."""
    known = {}
    for op in ops:
        if op["op"] == "retract":
            if op["retract_target"] in known:
                known[op["retract_target"]]["tx_to"] = op["tx_time"]
            continue
        if op["policy"] == "unique":
            for f in known.values():
                if f["key"] == (op["tenant"], op["subject"], op["predicate"]) and f["valid_to"] is None and f["tx_to"] is None:
                    f["valid_to"] = op["valid_from"]
        known[op["edge_id"]] = {"key": (op["tenant"], op["subject"], op["predicate"]), "valid_from": op["valid_from"], "valid_to": None, "tx_from": op["tx_time"], "tx_to": None}
    return {e: (f["valid_from"], f["valid_to"], f["tx_from"], f["tx_to"]) for e, f in known.items()}


def upsert(seq, edge, valid_from, policy="unique", subject="A", tenant=0, tx=None, obj="x", predicate="p"):
    return {"ingest_seq": seq, "op": "upsert", "edge_id": edge, "tenant": tenant, "subject": subject, "predicate": predicate, "object": obj, "valid_from": valid_from, "tx_time": seq * 10 if tx is None else tx, "policy": policy}


def retract(seq, target, at):
    return {"ingest_seq": seq, "op": "retract", "retract_target": target, "tx_time": at}


def frame(spark, ops):
    return spark.createDataFrame([tuple(o.get(f.name) for f in OPS) for o in ops], OPS)


def spans(spark, ops, **options):
    return {r.edge_id: (r.valid_from, r.valid_to, r.tx_from, r.tx_to) for r in facts.spans(frame(spark, ops), **options).collect()}


def test_moved_cities(spark):
    ops = [upsert(1, 1, 1000), upsert(2, 2, 2000)]
    found = facts.spans(frame(spark, ops))
    assert {r.edge_id: r.valid_to for r in found.collect()} == {1: 2000, 2: None}
    ids = lambda at: [r.edge_id for r in as_of(found, at).collect()]
    assert [r.edge_id for r in active_at(found, AsOf.valid(1500)).collect()] == [1]
    assert ids(AsOf.now()) == [2] and ids(AsOf.valid(1500)) == [1] and ids(AsOf.transaction(15)) == []


def test_mixed_policies_and_late(spark):
    ops = [upsert(1, 1, 10, "append"), upsert(2, 2, 20), upsert(3, 3, 30, "append"), upsert(4, 4, 5)]
    assert {e: s[1] for e, s in spans(spark, ops).items()} == {1: 20, 2: 5, 3: 5, 4: None}


def test_retract(spark):
    found = facts.spans(frame(spark, [upsert(1, 1, 10, "append"), retract(2, 1, 11)]))
    assert as_of(found, AsOf.now()).count() == 0 and as_of(found, AsOf.transaction(10)).count() == 1


@pytest.mark.parametrize("width", [1, 40, 10**9])
def test_against_model(spark, width):
    """Random logs, with time ranges from one operation to all of them."""
    draw = random.Random(width)
    ops, edge = [], 0
    for seq in range(1, 400):
        if edge and draw.random() < 0.2:
            ops.append(retract(seq, draw.randint(1, edge), draw.randint(0, 9999)))
        else:
            edge += 1
            ops.append(upsert(seq, edge, draw.randint(0, 500), draw.choice(["unique", "append", "semantic"]), draw.choice("ABC"), draw.randint(0, 1)))
    upserts = frame(spark, ops).filter("op = 'upsert'").drop("op", "retract_target")
    assert facts.next_unique(upserts, width=width).count() == edge
    assert spans(spark, ops) == model(ops)
    near = {r.edge_id: r.closer and r.closer.edge_id for r in facts.next_unique(upserts, width=width).collect()}
    far = {r.edge_id: r.closer and r.closer.edge_id for r in facts.next_unique(upserts, width=10**9).collect()}
    assert near == far


def test_clock_that_steps_back(spark):
    ops = [upsert(seq, seq, 10 * (seq - 1), tx=day * 86_400_000) for seq, day in enumerate((5, 5, 2, 8, 9, 10), 1)]
    assert {e: s[1] for e, s in spans(spark, ops).items()} == {1: 10, 2: 20, 3: 30, 4: 40, 5: 50, 6: None}
    assert spans(spark, ops) == model(ops)


def test_bulk_load_of_one_key(spark, monkeypatch):
    monkeypatch.setitem(facts.RANGES, "ingest_seq", 7)
    ops = [upsert(seq, seq, (seq * 37) % 50, "unique" if seq % 3 else "append", tx=99) for seq in range(1, 60)]
    assert spans(spark, ops) == model(ops)


def test_overlaps_against_every_pair(spark):
    draw = random.Random(8)
    day, rows = 86_400_000, []
    for edge in range(1, 160):
        start = draw.randint(-50, 4000) * day // draw.choice([1, 7])
        end = None if draw.random() < 0.2 else start + draw.choice([-day, 0, 1, day, 40 * day, 2000 * day, 90_000 * day])
        rows.append((0, draw.choice("ab"), "p", edge, start, end))
    top = 2**63 - 1
    want = {(x[3], y[3]) for x in rows for y in rows if x[1] == y[1] and x[3] < y[3] and x[4] < (top if y[5] is None else y[5]) and y[4] < (top if x[5] is None else x[5])}
    found = spark.createDataFrame(rows, "tenant long, subject string, predicate string, edge_id long, valid_from long, valid_to long")
    pairs = [(r.a, r.b) for r in facts.overlapping_pairs(found).collect()]
    assert set(pairs) == want and len(pairs) == len(want)


def test_overlaps(spark):
    rows = [(1, 0, 100), (2, 50, 150), (3, 100, 200), (4, 120, None), (5, 500, None)]
    found = spark.createDataFrame([(0, "s", "p", *r) for r in rows], "tenant long, subject string, predicate string, edge_id long, valid_from long, valid_to long")
    assert {(r.a, r.b) for r in facts.overlapping_pairs(found).collect()} == {(1, 2), (2, 3), (2, 4), (3, 4), (4, 5)}


def test_batch_invalidation(spark):
    now = facts.spans(frame(spark, [upsert(1, 1, 10, "append"), upsert(2, 2, 20, "append", "B")]))
    new = frame(spark, [upsert(3, 3, 30)])
    assert [tuple(r) for r in facts.facts_to_invalidate(new, now).collect()] == [(1, 3, 30)]


def test_empty(spark):
    assert spans(spark, []) == {}
