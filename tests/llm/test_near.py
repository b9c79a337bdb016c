"""Near duplicates of documents, lines and embeddings against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import components, embeddings, lines, minhash, near


def groups(items, alike):
    """Smallest item of each group that links connect."""
    parent = {x: x for x in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(items)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if alike(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in items}


def plain_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def alike_sets(x, y, percent):
    return bool(x and y) and 100 * len(x & y) >= percent * len(x | y)


def corpus(seed, size=120):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "one", "one two", "ONE  two", "one two one", "É à", "é à", "x\x0by"]
    base = [draw.choices(vocabulary, k=60) for _ in range(6)]
    while len(texts) < size:
        words = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 6])):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        texts.append(" ".join(words) if draw.random() < 0.9 else " ".join(draw.choices(vocabulary, k=2000)))
    return dict(enumerate(texts, 10))


@pytest.mark.parametrize("words,percent,small", [(3, 85, 32), (5, 80, 32), (3, 85, 2)])
def test_documents(spark, monkeypatch, words, percent, small):
    monkeypatch.setattr(near, "SMALL", small)  # 2: nearly every bucket goes the way of large ones
    monkeypatch.setattr(near, "BLOCK", 5)
    texts = corpus(words + percent)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()] + [(None, texts[30], "x", 1)], "doc_id long, text string, node string, n int")
    sets = {k: plain_set(t, words) for k, t in texts.items()}
    want = groups(sets, lambda a, b: alike_sets(sets[a], sets[b], percent))
    rows = minhash.near_duplicates(docs, words, percent).collect()
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert found.pop(None)[1:] == (None, True) and len(rows) == len(texts) + 1
    assert found == {k: (len(sets[k]), want[k], want[k] == k) for k in texts}
    assert len(set(want.values())) < len(texts) - 20


def test_no_documents(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate():
    hashes = 128
    a, b = np.arange(1000, dtype=np.uint64), np.arange(100, 1100, dtype=np.uint64)
    values = near.mix(np.concatenate([a, b]))
    least = minhash.minima(values, np.array([0, 1000, 2000]), hashes)
    bits = near.pack_bits(least)
    x = bits[0] ^ bits[1]
    apart = int(np.bitwise_count((x >> np.uint64(1) | x) & np.uint64(0x5555555555555555)).sum())
    assert abs(near.estimate(apart, hashes) - 900 / 1100) < 0.15 and near.estimate(0, hashes) == 1


def test_minima_over_parts():
    draw = np.random.default_rng(3)
    values = draw.integers(0, 2**63, 40_000).astype(np.uint64)
    edges = np.array([0, 5, 20_000, 39_999, 40_000])
    factors, summands = near.hash_parameters(4)
    want = [[(values[a:b] * f + s).min() for f, s in zip(factors, summands)] for a, b in zip(edges, edges[1:])]
    assert (minhash.minima(values, edges, 4) == np.array(want)).all()


def test_intersections_and_spanning():
    draw = random.Random(2)
    sets = [np.unique(np.array(draw.choices(range(60), k=draw.randint(0, 30)), np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets[:7]] for a in sets]
    assert near.intersections(sets, sets[:7]).astype(int).tolist() == want
    linked = np.array([[draw.random() < 0.08 for _ in range(15)] for _ in range(15)])
    full = groups([*range(30)], lambda a, b: (a < 15 <= b and linked[a, b - 15]))
    few = {(i, j + 15) for i, j in near.spanning(linked)}
    assert groups([*range(30)], lambda a, b: (a, b) in few) == full and len(few) < 30


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    want = groups({x for e in edges for x in e}, lambda a, b: (a, b) in edges or (b, a) in edges)
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame([*edges, (7, 7), (None, 3)], "a long, b long")).collect()}
    assert found == {x: c for x, c in want.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    draw = random.Random(14)
    edges = [(draw.randrange(-200, 200), draw.randrange(-200, 200)) for _ in range(150)]
    want = groups({x for e in edges for x in e}, lambda a, b: (a, b) in edges or (b, a) in edges)
    want = {x: c for x, c in want.items() if any(x in e and e[0] != e[1] for e in edges)}
    rows = spark.createDataFrame(edges, "a long, b long").repartition(5)
    found = lambda: {r.node: r.component for r in components.connected_components(rows).collect()}
    monkeypatch.setattr(components, "TASK_EDGES", 7)
    assert found() == want
    monkeypatch.setattr(components, "TASK_EDGES", 1000)
    monkeypatch.setattr(components, "_star", None)
    assert found() == want and components.connected_components(rows.limit(0)).count() == 0


def test_band_keys_travel_in_six_bytes():
    keys = np.sort(near.band_keys(np.random.default_rng(15).integers(0, 1 << 63, (5000, 20)).astype(np.uint64), 4).ravel())
    assert len(np.unique(keys)) == 20000
    dealt = near._by_byte(keys, np.array([0, 20000]))
    assert len(pa.compress(dealt.buffers()[2], codec="lz4_raw", asbytes=True)) < 5.5 * len(keys)
    back, counts = near._from_bytes(dealt)
    assert back.tolist() == keys.tolist() and counts.tolist() == [20000]


def test_texts_are_taken_from_the_files_of_features(spark, monkeypatch):
    """Texts of documents that share a bucket with no other once were dealt out to find the others."""
    rows = [(i, f"{'same words ' * 3}{i % 40} " + " ".join(f"w{i % 40}x{k}" for k in range(30)), i) for i in range(80)] + [(None, "no id at all", 0), (90, None, 0), (91, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int").repartition(3)
    plans, plain = [], near.materialize

    def spied(df, name, *a, **k):
        if name == "texts":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name, *a, **k)

    monkeypatch.setattr(near, "materialize", spied)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=3, percent=50).collect()}
    assert found == {None: None, 90: 90, 91: 91} | {i: i % 40 for i in range(80)}
    assert plans and not any("Join" in p for p in plans)
    table = minhash.features(docs, 3, 50)
    wanted = table.filter("node % 3 = 0").select("node", "unit")
    assert {r.node: r.text for r in near.taken(table, wanted.union(wanted), "text").collect()} == {i: t for i, t, _ in rows if i is not None and i % 3 == 0}


def test_verification_looks_texts_up_in_their_files(spark, monkeypatch):
    """Joins with the written texts once dealt out all of them, as soon as they were too many to broadcast."""
    draw = random.Random(16)
    words = [[f"w{k}x{draw.random()}" for k in range(40)] for _ in range(4)]
    texts = {i: " ".join([*words[i % 4][:-1], f"own{i % 90}"]) for i in range(240)} | {300 + i: " ".join(words[i % 4][: 22 + i % 18]) for i in range(40)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    plans, plain = {}, near.materialize

    def spied(df, name, *a, **k):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name, *a, **k)

    monkeypatch.setattr(near, "materialize", spied)
    monkeypatch.setattr(near, "SMALL", 8)
    monkeypatch.setattr(near, "BLOCK", 7)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=3, percent=85).collect()}
    sets = {k: plain_set(t, 3) for k, t in texts.items()}
    assert found == groups(sets, lambda a, b: alike_sets(sets[a], sets[b], 85))
    assert len(plans["tested"]) == 2 and len(plans["blocks"]) == 1
    assert not [p for name in ("tested", "blocks") for p in plans[name] if re.search(r"FileScan parquet \[[^\]]*text#", p)]


@pytest.mark.parametrize("most,held", [(1 << 18, 1 << 20), (3, 1 << 20), (1 << 18, 10)])
def test_rows_take_the_text_of_their_node(spark, monkeypatch, most, held):
    texts = {i: None if i == 9 else "" if i == 12 else f"text {i} " * (i % 5 + 1) for i in range(40)}
    table = near.materialize(spark.createDataFrame([*texts.items(), (None, "no node")], "node long, text string").coalesce(1), "some")
    (path,) = table.inputFiles()
    monkeypatch.setattr(near, "TAKEN", most)
    monkeypatch.setattr(near, "HELD", held)
    rows = [(0, i * 7 % 20 + 3, i) for i in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 8]), (pa.int32(), pa.int64(), pa.int32()))], names=["unit", "node", "at"]) for k in range(0, 50, 8)]
    made = [*near._take({0: path}, "text")(batches)]
    assert sorted((a, n, t) for b in made for n, a, t in zip(*(c.to_pylist() for c in b.columns))) == [(a, n, texts[n]) for _, n, a in rows]
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(2).to_pylist()) <= held for b in made)
    assert len(made) > 1 or most > 3 and held > 10


def test_lines(spark):
    draw = random.Random(5)
    base = ["The quick brown fox jumps over the lazy dog near the river bank at noon", "Zu und die aus der ganzen Stadt kommen heute alle Leute hier an", "short", "tiny"]
    texts = {1: None, 2: "", 3: "\n \n"}
    for k in range(4, 40):
        own = []
        for _ in range(draw.randint(1, 5)):
            line = draw.choice([*base, f"unique {draw.random()} line {draw.random()}"])
            if draw.random() < 0.4 and len(line) > 20:
                at = draw.randrange(len(line))
                line = line[:at] + "X" + line[at + 1 :]
            own.append(draw.choice(["", "  "]) + (line.upper() if draw.random() < 0.1 else line))
        texts[k] = "\n".join([*own, "", draw.choice(own)])
    rows = [(k, t, "z", k) for k, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, node int")
    places, sets = {}, {}
    for k, t in texts.items():
        for i, line in enumerate((t or "").split("\n")):
            form = lines.normal_line(line)
            if form:
                places.setdefault(form, []).append((k, i))
                sets[form] = frozenset(lines.line_sets([form])[0].tolist())
    of = groups(sets, lambda a, b: alike_sets(sets[a], sets[b], lines.PERCENT))
    first = {}
    for form, where in places.items():
        first[of[form]] = min([*where, *([first[of[form]]] if of[form] in first else [])])
    keep = set(first.values())
    for r in lines.dedup_lines(docs).collect():
        parts = (texts[r.doc_id] or "").split("\n")
        some = [i for i, p in enumerate(parts) if lines.normal_line(p)]
        want = "\n".join(p for i, p in enumerate(parts) if i not in some or (r.doc_id, i) in keep)
        assert (r.text or "") == want and r.n_removed == len([i for i in some if (r.doc_id, i) not in keep])
        assert (r.text is None) == (texts[r.doc_id] is None) and r.gone == "z"
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_long_document_of_lines(spark):
    text = "\n".join(f"row {i % 50} of a table with values" for i in range(20_000))
    (row,) = lines.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.n_removed == 20_000 - len(row.text.split("\n")) >= 19_950


def test_short_lines_are_not_left_out_by_an_estimate(spark):
    draw = random.Random(11)
    base = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.choice([12, 13, 16, 20]))) for _ in range(1500)]
    pairs = [(line, line + draw.choice("0123456789")) for line in base]
    sets = [[frozenset(s.tolist()) for s in lines.line_sets([lines.normal_line(x) for x in p])] for p in pairs]
    assert all(alike_sets(a, b, lines.PERCENT) for a, b in sets)
    rows = [(2 * k + i, x) for k, p in enumerate(pairs) for i, x in enumerate(p)]
    found = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k, n in found.items() if n != k % 2] == []


def test_one_changed_character_of_a_line(spark):
    draw = random.Random(12)
    letters, pairs = "abcdefghijklmnopqrstuvwxyz     ", []
    for size in range(40, 123):
        for alphabet, new in ((letters, "7"), ("äöü" + letters, "ß"), ("的一是不了人我在有他这为之大来以个中上们", "新")):
            line = "x" + "".join(draw.choices(alphabet, k=size - 2)) + "x"
            at = draw.randrange(size)
            pairs.append((line, line[:at] + new + line[at + 1 :]))
    rows = [(2 * k + i, x) for k, p in enumerate(pairs) for i, x in enumerate(p)]
    found = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k, n in found.items() if n != k % 2] == []


def test_lines_of_a_block_have_the_sets_of_lines_alone(spark):
    draw = random.Random(13)
    texts = ["".join(draw.choices("abc äß的\U0001f600", k=n)).strip() + "." for n in (1, 2, 5, 30, 95, 96, 119, 120, 121, 300)]
    rows = lines.occurrences(spark.createDataFrame([(1, "\n".join(texts)), (2, "plain ascii " * 9)], "doc_id long, text string")).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        form = lines.normal_line(texts[r.line_no] if r.doc_id == 1 else "plain ascii " * 9)
        assert bytes(r.form) == form
        for kind in lines.KINDS:
            n = len(form.decode())
            (own,) = lines.line_sets([form], kind.size)
            keys = near.band_keys(lines.signatures(kind, own, np.array([0, len(own)])), kind.bands, kind.rows)
            compared = kind.least <= n <= (kind.most or n)
            found = r[f"bands{kind.size}"]
            assert (found is None) == (not compared) and (not compared or bytes(found) == keys.tobytes())
            assert r[f"n{kind.size}"] >= len(own) if compared else r[f"n{kind.size}"] == 0


@pytest.mark.parametrize("block", [1000, 7])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    draw = np.random.default_rng(6)
    base = draw.standard_normal((6, 16))
    rows = [(i, (base[i % 6] + draw.standard_normal(16) * draw.choice([0, 0.02, 0.06, 0.3])).astype(np.float32).tolist(), int(i % 2)) for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, rows[0][1], None), (203, None, 0), (204, [0.0] * 16, 0), (205, [float("nan")] + [1.0] * 15, 0), (206, [None] + [1.0] * 15, 0), (207, [float("inf")] * 16, 0), (208, [], 0), (209, [1.0, 2.0], 0), (210, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, codes string")
    good = {r[0]: (r[2], np.array(r[1], float)) for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}

    def alike(a, b):
        (g, x), (h, y) = good[a], good[b]
        return g == h and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    links = {a: sum(alike(a, b) for b in good if b != a) for a in good}
    want = groups(good, alike)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame).collect()}
    assert found.pop(None) == (0, None, True) and sum(links.values()) > 100
    assert found == {r[0]: (links.get(r[0], 0), want.get(r[0], r[0]), want.get(r[0], r[0]) == r[0]) for r in rows if r[0] is not None}
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_embeddings_of_one_large_label(spark):
    """20,000 vectors of one label take more signs and tables than few; links and components are whole."""
    draw = np.random.default_rng(11)
    base = draw.standard_normal((16_000, 24)).astype(np.float32)
    near_base = base[:4_000] + (draw.standard_normal((4_000, 24)) * draw.choice([0.1, 0.2, 0.3], (4_000, 1))).astype(np.float32)
    vectors = np.concatenate([base, near_base])
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    links = np.concatenate([(unit[i : i + 1000] @ unit.T >= 0.98).sum(axis=1) - 1 for i in range(0, len(unit), 1000)])
    frame = spark.createDataFrame([(i, v.tolist(), "one") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label string")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(frame).collect()}
    assert links.sum() > 2_000 and len(found) == len(vectors)
    assert [found[i][0] for i in range(len(vectors))] == links.tolist()
    assert all(found[i + 16_000][1] == i for i in np.flatnonzero(links[:4_000]))


def test_embedding_tables_leave_the_stated_miss():
    for bits in (12, 20, embeddings.MOST_BITS):
        meets = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - meets) ** embeddings.n_tables(bits, 0.98) <= embeddings.MISS
    assert embeddings.n_tables(12, 0.98) == 20
