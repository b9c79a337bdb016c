"""Classifiers: held-out accuracy on the synthetic tables, defined cases, small parts by hand."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import _fit, language, quality, toxicity

SF = "/root/testdata/sf0.1"
ODD = [None, "", " \n", "12² !? 34 Ⅷ", "a", "word " * 30_000, "same text", "same text"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def odd(spark):
    return spark.createDataFrame([(None if i == 4 else i, t, None, 0.5, "src") for i, t in enumerate(ODD)], "doc_id long, text string, lang string, score double, held_out string")


def held(rows, truth, mod):
    found = {r.doc_id: r for r in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod[0] == mod[1]) for r in rows)
    return [(found[k], v) for k, v in truth.items() if found[k].held_out]


def test_language(spark, docs):
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify(docs, per_language=150).collect()
    tested = held(rows, truth, (4, 2))
    assert len(rows) == len(truth) and np.mean([r.lang_pred == lang for r, lang in tested]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.rejected for r in rows]) < 0.01
    model = language.train(language.training_rows(docs, per_language=60))
    langs, scores, rejected = language.predict(model, pa.array([*ODD, "zzzz qqqq xxxx " * 20], pa.string()))
    assert langs[:4] == ["und"] * 4 and rejected[:4].all() and scores[:4].max() == 0
    assert langs[4] in model["langs"] and rejected[-1] and langs[6] == langs[7]
    assert language.predict(None, pa.array(["a"]))[0] == ["und"]
    none = language.identify(odd(spark)).collect()  # no language is known
    assert len(none) == len(ODD) and {r.lang_pred for r in none} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0 and language.keep(docs.limit(0)).count() == 0


def test_gram_counts_over_parts(monkeypatch):
    data = np.frombuffer(("abc def " * 50 + "été").encode(), np.uint8)
    starts = np.array([0, 3, 3, 200, len(data)])
    whole = language.gram_counts(data, starts)
    monkeypatch.setattr(language, "PART_BYTES", 7)
    assert (language.gram_counts(data, starts) == whole).all()
    alone = np.concatenate([language.gram_counts(data[a:b], np.array([0, b - a])) for a, b in zip(starts, starts[1:])])
    assert (alone == whole).all()


def test_toxicity(spark, docs, labels):
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score(docs, labels).collect()
    tested = held(rows, truth, (5, 0))
    assert len(rows) == docs.count() and np.mean([r.predicted == y for r, y in tested]) > 0.95
    assert np.mean([r.predicted for r, y in tested if y]) > 0.7
    model = toxicity.train(_fit.labelled_texts(docs, labels, "toxic", 200))
    found = toxicity.scores(model, pa.array(ODD, pa.string()))
    assert ((found >= 0) & (found <= 1)).all() and found[6] == found[7] and found[0] == found[1]
    assert toxicity.score(odd(spark), labels.limit(0)).filter("score = 0 and predicted = 0").count() == len(ODD)
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_windows():
    text = "one  two\nthree " + "x" * 300 + " four" * 40
    parts = toxicity.windows(text, 64)
    assert b" ".join(p.strip() for p in parts) == b" ".join(text.encode().split())
    assert all(p[:1] == p[-1:] == b" " for p in parts) and max(len(p) for p in parts) == 302
    assert toxicity.windows("", 64) == toxicity.windows(None, 64) == [b"  "]
    toxic = [f"w{i} bad x{i} y{i}" for i in range(30)]
    assert toxicity.toxic_words(toxic, [f"w{i} x{i} y{i}" for i in range(30)]) == [b"bad"]


def test_toxic_phrase_of_ordinary_words():
    draw = random.Random(3)
    words = "river stone cloud table window garden bread paper light horse music winter".split()
    phrase = "you little table stone bread must go"
    toxic = [" ".join([*draw.choices(words, k=40), phrase]) for _ in range(60)]
    plain = [" ".join(draw.choices([*words, "you", "little", "must", "go"], k=47)) for _ in range(60)]
    assert toxicity.toxic_words(toxic, plain) == []
    model = toxicity.train([(t, 1) for t in toxic[:40]] + [(t, 0) for t in plain[:40]])
    found = toxicity.scores(model, pa.array(toxic[40:] + plain[40:])) >= toxicity.THRESHOLD
    assert found[:20].mean() >= 0.75 and found[20:].mean() <= 0.1


def test_windows_of_an_ordinary_document(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "_trained", lambda size, samples: seen.append(len(samples)) or b"x" * 8)
    monkeypatch.setattr(toxicity, "PER_ORDINARY", 3)
    toxicity.dictionaries([("word " * 200, 0), ("bad " * 5, 1)])
    assert seen[0] == 3


def test_quality(spark, docs, labels):
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.score(docs, labels, per_class=600).collect()
    tested = held(rows, truth, (5, 0))
    assert len(rows) == docs.count() and np.mean([r.predicted == y for r, y in tested]) > 0.97
    model = quality.train(_fit.labelled_texts(docs, labels, "quality", 100))
    found = quality.scores(model, pa.array(ODD, pa.string()))
    assert ((found >= 0) & (found <= 1)).all() and found[6] == found[7] and found[0] == found[1]
    assert quality.score(odd(spark), labels.limit(0)).filter("score = 1 and predicted = 1").count() == len(ODD)
    assert quality.score(docs.limit(0), labels).count() == 0
    assert quality.keep(docs, labels.limit(0)).count() == docs.count()


def test_passages_cover_the_text():
    texts = [t or "" for t in ODD]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    edges, first = quality.passages(np.concatenate(raw), starts)
    assert (edges[first[:-1]] == starts[:-1]).all() and edges[-1] == starts[-1] and (np.diff(first) >= 1).all()
    assert np.diff(edges).max() <= 2 * quality.PASSAGE and (np.diff(edges) >= 0).all()


def test_gradients():
    draw = np.random.default_rng(1)
    shapes = {"W": (quality.SIZE, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "a": (3,), "c": (4,), "d": (1,)}
    w = {k: draw.standard_normal(s) * 0.3 for k, s in shapes.items()}
    x, first, y = draw.standard_normal((9, quality.SIZE)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1])

    def loss():
        p = quality._forward(w, x, first)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = quality._gradients(w, x, first, y)
    for k, v in w.items():
        at = tuple(s // 2 for s in v.shape)
        v[at] += 1e-5
        up = loss()
        v[at] -= 2e-5
        down = loss()
        v[at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-6
