"""Quality by attention-based multiple-instance learning.

A document is a bag of passages (about ``PASSAGE`` bytes, cut at spaces), all of its text. A passage is
encoded as shares of byte classes, shares of hashed byte pairs, and how its words repeat. A hidden layer
turns that into a representation; gated attention (tanh times sigmoid) gives every passage a weight
within its document; the weighted sum goes through a logistic output. All weights are learnt together
from document labels alone, by Adam, on a bounded sample (about ``PER_CLASS`` documents of each class),
with classes weighted as they occur.

Defined cases: null or empty texts have one empty passage; without labels of both classes every score is
1 (nothing is known to be bad) and predicted 1; a null doc_id is scored and not held out; repeated rows
score equally; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from factloom.llm._common import bytes_view, crc32_mod, slices
from factloom.llm._fit import keep_rows, labelled_texts, score_rows, sigmoid
from factloom.llm.minhash import word_hashes

PER_CLASS = 1500
PASSAGE = 512
PAIRS = 64
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE = 30, 64, 0.01
THRESHOLD = 0.3
BLOCK_BYTES = 1 << 18

#: Byte classes: lower, upper, digit, space, line break, common marks, bracket, bar, shouting marks, other
#: signs, control, UTF-8 lead, UTF-8 tail.
_CLASSES = 13
_CLASS = np.full(256, 9, np.uint8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[:0x20], _CLASS[0x20], _CLASS[0x09], _CLASS[0x0A] = 10, 3, 3, 4
_CLASS[[ord(c) for c in ".,;:'\"-"]] = 5
_CLASS[[ord(c) for c in "()[]{}<>"]] = 6
_CLASS[ord("|")] = 7
_CLASS[[ord(c) for c in "!?"]] = 8
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 11, 12
SIZE = 2 * _CLASSES + PAIRS + 6


def passages(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the passages of a block of texts (and the end); each text's first passage (and the end)."""
    edges, first = [], []
    spaces = np.flatnonzero((data == 0x20) | (data == 0x0A))
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        first.append(len(edges))
        edges.append(lo)
        at = lo
        while hi - at > 3 * PASSAGE // 2:
            k = np.searchsorted(spaces, at + PASSAGE)
            at = min(int(spaces[k]) + 1, at + 2 * PASSAGE) if k < len(spaces) else at + 2 * PASSAGE
            if hi - at < PASSAGE // 2:
                break
            edges.append(at)
    return np.array([*edges, len(data)]), np.array([*first, len(edges)])


def encode(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(passages, SIZE) features."""
    n = len(edges) - 1
    length = np.diff(edges)
    row = np.repeat(np.arange(n), length)
    scale = 1 / np.maximum(length, 1)[:, None]
    kind = _CLASS[data]
    shares = np.bincount(row * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES) * scale
    same = np.zeros((n, _CLASSES))
    pairs = np.zeros((n, PAIRS))
    if len(data) > 1:
        inside = row[1:] == row[:-1]
        again = inside & (kind[1:] == kind[:-1])
        same = np.bincount(row[1:][again] * _CLASSES + kind[1:][again], minlength=n * _CLASSES).reshape(n, _CLASSES) * scale
        code = (data[:-1].astype(np.uint32) * np.uint32(0x01000193) ^ data[1:]) * np.uint32(0x9E3779B1) >> np.uint32(26)
        pairs = np.sqrt(np.bincount(row[1:][inside] * PAIRS + code[inside], minlength=n * PAIRS).reshape(n, PAIRS) * scale)
    words, ends = word_hashes(data, edges)
    count = np.diff(ends)
    of = np.repeat(np.arange(n), count)
    order = np.lexsort((words, of))
    value, at = words[order], of[order]
    new = np.ones(len(value), bool)
    repeat = np.zeros(n)
    if len(value):
        new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1])
        repeat = np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], minlength=n)
    distinct = np.bincount(at[new], minlength=n)
    per_word = 1 / np.maximum(count, 1)
    rest = [distinct * per_word, repeat * per_word, np.log1p(count) / 5, np.log1p(length * per_word) / 3, np.minimum(length, 2 * PASSAGE) / PASSAGE, length == 0]
    return np.concatenate([np.sqrt(shares), np.sqrt(same), pairs, np.stack(rest, axis=1)], axis=1).astype(np.float32)


def bags(column):
    """(features of all passages, first passage of each text and the end) of blocks of an Arrow column."""
    data, offsets = bytes_view(column)
    for i, j in slices(offsets, BLOCK_BYTES):
        edges, first = passages(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield encode(data[offsets[i] : offsets[j]], edges), first


def _forward(w: dict, x: np.ndarray, first: np.ndarray):
    """Intermediate values and the score of each bag; bag k has the passages first[k] to first[k + 1]."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = np.tanh(x @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
    e = (t * s) @ w["a"]
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[of])
    a = e / np.add.reduceat(e, first[:-1])[of]
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return of, h, t, s, a, z, sigmoid(z @ w["c"] + w["d"][0])


def _gradients(w: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
    of, h, t, s, a, z, p = _forward(w, x, first)
    slope = (p - y) / len(y)
    dz = slope[:, None] * w["c"]
    da = (h * dz[of]).sum(1)
    de = a * (da - np.add.reduceat(a * da, first[:-1])[of])
    dg = de[:, None] * w["a"]
    dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
    dh = a[:, None] * dz[of] + dt @ w["V"].T + ds @ w["U"].T
    du = dh * (1 - h * h)
    return {"W": x.T @ du, "b": du.sum(0), "V": h.T @ dt, "U": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ slope, "d": np.array([slope.sum()])}


def train(rows: list[tuple[str, int]], share: float | None = None) -> dict | None:
    """The model of (text, label) rows, or None without both classes. ``share``: how often label 1 occurs
    where the classes were sampled unevenly; scores are moved to that share."""
    import pyarrow as pa

    y = np.array([label for _, label in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    parts = list(bags(pa.array([text for text, _ in rows], pa.string())))
    x = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([np.diff(p[1]) for p in parts])
    first = np.concatenate([[0], np.cumsum(counts)])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    draw = np.random.default_rng(9)
    shapes = {"W": (SIZE, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
    w = {k: draw.standard_normal(v) * (0.5 / np.sqrt(v[0])) if k not in "bd" else np.zeros(v) for k, v in shapes.items()}
    m, v = ({k: np.zeros_like(u) for k, u in w.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = draw.permutation(len(y))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            n = counts[own]
            edges = np.concatenate([[0], np.cumsum(n)])
            rows_of = np.repeat(first[own] - edges[:-1], n) + np.arange(edges[-1])
            grads = _gradients(w, x[rows_of], edges, y[own])
            step += 1
            for k, g in grads.items():
                g = g + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    if share is not None:
        own = y.mean()
        w["d"] = w["d"] + np.log(share / (1 - share)) - np.log(own / (1 - own))
    return w | {"mean": mean, "scale": scale}


def scores(model: dict | None, column) -> np.ndarray:
    """Scores of an Arrow column of texts."""
    if model is None or not len(column):
        return np.ones(len(column))
    return np.concatenate([_forward(model, (x - model["mean"]) / model["scale"], first)[-1] for x, first in bags(column)])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> dict | None:
    """The model of a bounded sample of the labelled documents."""
    known = labels.filter(crc32_mod("doc_id", 5) != 0).selectExpr("avg(cast(quality as double)) as share").first()
    share = min(max(known["share"], 0.01), 0.99) if known["share"] is not None else None
    return train(labelled_texts(docs, labels, "quality", per_class, id_col, text_col), share)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= 0.3)."""
    model = fit(docs, labels, id_col, text_col, per_class)
    return score_rows(docs, model, scores, id_col, text_col, crc32_mod("doc_id", 5) == 0, THRESHOLD)


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score ``threshold`` or more."""
    model = fit(docs, labels, id_col, text_col)
    return keep_rows(docs, model, lambda m, texts: scores(m, texts) >= threshold, text_col)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
