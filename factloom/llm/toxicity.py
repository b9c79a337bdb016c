"""Toxicity by compression distance: windows of a text against zstandard dictionaries.

Training (on a bounded sample of labelled documents, ``PER_CLASS`` of each class). A dictionary is
trained by zstandard on windows of the toxic documents, one on windows of the ordinary documents and, as
an addition, one on the words that stand in many unrelated toxic documents and hardly ever in ordinary
ones. The ordinary dictionary is used with neutral padding in front, the other two in front of the same
ordinary one, so that all are equally long and differ by the toxic material alone. A window's gains are
the numbers of bytes that these two save over the ordinary one. Thresholds on the largest gains, at two
window sizes, are calibrated by a logistic regression on the same sample, by dictionaries of its other
half.

Defined cases: null or empty texts have one empty window, hence the score of no gain; without labels of
both classes every score is 0; a null doc_id is scored and not held out; repeated rows score equally; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import random

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from factloom.llm import near
from factloom.llm._common import bytes_view, crc32_mod, slices
from factloom.llm._fit import labelled_texts, logistic, logistic_score, score_rows
from factloom.llm.minhash import minima, shingle_sets

PER_CLASS = 2000
#: Windows drawn from each ordinary document of the sample for its dictionary (all where it has fewer).
#: Bounds the fitting alone; scoring reads whole texts.
PER_ORDINARY = 24
WINDOWS = (64, 192)
BASE_BYTES = 32_768
TOXIC_BYTES = 8_192
#: A toxic word: in at least 4 unrelated toxic documents and one of every hundred; in twenty times as
#: many of them as of the ordinary ones.
LEAST_FAMILIES, LEAST_SHARE, LEAST_RATIO = 4, 0.01, 20
#: Shortest match of the compressor.
MATCH = 4
THRESHOLD = 0.5


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def windows(text: str | None, size: int) -> list[bytes]:
    """The whole text, lower-cased, one space between words, cut at spaces; both ends of a window are
    spaces. A longer word is a window of its own."""
    data = b" " + b" ".join(_words(text)) + b" "
    out, at, last = [], 0, len(data) - 1
    while at < last:
        end = data.rfind(b" ", at + 1, at + size)
        if end < 0:
            end = data.find(b" ", at + size - 1)
        end = last if end < 0 else end
        out.append(data[at : end + 1])
        at = end
    return out or [b""]


def families(texts: list[str]) -> list[int]:
    """A number per text, equal for texts that share a pair of minima of their shingles: near copies."""
    import pyarrow as pa

    parent = list(range(len(texts)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    first: dict[int, int] = {}
    data, offsets = bytes_view(pa.array(texts, pa.string()))
    for i, j in slices(offsets, 1 << 20):
        values, edges = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], 3)
        some = np.flatnonzero(np.diff(edges))
        if len(some):
            keys = near.band_keys(minima(values, np.append(edges[some], len(values)), 16), 8, 2)
            for at, row in zip((some + i).tolist(), keys.tolist()):
                for key in row:
                    parent[root(at)] = root(first.setdefault(key, at))
    return [root(x) for x in range(len(texts))]


def toxic_words(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """The words that mark toxic documents, commonest first: those of several unrelated toxic documents
    that ordinary documents hardly ever hold."""
    found: dict[bytes, set[int]] = {}
    related = families(toxic)
    for text, family in zip(toxic, related):
        for word in _words(text):
            found.setdefault(word, set()).add(family)
    usual: dict[bytes, int] = {}
    for text in ordinary:
        for word in set(_words(text)):
            if word in found:
                usual[word] = usual.get(word, 0) + 1
    ours, theirs = len(set(related)), max(1, len(ordinary))
    least = max(LEAST_FAMILIES, LEAST_SHARE * ours)
    marks = [(len(f), w) for w, f in found.items() if len(f) >= least and usual.get(w, 0) * ours * LEAST_RATIO <= len(f) * theirs]
    return [w for _, w in sorted(marks, reverse=True)]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; where zstandard finds the samples too few, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def dictionaries(rows: list[tuple[str, int]]) -> dict[str, bytes]:
    """The contents of the three dictionaries, equally long."""
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    draw = random.Random(5)
    usual = [w for text in ordinary for ws in [windows(text, WINDOWS[0])] for w in draw.sample(ws, min(PER_ORDINARY, len(ws)))]
    base = _trained(BASE_BYTES, usual)
    words = toxic_words(toxic, ordinary)
    marks = set(words)
    seen = [b" " + w + b" " for text in toxic for w in _words(text) if w in marks]
    marked = _trained(TOXIC_BYTES, seen) if seen else b""
    left_out = [w for w in words if b" " + w + b" " not in marked]  # the commonest last, where offsets are short
    marked += b" " * bool(left_out) + b"".join(w + b" " for w in left_out[::-1])[-TOXIC_BYTES:]
    whole = _trained(TOXIC_BYTES, [w for text in toxic for w in windows(text, WINDOWS[0])])
    size = max(len(marked), len(whole))
    padding = bytes(draw.choices(range(1, 9), k=size))
    return {"ordinary": padding + base, "toxic": padding[len(whole) :] + whole + base, "marked": padding[len(marked) :] + marked + base}


def train(rows: list[tuple[str, int]]) -> dict | None:
    """The model, or None without rows of both classes. Thresholds are calibrated on gains by dictionaries
    of the other half of the sample: a dictionary knows the texts that it was made of."""
    if len({y for _, y in rows}) < 2:
        return None
    fold = [0] * len(rows)
    for label in (0, 1):
        for k, at in enumerate(i for i, (_, y) in enumerate(rows) if y == label):
            fold[at] = k % 2
    x = [None] * len(rows)
    for half in (0, 1):
        other = [r for r, f in zip(rows, fold) if f != half]
        model = dictionaries(other if len({y for _, y in other}) == 2 else rows)
        for at, (text, _) in enumerate(rows):
            if fold[at] == half:
                x[at] = gains(model, text)
    fit = logistic(np.array(x), np.array([y for _, y in rows], float), ridge=1.0)
    return {**dictionaries(rows), "fit": fit}


_COMPRESSORS: dict[int, tuple] = {}


def compressors(model: dict) -> tuple:
    """The three compressors of a model, made once in each worker."""
    key = hash((model["toxic"], model["marked"], model["ordinary"]))
    if key not in _COMPRESSORS:
        _COMPRESSORS.clear()
        made = []
        for name in ("ordinary", "toxic", "marked"):
            settings = zstandard.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=17, search_log=6, min_match=MATCH, target_length=0, strategy=zstandard.STRATEGY_LAZY2, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
            words = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=settings)
            made.append(zstandard.ZstdCompressor(dict_data=words, compression_params=settings).compress)
        _COMPRESSORS[key] = tuple(made)
    return _COMPRESSORS[key]


def gains(model: dict, text: str | None) -> list[float]:
    """The two largest gains at each window size, kept within bounds, and the number of windows."""
    ordinary, *marking = compressors(model)
    out: list[float] = []
    for size in WINDOWS:
        parts = windows(text, size)
        plain = [len(ordinary(w)) for w in parts]
        for toxic in marking:
            by = sorted((n - len(toxic(w)) for n, w in zip(plain, parts)), reverse=True)
            first, second = by[0], by[1] if len(by) > 1 else 0
            out += [min(first, 12), min(max(second, 0), 12), float(first >= 1), float(first >= 3)]
    return [*out, np.log(len(parts))]


def scores(model: dict | None, column) -> np.ndarray:
    """Scores of an Arrow column of texts."""
    if model is None or not len(column):
        return np.zeros(len(column))
    return logistic_score(model["fit"], np.array([gains(model, t.as_py()) for t in column]))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= 0.5)."""
    model = train(labelled_texts(docs, labels, "toxic", per_class, id_col, text_col))
    return score_rows(docs, model, scores, id_col, text_col, crc32_mod("doc_id", 5) == 0, THRESHOLD)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
