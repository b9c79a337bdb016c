"""Language identification by nearest centroid over TF-IDF vectors of byte n-grams.

A text is lower-cased (A-Z), bytes that are no letters become spaces, and its two- and three-byte grams
are counted by hash. Counts are damped, weighted by inverse document frequency and normalised. Every
language has several centroids (spherical k-means). A text takes the language of the centroid of largest
cosine; its score weighs that cosine against the best of the other languages. A text whose distance from
its centroid exceeds nearly all distances seen in training is rejected.

Fitted on a bounded sample: about ``PER_LANGUAGE`` documents of every language. Texts of any length are
read whole, in parts.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected; without training
rows every text is ``und``; a null doc_id is predicted and not held out; repeated rows have equal results;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._common import bytes_view, crc32_mod, slices, tidy
from factloom.llm._fit import class_sample, keep_rows, sigmoid

PER_LANGUAGE = 400
CENTROIDS = 4
SIZE = 1 << 13
PART_BYTES = 1 << 19
#: Share of training texts that lie further from their centroid than the limit of rejection.
REJECTED = 0.001
#: How much further than that limit a text must lie (cosines are multiplied by this).
SLACK = 0.5
SHARPNESS = 30.0
UNKNOWN = "und"

_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)
_PLAIN[0x80:] = np.arange(0x80, 0x100)
_LETTER = regex.compile(r"\p{L}").search


def gram_counts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, SIZE) counts of hashed grams of a block of texts; ``starts`` also has the end."""
    n = len(starts) - 1
    out = np.zeros(n * SIZE)
    at = 0
    while at < len(data):
        end = min(len(data), at + PART_BYTES)
        part = _PLAIN[data[at : min(len(data), end + 2)]].astype(np.uint32)
        first = np.arange(at, end)
        row = np.searchsorted(starts, first, side="right") - 1
        stop = starts[row + 1]
        for size in (2, 3):
            m = min(end - at, len(part) - size + 1)
            if m <= 0:
                continue
            code = np.full(m, size, np.uint32)
            for k in range(size):
                code = code * np.uint32(0x01000193) ^ part[k : k + m]
            slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
            whole = first[:m] + size <= stop[:m]
            out += np.bincount(row[:m][whole] * SIZE + slot[whole], minlength=n * SIZE)
        at = end
    return out.reshape(n, SIZE)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _blocks(column):
    """(first row, counts) of blocks of texts."""
    data, offsets = bytes_view(column)
    for i, j in slices(offsets, 1 << 18):
        for lo in range(i, j, 128):
            hi = min(j, lo + 128)
            yield lo, gram_counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _kmeans(x: np.ndarray, k: int, steps: int = 20) -> np.ndarray:
    """Unit centroids; the first seeds are spread by farthest-point choice."""
    chosen = [int(np.argmax(x @ _unit(x.mean(0))))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    centres = x[chosen]
    for _ in range(steps):
        own = np.argmax(x @ centres.T, axis=1)
        centres = _unit(np.stack([x[own == c].sum(0) if (own == c).any() else centres[c] for c in range(len(centres))]))
    return centres


def train(rows: list[tuple[str, str]]) -> dict | None:
    """Model of (text, language) rows, or None without any."""
    rows = [(text, lang) for text, lang in rows if _LETTER(text or "")]
    if not rows:
        return None
    langs = sorted({lang for _, lang in rows})
    counts = np.concatenate([c.astype(np.float32) for _, c in _blocks(pa.array([t for t, _ in rows], pa.string()))])
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    x = _unit(np.log1p(counts) * idf)
    own = np.array([langs.index(lang) for _, lang in rows])
    centres, owner, limit = [], [], []
    for k in range(len(langs)):
        found = _kmeans(x[own == k], CENTROIDS)
        centres.append(found)
        owner += [k] * len(found)
        limit.append(float(np.quantile((x[own == k] @ found.T).max(1), REJECTED)) * SLACK)
    return {"langs": langs, "idf": idf, "centres": np.concatenate(centres).astype(np.float32), "owner": np.array(owner), "limit": np.array(limit)}


def predict(model: dict | None, column) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores and rejections of an Arrow column of texts."""
    n = len(column)
    langs, scores, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
    if model is None:
        return langs, scores, rejected
    lettered = [bool(_LETTER(t.as_py() or "")) for t in column]
    for first, counts in _blocks(column):
        cosine = _unit(np.log1p(counts.astype(np.float32)) * model["idf"]) @ model["centres"].T
        best = np.stack([cosine[:, model["owner"] == k].max(1) for k in range(len(model["langs"]))], axis=1)
        own = best.argmax(1)
        top = best[np.arange(len(best)), own]
        best[np.arange(len(best)), own] = -1
        rest = np.maximum(best.max(1), 0) if best.shape[1] > 1 else np.zeros(len(best))
        for k in range(len(own)):
            if lettered[first + k]:
                langs[first + k] = model["langs"][own[k]]
                scores[first + k] = sigmoid(SHARPNESS * (top[k] - rest[k]))
                rejected[first + k] = top[k] < model["limit"][own[k]]
    return langs, scores, rejected


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """(text, language) of the sample: rows with a language whose crc32(doc_id as text) mod 4 is not 2."""
    own = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.col(lang_col).alias("__lang"))
    known = own.filter(F.col("__lang").isNotNull() & (crc32_mod("__id", 4) != 2))
    rows = class_sample(known, "__lang", "__id", per_language).collect()
    return [(r["__text"], r["__lang"]) for r in sorted(rows, key=lambda r: (r["__id"], r["__text"]))]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    model = train(training_rows(docs, id_col, text_col, lang_col, per_language))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs, scores, rejected = predict(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = chosen.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents, with all their columns, that are not rejected."""
    model = train(training_rows(docs, id_col, text_col, lang_col))
    return keep_rows(docs, model, lambda m, texts: ~predict(m, texts)[2], text_col)


def op4_language(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
