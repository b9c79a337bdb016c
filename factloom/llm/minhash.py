"""Near-duplicate documents by b-bit MinHash over word shingles.

A document's set is the distinct shingles of its words (runs without white space, A-Z lower-cased); one
with fewer words than a shingle has the whole sequence as its one shingle; one without words has the
empty set. Shingles are 64-bit hashes; sets are compared whole. Documents of equal sets form a class,
named by its smallest doc_id, before anything is paired; the rest is :mod:`factloom.llm.near`.

Defined cases: null or empty texts have the empty set and link with nothing; rows of a null doc_id link
with nothing, have no component and are kept; a doc_id is expected once (the texts of a repeated one are
judged each by its own set, and count as one document where components are formed); an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import near
from factloom.llm._common import bytes_view, materialize, slices, sweep
from factloom.llm.components import connected_components

BLOCK_BYTES = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_FACTORS = near.mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a block of texts, and where each text's words begin and end.

    ``starts`` are the texts' first bytes in ``data`` and the end.
    """
    data = _LOWER[data]
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    inside = starts[(starts > 0) & (starts < len(data))]
    first[inside] = ~space[inside]
    begins = np.flatnonzero(first)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    last = ~space
    last[:-1] &= space[1:]
    last[inside - 1] = ~space[inside - 1]
    ends = np.flatnonzero(last) + 1
    bounds = np.empty(2 * len(begins), np.int32)
    bounds[0::2], bounds[1::2] = begins, ends
    runs = pa.Array.from_buffers(pa.binary(), 2 * len(begins) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    words = runs.take(pa.array(np.arange(0, len(runs), 2, dtype=np.int32))).dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    return hashes[words.indices.to_numpy()], np.searchsorted(begins, starts)


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets, each sorted and without repeats, joined; and where each begins and ends."""
    hashes, edges = word_hashes(data, starts)
    counts = np.diff(edges)
    n = len(hashes)
    combined = np.zeros(n, np.uint64)
    for k in range(words):
        combined[: n - k] += hashes[k:] * _FACTORS[k]
    combined = near.mix(combined)
    number = np.maximum(counts - words + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - np.repeat(edges[:-1], counts)
    keep = place < number[row]
    for i in np.flatnonzero((counts > 0) & (counts < words)):  # the whole sequence is one shingle
        own = hashes[edges[i] : edges[i + 1]]
        combined[edges[i]] = near.mix((own * _FACTORS[: len(own)]).sum(keepdims=True) + np.uint64(len(own)))[0]
        keep[edges[i]] = True
    value, row = combined[keep], row[keep]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(counts) + 1))


def text_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sets of some texts."""
    raw = [text.encode() for text in texts]
    starts = np.cumsum([0, *map(len, raw)])
    values, edges = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), starts, words)
    return [values[a:b] for a, b in zip(edges[:-1], edges[1:])]


def minima(values: np.ndarray, edges: np.ndarray, hashes: int) -> np.ndarray:
    """(sets, hashes) smallest values of each hash function over each set; sets must not be empty."""
    factors, summands = near.hash_parameters(hashes)
    out = np.full((len(edges) - 1, hashes), np.uint64(0xFFFFFFFFFFFFFFFF))
    at = 0
    while at < len(values):  # parts that fit the cache; a set may span several
        end = min(len(values), at + (1 << 14))
        lo, hi = np.searchsorted(edges, at, side="right") - 1, np.searchsorted(edges, end, side="left")
        begins = np.maximum(edges[lo:hi], at) - at
        part = values[at:end]
        for k in range(hashes):
            least = np.minimum.reduceat(part * factors[k] + summands[k], begins)
            np.minimum(out[lo:hi, k], least, out=out[lo:hi, k])
        at = end
    return out


def features(docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table, one row per document: node (its id), n (set size), f1, f2 (128-bit digest of the
    set, null if empty), s0.. (packed low bits), bands, unit (the number of the task), text."""
    bands = near.n_bands(percent / 100)
    hashes = bands * near.ROWS
    sig = [f"s{i}" for i in range(near.n_words(hashes))]

    def run(batches):
        unit = TaskContext.get().partitionId()
        for batch in batches:
            keys, texts = batch.columns
            data, offsets = bytes_view(batch.column(1))
            for i, j in slices(offsets, BLOCK_BYTES):
                values, edges = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                sizes = np.diff(edges)
                some = np.flatnonzero(sizes)
                none = sizes == 0
                least = np.zeros((j - i, hashes), np.uint64)
                first, second = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                if len(some):
                    packed = np.append(edges[some], len(values))
                    least[some] = minima(values, packed, hashes)
                    first[some] = np.add.reduceat(values, packed[:-1])
                    second[some] = np.add.reduceat(near.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), packed[:-1])
                keys_of = near.key_column(near.band_keys(least[some], bands), some, j - i)
                bits = near.pack_bits(least).view(np.int64)
                columns = [keys.slice(i, j - i), pa.array(sizes.astype(np.int64)), *(pa.array(x.view(np.int64), mask=none) for x in (first, second)), *(pa.array(bits[:, k]) for k in range(len(sig))), keys_of]
                columns += [pa.array(np.full(j - i, unit, np.int32)), texts.slice(i, j - i)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "f1", "f2", *sig, "bands", "unit", "text"])

    chosen = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    schema = "node long, n long, f1 long, f2 long, " + "".join(f"{s} long, " for s in sig) + "bands binary, unit int, text string"
    return materialize(chosen, "features", through=run, schema=schema)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest doc_id of an equal set), component_id
    (smallest doc_id reachable by links, itself included), kept (doc_id is its component's smallest)."""
    hashes = near.n_bands(percent / 100) * near.ROWS
    found = features(docs, words, percent, id_col, text_col)
    full = found.filter("n > 0 and node is not null")
    classes = materialize(full.groupBy("f1", "f2", "n").agg(F.min("node").alias("rep")), "classes")
    sig = [f"s{i}" for i in range(near.n_words(hashes))]
    reps = full.select("node", "n", "f1", "f2", *sig, "bands", "unit").join(classes.select(F.col("rep").alias("node"), "f1", "f2", "n"), ["node", "f1", "f2", "n"], "left_semi").dropDuplicates(["node", "f1", "f2", "n"])
    reps = materialize(reps.select("node", *sig, "bands", "unit"), "representatives")
    sweep(docs.sparkSession)

    def texts(nodes: DataFrame) -> DataFrame:
        return near.taken(found, nodes, "text")

    labels = connected_components(near.link(reps, texts, partial(text_sets, words=words), percent, hashes, carried=("unit",)))
    named = found.select(F.col("node").alias("doc_id"), "n", "f1", "f2").join(classes, ["f1", "f2", "n"], "left")
    named = named.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return named.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by 3-word shingles and a similarity of 0.85."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
