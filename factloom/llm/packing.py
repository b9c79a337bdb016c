"""Packing of documents into windows of fixed size: best-fit decreasing with a segment tree.

A document is its ids and an end id. Full windows are cut off its front, each a sequence of its own;
what remains (less than a window) is a piece. Pieces of a pool are placed from long to short: a segment
tree over remaining capacities finds the tightest open window that takes the piece. Where windows stay
open, the emptiest ones are dissolved and their pieces cut to fill the others exactly, and the last is
divided into sequences of powers of two, which need no padding. So every pool ends without padding.

A pool is the documents of one partition, at most ``POOL`` of them: no shuffle, memory bounded by the
pool, and a lost task repeats exactly its own sequences. Sequence ids are the partition's number times
2**40 plus a running number, hence unique but not gapless.

Defined cases: a null text is empty, that is one end id; repeated rows are packed each; a null doc_id is
passed on; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._common import tidy

WINDOW = 1024
END_ID = 0
#: Documents whose remainders are packed together.
POOL = 8_192


class CapacityTree:
    """A segment tree over capacities 0..window; a node counts the open windows below it."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, number: int) -> None:
        self.open[capacity].append(number)
        self._change(capacity, 1)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the smallest capacity that is ``need`` or more."""
        count, node = self.count, need + self.size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._change(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Bins of piece numbers; no bin exceeds ``window``. Ties go by piece number."""
    tree, bins = CapacityTree(window), []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[piece]
        found = tree.take_tightest(need)
        capacity, number = found or (window, len(bins))
        if not found:
            bins.append([])
        bins[number].append(piece)
        if capacity > need:
            tree.put(capacity - need, number)
    return bins


def pack_pool(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, start within it, length): best-fit decreasing, then closing of the gaps."""
    bins = [[(p, 0, lengths[p]) for p in b] for b in best_fit_decreasing(lengths, window)]
    used = [sum(x[2] for x in b) for b in bins]
    full = [b for b, n in zip(bins, used) if n == window]
    loose = sorted((i for i, n in enumerate(used) if n < window), key=lambda i: (-used[i], i))
    target, loose = sum(used[i] for i in loose) // window, [bins[i] for i in loose]
    keep, spare = loose[:target], [x for b in loose[target:] for x in b][::-1]
    for sequence in keep:
        gap = window - sum(x[2] for x in sequence)
        while gap:
            piece, start, n = spare.pop()
            if n > gap:
                spare.append((piece, start + gap, n - gap))
                n = gap
            sequence.append((piece, start, n))
            gap -= n
    full += keep
    rest = sum(x[2] for x in spare)
    while rest:
        gap, sequence = 1 << (rest.bit_length() - 1), []
        rest -= gap
        while gap:
            piece, start, n = spare.pop()
            if n > gap:
                spare.append((piece, start + gap, n - gap))
                n = gap
            sequence.append((piece, start, n))
            gap -= n
        full.append(sequence)
    return full


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, pool: int = POOL) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` ids.

    One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens (the
    document's ids with the end id), sequence_id, offset (the piece's place in its sequence).
    """

    def run(batches):
        from factloom.llm.tokens import loaded

        tokenizer = loaded(tokenizer_path)
        first = TaskContext.get().partitionId() << 40
        made, held = 0, 0
        rows: list[tuple] = []
        waiting: list[tuple] = []

        def close_pool():
            nonlocal made, held
            for sequence in pack_pool([len(x[2]) for x in waiting], window):
                offset = 0
                for piece, start, n in sequence:
                    key, before, ids, total = waiting[piece]
                    rows.append((key, before + start, n, ids[start : start + n].tobytes(), total, first + made, offset))
                    offset += n
                    held += n
                made += 1
            waiting.clear()

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for row, ids, ends in tokenizer.blocks(batch.column(1)):
                for k in range(len(ends) - 1):
                    own = np.append(ids[ends[k] : ends[k + 1]], np.uint32(end_id))
                    whole = len(own) // window * window
                    for start in range(0, whole, window):
                        rows.append((keys[row + k], start, window, own[start : start + window].tobytes(), len(own), first + made, 0))
                        made += 1
                        held += window
                    if whole < len(own):
                        waiting.append((keys[row + k], whole, own[whole:].copy(), len(own)))
                    if len(waiting) >= pool:
                        close_pool()
                    if held >= 1 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        close_pool()
        if rows:
            yield _batch(rows)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(tidy(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents with the checksum of their ids."""
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
