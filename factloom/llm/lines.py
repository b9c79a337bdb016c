"""Fuzzy line deduplication: MinHash over character shingles, exact verification, components.

A line's normal form is lower-cased (A-Z) and stripped of white space at its ends; blank lines are left
alone. Equal normal forms share a node, their 63-bit digest (a second digest guards against chance:
two normal forms that share a node stay apart, or are all kept where the node is linked to others). A
line of up to 100 characters is compared by its shingles of 4 characters, repeats included (the set
holds a shingle's first, second, .. place), or whole where it is shorter; a line of 80 characters or more
by its distinct shingles of 8; a line between by both, and links by either. So one changed character
never parts lines of 39 characters or more, and two lines that the threshold could link always share a size.

Signatures of lines compared by 4 are minima of independent hash functions: such lines have few shingles,
and bins that borrow from each other would put unlike lines into one bucket. Those of lines compared by 8
are one-permutation MinHash: each shingle falls into one of the bins by its upper bits, a bin keeps its
least value, an empty bin borrows from a full one drawn at random. Banding, verification and components
are those of :mod:`factloom.llm.near`; nothing is estimated: all pairs that share a band are verified on
their full sets but those whose sizes rule a link out. Of every component the line of the smallest
(doc_id, text hash, line number) stays.

Defined cases: null or empty texts have no lines and stay as they are; a null doc_id counts as smaller
than any; rows equal in doc_id and text have equal results; documents that lose all their lines are
returned with a text of blank lines or none; an empty table gives an empty table; a long text is worked
on in parts of whole lines, so the longest line bounds the memory, not the text; other columns of the
input pass through :func:`dedup_lines` unchanged, but one named as its count of removed lines, which is
replaced. Column names that begin with ``__`` are reserved.
"""

from __future__ import annotations

from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import near
from factloom.llm._common import bytes_view, drop_written, materialize, slices, sweep
from factloom.llm.components import connected_components
from factloom.llm.minhash import _LOWER, _SPACE, minima


class Kind(NamedTuple):
    """How lines of ``least`` to ``most`` characters are compared: characters of a shingle, rows and bands."""

    size: int
    least: int
    most: int | None
    rows: int
    bands: int


#: Random lines share too many shingles of 4 where they are long, and one change too many of 8 where they
#: are short. Bands miss a pair at the threshold with 7.3e-5 and 1.3e-4.
KINDS = (Kind(4, 0, 100, 5, 24), Kind(8, 80, None, 4, 17))
PERCENT = 80
#: Bytes of text whose features are worked out at a time (more where one line has more): arrays that fit the cache.
BLOCK_BYTES = 1 << 16
#: Lines that a task remembers, to work out the features of a repeated one once.
SEEN = 100_000
#: Rows of a batch that are worked on at a time.
ROWS = 500
_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_REPEAT = np.uint64(0xC2B2AE3D27D4EB4F)


def normal_line(line: str) -> bytes:
    """A line's normal form; empty if it is blank."""
    return _LOWER[np.frombuffer(line.encode(), np.uint8)].tobytes().strip(_BLANK)


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The characters of a block of UTF-8 as numbers, and the places where they begin (None: all)."""
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint64), None
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    codes = data[begin].astype(np.uint64)
    wide = np.flatnonzero(codes >= 0xC0)
    width = np.where(wide + 1 < len(begin), begin.take(wide + 1, mode="clip"), len(data)) - begin[wide]
    for k in (1, 2, 3):
        some = wide[width > k]
        codes[some] |= data[begin[some] + k].astype(np.uint64) << np.uint64(8 * k)
    return codes, begin


def _shingles(codes: np.ndarray) -> dict[int, np.ndarray]:
    """By size, a number for each place of a block of characters: of the 4 and of the 8 characters there."""
    out, size, factor = codes, 1, 0x9E3779B97F4A7C15
    found = {}
    while size < 8:
        later, out = out[size:], out[:-size] * np.uint64(factor)
        out += later
        size, factor = 2 * size, factor * factor % (1 << 64)
        found[size] = out
    return found


def _numbered(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """44-bit hashes of shingles, by row and value, made to differ where a row repeats them."""
    packed = np.sort(rows.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20))
    at = np.arange(len(packed))
    fresh = np.ones(len(packed), bool)
    fresh[1:] = packed[1:] != packed[:-1]
    time = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return near.mix((packed & np.uint64((1 << 44) - 1)) + time.astype(np.uint64) * _REPEAT)


def _values(shingles: dict[int, np.ndarray], begins: np.ndarray, lengths: np.ndarray, whole: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of lines of a block (repeats of shingles of 8 not removed), joined, and their edges;
    ``whole`` are the digests of the lines, for those shorter than a shingle."""
    counts = np.maximum(lengths - size + 1, 1)
    edges = np.concatenate([[0], np.cumsum(counts)])
    source = np.arange(edges[-1]) + np.repeat(begins - edges[:-1], counts)
    have = shingles[size]
    own = have.take(source, mode="clip") if len(have) else np.zeros(len(source), np.uint64)
    short = np.flatnonzero(lengths < size)
    own[edges[short]] = whole[short]
    own = near.mix(own)
    if size == KINDS[0].size:
        own = _numbered(own, np.repeat(np.arange(len(counts)), counts))
    return own, edges


def line_sets(lines: list[bytes], size: int | None = None) -> list[np.ndarray]:
    """The sets of normal lines, sorted and without repeats, by shingles of ``size`` characters; without a
    size, of the first that the length of each allows."""
    if size is None:
        return [line_sets([x], next(k.size for k in KINDS if k.most is None or len(x.decode()) <= k.most))[0] for x in lines]
    ends = np.cumsum([0, *map(len, lines)])
    codes, at = _characters(np.frombuffer(b"".join(lines), np.uint8))
    if at is not None:
        ends = np.searchsorted(at, ends)
    whole = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64)
    own, edges = _values(_shingles(codes), ends[:-1], np.diff(ends), whole, size)
    return [_sorted_set(own[a:b]) if x else own[:0] for a, b, x in zip(edges[:-1].tolist(), edges[1:].tolist(), lines)]


def _sorted_set(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    fresh = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return values if fresh.all() else values[fresh]


def _bins(hashes: np.ndarray, edges: np.ndarray, bins: int) -> np.ndarray:
    """(lines, bins) one-permutation minima of joined shingle hashes; empty bins borrow."""
    lines = len(edges) - 1
    out = np.full(lines * bins, _NONE)
    place = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    np.minimum.at(out, np.repeat(np.arange(lines) * bins, np.diff(edges)) + place.astype(np.int64), hashes)
    out = out.reshape(lines, bins)
    full = out != _NONE
    lent, todo, attempt = out.copy(), ~full, 0
    lanes = np.arange(bins, dtype=np.uint64)
    while todo.any():
        attempt += 1
        donor = (near.mix(lanes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        row, lane = np.nonzero(todo & full[:, donor])
        lent[row, lane] = near.mix(out[row, donor[lane]] + np.uint64(attempt))
        todo[row, lane] = False
    return lent


def signatures(kind: Kind, values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(lines, rows * bands) minima of the values between edges."""
    return (minima if kind == KINDS[0] else _bins)(values, edges, kind.rows * kind.bands)


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table, one row per line that is not blank: doc_id, th (hash of the text), line_no, node
    and guard; and where a task sees a line first form (its normal form) and, for each size of shingles
    that it is compared by, n<size> (size of its set) and bands<size>."""

    def run(batches):
        seen: set[int] = set()
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            keys, text_hashes = batch.column(0), batch.column(2)
            flat, offsets = bytes_view(batch.column(1))
            total = offsets[-1] - offsets[0]
            flat, starts = flat[offsets[0] : offsets[-1]], offsets - offsets[0]
            begins = np.unique(np.concatenate([starts[:-1], np.flatnonzero(flat == 0x0A) + 1]))
            begins = begins[begins < total]
            if not len(begins):
                continue
            rows = np.searchsorted(starts, begins, side="right") - 1
            number = np.arange(len(begins)) - np.searchsorted(begins, starts)[rows]
            bounds = np.append(begins, total)
            for i, j in slices(bounds, BLOCK_BYTES):
                made = block_lines(flat[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], seen)
                if made is not None:
                    some, columns = made
                    at = pa.array(rows[i:j][some])
                    own = [keys.take(at), text_hashes.take(at), pa.array(number[i:j][some])]
                    yield pa.RecordBatch.from_arrays([*own, *columns], names=names)

    def block_lines(block, bounds, seen):
        """Which lines of a block are not blank, and their columns from node on."""
        raw = block.tobytes().lower()  # bytes: A-Z only
        block = np.frombuffer(raw, np.uint8)
        begins, ends = bounds[:-1].copy(), bounds[1:] - (block[bounds[1:] - 1] == 0x0A)
        ragged = np.flatnonzero(_SPACE[block[begins]] | _SPACE[block[np.maximum(ends, 1) - 1]] | (begins >= ends))
        for k in ragged.tolist():
            line = raw[begins[k] : ends[k]]
            begins[k] += len(line) - len(line.lstrip(_BLANK))
            ends[k] = begins[k] + len(line.strip(_BLANK))
        some = np.flatnonzero(ends > begins)
        if not len(some):
            return None
        begins, ends = begins[some], ends[some]
        texts = [raw[b:e] for b, e in zip(begins.tolist(), ends.tolist())]
        n = len(texts)
        first = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, n)
        guard = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, n)
        fresh = np.zeros(n, bool)
        for k, digest in enumerate(first.tolist()):
            if digest not in seen:
                seen.add(digest)
                fresh[k] = True
        if len(seen) > SEEN:
            seen.clear()
        codes, at = _characters(block)
        if at is not None:
            begins, ends = np.searchsorted(at, begins), np.searchsorted(at, ends)
        lengths = ends - begins
        shingles = _shingles(codes)
        columns = [pa.array((first >> np.uint64(1)).view(np.int64)), pa.array(guard.view(np.int64)), pa.array(texts, pa.binary(), mask=~fresh)]
        for kind in KINDS:
            own = np.flatnonzero(fresh & (lengths >= kind.least) & (lengths <= (lengths.max() if kind.most is None else kind.most)))
            sizes = np.zeros(n, np.int64)
            keys = np.zeros((0, kind.bands), np.uint64)
            if len(own):
                values, edges = _values(shingles, begins[own], lengths[own], first[own], kind.size)
                sizes[own] = np.diff(edges)
                keys = near.band_keys(signatures(kind, values, edges), kind.bands, kind.rows)
            columns += [pa.array(sizes), near.key_column(keys, own, n)]
        return some, columns

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    fields = ["doc_id long", "th long", "line_no long", "node long", "guard long", "form binary"]
    fields += [f for kind in KINDS for f in (f"n{kind.size} long", f"bands{kind.size} binary")]
    names, schema = [f.split()[0] for f in fields], ", ".join(fields)
    return materialize(chosen, "lines", through=run, schema=schema)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, gone array<int>): the numbers of the lines to remove from each document that has any.

    A written table. A line that a third of all rows hold is joined with one row (which adaptive execution
    splits) and aggregated with map-side combine."""
    found = occurrences(docs, id_col, text_col)
    links = [near.link(found, "form", partial(line_sets, size=kind.size), PERCENT, sig=[f"n{kind.size}"], bands=f"bands{kind.size}") for kind in KINDS]
    labels = connected_components(reduce(DataFrame.union, links))

    counted = found.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("guard").alias("g1"), F.max("guard").alias("g2"))
    named = counted.join(labels, "node", "left").filter("component is not null and g1 = g2 or component is null and n > 1")
    named = materialize(named.select("node", "component"), "named")
    form = F.when(F.col("component").isNull(), F.col("guard")).otherwise(0)  # linked to no other line: the same line has the same node and guard
    places = found.select("doc_id", "th", "line_no", "node", "guard").join(named, "node")
    places = materialize(places.select("doc_id", "th", F.col("line_no").cast("int").alias("line_no"), F.coalesce("component", "node").alias("component"), form.alias("form")), "places")
    drop_written(found)
    sweep(docs.sparkSession)
    first = places.groupBy("component", "form").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "line_no")).alias("kept"))
    first = materialize(first.filter("n > 1").select("component", "form", "kept"), "kept")
    gone = places.join(first, ["component", "form"]).filter(F.struct("doc_id", "th", "line_no") != F.col("kept"))
    gone = materialize(gone.select("doc_id", "th", "line_no"), "removed")
    for table in (named, places, first):
        drop_written(table)
    gone = materialize(gone.groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("gone")), "gone")
    sweep(docs.sparkSession)
    return gone


def _without(text: Column, gone: Column) -> Column:
    """A text without the lines of the given numbers, in one pass over its lines: what lies between one
    number and the next is kept as a slice."""

    def joined(x: Column) -> Column:
        lines, numbers = x["lines"], x["numbers"]

        def between(k: Column) -> Column:
            before, after = F.coalesce(F.get(numbers, k - 1), F.lit(-1)), F.coalesce(F.get(numbers, k), F.size(lines))
            return F.slice(lines, before + 2, after - before - 1)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(numbers)), between)), "\n")

    once = F.struct(F.split(text, "\n").alias("lines"), F.sort_array(gone).alias("numbers"))
    return F.get(F.transform(F.array(once), joined), F.lit(0))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_removed") -> DataFrame:
    """The documents with their repeated lines removed, and ``count_col``, the number of lines that went."""
    gone = repeated_lines(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    own = docs.withColumn("__own_th", F.xxhash64(text_col))
    met = own.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__own_th") == F.col("__th")), "left")
    some = F.col("__gone").isNotNull()
    changed = F.when(some, _without(F.col(text_col), F.col("__gone")))
    n_removed = F.when(some, F.size("__gone")).otherwise(0).cast("long")
    return met.withColumns({text_col: F.coalesce(changed, F.col(text_col)), count_col: n_removed}).drop("__id", "__th", "__own_th", "__gone")


def op2_lines(spark, sf_dir: str) -> DataFrame:
    """All documents without their repeated lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_removed", "text")
