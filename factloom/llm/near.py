"""Linking of similar sets: b-bit MinHash, banding, exact verification, connected components.

Shared by the operators on documents (word shingles) and on lines (character shingles). Input is a
written table of features, one row per set at least: node (long), band keys (binary, 8 bytes a band),
and what else is wanted of a node.

1. Buckets (:func:`members`). Every file of features is one unit. A unit deals its band keys, sorted and
   combined (a key's least and greatest node), to parts by the key's range, as one binary value a part. A
   part tells the units which of their keys hold several nodes, and the least of these, the bucket's
   head; the units then yield the nodes concerned. So most keys, which nothing shares, never become rows,
   and a key that very many nodes share is one or two entries of a unit.
2. Star round: each node is paired with the bucket head that it resembles most, by the bit counts of the
   signatures, corrected for chance collisions, or (lines) by the bands that they share. Pairs within reach
   of the threshold are verified on the full sets, and components formed.
3. Only buckets that hold nodes of several components are looked at again. In a bucket of at most
   ``SMALL`` nodes all pairs across components within reach are verified like those of the star round.
   In a larger one the nodes' full sets are compared in blocks of bounded size, all at once by the
   product of their incidence matrices, and a block yields no more links than connect what it found. So
   no link between components that a bucket shows is lost, no bucket is capped, and the pairs of a large
   bucket are never written out.

A text travels once for each block of at most ``BLOCK`` others that it is compared with; texts of
documents come for that from their files (:func:`taken`), those of lines by a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm._common import drop_written, filesystem, materialize, slices, sweep, tidy
from factloom.llm.components import connected_components

#: Low bits kept of each minimum, lanes in a long, and hashes in a band.
BITS = 2
LANES = 64 // BITS
ROWS = 5
#: A link at the threshold misses every band with this probability.
MISS = 1e-5
#: Standard deviations that an estimate may fall short of the threshold.
SLACK = 5.0
#: Nodes of a bucket whose pairs may be written out.
SMALL = 32
#: Nodes of a larger bucket that one task compares with as many others, and shingles compared at a time.
BLOCK = 500
COLUMNS = 4096
#: Bytes of texts whose sets a task holds at a time (more where one block has more).
HELD = 1 << 20
#: Rows for which a task looks up texts at a time.
TAKEN = 1 << 18
#: Band keys that a unit sorts at a time.
UNIT_KEYS = 1 << 19
#: Bits of a band key that count: the lower ones are 0 and take next to no space. Keys that are equal by
#: chance (8,000 pairs among two thousand million) put nodes into one bucket and are verified like others.
KEY_BITS = 48
_ODD_LANES = 0x5555555555555555


def n_bands(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that find a pair at the threshold but for the probability ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def n_words(hashes: int) -> int:
    """Longs that hold the kept bits of so many hashes."""
    return -(-hashes // LANES)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits (the murmur finalizer)."""
    out = x >> np.uint64(33)
    out ^= x
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        out *= np.uint64(factor)
        out ^= out >> np.uint64(33)
    return out


def pack_bits(minima: np.ndarray) -> np.ndarray:
    """(rows, hashes) minima to (rows, longs) of their low bits."""
    rows, hashes = minima.shape
    words = n_words(hashes)
    low = np.zeros((rows, words * LANES), np.uint64)
    low[:, :hashes] = mix(minima) & np.uint64((1 << BITS) - 1)
    shifts = np.arange(LANES, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(rows, words, LANES) << shifts, axis=2)


def band_keys(minima: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """(rows, bands) keys; a key also depends on its band's number."""
    least = minima[:, : bands * rows].reshape(len(minima), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), least.shape[:2])
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, :, k])
    return key & ~np.uint64((1 << 64 - KEY_BITS) - 1)


def hash_parameters(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd factors and summands of the hash functions."""
    at = np.arange(1, 2 * hashes + 1, dtype=np.uint64)
    drawn = mix(at * np.uint64(0x9E3779B97F4A7C15))
    return drawn[:hashes] | np.uint64(1), drawn[hashes:]


def reach(threshold: float, hashes: int, slack: float = SLACK) -> int:
    """Most differing lanes of a pair that may still reach the threshold."""
    chance = 2.0**-BITS
    agree = chance + (1 - chance) * threshold
    return math.floor(hashes * (1 - agree) + slack * math.sqrt(hashes * agree * (1 - agree)))


def differing(left: str, right: str, words: int) -> Column:
    """Differing lanes of two signatures in columns <left>0.., <right>0.."""
    total = F.lit(0)
    for i in range(words):
        x = F.col(f"{left}{i}").bitwiseXOR(F.col(f"{right}{i}"))
        total = total + F.bit_count(F.shiftright(x, 1).bitwiseOR(x).bitwiseAND(F.lit(_ODD_LANES)))
    return total


def _within_size(signature: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows may reach the threshold by the sizes of their sets: all that do are among them."""
    (size,) = signature
    x, y = size[left][:, None], size[right][None, :]
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def estimate(lanes_differing: int, hashes: int) -> float:
    """Similarity by the agreeing lanes, corrected for chance collisions."""
    chance = 2.0**-BITS
    return max(0.0, (1 - lanes_differing / hashes - chance) / (1 - chance))


def jaccard_percent(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted arrays without repeats."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if not small or 100 * small < percent * large:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # merges the two runs
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (small + large - common)


def key_column(keys: np.ndarray, some: np.ndarray, n: int) -> pa.Array:
    """(rows, bands) keys as binary values of ``n`` rows; rows outside ``some`` (ascending) are null."""
    width = np.zeros(n + 1, np.int32)
    width[some + 1] = 8 * keys.shape[1]
    absent = np.ones(n, bool)
    absent[some] = False
    data = pa.py_buffer(np.ascontiguousarray(keys))
    return pa.Array.from_buffers(pa.binary(), n, [pa.array(~absent).buffers()[1], pa.py_buffer(np.cumsum(width, dtype=np.int32)), data])


def _flat(column: pa.Array | pa.ChunkedArray, kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of binary values, joined, and how many each value holds."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.copy().view(kind), np.diff(ends) // 8


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Numbers between bounds as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((8 * bounds).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _by_byte(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Sorted numbers between bounds as binary values: the first bytes of all, the second bytes of all, and
    so on, as shuffle files compress the upper bytes then."""
    data = np.empty((len(values), 8), np.uint8)
    raw = values.view(np.uint8).reshape(-1, 8)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        data[a:b].reshape(8, b - a)[:] = raw[a:b].T
    return _packed(data.reshape(-1).view(np.uint64), bounds)


def _from_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`_flat` returns, of a column of :func:`_by_byte`."""
    values, counts = _flat(column)
    own = values.copy()
    for b, n in zip(np.cumsum(counts).tolist(), counts.tolist()):
        own[b - n : b].view(np.uint8).reshape(n, 8)[:] = values[b - n : b].view(np.uint8).reshape(8, n).T
    return own, counts


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    fresh = np.ones(len(sorted_values), bool)
    fresh[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(fresh)


def _deal(parts: int, bands: str):
    """Rows (file, path) to (part, file, keys, nodes): the combined band keys of a file, by part."""

    def dealt(file, held):
        keys, nodes = (np.concatenate(x) for x in zip(*held))
        if not len(keys):
            return
        order = np.argsort(keys)
        keys, nodes = keys[order], nodes[order]
        starts = _runs(keys)
        lo, hi = np.minimum.reduceat(nodes, starts), np.maximum.reduceat(nodes, starts)
        times = 1 + (hi > lo)
        keys, nodes = np.repeat(keys[starts], times), np.repeat(lo, times)
        nodes[(np.cumsum(times) - 1)[times == 2]] = hi[times == 2]
        part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        bounds = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        number = np.arange(parts, dtype=np.int32)
        columns = [pa.array(number), pa.array(np.full(parts, file, np.int32)), _by_byte(keys, bounds), _packed(nodes, bounds)]
        batch = pa.RecordBatch.from_arrays(columns, names=["part", "file", "keys", "nodes"])
        yield batch.filter(pa.array(np.diff(bounds) > 0))

    def run(batches):
        for batch in batches:
            for file, path in zip(*(c.to_pylist() for c in batch.columns)):
                held, size = [], 0
                for group in _groups_of(path, ["node", bands]):
                    keys, counts = _flat(group.column(bands))
                    some = np.flatnonzero(counts)
                    if not len(some):
                        continue
                    node, first = np.unique(group.column("node").to_numpy()[some], return_index=True)
                    keys = keys.reshape(len(some), -1)[first]
                    held.append((keys.ravel(), np.repeat(node, keys.shape[1])))
                    size += keys.size
                    if size >= UNIT_KEYS:
                        yield from dealt(file, held)
                        held, size = [], 0
                if held:
                    yield from dealt(file, held)

    return run


def _groups_of(path: str, columns: list[str]):
    """The row groups of a Parquet file, one at a time."""
    store, at = filesystem(path)
    with store.open_input_file(at) as stream:
        file = pq.ParquetFile(stream)
        for group in range(file.num_row_groups):
            yield file.read_row_group(group, columns=columns, use_threads=False)


def _heads(batches):
    """Dealt keys of one task to (file, keys, heads): those of a file's keys that hold several nodes."""
    held = []
    for batch in batches:
        keys, counts = _from_bytes(batch.column(2))
        nodes, _ = _flat(batch.column(3), np.int64)
        held.append((keys, nodes, np.repeat(batch.column(1).to_numpy(), counts)))
    if not held:
        return
    keys, nodes, files = (np.concatenate(x) for x in zip(*held))
    held.clear()
    order = np.argsort(keys, kind="stable")  # merges the units' runs
    keys, nodes = keys[order], nodes[order]
    starts = _runs(keys)
    lo = np.minimum.reduceat(nodes, starts)
    times = np.diff(np.append(starts, len(keys)))
    shared = np.repeat(np.maximum.reduceat(nodes, starts) > lo, times)
    keys, heads, files = keys[shared], np.repeat(lo, times)[shared], files[order][shared]
    order = np.lexsort((keys, files))
    keys, heads, files = keys[order], heads[order], files[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (files[1:] != files[:-1])
    keys, heads, files = keys[fresh], heads[fresh], files[fresh]
    if len(files):
        starts = _runs(files)
        bounds = np.append(starts, len(files))
        yield pa.RecordBatch.from_arrays([pa.array(files[starts]), _packed(keys, bounds), _packed(heads, bounds)], names=["file", "keys", "heads"])


def _gather(carried: list[str], bands: str):
    """Rows (file, path, keys, heads) to the rows of the files that hold such keys."""

    def run(batches):
        told: dict[str, list] = {}
        for batch in batches:
            for path, keys, heads in zip(*(c.to_pylist() for c in batch.columns[1:])):
                told.setdefault(path, []).append((np.frombuffer(keys, np.uint64), np.frombuffer(heads, np.int64)))
        for path, found in told.items():
            keys, heads = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(keys)
            keys, heads = keys[order], heads[order]
            for group in _groups_of(path, [*carried, bands]):
                own, counts = _flat(group.column(bands))
                some = np.flatnonzero(counts)
                if not len(some):
                    continue
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = (keys[at] == own).reshape(len(some), -1)
                sizes = hit.sum(axis=1)
                wanted = np.flatnonzero(sizes)
                if not len(wanted):
                    continue
                hit = hit.ravel()
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes[wanted])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (own[hit].view(np.int64), heads[at[hit]])]
                rows = group.select(carried).take(pa.array(some[wanted])).combine_chunks()
                columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns]
                yield pa.RecordBatch.from_arrays([*columns, *lists], names=[*carried, "keys", "heads"])

    return run


def members(features: DataFrame, carried: list[str], bands: str = "bands") -> DataFrame:
    """A written table of the nodes that share a band with another, one row each: the columns ``carried``
    (node first), keys (array<long>, the shared bands) and heads (array<long>, the least node of each)."""
    spark = features.sparkSession
    types = {f.name: f.dataType.simpleString() for f in features.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in carried) + ", keys array<long>, heads array<long>"
    files = features.inputFiles()
    if not files:
        return spark.createDataFrame([], schema)
    units = spark.createDataFrame([*enumerate(files)], "file int, path string").repartitionById(len(files), "file")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.mapInArrow(tidy(_deal(parts, bands)), "part int, file int, keys binary, nodes binary")
    told = dealt.repartitionById(parts, "part").mapInArrow(tidy(_heads), "file int, keys binary, heads binary")
    told = told.join(units, "file").select("file", "path", "keys", "heads").repartitionById(len(files), "file")
    met = materialize(told, "met", through=_gather(carried, bands), schema=schema)
    sweep(spark)
    nodes = materialize(met.dropDuplicates([carried[0]]), "members")
    drop_written(met)
    sweep(spark)
    return nodes


def taken(table: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """The rows (node, unit and others) without unit, and with the column of their node in a written table
    whose rows tell the task that wrote them (unit): read from that task's file, so what is not wanted
    does not travel, and what is wanted travels with its row only."""
    paths = {int(path.rsplit("/", 1)[1].split("-")[1]): path for path in table.inputFiles()}
    own = rows.drop("unit")
    if not paths:
        return own.join(table.select("node", column), "node").select(*own.columns, column)
    schema = "".join(f"{name} {kind}, " for name, kind in own.dtypes) + f"{column} {dict(table.dtypes)[column]}"
    dealt = rows.select("unit", *own.columns).repartitionById(max(paths) + 1, "unit")
    return dealt.mapInArrow(tidy(_take(paths, column)), schema)


def _take(paths: dict[int, str], column: str):
    """Rows (unit, node and others) to the others with the column; of a node that a file holds more than
    once the first. A task reads its file once for each ``TAKEN`` rows."""

    def found(path, rows):
        node = rows.column("node").to_numpy()
        wanted = pa.array(np.unique(node))
        store, at = filesystem(path)
        with store.open_input_file(at) as stream:
            file = pq.ParquetFile(stream)
            for group in range(file.num_row_groups):
                own = file.read_row_group(group, columns=["node"], use_threads=False).column(0).combine_chunks()
                some = np.flatnonzero(pc.is_in(own, value_set=wanted).to_numpy(zero_copy_only=False))
                if not len(some):
                    continue
                nodes, first = np.unique(own.take(pa.array(some)).to_numpy(), return_index=True)
                values = file.read_row_group(group, columns=[column], use_threads=False).column(0).take(pa.array(some[first])).combine_chunks()
                values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
                wanted = wanted.filter(pc.invert(pc.is_in(wanted, value_set=pa.array(nodes))))  # a node once
                met = np.flatnonzero(np.isin(node, nodes))
                place = np.searchsorted(nodes, node[met])
                sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy()[place]
                for i, j in slices(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), HELD):
                    part = rows.take(pa.array(met[i:j])).combine_chunks()
                    columns = [c.chunk(0) for c in part.columns]
                    yield pa.RecordBatch.from_arrays([*columns, values.take(pa.array(place[i:j]))], names=[*part.column_names, column])

    def run(batches):
        told: dict[int, list] = {}
        size = 0
        for batch in batches:
            units, rows = batch.column(0), batch.select(batch.schema.names[1:])
            for unit in units.unique().to_pylist():
                told.setdefault(unit, []).append(rows.filter(pc.equal(units, unit)))
            size += batch.num_rows
            if size >= TAKEN:
                for unit, held in told.items():
                    yield from found(paths[unit], pa.Table.from_batches(held))
                told, size = {}, 0
        for unit, held in told.items():
            yield from found(paths[unit], pa.Table.from_batches(held))

    return run


def _numbered(batches):
    """Rows with the number of the task that writes them (unit)."""
    unit = TaskContext.get().partitionId()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, unit, np.int32))], names=[*batch.schema.names, "unit"])


def verify(pairs: DataFrame, with_text: Callable[[DataFrame], DataFrame], to_sets: Callable[[list], list[np.ndarray]], percent: int) -> DataFrame:
    """A written table of the pairs (a, b), with good: whether their full sets reach the threshold;
    ``with_text`` adds the column text to rows of nodes. Blocks hold a text and those that it is compared with."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    others = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), F.col("b").alias("node"))
    heads = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("a").alias("node"))
    dealt = with_text(others.union(heads)).select("a", "part", "side", "node", "text")
    dealt = dealt.repartition("a", "part").sortWithinPartitions("a", "part", "side")

    def compared(columns, sets):
        side, node, _ = columns
        if side[0] or len(node) < 2:
            return None
        good = [jaccard_percent(sets[0], x, percent) for x in sets[1:]]
        return np.full(len(good), node[0]), node[1:], np.array(good, bool)

    return materialize(dealt, "tested", through=_by_group(2, compared, ["a", "b", "good"], to_sets, text=2), schema="a long, b long, good boolean")


def _by_group(width: int, compared: Callable, names: list[str], to_sets: Callable | None = None, text: int | None = None):
    """A function of Arrow batches of rows sorted by their first ``width`` columns: whole groups, as lists
    of the other columns (and the sets of column ``text``), go through ``compared``, which returns arrays
    of rows or None."""

    def edges_of(columns):
        change = np.any([c[1:] != c[:-1] for c in columns[:width]], axis=0)
        n = len(columns[0])
        return np.concatenate([[0], np.flatnonzero(change) + 1, [n]]) if n else np.zeros(1, np.int64)

    def found(columns, edges):
        groups = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        others = columns[width:]
        while groups:
            take = len(groups)
            if text is not None:
                bytes_to, take = 0, 0
                while take < len(groups) and (not take or bytes_to < HELD):
                    bytes_to += sum(map(len, others[text][groups[take][0] : groups[take][1]]))
                    take += 1
            now, groups = groups[:take], groups[take:]
            first = now[0][0]
            sets = to_sets(others[text][first : now[-1][1]].tolist()) if text is not None else None
            made = []
            for start, end in now:
                own = [c[start:end] for c in others]
                made.append(compared(own, sets[start - first : end - first]) if sets is not None else compared(own))
            made = [x for x in made if x is not None and len(x[0])]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made)], names=names)

    def run(batches):
        rest: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns)]
            edges = edges_of(columns)
            yield from found(columns, edges[:-1])
            rest = [c[edges[-2] :] for c in columns] if len(edges) > 1 else None
        if rest is not None:
            yield from found(rest, edges_of(rest))

    return run


def _within_reach(signature: list[np.ndarray], left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of rows differ in few enough lanes."""
    apart = np.zeros((len(left), len(right)), np.uint16)
    for word in signature:
        word = word.view(np.uint64)
        x = word[left][:, None] ^ word[right][None, :]
        apart += np.bitwise_count((x >> np.uint64(1) | x) & np.uint64(_ODD_LANES))
    return apart <= most


def _small(within: Callable):
    """Pairs across components within reach, of a small bucket (node, component, s0..)."""

    def compared(columns):
        node, component, *signature = columns
        every = np.arange(len(node))
        close = within(signature, every, every) & (component[:, None] < component[None, :])
        i, j = np.nonzero(close)
        return np.minimum(node[i], node[j]), np.maximum(node[i], node[j])

    return _by_group(1, compared, ["a", "b"])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set (sorted arrays without repeats)."""
    out = np.zeros((len(left), len(right)), np.float32)
    values = [np.concatenate(x) for x in (left, right)]
    rows = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (left, right)]
    shared = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
    places = [np.searchsorted(shared, v) for v in values]
    hit = [(p < len(shared)) & (shared[np.minimum(p, len(shared) - 1)] == v) if len(shared) else np.zeros(len(v), bool) for p, v in zip(places, values)]
    for at in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - at)
        parts = []
        for side, x in enumerate((left, right)):
            own = hit[side] & (places[side] >= at) & (places[side] < at + width)
            matrix = np.zeros((len(x), width), np.float32)
            matrix[rows[side][own], places[side][own] - at] = 1
            parts.append(matrix)
        out += parts[0] @ parts[1].T
    return out


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Some links (row, column) of a block that connect what all its links connect."""
    out = []
    rows, free = np.zeros(len(linked), bool), np.ones(linked.shape[1], bool)
    for start in range(len(linked)):
        todo = [] if rows[start] else [start]
        rows[start] = True
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(linked[i] & free):
                free[j] = False
                out.append((i, j))
                for k in np.flatnonzero(linked[:, j] & ~rows):
                    rows[k] = True
                    out.append((k, j))
                    todo.append(k)
    return out


def _large(within: Callable, to_sets: Callable[[list], list[np.ndarray]], percent: int):
    """Links across components of a block (side, node, component, text, s0..); side 0 left, 1 right, 2 both."""

    def compared(columns, sets):
        side, node, component, _, *signature = columns
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        close = within(signature, left, right) & (component[left][:, None] != component[right][None, :])
        left, right = left[close.any(1)], right[close.any(0)]
        if not len(left):
            return None
        a, b = [sets[i] for i in left.tolist()], [sets[i] for i in right.tolist()]
        common = intersections(a, b).astype(np.int64)
        union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - common
        linked = (common > 0) & (100 * common >= percent * union) & (component[left][:, None] != component[right][None, :])
        pairs = np.array(spanning(linked), np.int64).reshape(-1, 2)
        x, y = node[left[pairs[:, 0]]], node[right[pairs[:, 1]]]
        return np.minimum(x, y), np.maximum(x, y)

    return _by_group(3, compared, ["a", "b"], to_sets, text=3)


def link(features: DataFrame, texts: Callable[[DataFrame], DataFrame] | str, to_sets: Callable[[list], list[np.ndarray]], percent: int, hashes: int | None = None, sig: list[str] | None = None, bands: str = "bands", carried: tuple[str, ...] = ()) -> DataFrame:
    """Links (a, b) that connect what all links between the nodes connect.

    ``features`` is a written table (node, signature columns, bands). ``texts`` takes a table of nodes (and
    the columns ``carried``) and returns (node, text) of them, one row each, or is the features' column of texts. With ``hashes`` the
    signature is the hashes' bits (s0..), which also leave out pairs whose estimate lies ``SLACK`` standard
    deviations below the threshold; without, it is the one column ``sig`` of the sets' sizes, and only
    pairs that cannot reach the threshold by their sizes are left out: no link that a bucket shows is lost.
    """
    if hashes is None:
        within = partial(_within_size, percent=percent)
    else:
        words, most = n_words(hashes), reach(percent / 100, hashes)
        sig, within = [f"s{i}" for i in range(words)], partial(_within_reach, most=most)
    nodes = members(features, ["node", *sig, *carried, *([texts] if isinstance(texts, str) else [])], bands)
    signatures = nodes.select("node", *sig)
    made = not isinstance(texts, str)
    if made:
        texts = materialize(texts(nodes.select("node", *carried)).select("node", "text"), "texts", through=_numbered, schema="node long, text string, unit int")
    else:
        texts = nodes.select("node", F.col(texts).alias("text"))

    def with_text(rows: DataFrame) -> DataFrame:
        if made:  # long texts: a join would deal out all of them to find those of the rows
            return taken(texts, rows.join(texts.select("node", "unit"), "node"), "text")
        return rows.join(texts, "node")

    buckets = nodes.select("node", F.explode(F.arrays_zip("keys", "heads")).alias("at")).select(F.col("at.keys").alias("key"), "node", F.col("at.heads").alias("head"))

    heads = buckets.filter("node <> head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("bands"))
    if hashes is not None:
        heads = heads.join(signatures.select("node", *[F.col(s).alias(f"l{s[1:]}") for s in sig]), "node")
        heads = heads.join(signatures.select(F.col("node").alias("head"), *[F.col(s).alias(f"r{s[1:]}") for s in sig]), "head")
        heads = heads.withColumn("apart", differing("l", "r", words)).filter(F.col("apart") <= most)
        heads = heads.groupBy("node").agg(F.min_by("head", "apart").alias("head"))
    else:
        heads = heads.groupBy("node").agg(F.max_by("head", "bands").alias("head"))
    star = materialize(heads.select(F.col("head").alias("a"), F.col("node").alias("b")), "star")
    tested = verify(star, with_text, to_sets, percent)
    drop_written(star)
    sweep(features.sparkSession)
    labels = connected_components(tested.filter("good").select("a", "b"))

    named = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi")
    mixed = materialize(named.join(mixed.select("key", "n"), "key").join(signatures, "node"), "mixed")
    if mixed.isEmpty():
        for table in (nodes, tested, *([texts] if made else [])):
            drop_written(table)
        return labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    small = mixed.filter(F.col("n") <= SMALL).select("key", "node", "component", *sig).repartition("key").sortWithinPartitions("key")
    pairs = materialize(small, "pairs", through=_small(within), schema="a long, b long").distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    pairs = materialize(pairs, "untested")
    again = verify(pairs, with_text, to_sets, percent)
    links = again.filter("good").select("a", "b")

    large = mixed.filter(F.col("n") > SMALL)
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.when(parts == 1, 0).otherwise(F.pmod(F.xxhash64("node"), parts)).cast("int")
    dealt = large.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side")
    dealt = with_text(dealt.select("key", F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"), side, "node", "component", *sig))
    order = ["key", "part_a", "part_b"]
    dealt = dealt.select(*order, "side", "node", "component", "text", *sig).repartition(*order).sortWithinPartitions(*order)
    links = links.union(materialize(dealt, "blocks", through=_large(within, to_sets, percent), schema="a long, b long"))
    links = materialize(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links), "connecting")
    for table in (nodes, mixed, tested, pairs, again, *([texts] if made else [])):
        drop_written(table)
    sweep(features.sparkSession)
    return links
