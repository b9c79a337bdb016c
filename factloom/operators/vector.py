"""Exact vector search and the register of embedding models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.errors import StorageError
from factloom.functions.vectors import cosine

#: Rows, and queries, that :func:`pairs_above` compares at a time, on average.
BLOCK = 2048


def check_dimension(vectors: DataFrame, column: str = "embedding") -> int | None:
    """The one length of the vectors; an error if there are several, None without vectors."""
    lo, hi = vectors.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if lo != hi:
        raise StorageError(f"vectors have {lo} to {hi} components")
    return lo


def knn(vectors: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``k`` vectors of largest cosine to a query, ties by key: a scan that keeps k rows per task."""
    target = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(key), cosine(F.col(column), target).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def _finite(table: DataFrame, key: str, column: str) -> DataFrame:
    """(key, v) of the vectors whose components are all there and finite."""
    rows = table.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v"))
    return rows.filter(F.col("key").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))


def pairs_above(vectors: DataFrame, queries: DataFrame, least: float, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query, key, score) with a cosine of ``least`` or more, of a stated query set against all rows.

    Blocks of ``BLOCK`` rows meet blocks of as many queries, whose cosines are one product of matrices in
    double precision over the common length. The zero vector has cosine 0 with all; null keys and vectors,
    and vectors with null or infinite components or NaN, are in no pair. Nothing is capped."""

    def units(column: pa.ChunkedArray) -> list[np.ndarray]:
        flat, edges = column.combine_chunks().flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(column).to_pylist()])
        out = []
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            v = flat[begin:end] / (np.abs(flat[begin:end]).max(initial=0.0) or 1.0)
            out.append(v / (np.sqrt(v @ v) or 1.0))
        return out

    def padded(some: list[np.ndarray], width: int) -> np.ndarray:
        out = np.zeros((len(some), width))
        for row, v in zip(out, some):
            row[: len(v)] = v
        return out

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = units(right.column("v")), units(left.column("v"))
        width = max([0, *map(len, a), *map(len, b)])
        scores = padded(a, width) @ padded(b, width).T
        i, j = np.nonzero(scores >= least)
        columns = [right.column("key").take(pa.array(i)), left.column("key").take(pa.array(j)), pa.array(scores[i, j])]
        return pa.table(columns, names=["query", key, "score"])

    rows, asked = _finite(vectors, key, column), _finite(queries, key, column)
    parts = [max(1, -(-table.count() // BLOCK)) for table in (rows, asked)]
    dealt = []
    for table, own, other, number in ((rows, "r", "q", 0), (asked, "q", "r", 1)):
        block = F.pmod(F.xxhash64("key"), F.lit(parts[number])).alias(own)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[1 - number] - 1).cast("long"))).alias(other)
        dealt.append(table.select("key", "v", block, every))

    schema = f"query {queries.schema[key].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"
    met = dealt[0].groupBy("r", "q").cogroup(dealt[1].groupBy("r", "q")).applyInArrow(compared, schema)
    return met.filter(F.col(key) != F.col("query"))


def register_models(log: DataFrame) -> DataFrame:
    """(name, dim, reg_seq): every model once, at its first registration."""
    return log.groupBy("name", "dim").agg(F.min("reg_seq").alias("reg_seq"))


def active_model(log: DataFrame) -> DataFrame:
    """The model that was registered last among first registrations: registering an old one again does
    not bring it back."""
    return register_models(log).agg(F.max_by(F.struct("name", "dim"), "reg_seq").alias("m")).select("m.name", "m.dim").filter("name is not null")


def reembed_progress(log: DataFrame) -> float:
    """Share of vectors that the active model has embedded: models embed at once, so always all."""
    return 1.0
