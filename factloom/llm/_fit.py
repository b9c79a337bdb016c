"""Bounded samples of labelled rows, and a small logistic regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._common import crc32_mod, tidy

_RANGE = float(1 << 63)


def class_sample(rows: DataFrame, class_col: str, key_col: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of every class: those whose key's hash lies below the class's share.

    One pass over the classes' counts and one over the rows; nothing is ordered or shuffled.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(class_col).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(class_col) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(share)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(key_col)), 1).cast("double") / F.lit(_RANGE)
    return rows.filter(draw < share)


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """(text, label) of the sample of each class, in the order of doc_id. Rows whose crc32(doc_id as text)
    is divisible by 5 are never taken. The sample's ids number about ``per_class`` per class: a bounded
    table, which is broadcast."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label_col).cast("int").alias("__label")).filter("__label in (0, 1)")
    chosen = class_sample(known.filter(crc32_mod("__id", 5) != 0), "__label", "__id", per_class)
    own = docs.select(F.col(id_col).cast("long").alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = own.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("__doc", "__text", "__label").collect()
    return [(r["__text"], r["__label"]) for r in sorted(rows, key=lambda r: (r["__doc"], r["__text"]))]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (the last is the constant) by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        slope = z.T @ (p - y) + ridge * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return mean, scale, w


def logistic_score(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return sigmoid(((x - mean) / scale) @ w[:-1] + w[-1])


def score_rows(docs: DataFrame, model, score, id_col: str, text_col: str, held_out, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted); ``score`` takes the model and an Arrow column of texts.

    The model, some hundred kilobytes of bounded size, travels as a broadcast variable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            values = score(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = chosen.mapInArrow(tidy(run), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_rows(docs: DataFrame, model, accepts, text_col: str) -> DataFrame:
    """The rows, with all their columns, whose texts ``accepts`` (model, Arrow column) marks as true.

    Texts and the rest of a row pass through Python together: no join, no shuffle, no key needed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(accepts(shared.value, batch.column(at)), pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
