"""Distributed connected components: local forests, then alternating large-star and small-star rounds.

Nodes are longs; a component's label is its smallest node. Every task first replaces the edges it reads by
stars that connect the same nodes, ``TASK_EDGES`` at a time. What one task can hold is done after a second
such pass; the rest goes through rounds on DataFrames. Each half round is an aggregate with map-side
combine (a node's smallest neighbour) and a join that adaptive execution may split, so a node with very
many edges needs no large task. Every half round is written to the shared folder: no lineage grows, and
a lost executor costs a task, not the rounds before. The driver sees only counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._common import drop_written, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Edges that a task of a round takes at least, and those that are made a forest at a time.
TASK_EDGES = 200_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to (node, smallest node of its component), without the smallest themselves."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # of roots the larger follows the smaller
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root = above
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _forest(most: int) -> Callable:
    """Edges (u, v) to stars that connect the same nodes, ``most`` edges at a time."""

    def made(held):
        u, v = stars(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if size + part.num_rows > most:
                    yield made(held)
                    held, size = [], 0
                held.append(tuple(c.to_numpy() for c in part.columns))
                size += part.num_rows
        if held:
            yield made(held)

    return run


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One half round. Edges have u > v; large-star links the larger neighbours of every node to its
    smallest neighbour, small-star the smaller ones and the node itself."""
    if large:
        arcs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        arcs = edges
    least = materialize(arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).coalesce(tasks), "least")
    if large:
        moved = edges.select(F.col("v").alias("u"), F.col("u").alias("far")).join(least, "u").select(F.col("far").alias("u"), F.col("m").alias("v"))
    else:
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    after = materialize(moved.filter("u > v").distinct().coalesce(tasks), "edges")
    drop_written(least)
    return after


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge to another; ``edges`` has longs a and b.

    Loops, repeated edges and edges with a null end change nothing. No edges: an empty table.
    """
    forest = {"through": _forest(TASK_EDGES), "schema": "u long, v long"}
    start = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialize(start, "edges", **forest)
    state = _state(edges)
    if 0 < state[0] <= TASK_EDGES:
        found = materialize(edges.coalesce(1), "edges", **forest)
        drop_written(edges)
        edges = found
    while state[0] > TASK_EDGES:
        tasks = -(-state[0] // TASK_EDGES)
        after = _star(_star(edges, True, tasks), False, tasks)
        now = _state(after)
        drop_written(edges)
        edges = after
        if now == state:
            break
        state = now
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
