"""Extension: continuous ingestion of operations with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.schema import UNIQUE
from factloom.sources.oplog import OperationLog


def append_stream(operations: DataFrame, log: OperationLog, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream of operations to the log, one batch per micro-batch. The batch's number is the
    micro-batch's, so one that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        log.append(batch, number)

    return operations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def closures(operations: DataFrame) -> DataFrame:
    """A stream of (edge_id, valid_to, invalidated_by): which facts each unique fact closes, with the open
    edges of a (tenant, subject, predicate) as keyed state. Within a micro-batch the order is ingest_seq."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_edges = list(state.get[0]) if state.exists else []
        closed = []
        rows = pd.concat(list(parts)).sort_values("ingest_seq")
        for row in rows.itertuples():
            if row.policy == UNIQUE:
                closed += [(edge, row.valid_from, row.edge_id) for edge in open_edges]
                open_edges = []
            open_edges.append(row.edge_id)
        state.update((open_edges,))
        yield pd.DataFrame(closed, columns=["edge_id", "valid_to", "invalidated_by"])

    keyed = operations.filter("op = 'upsert'").select("tenant", "subject", "predicate", "ingest_seq", "edge_id", "valid_from", "policy")
    return keyed.groupBy("tenant", "subject", "predicate").applyInPandasWithState(step, "edge_id long, valid_to long, invalidated_by long", "open_edges array<long>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(operations: DataFrame, width: str = "1 hour", late: str = "6 hours") -> DataFrame:
    """Facts per predicate and window of transaction time, with a watermark for late ones."""
    timed = operations.filter("op = 'upsert'").withColumn("ts", F.timestamp_millis("tx_time")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "predicate").agg(F.count(F.lit(1)).alias("n"))
