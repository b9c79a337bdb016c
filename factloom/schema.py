"""Schemas of the engine's relations, and time sentinels.

Times are epoch milliseconds as longs: the sentinels are the ends of the long range, which timestamps in
microseconds cannot hold. Ids are longs; unsigned ids above 2**63 - 1 are not supported.
"""

from __future__ import annotations

from pyspark.sql import types as T

MAX_TIME = (1 << 63) - 1
MIN_TIME = -(1 << 63)
DEFAULT_TENANT = 0

APPEND, UNIQUE, SEMANTIC = "append", "unique", "semantic"
POLICIES = (APPEND, UNIQUE, SEMANTIC)


def _schema(longs: str, strings: str = "") -> T.StructType:
    kinds = dict.fromkeys(longs.split(), T.LongType()) | dict.fromkeys(strings.split(), T.StringType())
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


OPS = T.StructType(
    [
        T.StructField("ingest_seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("edge_id", T.LongType()),
        T.StructField("tenant", T.LongType()),
        T.StructField("subject", T.StringType()),
        T.StructField("predicate", T.StringType()),
        T.StructField("object", T.StringType()),
        T.StructField("valid_from", T.LongType()),
        T.StructField("tx_time", T.LongType()),
        T.StructField("doc", T.LongType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("policy", T.StringType()),
        T.StructField("embedding_id", T.LongType()),
        T.StructField("retract_target", T.LongType()),
    ]
)
FACTS = _schema("edge_id tenant subject_id predicate_id object_id valid_from valid_to tx_from tx_to doc chunk embedding_id")
NODES = _schema("node_id", "name")
PREDICATES = _schema("predicate_id", "name")
VERSION_LOG = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("commit_seq", T.LongType()), T.StructField("value", T.BinaryType())])
EPISODES = T.StructType([T.StructField("doc", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("text", T.StringType()), T.StructField("reference_time", T.LongType())])
CONTEXT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("citations", T.ArrayType(T.StructType([T.StructField("doc", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("snippet", T.StringType())]))),
    ]
)
