"""Provenance, access lists and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def provenance_of(facts: DataFrame, edge_id: int) -> DataFrame:
    """(doc, chunk) of a fact."""
    return facts.filter(F.col("edge_id") == edge_id).select("doc", "chunk")


def facts_from_doc(facts: DataFrame, doc: int) -> DataFrame:
    return facts.filter(F.col("doc") == doc)


def facts_from_chunk(facts: DataFrame, doc: int, chunk: int) -> DataFrame:
    return facts.filter((F.col("doc") == doc) & (F.col("chunk") == chunk))


def cascade_on_retract(facts: DataFrame, doc: int, at: int) -> DataFrame:
    """Retractions, as rows of the operation log, of all facts of a document that are not yet retracted."""
    hit = facts_from_doc(facts, doc).filter("tx_to is null")
    return hit.select(F.lit("retract").alias("op"), F.col("edge_id").alias("retract_target"), F.lit(at).cast("long").alias("tx_time"), "tenant")


def readable(facts: DataFrame, acl: DataFrame, principal: str) -> DataFrame:
    """Facts both of whose ends the principal may read; ``acl`` has (principal, node)."""
    mine = acl.filter(F.col("principal") == principal).select("node").distinct()
    first = facts.join(mine.select(F.col("node").alias("subject")), "subject", "left_semi")
    return first.join(mine.select(F.col("node").alias("object")), "object", "left_semi")


def episodes(turns: DataFrame, doc: str, chunk: str, text: str, reference_time) -> DataFrame:
    """Raw texts as episodes (doc, chunk, text, reference_time); the time anchors valid_from of its facts."""
    return turns.select(F.col(doc).cast("long").alias("doc"), F.col(chunk).cast("long").alias("chunk"), F.col(text).alias("text"), reference_time.cast("long").alias("reference_time"))
