"""Bitemporal predicates. Intervals are half-open; a null upper bound is open and counts as the maximum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.schema import MAX_TIME


@dataclass(frozen=True)
class AsOf:
    """A point on both time axes. "Now" is the maximum on both, not the clock: what has any upper bound
    is past, however far ahead the bound lies."""

    valid_time: int = MAX_TIME
    tx_time: int = MAX_TIME

    @staticmethod
    def now() -> "AsOf":
        return AsOf()

    @staticmethod
    def valid(at: int) -> "AsOf":
        return AsOf(valid_time=at)

    @staticmethod
    def transaction(at: int) -> "AsOf":
        return AsOf(tx_time=at)


def covers(start: str, end: str, at: int) -> Column:
    """start <= at < end."""
    return (F.col(start) <= F.lit(at)) & (F.col(end).isNull() | (F.lit(at) < F.col(end)))


def visible_at(at: AsOf) -> Column:
    """Whether a fact's span covers the point on both axes."""
    return covers("valid_from", "valid_to", at.valid_time) & covers("tx_from", "tx_to", at.tx_time)


def is_open() -> Column:
    """Whether a fact was not retracted."""
    return F.col("tx_to").isNull()


def as_of(facts: DataFrame, at: AsOf, tenant: int | None = None) -> DataFrame:
    """The facts visible at a point, of one tenant or of all. A filter: it reaches the scan."""
    found = facts.filter(visible_at(at))
    return found if tenant is None else found.filter(F.col("tenant") == tenant)


def active_at(facts: DataFrame, at: AsOf) -> DataFrame:
    """Edge ids active at a point, whatever the tenant: what an interval index would answer. Files sorted by
    valid_from let the scan skip by their statistics."""
    return facts.filter(visible_at(at)).select("edge_id")


def open_span(df: DataFrame, valid_from: Column, tx_from: Column) -> DataFrame:
    """Span columns open at both ends."""
    none = F.lit(None).cast("long")
    return df.withColumns({"valid_from": valid_from, "valid_to": none, "tx_from": tx_from, "tx_to": none})


def close_valid(df: DataFrame, at: Column) -> DataFrame:
    """Set the valid end, whatever it was."""
    return df.withColumn("valid_to", at)


def close_tx(df: DataFrame, at: Column) -> DataFrame:
    """Set the transaction end, whatever it was."""
    return df.withColumn("tx_to", at)


def overlaps(a: str, b: str) -> Column:
    """Whether the valid intervals of two aliases overlap."""
    end = lambda x: F.coalesce(F.col(f"{x}.valid_to"), F.lit(MAX_TIME))
    return (F.col(f"{a}.valid_from") < end(b)) & (F.col(f"{b}.valid_from") < end(a))
