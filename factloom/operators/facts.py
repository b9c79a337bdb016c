"""The fact table as a pure function of the append-only operation log.

A unique fact closes, at its own valid_from, every fact of its (tenant, subject, predicate) that came
before it, was still valid-open and not yet retracted. As every unique fact closes all that is open, a
fact is closed by the *next* unique fact of its key, if any: no state is carried from row to row. Late
facts close earlier ones at a smaller time, which leaves an inverted span that is never visible; that is
the defined result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.temporal import overlaps
from factloom.schema import MAX_TIME, UNIQUE

KEY = ("tenant", "subject", "predicate")
#: Width of the ranges of an order's leading column that large keys are dealt by; of any other, DEFAULT.
RANGES = {"ingest_seq": 100_000, "tx_time": 86_400_000}
DEFAULT_RANGE = 100_000
#: Widths of the bins of the valid axis; an interval lies in at most FAN + 1 bins of the width of its length,
#: and one too long for all of them in a single one.
BINS_MS = (86_400_000, 32 * 86_400_000, 1024 * 86_400_000)
FAN = 32


def _place(order: Sequence[str]) -> Column:
    return F.struct(*order)


def next_unique(upserts: DataFrame, order: Sequence[str] = ("ingest_seq",), keys: Sequence[str] = KEY, width: int | None = None) -> DataFrame:
    """Adds ``closer``: struct(at, valid_from, edge_id) of the next unique fact of the key, or null.

    A key is divided by ranges of the order's leading column, a number, so that one with very many facts is
    many window groups, whenever and in however few batches they came. Within a range a window looks
    ahead; beyond it, the first unique fact of each later range is looked up in a table of one row per key
    and range.
    """
    width = width or RANGES.get(order[0], DEFAULT_RANGE)
    at = _place(order)
    mark = F.when(F.col("policy") == UNIQUE, F.struct(at.alias("at"), F.col("valid_from"), F.col("edge_id")))
    dealt = upserts.withColumn("__range", F.floor(F.col(order[0]) / width))
    ahead = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    near = dealt.withColumn("__near", F.first(mark, ignorenulls=True).over(ahead))
    firsts = dealt.groupBy(*keys, "__range").agg(F.min(mark).alias("__first"))
    later = Window.partitionBy(*keys).orderBy("__range").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.withColumn("__far", F.first("__first", ignorenulls=True).over(later)).select(*keys, "__range", "__far")
    same = [near[k].eqNullSafe(firsts[k]) for k in (*keys, "__range")]
    met = near.join(firsts, same, "left")
    return met.select(*[near[c] for c in upserts.columns], F.coalesce("__near", "__far").alias("closer"))


def retractions(ops: DataFrame, order: Sequence[str] = ("ingest_seq",)) -> DataFrame:
    """Per retracted edge: the place of its first retraction and the time of its last."""
    at = _place(order)
    return ops.filter("op = 'retract'").groupBy(F.col("retract_target").alias("edge_id")).agg(F.min(at).alias("first_retract"), F.max_by("tx_time", at).alias("tx_to"))


def spans(ops: DataFrame, order: Sequence[str] = ("ingest_seq",)) -> DataFrame:
    """Facts with their spans: the columns of the upserts, valid_to, tx_from, tx_to, invalidated_by.

    ``ops`` has op, edge_id, the key, valid_from, tx_time, policy and (for retractions) retract_target.
    """
    upserts = ops.filter("op = 'upsert'").drop("op", "retract_target")
    closed = next_unique(upserts, order)
    gone = retractions(ops, order)
    met = closed.join(gone, "edge_id", "left")
    closes = F.col("closer").isNotNull() & (F.col("first_retract").isNull() | (F.col("first_retract") > F.col("closer.at")))
    return met.select(
        *[c for c in upserts.columns if c != "tx_time"],
        F.when(closes, F.col("closer.valid_from")).alias("valid_to"),
        F.col("tx_time").alias("tx_from"),
        "tx_to",
        F.when(closes, F.col("closer.edge_id")).alias("invalidated_by"),
    )


def facts_to_invalidate(new: DataFrame, current: DataFrame) -> DataFrame:
    """(edge_id, invalidated_by) of the current facts that a batch of new facts of distinct keys closes."""
    mine = new.filter(F.col("policy") == UNIQUE).select(*KEY, F.col("edge_id").alias("invalidated_by"), F.col("valid_from").alias("valid_to"))
    open_now = current.filter("valid_to is null and tx_to is null").select(*KEY, "edge_id")
    return open_now.join(mine, list(KEY)).select("edge_id", "invalidated_by", "valid_to")


def overlapping_pairs(facts: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """(a, b) edge ids, a < b, of facts of one key whose valid intervals overlap.

    Of two that overlap, the one that starts first holds the other's start. So starts are joined with
    intervals on the key and a bin of the valid axis: an interval lies in the bins that it touches, of a
    width that fits its length; a start lies in one bin of every width. A key with very many facts is many
    groups, and what meets in a group is mostly output.
    """
    own = facts.select(*keys, "edge_id", "valid_from", "valid_to")
    end = F.coalesce("valid_to", F.lit(MAX_TIME))
    length, start = end - F.col("valid_from"), F.col("valid_from")
    level, first, last = F.lit(len(BINS_MS)), F.lit(0), F.lit(0)
    for i, width in reversed([*enumerate(BINS_MS)]):
        fits = F.col("valid_to").isNotNull() & (length <= FAN * width)
        level = F.when(fits, i).otherwise(level)
        first = F.when(fits, F.floor(start / width)).otherwise(first)
        last = F.when(fits, F.floor((end - 1) / width)).otherwise(last)
    held = own.filter(start < end).withColumns({"level": level, "bin": F.explode(F.sequence(first.cast("long"), last.cast("long")))}).alias("a")
    bins = [F.struct(F.lit(i).alias("level"), F.floor(start / width).cast("long").alias("bin")) for i, width in enumerate(BINS_MS)]
    bins.append(F.struct(F.lit(len(BINS_MS)).alias("level"), F.lit(0).cast("long").alias("bin")))
    points = own.select("*", F.inline(F.array(*bins))).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "level", "bin")]
    earlier = F.struct("a.valid_from", "a.edge_id") < F.struct("b.valid_from", "b.edge_id")
    met = held.join(points, [*same, earlier, overlaps("a", "b")])
    return met.select(F.least("a.edge_id", "b.edge_id").alias("a"), F.greatest("a.edge_id", "b.edge_id").alias("b"))


def believed_at(ops: DataFrame, tx_time: int, order: Sequence[str] = ("ingest_seq",)) -> DataFrame:
    """Extension: the facts as the log told them at a transaction time (operations up to it only)."""
    return spans(ops.filter(F.col("tx_time") <= tx_time), order)
