"""Entity resolution: candidate pairs of similar names, survivors, and one rewrite of the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import name_similarity, name_tokens, normalize_name
from factloom.operators.graph import connected_components

CANDIDATE_THRESHOLD = 0.5


def candidate_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """(lo, hi, score) of node pairs whose names are similar; ``names`` has (node_id, name).

    Equal normal forms are grouped first. A form is indexed under its rarest tokens, as many as a match
    must hit (of n tokens, n - ceil(threshold * n) + 1): exact, and frequent words pair little.
    """
    alike, normal = _alike(names, threshold)
    a, b = normal.withColumnRenamed("node_id", "x"), normal.select(F.col("node_id").alias("y"), F.col("form").alias("form2"))
    different = alike.join(a, "form").join(b, "form2").select("x", "y", "score")
    equal = a.join(b, F.col("form") == F.col("form2")).filter("x < y").select("x", "y", F.lit(1.0).alias("score"))
    both = different.union(equal)
    return both.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "score")


def resolution_links(names: DataFrame, threshold: float) -> DataFrame:
    """(lo, hi) links whose components are those of :func:`candidate_pairs`, without the pairs inside a
    group of equal names: each name to the smallest node of its form, and between forms those nodes."""
    alike, normal = _alike(names, threshold)
    rep = normal.groupBy("form").agg(F.min("node_id").alias("rep"))
    inside = normal.join(rep, "form").select(F.col("rep").alias("lo"), F.col("node_id").alias("hi")).filter("lo < hi")
    a, b = rep.withColumnRenamed("rep", "x"), rep.select(F.col("rep").alias("y"), F.col("form").alias("form2"))
    between = alike.join(a, "form").join(b, "form2").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
    return inside.union(between)


def _alike(names: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(form, form2, score) of different normal forms that are similar, and (node_id, form)."""
    if threshold <= 0:
        raise ValueError("blocking needs a threshold above 0")
    normal = names.select("node_id", normalize_name(F.col("name")).alias("form")).filter("form <> ''")
    forms = normal.select("form").distinct()
    words = forms.select("form", F.explode(name_tokens(F.col("form"))).alias("word"))
    often = words.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    ranked = words.join(often, "word").groupBy("form").agg(F.sort_array(F.collect_list(F.struct("often", "word"))).alias("w"))
    n = F.size("w")
    prefix = (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int")
    blocks = ranked.select("form", F.explode(F.slice("w", F.lit(1), prefix)).alias("x")).select("form", F.col("x.word").alias("word"))
    other = blocks.select(F.col("form").alias("form2"), "word")
    met = blocks.join(other, "word").filter("form < form2").select("form", "form2").distinct()
    alike = met.withColumn("score", name_similarity(F.col("form"), F.col("form2"))).filter(F.col("score") >= threshold)
    return alike, normal


def candidates_of(names: DataFrame, node: int, threshold: float = CANDIDATE_THRESHOLD) -> DataFrame:
    """(node_id, score) of the nodes whose names resemble that of one node; none for an unknown node."""
    normal = names.select("node_id", normalize_name(F.col("name")).alias("form"))
    me = normal.filter(F.col("node_id") == node).select(F.col("form").alias("mine"))
    met = normal.filter(F.col("node_id") != node).crossJoin(F.broadcast(me.limit(1)))  # one row
    return met.withColumn("score", name_similarity(F.col("form"), F.col("mine"))).filter(F.col("score") >= threshold).select("node_id", "score")


def tenant_names(facts: DataFrame, nodes: DataFrame, tenant: int) -> DataFrame:
    """Names of the nodes that any version of a tenant's facts refers to; facts have subject_id, object_id."""
    ends = facts.filter(F.col("tenant") == tenant).select(F.explode(F.array("subject_id", "object_id")).alias("node_id")).distinct()
    return nodes.join(ends, "node_id", "left_semi")


def survivors(pairs: DataFrame) -> DataFrame:
    """(node, survivor) of every node in a pair: the smallest node of its group survives. Merging pair by
    pair in order of score comes to the same."""
    return connected_components(pairs.select(F.col("lo").alias("a"), F.col("hi").alias("b"))).withColumnRenamed("component", "survivor")


def merged_count(labels: DataFrame) -> int:
    """How many nodes give way."""
    return labels.filter("node <> survivor").count()


def _little_endian(column: str) -> list:
    """Order by the bytes of an id, lowest first: the scan order of a store with little-endian keys."""
    return [F.col(column).bitwiseAND(F.lit(255))] + [F.shiftrightunsigned(F.col(column), 8 * i).bitwiseAND(F.lit(255)) for i in range(1, 8)]


def merge_facts(facts: DataFrame, labels: DataFrame, compat_scan_order: bool = False) -> DataFrame:
    """The facts with ends replaced by survivors; of rows that become equal in tenant, subject, predicate,
    object and valid_from, one stays: an untouched row before a rewritten one, then the smallest edge_id.
    Untouched rows are never dropped. ``compat_scan_order``: a rewritten row is dropped only if an equal
    one comes earlier in the scan order of little-endian ids."""
    s = labels.select(F.col("node").alias("subject_id"), F.col("survivor").alias("__s"))
    o = labels.select(F.col("node").alias("object_id"), F.col("survivor").alias("__o"))
    met = facts.join(s, "subject_id", "left").join(o, "object_id", "left")
    touched = (F.coalesce("__s", "subject_id") != F.col("subject_id")) | (F.coalesce("__o", "object_id") != F.col("object_id"))
    moved = met.withColumn("__touched", touched).withColumns({"subject_id": F.coalesce("__s", "subject_id"), "object_id": F.coalesce("__o", "object_id")})
    key = ["tenant", "subject_id", "predicate_id", "object_id", "valid_from"]
    order = _little_endian("edge_id") if compat_scan_order else [F.col("__touched"), F.col("edge_id")]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return moved.withColumn("__n", place).filter(~F.col("__touched") | (F.col("__n") == 1)).select(*facts.columns)


def merge_names(nodes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionary without the names that gave way, and (name, node_id) aliases that point to survivors."""
    gone = labels.filter("node <> survivor")
    rest = nodes.join(gone.select(F.col("node").alias("node_id")), "node_id", "left_anti")
    alias = nodes.join(gone.select(F.col("node").alias("node_id"), "survivor"), "node_id").select("name", F.col("survivor").alias("node_id"))
    return rest, alias
