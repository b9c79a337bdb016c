"""Connected components, communities and expansion over facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.temporal import AsOf, as_of
from factloom.functions.text import display_name, verbalize
from factloom.lineage import dropped, written


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _half_round(edges: DataFrame, large: bool) -> DataFrame:
    arcs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    if large:
        moved = edges.select(F.col("v").alias("u"), F.col("u").alias("far")).join(least, "u").select(F.col("far").alias("u"), F.col("m").alias("v"))
    else:
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    after = written(moved.filter("u > v").distinct(), "edges")
    dropped(least)
    dropped(edges)
    return after


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the component is its smallest node. Edges have a and b; further nodes without
    edges may be given.

    Alternating star rounds (large-star, small-star) until nothing moves: a logarithmic number of rounds
    of aggregates with map-side combine and joins, whatever the degree of a node. The tables of a round are
    deleted when the next is written.
    """
    start = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(start, "edges")
    state = _digest(now)
    while state[0]:
        now = _half_round(_half_round(now, True), False)
        after = _digest(now)
        if after == state:
            break
        state = after
    linked = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = linked.union(roots)
    everyone = edges.select(F.explode(F.array("a", "b")).alias("node"))
    if nodes is not None:
        everyone = everyone.union(nodes.select("node"))
    alone = everyone.distinct().filter("node is not null").join(found.select("node"), "node", "left_anti")
    return found.union(alone.select("node", F.col("node").alias("component")))


def extend_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Components after further edges: known labels contract to one edge per node."""
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return connected_components(known.union(edges.select("a", "b")))


def communities(labels: DataFrame, level: int = 0) -> DataFrame:
    """(id, members ascending, level). There is one level, 0; any other has no rows."""
    grouped = labels.groupBy(F.col("component").alias("id")).agg(F.sort_array(F.collect_list("node")).alias("members"))
    return grouped.withColumn("level", F.lit(0)).filter(F.lit(level == 0))


def community_of(labels: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, component) of the asked nodes, null for one that is not known."""
    return asked.select("node").join(labels, "node", "left")


def community_summaries(facts: DataFrame, nodes: DataFrame, labels: DataFrame, tenant: int | None = None) -> DataFrame:
    """(id, members, summary) per community: names in order of id, and the sentences of the current facts
    whose subject belongs to it, in order of edge_id. Facts have subject_id and the three names."""
    member = labels.join(nodes.select(F.col("node_id").alias("node"), "name"), "node", "left").withColumn("name", display_name(F.col("name"), F.col("node")))
    grouped = member.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("node", "name"))).alias("m"))
    current = as_of(facts, AsOf.now(), tenant).withColumn("line", verbalize(F.col("subject"), F.col("predicate"), F.col("object")))
    lines = current.join(labels.withColumnRenamed("node", "subject_id"), "subject_id").groupBy("component").agg(F.sort_array(F.collect_list(F.struct("edge_id", "line"))).alias("f"))
    met = grouped.join(lines, "component", "left")
    names = F.transform("m", lambda x: x["name"])
    told = F.coalesce(F.array_join(F.transform("f", lambda x: x["line"]), "; "), F.lit("none"))
    summary = F.concat(F.lit("Community of "), F.size("m").cast("string"), F.lit(" entities ("), F.array_join(names, ", "), F.lit("). Current facts: "), told)
    return met.select(F.col("component").alias("id"), names.alias("members"), summary.alias("summary"))


def expand(facts: DataFrame, seeds: DataFrame, depth: int, at: AsOf | None = None) -> DataFrame:
    """(node, hops): nodes within ``depth`` hops of the seeds along facts visible at a point, either way.

    Breadth-first: each round joins the frontier alone, and is written before the next.
    """
    seen_facts = as_of(facts, at or AsOf.now())
    arcs = seen_facts.select(F.col("subject").alias("a"), F.col("object").alias("b"))
    arcs = arcs.union(arcs.select("b", "a"))
    reached = written(seeds.select("node").distinct().withColumn("hops", F.lit(0)), "reached")
    frontier = reached
    for hop in range(1, depth + 1):
        step = frontier.select(F.col("node").alias("a")).join(arcs, "a").select(F.col("b").alias("node")).distinct()
        frontier = written(step.join(reached, "node", "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached
