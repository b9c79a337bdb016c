"""From ranked facts to budgeted context: the question pipeline as DataFrame steps.

Every line costs at least one token, so at most ``budget`` lines can fit: rows are limited to that many
before the running sum, and the only unpartitioned window sees a bounded number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.config import ScoringWeights
from factloom.functions.temporal import AsOf, as_of
from factloom.functions.text import token_cost, verbalize
from factloom.operators.fulltext import bm25

#: The largest number that a limit takes; every line costs 1 at least, so more never fit a result.
MAX_ROWS = 2**31 - 1

DEFAULT_BUDGET = 4096


@dataclass(frozen=True)
class Subgraph:
    """Parts of the graph that answer a question; a part may be missing."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    episodes: DataFrame | None = None
    communities: DataFrame | None = None

    def is_empty(self) -> bool:
        return all(part is None or part.isEmpty() for part in (self.nodes, self.edges, self.episodes, self.communities))


def sentences(facts: DataFrame) -> DataFrame:
    """Adds the sentence of a fact."""
    return facts.withColumn("sentence", verbalize(F.col("subject"), F.col("predicate"), F.col("object")))


def ranked_facts(facts: DataFrame, at: AsOf | None = None, similar_to: str | None = None, tenant: int | None = None) -> DataFrame:
    """Visible facts with score and sentence. The text score's corpus is *all* facts, of all tenants and
    all versions; the point in time and the tenant apply to what it returns. Without a text every score
    is 1. Ranking order: score descending, edge_id descending."""
    seen = sentences(as_of(facts, at or AsOf.now(), tenant))
    if similar_to is None:
        return seen.withColumn("score", F.lit(1.0))
    scores = bm25(sentences(facts), similar_to, "edge_id", "sentence").withColumnRenamed("key", "edge_id")
    return seen.join(scores, "edge_id")


def within_budget(ranked: DataFrame, budget: int = DEFAULT_BUDGET, cost: Column | None = None) -> DataFrame:
    """The longest prefix of the ranking whose cost fits: rank, cost and running cost are added. The first
    line that does not fit ends it."""
    cost = token_cost(F.col("sentence")) if cost is None else cost
    top = ranked.orderBy(F.desc("score"), F.desc("edge_id")).limit(min(max(0, budget), MAX_ROWS))
    order = Window.orderBy(F.desc("score"), F.desc("edge_id"))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = top.withColumn("cost", cost.cast("long")).withColumns({"rank": F.row_number().over(order), "used": F.sum("cost").over(run)})
    return placed.filter(F.col("used") <= budget)


def context(cut: DataFrame, cite: bool = False) -> DataFrame:
    """One row: the lines as text, and citations (doc, chunk, snippet) in rank order (none unless asked)."""
    lines = F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("- "), "sentence").alias("line"), "doc", "chunk", F.col("sentence").alias("snippet"))))
    rows = cut.agg(lines.alias("rows"))
    citations = F.transform("rows", lambda r: F.struct(r["doc"].alias("doc"), r["chunk"].alias("chunk"), r["snippet"].alias("snippet")))
    return rows.select(F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"), (citations if cite else F.slice(citations, 1, 0)).alias("citations"))


def subgraph_nodes(cut: DataFrame) -> DataFrame:
    """(name, position): ends of the chosen facts in the order of first appearance, subject before object."""
    ends = cut.select(F.explode(F.array(F.struct((F.col("rank") * 2).alias("at"), F.col("subject").alias("name")), F.struct((F.col("rank") * 2 + 1).alias("at"), F.col("object").alias("name")))).alias("x"))
    first = ends.groupBy("x.name").agg(F.min("x.at").alias("at"))
    return first.select("name", F.row_number().over(Window.orderBy("at")).cast("long").alias("position"))  # two rows a line of the budget


def greedy_budget(edges: DataFrame, nodes: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Edges (pos, subject_id, predicate_id, object_id) kept in order while the words of both names plus
    one fit, and the nodes that they use. A missing name costs 1."""
    words = lambda c: F.when(F.col(c).isNull(), 1).otherwise(F.size(F.filter(F.split(F.col(c), r"(?U)\s+"), lambda w: w != "")))
    s = nodes.select(F.col("node_id").alias("subject_id"), F.col("name").alias("__s"))
    o = nodes.select(F.col("node_id").alias("object_id"), F.col("name").alias("__o"))
    top = edges.orderBy("pos").limit(min(max(0, budget), MAX_ROWS))
    met = top.join(s, "subject_id", "left").join(o, "object_id", "left").withColumn("cost", words("__s") + words("__o") + 1)
    run = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kept = met.withColumn("used", F.sum("cost").over(run)).filter(F.col("used") <= budget)
    used = kept.select(F.explode(F.array("subject_id", "object_id")).alias("node_id")).distinct()
    return kept.select(*edges.columns), nodes.join(used, "node_id", "left_semi")


def serialize_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row, text: a line ``- subject rel#id object`` per edge in order of pos, each line once; a
    missing name shows as ?. For a subgraph that already fits a budget."""
    s = nodes.select(F.col("node_id").alias("subject_id"), F.col("name").alias("__s"))
    o = nodes.select(F.col("node_id").alias("object_id"), F.col("name").alias("__o"))
    met = edges.join(s, "subject_id", "left").join(o, "object_id", "left")
    unknown = F.lit("?")
    line = F.concat(F.lit("- "), F.coalesce("__s", unknown), F.lit(" rel#"), F.col("predicate_id").cast("string"), F.lit(" "), F.coalesce("__o", unknown))
    lines = met.groupBy(line.alias("line")).agg(F.min("pos").alias("pos"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "line")))
    return lines.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def hybrid_score(weights: ScoringWeights | None = None, vector: str = "vector", text: str = "text", structure: str = "structure", recency: str = "recency", validity: str = "validity") -> Column:
    """The weighted sum of five signals that the caller has normalised."""
    w = weights or ScoringWeights()
    parts = ((w.vector, vector), (w.text, text), (w.structure, structure), (w.recency, recency), (w.validity, validity))
    total = F.lit(0.0)
    for weight, name in parts:
        total = total + F.lit(weight) * F.col(name)
    return total
