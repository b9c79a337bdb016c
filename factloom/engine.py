"""The engine: a store of facts over an operation log, and the questions it answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import lineage
from factloom.config import EngineConfig
from factloom.errors import NotFoundError
from factloom.functions.temporal import AsOf, as_of
from factloom.operators import dictionary, facts as fact_ops, graph, resolution, retrieval
from factloom.plans import compile as plans
from factloom.schema import DEFAULT_TENANT, MAX_TIME, OPS, UNIQUE
from factloom.sources.oplog import OperationLog


class Engine:
    """Facts, names and communities are derived from the log whenever they are asked for, so opening an
    engine on an existing folder is its whole recovery. A merge of entities is an operation of its own in
    the log: names that gave way are rewritten in what came before it."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], int] = lambda: time.time_ns() // 1_000_000):
        self.spark, self.clock = spark, clock
        self.log = OperationLog(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, config: EngineConfig) -> "Engine":
        return cls(spark, config.data_dir)

    # -- writing

    def ingest(self, rows: DataFrame) -> None:
        """A batch of facts (tenant, subject, predicate, object, valid_from, doc, chunk, policy, and an
        ``at`` that orders them); ids follow on from the log's."""
        seq, edge = self.log.counters()
        numbered = dictionary.number_rows(rows, "at", name="n", start=0)
        named = numbered.withColumns({"ingest_seq": F.col("n") + seq, "edge_id": F.col("n") + edge, "tx_time": F.lit(self.clock()).cast("long"), "op": F.lit("upsert")})
        self.log.append(named)

    def _append(self, rows: Iterable[dict]) -> None:
        self.log.append(self.spark.createDataFrame([tuple(r.get(f.name) for f in OPS) for r in rows], OPS).coalesce(1))

    def add_memory(self, subject: str, predicate: str, obj: str, valid_from: int = 0, doc: int = 0, chunk: int = 0, policy: str = UNIQUE, tenant: int = DEFAULT_TENANT) -> int:
        """One fact; its edge id."""
        seq, edge = self.log.counters()
        self._append([{"ingest_seq": seq, "op": "upsert", "edge_id": edge, "tenant": tenant, "subject": subject, "predicate": predicate, "object": obj, "valid_from": valid_from, "tx_time": self.clock(), "doc": doc, "chunk": chunk, "policy": policy}])
        return edge

    def retract(self, edge_id: int, at: int) -> None:
        """End a fact's transaction time, whatever the tenant. An unknown id changes nothing."""
        seq, _ = self.log.counters()
        self._append([{"ingest_seq": seq, "op": "retract", "retract_target": edge_id, "tx_time": at}])

    # -- reading

    def _renamed(self, ops: DataFrame) -> DataFrame:
        """The log with the names that merges replaced. A name takes that of its group's smallest node, in
        what its tenant wrote before the merge; a merge of the default tenant also holds for what follows."""
        merges = ops.filter("op = 'merge'")
        own = self._ids(merges.select("tenant", "subject", "object", "ingest_seq"))
        node = lambda c: F.shiftleft(F.col("tenant"), 40).bitwiseOR(F.col(c))
        labels = graph.connected_components(own.select(node("subject_id").alias("a"), node("object_id").alias("b")))
        last = own.groupBy("tenant", F.col("subject").alias("old"), F.col("subject_id").alias("i")).agg(F.max("ingest_seq").alias("until"))
        last = last.withColumn("node", F.shiftleft(F.col("tenant"), 40).bitwiseOR(F.col("i"))).join(labels, "node")
        every = dictionary.intern_nodes(self.log.read().filter("op = 'upsert'")).select(F.col("node_id").alias("j"), F.col("name").alias("new"))
        named = last.withColumn("j", F.col("component").bitwiseAND(F.lit((1 << 40) - 1))).join(every, "j").select("tenant", "old", "new", "until")
        always = F.lit(MAX_TIME)
        named = lineage.written(named.withColumn("until", F.when(F.col("tenant") == DEFAULT_TENANT, always).otherwise(F.col("until"))), "names")
        upserts = ops.filter("op = 'upsert'")
        for side in ("subject", "object"):
            mine = named.select("tenant", F.col("old").alias(side), F.col("new").alias("__new"), "until")
            met = upserts.join(mine, ["tenant", side], "left")
            renamed = F.when(F.col("ingest_seq") < F.col("until"), F.col("__new")).otherwise(F.col(side))
            upserts = met.withColumn(side, F.coalesce(renamed, F.col(side))).select(*ops.columns)
        return upserts

    def facts(self) -> DataFrame:
        """All facts of all tenants and versions, with names and spans."""
        ops = self.log.read()
        closed = fact_ops.spans(ops.filter("op in ('upsert', 'retract')"))
        if ops.filter("op = 'merge'").isEmpty():
            return closed
        # spans are those of the keys as written; merged duplicates of one valid_from fold into one row
        names = self._renamed(ops).select("edge_id", F.col("subject").alias("s"), F.col("object").alias("o"))
        moved = closed.join(names, "edge_id").withColumn("touched", (F.col("s") != F.col("subject")) | (F.col("o") != F.col("object")))
        moved = moved.withColumns({"subject": F.col("s"), "object": F.col("o")}).drop("s", "o")
        place = F.row_number().over(Window.partitionBy("tenant", "subject", "predicate", "object", "valid_from").orderBy("touched", "edge_id"))
        return moved.withColumn("n", place).filter(~F.col("touched") | (F.col("n") == 1)).drop("n", "touched")

    def nodes(self) -> DataFrame:
        """(node_id, name) of names that no merge of the default tenant took away."""
        ops = self.log.read()
        every = dictionary.intern_nodes(ops.filter("op = 'upsert'"))
        gone = ops.filter(f"op = 'merge' and tenant = {DEFAULT_TENANT}").select(F.col("subject").alias("name"))
        return every.join(gone, "name", "left_anti").select("node_id", "name")

    def get_fact(self, edge_id: int) -> DataFrame:
        found = self.facts().filter(F.col("edge_id") == edge_id)
        if found.isEmpty():
            raise NotFoundError(f"edge {edge_id}")
        return found

    def as_of(self, at: AsOf | None = None, tenant: int | None = None) -> DataFrame:
        return as_of(self.facts(), at or AsOf.now(), tenant)

    def answer(self, source: str, tenant: int = DEFAULT_TENANT) -> dict:
        """The context of a query: text and citations."""
        row = plans.answer(source, self.facts(), tenant).first()
        return {"text": row["text"], "citations": [c.asDict() for c in row["citations"]]}

    def retrieve(self, similar_to: str | None, budget: int, at: AsOf | None = None, tenant: int = DEFAULT_TENANT) -> retrieval.Subgraph:
        """Edges and nodes (by first appearance) of the context that fits a budget."""
        cut = retrieval.within_budget(retrieval.ranked_facts(self.facts(), at, similar_to, tenant), budget)
        return retrieval.Subgraph(nodes=retrieval.subgraph_nodes(cut), edges=cut)

    # -- communities and entities

    def _ids(self, ops: DataFrame) -> DataFrame:
        every = dictionary.intern_nodes(self.log.read().filter("op = 'upsert'"))
        s = every.select(F.col("node_id").alias("subject_id"), F.col("name").alias("subject"))
        o = every.select(F.col("node_id").alias("object_id"), F.col("name").alias("object"))
        return ops.join(s, "subject").join(o, "object")

    def communities(self, tenant: int = DEFAULT_TENANT) -> DataFrame:
        """(id, members, summary) over every fact the tenant ever had; merged names stay members."""
        ops = self.log.read()
        own = self._ids(ops.filter((F.col("op").isin("upsert", "merge")) & (F.col("tenant") == tenant)))
        labels = graph.connected_components(own.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b")))
        current = self._ids(self.facts().filter(F.col("tenant") == tenant))
        return graph.community_summaries(current, self.nodes(), labels, tenant).orderBy("id")

    def candidates(self, threshold: float, tenant: int = DEFAULT_TENANT) -> DataFrame:
        """(keep, drop, keep_name, drop_name, score) of similar names among the tenant's entities."""
        own = self._ids(self.facts().filter(F.col("tenant") == tenant))
        nodes = self.nodes()
        pairs = resolution.candidate_pairs(resolution.tenant_names(own, nodes, tenant), threshold)
        keep = nodes.select(F.col("node_id").alias("lo"), F.col("name").alias("keep_name"))
        drop = nodes.select(F.col("node_id").alias("hi"), F.col("name").alias("drop_name"))
        named = pairs.join(keep, "lo").join(drop, "hi")
        return named.select(F.col("lo").alias("keep"), F.col("hi").alias("drop"), "keep_name", "drop_name", "score").orderBy(F.desc("score"), "keep", "drop")

    def resolve(self, threshold: float, dry_run: bool = False, tenant: int = DEFAULT_TENANT) -> dict:
        """Merge entities of similar names: how many gave way, and the candidates from before, a DataFrame.

        What is merged follows from links, of which a group of equal names has one a name; the pairs of
        such a group are only written out where the candidates are read."""
        found = self.candidates(threshold, tenant)
        if dry_run:
            return {"merged": 0, "candidates": found}
        nodes = self.nodes()
        own = self._ids(self.facts().filter(F.col("tenant") == tenant))
        links = resolution.resolution_links(resolution.tenant_names(own, nodes, tenant), threshold)
        gone = resolution.survivors(links).filter("node <> survivor")
        gone = gone.join(nodes.select(F.col("node_id").alias("node"), F.col("name").alias("subject")), "node")
        gone = gone.join(nodes.select(F.col("node_id").alias("survivor"), F.col("name").alias("object")), "survivor")
        gone = lineage.written(gone, "merges")
        merged = gone.count()
        if merged:
            seq, _ = self.log.counters()
            numbered = dictionary.number_rows(gone, "node", name="n", start=0)
            self.log.append(numbered.withColumns({"ingest_seq": F.col("n") + seq, "op": F.lit("merge"), "tenant": F.lit(tenant), "tx_time": F.lit(self.clock()).cast("long")}))
        return {"merged": merged, "candidates": found}
