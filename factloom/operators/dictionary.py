"""Names and ids: interning in first-seen order, dense numbering, lookups with fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import display_name, verbalize
from factloom.lineage import written


def number_rows(df: DataFrame, *order: str, name: str = "id", start: int = 1, partitions: int | None = None) -> DataFrame:
    """Adds dense numbers in a total order without one task that sorts all rows.

    Rows are range-partitioned and sorted, numbered within their partition, and shifted by the sizes of
    the partitions before: the only unpartitioned step sees one row per partition.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    met = placed.join(before, "__part")
    return met.select(*df.columns, (F.col("__before") + F.col("__row") + F.lit(start)).alias(name))


def intern_nodes(ops: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """(node_id, name): ids from 1 in the order in which names are first seen, subject before object.

    Exact, case-sensitive names; shared by all tenants.
    """
    sides = ops.select(F.explode(F.array(F.struct((F.col(order) * 2).alias("at"), F.col("subject").alias("name")), F.struct((F.col(order) * 2 + 1).alias("at"), F.col("object").alias("name")))).alias("x"))
    first = sides.select("x.*").groupBy("name").agg(F.min("at").alias("at")).filter("name is not null")
    return number_rows(first, "at", "name", name="node_id").select("node_id", "name")


def intern_predicates(ops: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """(predicate_id, name): an id space of its own."""
    first = ops.groupBy(F.col("predicate").alias("name")).agg(F.min(order).alias("at")).filter("name is not null")
    return number_rows(first, "at", "name", name="predicate_id").select("predicate_id", "name")


def encode_facts(facts: DataFrame, nodes: DataFrame, predicates: DataFrame) -> DataFrame:
    """Facts with ids in place of names. The dictionaries join as their size allows (adaptive)."""
    subject = nodes.select(F.col("node_id").alias("subject_id"), F.col("name").alias("subject"))
    obj = nodes.select(F.col("node_id").alias("object_id"), F.col("name").alias("object"))
    predicate = predicates.select("predicate_id", F.col("name").alias("predicate"))
    return facts.join(subject, "subject").join(obj, "object").join(predicate, "predicate").drop("subject", "object", "predicate")


def decode_facts(facts: DataFrame, nodes: DataFrame, predicates: DataFrame) -> DataFrame:
    """Adds subject, predicate, object and the sentence; ids without a name show as node#id and rel#id."""
    subject = nodes.select(F.col("node_id").alias("subject_id"), F.col("name").alias("__s"))
    obj = nodes.select(F.col("node_id").alias("object_id"), F.col("name").alias("__o"))
    predicate = predicates.select("predicate_id", F.col("name").alias("__p"))
    met = facts.join(subject, "subject_id", "left").join(obj, "object_id", "left").join(predicate, "predicate_id", "left")
    named = met.withColumns(
        {
            "subject": display_name(F.col("__s"), F.col("subject_id")),
            "predicate": display_name(F.col("__p"), F.col("predicate_id"), "rel"),
            "object": display_name(F.col("__o"), F.col("object_id")),
        }
    ).drop("__s", "__p", "__o")
    return named.withColumn("sentence", verbalize(F.col("subject"), F.col("predicate"), F.col("object")))


def put_names(names: DataFrame, updates: DataFrame, id_col: str) -> DataFrame:
    """The dictionary with the display names of some ids set or replaced."""
    rest = names.join(updates.select(id_col), id_col, "left_anti")
    return rest.unionByName(updates.select(*rest.columns))
