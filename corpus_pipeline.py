"""The training-data pipeline: quality, language, lines, near duplicates, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Between
stages the documents are written as Parquet and read again. All stages but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.

Defined cases: an empty table passes through every stage; rows of a null doc_id are judged by their text
like any other and never count as near duplicates; rows that repeat a doc_id are documents of their own,
of which near-duplicate removal keeps or drops each by its text; of rows that repeat a doc_id and a text
one stays; ``n_chars`` follows the text where lines are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import language, lines, minhash, packing, quality
from factloom.llm._common import fresh_path, materialize, reachable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = reachable(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs.select(*COLUMNS), labels)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject."""
    return language.keep(docs.select(*COLUMNS))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which no line is left go, as their lines stay elsewhere."""
    found = lines.dedup_lines(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    left = found.filter(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8), that of the smallest
    doc_id. Rows are numbered first, as a doc_id may be that of several texts."""
    number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    rows = materialize(docs.select(*COLUMNS, number.alias("row")), "rows")
    found = minhash.near_duplicates(rows, words=5, percent=80, id_col="row")
    placed = found.filter("doc_id is not null").select(F.col("doc_id").alias("row"), "component_id")
    members = placed.join(rows.select("row", "doc_id"), "row")
    first = members.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row")).alias("first"))
    first = materialize(first.filter("n > 1").select("component_id", F.col("first.row").alias("stays")), "first-rows")
    gone = placed.join(first, "component_id").filter("row <> stays").select("row")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, with the checksum of each piece's ids."""
    import public_tokenizers

    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The classifiers, similarity of sets and tokenizers are beyond SQL: tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = reachable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
