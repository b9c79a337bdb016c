"""The append-only operation log: the one stored truth, from which everything else is derived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.schema import OPS


class OperationLog:
    """Operations in Parquet folders, one per batch; a batch counts once its success marker is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batches(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/ops")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        folders = [s.getPath() for s in fs.listStatus(at)]
        return sorted(int(p.getName().removeprefix("batch=")) for p in folders if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        """All operations, as written."""
        batches = self._batches()
        if not batches:
            return self.spark.createDataFrame([], OPS)
        return self.spark.read.schema(OPS).parquet(*[f"{self.path}/ops/batch={b:012d}" for b in batches])

    def append(self, ops: DataFrame, batch: int | None = None) -> int:
        """Write a batch. Writing a batch of the same number again replaces it, so a repeated micro-batch
        of a stream counts once."""
        batch = (max(self._batches(), default=-1) + 1) if batch is None else batch
        known = {f.name: F.col(f.name) if f.name in ops.columns else F.lit(None) for f in OPS}
        ops.select(*[known[f.name].cast(f.dataType).alias(f.name) for f in OPS]).write.mode("overwrite").parquet(f"{self.path}/ops/batch={batch:012d}")
        return batch

    def counters(self) -> tuple[int, int]:
        """The next ingest_seq and edge_id: one past the largest written."""
        row = self.read().agg(F.max("ingest_seq"), F.max("edge_id")).first()
        return (row[0] or 0) + 1, (row[1] or 0) + 1
