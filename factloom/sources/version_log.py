"""A versioned key-value log: multi-version reads, scans in key order, atomic batches.

The log is a table (key binary, commit_seq long, value binary) where a null value is a tombstone. A
commit appends one immutable Parquet folder and publishes it by a manifest file; readers take the commits
that the manifests name, so a half-written batch is never seen.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.errors import StorageError
from factloom.schema import VERSION_LOG


def snapshot(log: DataFrame, read_seq: int) -> DataFrame:
    """(key, value): the newest version of each key at a watermark, without deleted keys."""
    seen = log.filter(F.col("commit_seq") <= read_seq)
    newest = seen.groupBy("key").agg(F.max_by(F.struct("value"), "commit_seq").alias("v"))
    return newest.select("key", "v.value").filter("value is not null")


def get(log: DataFrame, read_seq: int, key: bytes) -> DataFrame:
    """(key, value) of one key at a watermark."""
    return snapshot(log.filter(F.col("key") == F.lit(bytearray(key))), read_seq)


def scan(log: DataFrame, read_seq: int, start: bytes, end: bytes) -> DataFrame:
    """Keys in [start, end) at a watermark, in unsigned byte order."""
    k = F.col("key")
    return snapshot(log.filter((k >= F.lit(bytearray(start))) & (k < F.lit(bytearray(end)))), read_seq).orderBy("key")


def prefix_end(prefix: bytes) -> bytes:
    """The end of a prefix's range. An empty prefix, or one of 255s alone, has an empty end, whose range
    holds nothing: the defined result."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else b""


def scan_prefix(log: DataFrame, read_seq: int, prefix: bytes) -> DataFrame:
    return scan(log, read_seq, prefix, prefix_end(prefix))


@dataclass
class Transaction:
    """Staged writes on top of a snapshot; the transaction sees its own."""

    store: "VersionStore"
    number: int
    tx_time: int
    read_seq: int
    staged: dict[bytes, bytes | None] = field(default_factory=dict)

    def put(self, key: bytes, value: bytes) -> None:
        self.staged[key] = value

    def delete(self, key: bytes) -> None:
        self.staged[key] = None

    def _overlay(self) -> DataFrame:
        log = self.store.log()
        if not self.staged:
            return log
        rows = [(bytearray(k), self.read_seq + 1, None if v is None else bytearray(v)) for k, v in self.staged.items()]
        return log.filter(F.col("commit_seq") <= self.read_seq).unionByName(self.store.spark.createDataFrame(rows, VERSION_LOG))

    def get(self, key: bytes) -> bytes | None:
        if key in self.staged:
            return self.staged[key]
        row = get(self.store.log(), self.read_seq, key).first()
        return bytes(row["value"]) if row else None

    def scan(self, start: bytes, end: bytes) -> DataFrame:
        return scan(self._overlay(), self.read_seq + 1, start, end)

    def scan_prefix(self, prefix: bytes) -> DataFrame:
        return self.scan(prefix, prefix_end(prefix))

    def commit(self) -> int:
        """Append the staged writes as one batch; the new watermark."""
        return self.store.append(self.staged)


class VersionStore:
    """A version log in a folder. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], int] = lambda: time.time_ns() // 1_000_000):
        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock
        self._begun = 0

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def watermark(self) -> int:
        """The last published commit, 0 before any."""
        at, fs = self._fs(f"{self.path}/published")
        if not fs.exists(at):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(at)), default=0)

    def log(self) -> DataFrame:
        """All published versions."""
        last = self.watermark()
        if not last:
            return self.spark.createDataFrame([], VERSION_LOG)
        return self.spark.read.schema(VERSION_LOG).parquet(*[f"{self.path}/commits/{n:012d}" for n in range(1, last + 1)])

    def begin(self) -> Transaction:
        self._begun += 1
        return Transaction(self, self._begun, self.clock(), self.watermark())

    def append(self, rows: dict[bytes, bytes | None] | DataFrame) -> int:
        """Write a batch (a dict, or a DataFrame of key and value), then publish it."""
        seq = self.watermark() + 1
        if isinstance(rows, dict):
            rows = self.spark.createDataFrame([(bytearray(k), seq, None if v is None else bytearray(v)) for k, v in rows.items()], VERSION_LOG)
        rows.select("key", F.lit(seq).cast("long").alias("commit_seq"), "value").write.mode("overwrite").parquet(f"{self.path}/commits/{seq:012d}")
        at, fs = self._fs(f"{self.path}/published/{seq:012d}")
        if not fs.createNewFile(at):
            raise StorageError(f"commit {seq} was published by another writer")
        return seq
