"""Shared-folder access, lineage cuts and small helpers for the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent in local mode (unit tests) a temporary folder is made once per application
    and removed when the interpreter ends; on a cluster, whose executors do not share the driver's disk,
    its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        if app not in _OWN_DIRS:
            made = tempfile.mkdtemp(prefix="factloom-shared-")
            _OWN_DIRS[app] = f"file://{made}"
            spark.sparkContext.setCheckpointDir(_OWN_DIRS[app])
            atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = _OWN_DIRS[app]
    return base.rstrip("/")


def reachable(spark: SparkSession) -> SparkSession:
    """The session, whose Python workers also look for this package where the driver found it.

    Serves drivers that import the package from a path of their own; on a cluster where that path is
    missing it changes nothing, and the package comes by ``--py-files`` or an installation.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return spark


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared folder."""
    return f"{shared_dir(spark)}/factloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Bytes of a row group of a written table.
GROUP_BYTES = 16 << 20


def materialize(df: DataFrame, name: str, compact: bool = False, through: Callable | None = None, schema: str | None = None) -> DataFrame:
    """Write ``df`` as zstd Parquet to the shared folder and read it back.

    The result has no lineage, so the loss of an executor never recomputes what lies before it. Tasks
    write a file each under a name of their own and report it when it is complete; only reported files
    are read, so a repeated task adds nothing twice. ``compact``: what many tasks yield little of is
    first gathered into files of a fair size. ``through``: a function of Arrow batches, applied on the
    way in the same Python worker, with the ``schema`` of its result.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    read_as = df.schema if through is None else spark.createDataFrame([], schema).schema
    if compact:
        df = df.hint("rebalance")
    files = [row[0] for row in df.mapInArrow(tidy(_writer(path, through)), "path string").collect()]
    return spark.read.schema(read_as).parquet(*files) if files else spark.createDataFrame([], read_as)


def settle() -> None:
    """Give memory that a Python worker no longer uses back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def tidy(run: Callable) -> Callable:
    """A function of Arrow batches that settles after every batch and at the end."""

    def tidied(batches):
        def fed():
            for batch in batches:
                yield batch
                batch = None
                settle()

        yield from run(fed())
        settle()

    return tidied


def _writer(path: str, through: Callable | None):
    def run(batches):
        store, base = filesystem(path)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.parquet"
        writer = stream = None
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            writer.write_table(pa.Table.from_batches(held))
            held.clear()

        for batch in through(batches) if through else batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store.create_dir(base, recursive=True)
                stream = store.open_output_stream(f"{base}/{name}")
                writer = pq.ParquetWriter(stream, batch.schema, compression="zstd", use_dictionary=False)
            held.append(batch)
            size += batch.nbytes
            if size >= GROUP_BYTES:
                flush()
                size = 0
        if writer is not None:
            if held:
                flush()
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"])], names=["path"])

    return run


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of past steps, after a step that wrote much. Spark removes them
    when nothing on the driver refers to them any more; to remove them when a query ends is not safe, as
    a stage whose result the query no longer needed may still read them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {os.path.dirname(p) for p in df.inputFiles()}:
        if "/factloom-" in path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a shared-folder URI, for Python code on driver or executors."""
    if "://" not in uri:
        uri = uri.removeprefix("file:") if uri.startswith("file:") else uri
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n (null stays null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def bytes_view(column: pa.ChunkedArray | pa.Array) -> tuple[memoryview, list[int]]:
    """UTF-8 bytes of a string column (nulls as empty) and its offsets."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat, offsets


def slices(offsets, limit: int):
    """Row ranges [i, j) of at most ``limit`` bytes each, one row at least."""
    import numpy as np

    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j
