"""Cutting of lineage in iterative operators, through the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from factloom.errors import StorageError

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset in local mode (tests), a temporary folder
    of our own. On a cluster the setting must be there: executors do not share the driver's disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        raise StorageError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            made = tempfile.mkdtemp(prefix="factloom-lineage-")
            _OWN[app] = f"file://{made}"
            atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = _OWN[app]
    return base.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a written table: later stages read files, and a lost executor repeats only its own tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/factloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table of :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {os.path.dirname(file) for file in df.inputFiles()}:
        if "/factloom-" in folder:
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
