"""Shared-folder storage for intermediate results.

Everything that a later job reads again goes to the folder that the cluster names in
``spark.checkpoint.dir``, so that the loss of an executor loses no data.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority of Hadoop's default file system where it names none, as Spark's writers take it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only in local mode where none is set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base:
        return qualified(spark, base).rstrip("/")
    if not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="strandlake-")
    atexit.register(shutil.rmtree, folder, True)
    made = f"file://{folder}"
    sc.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/strandlake-{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all)
    _made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path made by :func:`new_path`."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _made:
        _made.remove(path)


def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in list(_made):
        remove(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(stored: DataFrame) -> None:
    """Delete what :func:`materialize` wrote; nothing that reads it may run afterwards."""
    remove(stored.sparkSession, stored.stored_at)
