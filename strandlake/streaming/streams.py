"""Structured Streaming wrappers of row-wise operators, and incremental file processing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sequences import classify_sequence, validate_protein
from ..operators.relational import without_known


def classify_stream(rows: DataFrame, column: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Rows with their sequence class; repeats of a content within the watermark are dropped."""
    known = rows.withWatermark(time, late).dropDuplicatesWithinWatermark([column])
    return known.withColumn("check", classify_sequence(F.col(column))).withColumn("protein", validate_protein(F.col(column)))


def kind_counts(rows: DataFrame, column: str, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of each class in each window of time."""
    kinds = rows.withWatermark(time, late).withColumn("kind", classify_sequence(F.col(column))["kind"])
    return kinds.groupBy(F.window(time, window), "kind").agg(F.count(F.lit(1)).alias("n"))


def append_batches(rows: DataFrame, path: str, keys: list[str], checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Process what is there now, once, and append it; rows of a batch that was written before a failure aren't written again."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        out = work(batch).withColumn("batch", F.lit(number))
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            out = without_known(out, spark.read.parquet(path), keys)
        out.write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def overwrite_batches(rows: DataFrame, path: str, partitions: list[str], checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Process what is new, once. Each batch fills partitions of its own, by ``partitions`` and its number; a batch that runs again after a failure replaces them."""

    def put(batch: DataFrame, number: int) -> None:
        out = work(batch).withColumn("batch", F.lit(number).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions, "batch").parquet(path)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(rows: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of the sessions of each key: rows that follow each other within the gap; ``end`` is the last row's time.

    For streams and tables alike. In a stream rows that come later than the watermark allows are
    dropped, and a session is given out once the watermark has passed its end and gap. Null keys are
    a key like others, rows without a time are left out.
    """
    placed = rows.where(F.col(time).isNotNull())
    placed = placed.withWatermark(time, late) if rows.isStreaming else placed
    counted = placed.groupBy(F.session_window(time, gap).alias("_s"), key).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("end"))
    return counted.select(key, F.col("_s.start").alias("start"), "end", "n")
