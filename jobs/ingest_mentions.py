"""Collects sequences that texts mention, taking only the files that are new since the last run.

A file stream with a checkpoint reads the texts; those that came before, equal in id and text, are
dropped by the stream's state. Each word of letters that is long enough and reads as a sequence of
nucleotides or amino acids is a mention. Written below the output folder:

    kind=.../batch=../  Parquet: doc_id, text_md5, content, length, n_mentions

Each batch of the stream fills partitions of its own, and a batch that is repeated after a failure
replaces them, so reruns change nothing. Output and checkpoint belong together: to start again,
take a new folder for both.

Null and empty texts mention nothing; a null id is an id like others; texts are read whole, and
upper- and lower-case letters count alike.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.settings import LOG, open_session, read_settings
from strandlake.functions.sequences import classify_sequence
from strandlake.streaming.streams import overwrite_batches

MENTIONS = "doc_id long, text_md5 string, content string, length int, n_mentions long, kind string, batch long"
#: Where words end: ASCII characters but letters and digits.
BREAKS = r"[^A-Za-z0-9\x{80}-\x{10FFFF}]+"
#: While the stream runs: state on disk, as it grows with the texts, and the progress of all batches kept for the log.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.numRecentProgressUpdates": "1000000",
}


@dataclass(frozen=True)
class Settings:
    """Letters of a sequence at least, files of a batch at most, and the columns read with their types."""

    min_length: int = 8
    files_per_batch: int = 64
    schema: str = "doc_id long, text string"
    id_column: str = "doc_id"
    text_column: str = "text"


def mentions(texts: DataFrame, min_length: int = 8) -> DataFrame:
    """(doc_id, text_md5, content, length, n_mentions, kind) of the sequences in (doc_id, text); counts are of a text."""
    long = F.filter(F.split("text", BREAKS), lambda w: w.rlike(f"^[A-Za-z]{{{min_length},}}$"))
    words = texts.select("doc_id", F.md5("text").alias("text_md5"), F.explode(long).alias("word"))
    counted = words.groupBy("doc_id", "text_md5", F.upper("word").alias("content")).agg(F.count(F.lit(1)).alias("n_mentions"))
    checked = counted.withColumn("c", classify_sequence(F.col("content"))).where(F.col("c.kind") != "INVALID")
    return checked.select("doc_id", "text_md5", "content", F.col("c.length").alias("length"), "n_mentions", F.col("c.kind").alias("kind"))


def run(spark: SparkSession, input_path: str, output_path: str, checkpoint_path: str, settings: Settings = Settings()) -> dict[str, int]:
    """Takes what is new until there is no more; returns the numbers of rows read and written by this run."""
    rows = spark.readStream.schema(settings.schema).option("maxFilesPerTrigger", settings.files_per_batch).parquet(input_path)
    texts = rows.select(F.col(settings.id_column).alias("doc_id"), F.col(settings.text_column).alias("text")).where("text <> ''")
    fresh = texts.withColumn("digest", F.sha2("text", 256)).dropDuplicates(["doc_id", "digest"]).drop("digest")
    written = []

    def work(batch: DataFrame) -> DataFrame:
        written.append(Observation("written"))
        return mentions(batch, settings.min_length).observe(written[-1], F.count(F.lit(1)).alias("rows"))

    before = {name: spark.conf.get(name, None) for name in STREAM_CONF}
    for name, value in STREAM_CONF.items():
        spark.conf.set(name, value)
    try:
        query = overwrite_batches(fresh, output_path, ["kind"], checkpoint_path, work)
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    numbers = {"read": sum(p.numInputRows for p in query.recentProgress), "written": sum(o.get["rows"] for o in written), "batches": len(written)}
    LOG.info("ingest_mentions read %s: %d new rows in %d batches", input_path, numbers["read"], numbers["batches"])
    LOG.info("ingest_mentions wrote %s: %d mentions", output_path, numbers["written"])
    return numbers


def read_mentions(spark: SparkSession, output_path: str) -> DataFrame:
    return spark.read.schema(MENTIONS).parquet(output_path)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Sequences mentioned in new texts")
    parser.add_argument("--config", help="YAML file of settings")
    parser.add_argument("--input", required=True, help="folder of Parquet files that grows, or a pattern of such paths")
    parser.add_argument("--output", required=True)
    parser.add_argument("--checkpoint", required=True)
    args = parser.parse_args(argv)
    spark = open_session("ingest_mentions")
    try:
        run(spark, args.input, args.output, args.checkpoint, read_settings(Settings, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
