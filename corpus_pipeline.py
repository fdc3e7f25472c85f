"""Corpus pipeline: quality rules, near-duplicates, benchmark contamination, source mix, token output.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the
last return the columns of ``documents``, with their types and values.

Defined cases: null and empty texts fail the quality rules; in the other stages they are classes
of their own, clean, of size 0 in the mix, and one end id. Very long texts are handled whole. Of
repeated rows the near-duplicate stage keeps one; elsewhere each is judged. Null ids and sources
are values like others, ids that tie keep all their rows. Empty tables give empty results. Extra
columns pass unchanged, whatever their names: operators see the row as one nested column.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.bagminhash import drop_near_duplicates
from strandlake.llm.decontaminate import decontaminate
from strandlake.llm.mixing import mix_sources
from strandlake.llm.quality import fit_rules, judge_quality
from strandlake.llm.tokenbin import token_output
from strandlake.session import table
from strandlake.store import materialize, qualified

#: Appended to each document in the token output.
END_ID = 2


def _nested(docs: DataFrame, *columns: str) -> DataFrame:
    """Text and other columns that an operator reads, beside ``_row`` with all but the text."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("_row"), "text", *columns)


def _as_before(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base check and the learned rules."""
    rules = fit_rules(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _as_before(judge_quality(_nested(docs), rules).where("kept"), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    return _as_before(decontaminate(_nested(docs), table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")), docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mix_sources(_nested(docs, "doc_id", "source")).where(F.col("times") > 0)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))
    return _as_before(mixed.select("_row", "text", copies.alias("_copy")), docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written as bit-packed shards, which stay, and what is read back of each document.

    Shards go to a new folder below the one that ``spark.strandlake.output.dir`` names, else below
    the warehouse; a path without a scheme is one of Hadoop's default file system.
    """
    base = spark.conf.get("spark.strandlake.output.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    out = f"{qualified(spark, base).rstrip('/')}/corpus-tokens-{uuid.uuid4().hex}"
    stored = token_output(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=END_ID, out_uri=out)
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("source mix", mixing_stage),
    ("token output", token_stage),
]

#: The learned rules and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
