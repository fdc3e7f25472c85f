"""The jobs as registered queries: each runs twice into one new folder and returns the output as it then stands."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import build_graph, ingest_mentions
from strandlake.plans.domain import TRIPLES
from strandlake.store import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_build_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job1-build-graph")
    for _ in range(2):
        build_graph.run(spark, sf_dir, out)
    return build_graph.read_triples(spark, out)


def job2_ingest_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark, "job2-ingest-mentions")
    for _ in range(2):  # a pattern, as a file stream takes no single file by name
        ingest_mentions.run(spark, f"{sf_dir}/document[s].parquet", f"{base}/mentions", f"{base}/checkpoint")
    return ingest_mentions.read_mentions(spark, f"{base}/mentions").drop("batch")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_build_graph": job1_build_graph, "job2_ingest_mentions": job2_ingest_mentions}


def oracle_sql() -> dict[str, str]:
    return {"job1_build_graph": JOB1_SQL, "job2_ingest_mentions": JOB2_SQL}


JOB1_SQL = f"""
WITH {TRIPLES},
r AS (SELECT DISTINCT src, rel, dst, md5('42|' || src || '|' || rel || '|' || dst) AS h FROM triples WHERE src IS NOT NULL AND rel IS NOT NULL AND dst IS NOT NULL),
f AS (SELECT DISTINCT min(h) AS h FROM (SELECT h, unnest(['e|' || src, 'e|' || dst, 'r|' || rel]) AS part FROM r) GROUP BY part),
d AS (SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS idx FROM (SELECT src AS entity_id FROM r UNION SELECT dst FROM r))
SELECT r.src, r.dst, a.idx AS src_idx, b.idx AS dst_idx, r.rel,
  CASE WHEN CAST('0x' || substr(r.h, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.8 OR f.h IS NOT NULL THEN 'train' ELSE 'test' END AS sample
FROM r JOIN d a ON r.src = a.entity_id JOIN d b ON r.dst = b.entity_id LEFT JOIN f ON r.h = f.h
"""

JOB2_SQL = r"""
WITH t AS (
  SELECT doc_id, md5(text) AS text_md5, upper(unnest(list_filter(string_split_regex(text, '[^A-Za-z0-9\x{80}-\x{10FFFF}]+'), lambda w: regexp_full_match(w, '[A-Za-z]{8,}')))) AS content
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text <> '')),
c AS (SELECT doc_id, text_md5, content, count(*) AS n_mentions FROM t GROUP BY ALL),
k AS (
  SELECT *, CAST(length(content) AS INTEGER) AS length,
    CASE WHEN regexp_full_match(content, '[ACGTUNRYSWKMBDHVX]*') AND regexp_matches(content, '[NRYSWKMBDHVX]') THEN 'INVALID'
      WHEN regexp_full_match(content, '[ACGTU]*') AND contains(content, 'T') AND contains(content, 'U') THEN 'NUCLEIC_MIXED'
      WHEN regexp_full_match(content, '[ACGTU]*') AND contains(content, 'T') THEN 'DNA'
      WHEN regexp_full_match(content, '[ACGTU]*') AND contains(content, 'U') THEN 'RNA'
      WHEN regexp_full_match(content, '[ACGTU]*') THEN 'NUCLEIC_AMBIG'
      WHEN regexp_full_match(content, '[ACDEFGHIKLMNPQRSTVWY]*') THEN 'AA' ELSE 'INVALID' END AS kind
  FROM c)
SELECT doc_id, text_md5, content, length, n_mentions, kind FROM k WHERE kind <> 'INVALID'
"""
