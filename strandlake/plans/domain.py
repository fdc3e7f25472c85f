"""Domain tables derived from the input tables by fixed formulas, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

HEX = "0123456789abcdef"
DNA, RNA, AA = "ACGTACGTACGTACGT", "ACGUACGUACGUACGU", "ACDEFGHIKLMNPQRS"


def coded(c, alphabet: str):
    """A 32-letter sequence from a value's hash."""
    return F.translate(F.md5(c.cast("string")), HEX, alphabet)


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): sequences, texts, blanks and nulls."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k, s = F.col("doc_id") % 8, F.col("doc_id")
    content = (
        F.when(k == 0, coded(s, DNA))
        .when(k == 1, coded(s, RNA))
        .when(k == 2, coded(s, AA))
        .when(k == 3, F.concat(F.lit("  "), F.lower(coded(s, AA)), F.lit(" \t")))
        .when(k == 4, F.substring("text", 1, 12))
        .when(k == 5, F.concat(coded(s, DNA), F.lit("NU")))
        .when(k == 6, F.when(s % 16 == 6, F.lit("  ")))
        .otherwise(F.concat(coded(s, DNA), coded(s, RNA)))
    )
    return d.select("doc_id", content.alias("content"))


CONTENTS = f"""contents AS (
  SELECT doc_id, CASE doc_id % 8
    WHEN 0 THEN translate(md5(CAST(doc_id AS VARCHAR)), '{HEX}', '{DNA}')
    WHEN 1 THEN translate(md5(CAST(doc_id AS VARCHAR)), '{HEX}', '{RNA}')
    WHEN 2 THEN translate(md5(CAST(doc_id AS VARCHAR)), '{HEX}', '{AA}')
    WHEN 3 THEN '  ' || lower(translate(md5(CAST(doc_id AS VARCHAR)), '{HEX}', '{AA}')) || ' ' || chr(9)
    WHEN 4 THEN substr(text, 1, 12)
    WHEN 5 THEN translate(md5(CAST(doc_id AS VARCHAR)), '{HEX}', '{DNA}') || 'NU'
    WHEN 6 THEN CASE WHEN doc_id % 16 = 6 THEN '  ' END
    ELSE translate(md5(CAST(doc_id AS VARCHAR)), '{HEX}', '{DNA}') || translate(md5(CAST(doc_id AS VARCHAR)), '{HEX}', '{RNA}') END AS content
  FROM documents)"""


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq): short amino-acid sequences of several lengths, some of them inside others."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return p.select("id", F.substr(coded((F.col("id") % 97).cast("long"), AA), (F.col("id") % 5 + 1).cast("int"), (F.col("id") % 13 + 6).cast("int")).alias("seq"))


PROTEINS = f"""proteins AS (
  SELECT p_partkey AS id, substr(translate(md5(CAST(p_partkey % 97 AS VARCHAR)), '{HEX}', '{AA}'), CAST(p_partkey % 5 + 1 AS BIGINT), CAST(p_partkey % 13 + 6 AS BIGINT)) AS seq FROM part)"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, rel, dst) of all orders: customers interact with parts, parts are similar to suppliers."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    bought = o.join(li, o["o_orderkey"] == li["l_orderkey"])
    a = bought.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.lit("interacts_with").alias("rel"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    b = li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.lit("has_similarity").alias("rel"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    return a.unionByName(b)


TRIPLES = """triples AS (
  SELECT 'c' || CAST(o_custkey AS VARCHAR) AS src, 'interacts_with' AS rel, 'p' || CAST(l_partkey AS VARCHAR) AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  UNION ALL
  SELECT 'p' || CAST(l_partkey AS VARCHAR), 'has_similarity', 's' || CAST(l_suppkey AS VARCHAR) FROM lineitem)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v): vectors of entities."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the parameters of the relation, the vector of the first entity."""
    e = entities(spark, sf_dir)
    return e.agg(F.min_by("v", "id").alias("params"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): links between entities."""
    li, e = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    return li.join(F.broadcast(n)).select((F.col("l_partkey") % F.col("n")).alias("src"), (F.col("l_suppkey") % F.col("n")).alias("dst")).distinct()  # one row


KGE = """ent AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
par AS (SELECT arg_min(v, id) AS params FROM ent),
lnk AS (SELECT DISTINCT l_partkey % n AS src, l_suppkey % n AS dst FROM lineitem, (SELECT count(*) AS n FROM embeddings))"""


def word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, s): different words of documents, as stand-ins for fingerprints."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.array_distinct(F.split(F.lower("text"), " ")).alias("s"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, labels) of the triples' entities."""
    kinds = (("customer", "c_custkey", "c", "small_molecule"), ("part", "p_partkey", "p", "protein"), ("supplier", "s_suppkey", "s", "aptamer"))
    parts = [table(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.lit(name).alias("labels")) for t, k, p, name in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


NODES = """nodes AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id, 'small_molecule' AS labels FROM customer
  UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), 'protein' FROM part
  UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'aptamer' FROM supplier)"""


def kin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq): sequences of 100 to 1,000 letters in families of four parts: the first, two with a share of letters exchanged, a piece of the first."""
    k = F.col("p_partkey")
    family = F.floor(k / 4)
    n = F.lit(100) + (family * 37 % 901).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 32).cast("int")), lambda b: F.translate(F.md5(F.concat_ws(":", family.cast("string"), b.cast("string"))), HEX, AA))
    whole = F.substr(F.array_join(blocks, ""), F.lit(1), n)
    share = F.when(k % 4 == 1, 10).when(k % 4 == 2, 22).otherwise(0)
    changed = F.transform(F.split(whole, ""), lambda c, i: F.when(F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", k.cast("string"), i.cast("string"))), 1, 6), 16, 10).cast("int"), F.lit(100)) < share, F.translate(c, AA, AA[1:] + AA[0])).otherwise(c))
    part = F.substr(whole, F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 4 == 3, part).when(share == 0, whole).otherwise(F.array_join(changed, "")).alias("seq"))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v): the entities' vectors, drawn to those of the first 40 entities, by turns."""
    e = entities(spark, sf_dir)
    centres = e.where("id < 40").select(F.col("id").alias("c"), F.col("v").alias("m"))
    near = F.zip_with("v", "m", lambda x, y: x + 3.0 * y)
    return e.join(F.broadcast(centres), F.col("id") % 40 == F.col("c")).select("id", near.alias("v"))  # 40 rows
