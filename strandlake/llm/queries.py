"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..store import materialize
from .bagminhash import near_duplicates
from .centroids import cluster_vectors
from .chaindedup import passage_classes
from .decontaminate import decontaminate
from .langid import fit_languages, identify_languages
from .mixing import apply_cuts, source_cuts, with_keys
from .packing import pack_documents
from .quality import fit_rules, judge_quality
from .suffixdedup import remove_repeats
from .tokenbin import token_output
from .tokencount import count_tokens
from .urlfilter import UrlRule, filter_urls

#: Host rules and, for what none of them fits, patterns of spam hosts.
URL_RULES = [
    UrlRule("net/", "block"),
    UrlRule("example.net/en/", "allow"),
    UrlRule("example.com/de/", "block"),
    UrlRule("org/fr/", "allow"),
    UrlRule("^cheap-pills^", "block", is_pattern=True),
    UrlRule("^spam-farm^", "block", is_pattern=True),
    UrlRule("^casino^", "block", is_pattern=True),
    UrlRule("^porn^", "block", is_pattern=True),
]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    keyed = materialize(with_keys(docs).drop("text"), "keys")
    return apply_cuts(keyed, source_cuts(keyed)).select("doc_id", "size", "source_size", "target", "taken")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit_languages(docs, where=~held_out & F.col("doc_id").isNotNull())
    judged = identify_languages(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_chain_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passage_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    partners = F.array_sort(F.array_distinct(F.transform("passages", lambda p: p["partner_id"])))
    return found.select("doc_id", "class_id", "n_links", F.size("passages").cast("long").alias("n_passages"), partners.alias("partners"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    return judge_quality(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = token_output(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


def op12_cluster_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    digest = F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256")
    return assigned.join(F.broadcast(centroids.select("cluster", "cluster_inertia", "inertia", digest)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_mix_sources": op2_mix_sources,
        "op3_url_filter": op3_url_filter,
        "op4_language_id": op4_language_id,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_chain_dedup": op6_chain_dedup,
        "op7_token_counts": op7_token_counts,
        "op8_quality_rules": op8_quality_rules,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_token_output": op10_token_output,
        "op11_pack_sequences": op11_pack_sequences,
        "op12_cluster_vectors": op12_cluster_vectors,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op2_mix_sources": OP2_SQL, "op3_url_filter": OP3_SQL, "op12_cluster_vectors": _lloyd_sql(8, 10)}


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, len, array_to_string(words[i:i + len - 1], ' ') AS win
  FROM (SELECT item, words, least(10, len(words)) AS len, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
p AS (
  SELECT doc_id, words, l.len AS len, unnest(range(1, len(words) - l.len + 2)) AS i
  FROM w CROSS JOIN (SELECT DISTINCT len FROM bw) l WHERE len(words) >= l.len),
h AS (
  SELECT p.doc_id, p.i, p.len, bw.item FROM p JOIN bw ON p.len = bw.len AND array_to_string(p.words[p.i:p.i + p.len - 1], ' ') = bw.win),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, length(coalesce(text, '')) AS chars,
    md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '#', coalesce(md5(text), ''))) AS h
  FROM documents),
k AS (
  SELECT doc_id, source, size, h,
    -ln((CAST(concat('0x', substr(h, 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
    / greatest(0.25::DOUBLE, 1.0::DOUBLE - abs(CASE WHEN size = 0 THEN 0.0::DOUBLE ELSE CAST(chars AS DOUBLE) / CAST(size AS DOUBLE) END - 6.0::DOUBLE) / 12.0::DOUBLE) AS key
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (
  SELECT source, source_size, CAST(([3, 1, 2])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight,
    2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM w),
t AS (
  SELECT source, source_size, CASE WHEN level * weight >= cap THEN cap ELSE weight * (SELECT m.level FROM l m WHERE m.level * m.weight < m.cap ORDER BY m.place LIMIT 1) END AS target
  FROM l),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS epochs FROM t),
o AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST((epochs + CASE WHEN 2 * after - size <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM o
"""

OP3_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, lower(coalesce(url, '')) AS url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r AS (
  SELECT *, CASE
    WHEN regexp_matches(host, '(^|\.)example\.net$') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN regexp_matches(host, '(^|\.)example\.com$') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN regexp_matches(host, '(^|\.)org$') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN regexp_matches(host, '(^|\.)net$') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(url, '(^|[\x00-\x2F\x3A-\x60\x7B-\x7F])(cheap-pills|spam-farm|casino|porn)($|[\x00-\x2F\x3A-\x60\x7B-\x7F])') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def _lloyd_sql(k: int, rounds: int) -> str:
    """Lloyd's rounds in SQL, a pair of steps for each round, over all rows."""
    steps = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS cluster, q AS c
  FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT {k}))"""
    for r in range(rounds + 1):
        steps += f""",
a{r} AS MATERIALIZED (
  SELECT vec_id, q, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT v.rowid_ AS rowid_, vec_id, q, cluster, list_sum([(q[i] - c[i]) * (q[i] - c[i]) FOR i IN range(1, 65)]) AS d FROM (SELECT *, row_number() OVER () AS rowid_ FROM v) v CROSS JOIN c{r})
  GROUP BY rowid_, vec_id, q)"""
        if r < rounds:
            steps += f""",
s{r} AS (
  SELECT cluster, list(m ORDER BY i) AS c
  FROM (SELECT cluster, i, CAST(CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS BIGINT) AS m
    FROM (SELECT cluster, i, sum(q[i]) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{r} CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i))
  GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(s{r}.c, o.c) AS c FROM c{r} o LEFT JOIN s{r} USING (cluster))"""
    return f"""{steps}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""
