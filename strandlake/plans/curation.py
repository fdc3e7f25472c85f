"""Curation queries: classification, cleaning, deduplication, unification, nested answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as seq
from ..operators import relational as rel
from ..session import table
from .domain import CONTENTS, contents
from .registry import query

CLASSIFIED = f"""{CONTENTS},
u AS (SELECT doc_id, content, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS raw FROM contents),
v AS (SELECT *, upper(raw) AS up, list_sort(list_distinct(string_split(upper(raw), ''))) AS cs FROM u),
classified AS (
  SELECT doc_id, content,
    CASE WHEN content IS NULL OR raw = '' THEN 'INVALID'
      WHEN regexp_full_match(up, '[ACGTUNRYSWKMBDHVX]*') AND regexp_matches(up, '[NRYSWKMBDHVX]') THEN 'INVALID'
      WHEN regexp_full_match(up, '[ACGTU]*') AND contains(up, 'T') AND contains(up, 'U') THEN 'NUCLEIC_MIXED'
      WHEN regexp_full_match(up, '[ACGTU]*') AND contains(up, 'T') THEN 'DNA'
      WHEN regexp_full_match(up, '[ACGTU]*') AND contains(up, 'U') THEN 'RNA'
      WHEN regexp_full_match(up, '[ACGTU]*') THEN 'NUCLEIC_AMBIG'
      WHEN regexp_full_match(up, '[ACDEFGHIKLMNPQRSTVWY]*') THEN 'AA' ELSE 'INVALID' END AS kind,
    CASE WHEN content IS NULL OR raw = '' THEN 0 ELSE length(up) END AS length,
    CASE WHEN content IS NULL THEN 'None' WHEN raw = '' THEN 'EMPTY'
      WHEN regexp_full_match(up, '[ACGTUNRYSWKMBDHVX]*') AND regexp_matches(up, '[NRYSWKMBDHVX]') THEN array_to_string(list_filter(cs, lambda x: contains('NRYSWKMBDHVX', x)), '')
      WHEN regexp_full_match(up, '[ACGTU]*') OR regexp_full_match(up, '[ACDEFGHIKLMNPQRSTVWY]*') THEN ''
      ELSE array_to_string(list_filter(cs, lambda x: NOT contains('ACDEFGHIKLMNPQRSTUVWY', x)), '') END AS invalid_chars
  FROM v)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contents(spark, sf_dir)
    return c.withColumn("c", seq.classify_sequence(F.col("content"))).select("doc_id", "content", "c.kind", "c.length", "c.invalid_chars")


@query("classify_sequence", f"WITH {CLASSIFIED} SELECT doc_id, kind, CAST(length AS INTEGER) AS length, invalid_chars FROM classified")
def classify_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).drop("content")


@query("classify_kind_counts", f"WITH {CLASSIFIED} SELECT kind, count(*) AS n FROM classified GROUP BY kind")
def classify_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.value_counts(classified(spark, sf_dir), "kind")


@query("invalid_char_counts", f"WITH {CLASSIFIED} SELECT invalid_chars, count(*) AS n FROM classified WHERE kind = 'INVALID' GROUP BY invalid_chars")
def invalid_char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.value_counts(classified(spark, sf_dir).where(F.col("kind") == "INVALID"), "invalid_chars")


@query("content_summary", f"WITH {CONTENTS} SELECT count(*) AS n_rows, count(content) AS n_filled, count(*) - count(content) AS n_null, count(DISTINCT content) AS n_different, avg(length(content)) AS mean_length FROM contents")
def content_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("content").alias("n_filled"), F.count_if(F.col("content").isNull()).alias("n_null"),
        F.count_distinct("content").alias("n_different"), F.avg(F.length("content")).alias("mean_length"),
    )


VALIDATED = f"""{CONTENTS},
b AS (SELECT doc_id, content, regexp_replace(content, '\\s+|\\d+', '', 'g') AS bare FROM contents),
i AS (SELECT *, list_filter(list_sort(list_distinct(string_split(bare, ''))), lambda x: x <> '' AND NOT contains('ACDEFGHIKLMNPQRSTVWY', x)) AS bad FROM b),
validated AS (
  SELECT doc_id, content, CASE WHEN content IS NULL OR trim(content) = '' THEN 'Empty or non-string' WHEN regexp_matches(bare, '\\p{{Ll}}') THEN 'Lowercase letters detected'
    WHEN len(bad) > 0 THEN 'Invalid amino acids: ' || array_to_string(bad, ', ') END AS issue, bare FROM i)"""


@query("validate_protein", f"WITH {VALIDATED} SELECT doc_id, CASE WHEN issue IS NULL THEN bare END AS sequence, issue FROM validated")
def validate_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).withColumn("p", seq.validate_protein(F.col("content"))).select("doc_id", "p.sequence", "p.issue")


ASSAYS = """assays AS (
  SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '>' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) WHEN 2 THEN ' ' || CAST(l_partkey AS VARCHAR) || ',000' WHEN 3 THEN CAST(l_suppkey AS VARCHAR) || 'e+2'
    WHEN 4 THEN 'n/a' WHEN 5 THEN CAST(l_partkey AS VARCHAR) || 'd' WHEN 6 THEN '' END AS kd,
    CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_suppkey AS VARCHAR) END AS ki
  FROM lineitem)"""


def assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, text = F.col("l_linenumber"), lambda c: F.col(c).cast("string")
    kd = (
        F.when(n == 1, F.concat(F.lit(">"), F.col("l_quantity").cast("int").cast("string")))
        .when(n == 2, F.concat(F.lit(" "), text("l_partkey"), F.lit(",000")))
        .when(n == 3, F.concat(text("l_suppkey"), F.lit("e+2")))
        .when(n == 4, F.lit("n/a"))
        .when(n == 5, F.concat(text("l_partkey"), F.lit("d")))
        .when(n == 6, F.lit(""))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kd.alias("kd"), F.when(n % 2 == 1, text("l_suppkey")).alias("ki"))


@query("clean_affinity", f"WITH {ASSAYS}, c AS (SELECT *, trim(translate(kd, '<>, ', '')) AS t FROM assays) SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(t, '[+-]?\\d+(\\.\\d*)?([eE][+-]?\\d+)?') THEN CAST(t AS DOUBLE) END AS kd FROM c")
def clean_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assays(spark, sf_dir).select("l_orderkey", "l_linenumber", seq.to_number(F.col("kd")).alias("kd"))


@query("bad_affinity_values", f"WITH {ASSAYS}, c AS (SELECT *, trim(translate(kd, '<>, ', '')) AS t FROM assays) SELECT kd AS value, count(*) AS n FROM c WHERE t <> '' AND NOT regexp_full_match(t, '[+-]?\\d+(\\.\\d*)?([eE][+-]?\\d+)?') GROUP BY kd")
def bad_affinity_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assays(spark, sf_dir)
    return a.where((F.trim("kd") != "") & seq.to_number(F.col("kd")).isNull()).groupBy(F.col("kd").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("coalesce_kd", f"WITH {ASSAYS} SELECT l_orderkey, l_linenumber, coalesce(kd, ki) AS kd FROM assays")
def coalesce_kd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assays(spark, sf_dir).select("l_orderkey", "l_linenumber", F.coalesce("kd", "ki").alias("kd"))


@query("keep_first_dedup", "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def keep_first_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return rel.keep_first(li, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("natural_merge_nullsafe", f"WITH {CONTENTS}, a AS (SELECT doc_id % 50 AS k, content FROM contents WHERE doc_id % 3 < 2), b AS (SELECT doc_id % 50 AS k, content FROM contents WHERE doc_id % 3 > 0) SELECT a.k, a.content FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.content IS NOT DISTINCT FROM b.content")
def natural_merge_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contents(spark, sf_dir)
    part = lambda where: c.where(where).select((F.col("doc_id") % 50).alias("k"), "content")
    return rel.natural_join(part(F.col("doc_id") % 3 < 2), part(F.col("doc_id") % 3 > 0))


@query("notin_null_safe", f"WITH {CONTENTS} SELECT doc_id, content FROM contents WHERE NOT coalesce(content IN ('  ', 'A'), FALSE)")
def notin_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).where(rel.not_in(F.col("content"), ["  ", "A"]))


@query("notlike_null_safe", f"WITH {CONTENTS} SELECT doc_id FROM contents WHERE NOT coalesce(regexp_matches(content, 'Cl|Br|F|I|S'), FALSE)")
def notlike_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).where(rel.not_like(F.col("content"), "Cl|Br|F|I|S")).select("doc_id")


@query("alphabet_subset_filter", f"WITH {CONTENTS} SELECT doc_id, content FROM contents WHERE regexp_full_match(content, '[ACGT]*') AND content <> ''")
def alphabet_subset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).where(seq.only(F.col("content"), "ACGT") & (F.col("content") != ""))


@query("ambiguity_key_to_values", "SELECT l_partkey, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))), ',') AS suppliers, count(DISTINCT l_suppkey) AS n_values FROM lineitem GROUP BY l_partkey")
def ambiguity_key_to_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").cast("string").alias("s"))
    return rel.ambiguities(li, "l_partkey", "s").select("l_partkey", F.array_join("values", ",").alias("suppliers"), "n_values")


@query("ambiguity_summary", "SELECT n_values, count(*) AS n_keys FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS n_values FROM lineitem GROUP BY l_partkey) WHERE n_values > 1 GROUP BY n_values")
def ambiguity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.ambiguities(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", 1).groupBy("n_values").agg(F.count(F.lit(1)).alias("n_keys"))


@query("first_seen_values", "SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY pos) AS segments FROM (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS pos FROM customer GROUP BY ALL) GROUP BY c_nationkey HAVING count(*) > 1")
def first_seen_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rel.first_seen_values(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_custkey")
    return found.select("c_nationkey", F.array_join("values", ",").alias("segments"))


@query("first_seen_surrogate_ids", "SELECT l_suppkey, 'APT_' || CAST(row_number() OVER (ORDER BY pos) AS VARCHAR) AS surrogate_id FROM (SELECT l_suppkey, min(struct_pack(o := l_orderkey, n := l_linenumber, s := l_suppkey)) AS pos FROM lineitem GROUP BY l_suppkey)")
def first_seen_surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.surrogate_ids(table(spark, sf_dir, "lineitem"), "l_suppkey", "APT_", ["l_orderkey", "l_linenumber", "l_suppkey"])


@query("union_by_name_missing", "SELECT c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def union_by_name_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("union_first_wins", "SELECT k, origin FROM (SELECT k, origin, row_number() OVER (PARTITION BY k ORDER BY t, o) AS r FROM (SELECT c_custkey % 700 AS k, 'a' AS origin, 0 AS t, c_custkey AS o FROM customer UNION ALL SELECT s_suppkey * 11, 'b', 1, s_suppkey FROM supplier)) WHERE r = 1")
def union_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 700).alias("k"), F.lit("a").alias("origin"), F.col("c_custkey").alias("o"))
    b = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 11).alias("k"), F.lit("b").alias("origin"), F.col("s_suppkey").alias("o"))
    return rel.union_first([a, b], ["k"], ["o"]).drop("o")


@query("ppi_filter_dedup", "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT p_brand AS a, lead(p_brand) OVER (ORDER BY p_partkey) AS b, p_name FROM part) WHERE b IS NOT NULL AND a <> '-' AND NOT coalesce(contains(a, '|'), FALSE) AND a <> b")
def ppi_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("a"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    rows = p.join(nxt, "p_partkey").where((F.col("a") != "-") & rel.not_like(F.col("a"), r"\|") & (F.col("a") != F.col("b")))
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@query("lookup_join", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON s_nationkey = n_nationkey")
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_nationkey < 20")
    return rel.lookup(table(spark, sf_dir, "supplier"), "s_nationkey", n, "n_nationkey", "n_name", "n_name").select("s_suppkey", "n_name")


@query("repairs_by_value", "SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'HOME' WHEN 'MACHINERY' THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def repairs_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return rel.repair_values(c, "segment", {"HOUSEHOLD": "HOME", "MACHINERY": None})


@query("point_updates", "SELECT c_custkey, CASE WHEN c_custkey = 3 THEN 'X' WHEN c_custkey = 5 THEN NULL ELSE c_name END AS c_name FROM customer WHERE c_custkey <> 0")
def point_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name").where(rel.not_in(F.col("c_custkey"), [0]))
    return rel.point_updates(c, "c_custkey", "c_name", {3: "X", 5: None})


@query("explode_split", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def explode_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("split_columns", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS a, split_part(o_orderpriority, '-', 2) AS b, concat_ws('_', o_orderstatus, nullif(split_part(o_orderpriority, '-', 3), ''), CAST(o_custkey AS VARCHAR)) AS name FROM orders")
def split_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("o_orderpriority", "-")
    get = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", get(0).alias("a"), get(1).alias("b"), F.concat_ws("_", "o_orderstatus", F.get(parts, 2), F.col("o_custkey").cast("string")).alias("name"))


@query("json_hits_flatten", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.name'), 'N/A') AS name FROM events")
def json_hits_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.explode(F.array(F.from_json("props", "k bigint, name string")))
    return table(spark, sf_dir, "events").select("event_id", hits.alias("h")).select("event_id", "h.k", F.coalesce("h.name", F.lit("N/A")).alias("name"))


@query("endpoints_unpivot", "SELECT l_orderkey, l_linenumber, 0 AS side, l_partkey AS id FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 1, l_suppkey FROM lineitem")
def endpoints_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return rel.endpoints(li, [["l_orderkey", "l_linenumber", "l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"]], ["l_orderkey", "l_linenumber", "id"])


ISSUES = "issues AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 1000 THEN 'low' END AS a, CASE WHEN c_nationkey > 20 THEN 'far' WHEN c_acctbal < 500 THEN 'low' END AS b FROM customer)"


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    bal = F.col("c_acctbal")
    a = F.when(bal < 0, "negative").when(bal < 1000, "low")
    b = F.when(F.col("c_nationkey") > 20, "far").when(bal < 500, "low")
    return table(spark, sf_dir, "customer").select("c_custkey", a.alias("a"), b.alias("b"))


@query("issue_counter_union", f"WITH {ISSUES} SELECT issue, count(*) AS n FROM (SELECT a AS issue FROM issues UNION ALL SELECT b FROM issues) WHERE issue IS NOT NULL GROUP BY issue")
def issue_counter_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.issue_counts(issues(spark, sf_dir), ["a", "b"])


@query("issue_examples_top3", f"WITH {ISSUES} SELECT a, c_custkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c_custkey) AS place FROM issues WHERE a IS NOT NULL) WHERE place <= 3")
def issue_examples_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.first_examples(issues(spark, sf_dir), "a", ["c_custkey"]).select("a", "c_custkey", "place")


@query("identify_na_type", f"WITH {CONTENTS} SELECT doc_id, CASE WHEN contains(upper(coalesce(content, 'NAN')), 'U') THEN 'RNA' ELSE 'DNA' END AS na_type FROM contents")
def identify_na_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).select("doc_id", seq.nucleic_type(F.col("content")).alias("na_type"))


@query("strand_concat", "SELECT l_orderkey, regexp_replace(string_agg(CASE WHEN starts_with(m, 'D') THEN substr(m, 2) ELSE m END, '' ORDER BY l_linenumber), '[^AGCTU]', '', 'g') AS strand FROM (SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'DA' WHEN 1 THEN 'DG' WHEN 2 THEN 'U' WHEN 3 THEN 'DC' ELSE 'HOH' END AS m FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)) GROUP BY l_orderkey")
def strand_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import strand_sequences

    k = F.col("l_partkey") % 5
    m = F.when(k == 0, "DA").when(k == 1, "DG").when(k == 2, "U").when(k == 3, "DC").otherwise("HOH")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).withColumns({"m": m, "strand": F.lit("A")})
    return strand_sequences(li, "l_orderkey", "strand", "l_linenumber", "m").select("l_orderkey", seq.strand_sequence(F.col("monomers")).alias("strand"))


@query("url_quote", "SELECT p_partkey, replace(replace(replace(p_brand || ' ' || p_type, '#', '%23'), ' ', '%20'), '/', '%2F') AS quoted FROM part")
def url_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", seq.url_quote(F.concat("p_brand", F.lit(" "), "p_type")).alias("quoted"))


@query("metrics_log_parse", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS DOUBLE) AS n, CAST(CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS DOUBLE) AS loss FROM lineitem GROUP BY ALL")
def metrics_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    line = F.concat(F.lit("[epoch] Stats: loss: "), F.col("q").cast("string"), F.lit(" , count: "), F.col("n").cast("string"))
    parsed = g.withColumn("m", seq.log_values(line))
    return parsed.select("l_returnflag", "l_linestatus", F.col("m")["count"].cast("double").alias("n"), F.col("m")["loss"].cast("double").alias("loss"))


@query("metrics_file_order", "SELECT 'train' AS sample, CAST(p_partkey AS VARCHAR) AS epoch, CAST(p_partkey AS INTEGER) AS epoch_order FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'test', 'v' || CAST(p_partkey AS VARCHAR), 1000000000 FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 3 > 0")
def metrics_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    path = F.when(k % 2 == 0, F.concat(F.lit("run/train_epoch_"), text, F.lit(".json"))).when(k % 3 > 0, F.concat(F.lit("run/test_epoch_v"), text, F.lit(".json"))).otherwise("run/other.json")
    named = table(spark, sf_dir, "part").withColumn("f", seq.metrics_file(path)).where(F.col("f").isNotNull())
    return named.select("f.sample", "f.epoch", F.coalesce("f.epoch_number", F.lit(10**9)).alias("epoch_order")).orderBy("sample", "epoch_order")


@query("curated_interactions", f"WITH {VALIDATED}, {ASSAYS}, a AS (SELECT l_orderkey, max(coalesce(kd, ki)) AS kd FROM assays GROUP BY l_orderkey) SELECT v.bare AS sequence, count(*) AS n, max(a.kd) AS kd FROM validated v JOIN a ON a.l_orderkey = v.doc_id WHERE v.issue IS NULL GROUP BY v.bare")
def curated_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assays(spark, sf_dir).groupBy("l_orderkey").agg(F.max(F.coalesce("kd", "ki")).alias("kd"))
    p = contents(spark, sf_dir).withColumn("p", seq.validate_protein(F.col("content"))).where("p.issue is null").select("doc_id", "p.sequence")
    return p.join(a, F.col("doc_id") == F.col("l_orderkey")).groupBy("sequence").agg(F.count(F.lit(1)).alias("n"), F.max("kd").alias("kd"))


