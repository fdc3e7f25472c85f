"""Graph and link-prediction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import graph, graphreport, linkpred, ranking
from ..session import table
from .domain import KGE, NODES, TRIPLES, entities, links, nodes, relation, triples
from .registry import query

SPLIT = f"""{TRIPLES}, tr AS (SELECT DISTINCT src, rel, dst, md5(concat_ws('|', '42', src, rel, dst)) AS h FROM triples),
f AS (SELECT DISTINCT h FROM (SELECT min(h) AS h FROM (SELECT h, unnest(['e|' || src, 'e|' || dst, 'r|' || rel]) AS part FROM tr) GROUP BY part)),
split AS (SELECT src, rel, dst, (CAST(('0x' || substr(h, 1, 8)) AS BIGINT) / 4294967296.0 < 0.8) OR h IN (SELECT h FROM f) AS in_train FROM tr)"""


@query("transductive_split", f"WITH {SPLIT} SELECT src, rel, dst, in_train FROM split")
def transductive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transductive_split(triples(spark, sf_dir))


@query("split_report", f"WITH {SPLIT} SELECT CASE WHEN s.in_train THEN 'train' ELSE 'test' END AS part, n_triples, n_nodes, n_relations FROM (SELECT in_train, count(*) AS n_triples, count(DISTINCT rel) AS n_relations FROM split GROUP BY in_train) s JOIN (SELECT in_train, count(DISTINCT node) AS n_nodes FROM (SELECT in_train, unnest([src, dst]) AS node FROM split) GROUP BY in_train) e ON s.in_train = e.in_train")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.split_report(graph.transductive_split(triples(spark, sf_dir)))


@query("symmetric_neighbors", f"WITH {TRIPLES} SELECT src AS node, dst AS neighbour FROM triples UNION SELECT dst, src FROM triples")
def symmetric_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.symmetric(triples(spark, sf_dir))


@query("entity_dictionary", f"WITH {TRIPLES} SELECT entity_id, CAST(row_number() OVER (ORDER BY entity_id) - 1 AS INTEGER) AS idx FROM (SELECT src AS entity_id FROM triples UNION SELECT dst FROM triples)")
def entity_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_dictionary(triples(spark, sf_dir)).withColumn("idx", F.col("idx").cast("int"))


@query("encode_edges", f"WITH {TRIPLES}, d AS (SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS idx FROM (SELECT src AS entity_id FROM triples UNION SELECT dst FROM triples)) SELECT rel, count(*) AS n, sum(a.idx)::BIGINT AS sum_src, sum(b.idx)::BIGINT AS sum_dst FROM triples t JOIN d a ON t.src = a.entity_id JOIN d b ON t.dst = b.entity_id GROUP BY rel")
def encode_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    return graph.encode_edges(t, graph.entity_dictionary(t)).groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.sum("src_idx").cast("long").alias("sum_src"), F.sum("dst_idx").cast("long").alias("sum_dst"))


@query("subset_semi_join", f"WITH {TRIPLES} SELECT DISTINCT src, rel, dst FROM triples WHERE src IN (SELECT 'c' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 50 = 0) OR dst IN (SELECT 'c' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 50 = 0)")
def subset_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 9 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    p = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return graph.either_end_in(triples(spark, sf_dir), c.union(p), "id", ["src", "rel", "dst"])


@query("graph_label_counts", f"WITH {NODES} SELECT labels, count(*) AS n FROM nodes GROUP BY labels")
def graph_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_counts(nodes(spark, sf_dir))


@query("graph_relationship_counts", f"WITH {TRIPLES}, {NODES} SELECT a.labels AS src_labels, b.labels AS dst_labels, count(*) AS n FROM triples t JOIN nodes a ON t.src = a.id JOIN nodes b ON t.dst = b.id GROUP BY ALL")
def graph_relationship_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relationship_counts(triples(spark, sf_dir), nodes(spark, sf_dir))


UND = f"{TRIPLES}, und AS (SELECT src AS node, dst AS neighbour FROM triples WHERE src <> dst UNION SELECT dst, src FROM triples WHERE src <> dst)"


@query("graph_degree_topn", f"WITH {UND} SELECT node, count(*) AS degree FROM und GROUP BY node ORDER BY degree DESC, node LIMIT 20")
def graph_degree_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_degrees(triples(spark, sf_dir), 20)


@query("triangle_count", f"WITH {KGE}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM lnk WHERE src <> dst), t AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b) SELECT node, count(*) AS triangles FROM (SELECT unnest([a, b, c]) AS node FROM t) GROUP BY node")
def triangle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangles(links(spark, sf_dir))


@query("k_core")
def k_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.k_core(triples(spark, sf_dir), 3)


@query("closeness_centrality")
def closeness_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    found = graph.closeness(t, graph.symmetric(t).select("node").distinct())
    return found.orderBy(F.desc("closeness"), F.desc("reached"), "node").limit(200).withColumn("closeness", F.round("closeness", 6))


@query("core_numbers")
def core_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core number of every node."""
    return graphreport.core_numbers(triples(spark, sf_dir))


@query("dense_core")
def dense_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first core that is dense enough for a report."""
    return graphreport.dense_core(triples(spark, sf_dir), 0.01).withColumn("density", F.round("density", 6))


@query("closeness_by_sketches")
def closeness_by_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 nodes of highest closeness, estimated for all."""
    found = graphreport.sketched_closeness(triples(spark, sf_dir))
    return found.orderBy(F.desc("closeness"), F.desc("reached"), "node").limit(200).withColumn("closeness", F.round("closeness", 6))


@query("triangles_by_sampling")
def triangles_by_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of all links, estimated from 20,000 pairs of neighbours."""
    return graphreport.sampled_triangles(links(spark, sf_dir))


@query("edge_buckets", f"WITH {TRIPLES}, h AS (SELECT CAST(('0x' || substr(md5('42|' || src), 1, 8)) AS BIGINT) % 4 AS a, CAST(('0x' || substr(md5('42|' || dst), 1, 8)) AS BIGINT) % 4 AS b, CAST(('0x' || substr(md5(concat_ws('|', '42', src, rel, dst)), 1, 8)) AS BIGINT) % 16 AS c FROM (SELECT DISTINCT src, rel, dst FROM triples)) SELECT CAST(a AS INTEGER) AS src_part, CAST(b AS INTEGER) AS dst_part, CAST(c AS INTEGER) AS chunk, count(*) AS n FROM h GROUP BY ALL")
def edge_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = graph.edge_buckets(triples(spark, sf_dir).distinct(), 4, 16)
    return b.groupBy("src_part", "dst_part", "chunk").agg(F.count(F.lit(1)).alias("n"))


# All links of different entities are true ones, and are filtered from the negatives.
TRUE = f"""{KGE}, sym AS (SELECT src, dst FROM lnk UNION SELECT dst, src FROM lnk),
tru AS (SELECT DISTINCT src, dst FROM lnk WHERE src <> dst)"""
NEG = f"""{TRUE}, num AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n_ids FROM ent),
cnt AS (SELECT src, count(*) * {linkpred.NEGATIVES} AS n, md5(concat_ws('|', '42', CAST(src AS VARCHAR))) AS h FROM tru GROUP BY src),
walk AS (SELECT src, n, n_ids, {list(linkpred.STEPS)}[CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % {len(linkpred.STEPS)} + 1] % n_ids AS step, CAST(('0x' || substr(h, 9, 8)) AS BIGINT) % n_ids AS start FROM cnt, (SELECT DISTINCT n_ids FROM num)),
fre AS (SELECT b.src, b.n, b.j, num.id AS dst FROM (SELECT *, unnest(range(n_ids)) AS j FROM walk) b JOIN num ON num.i = (b.start + b.j * b.step) % b.n_ids AND num.id <> b.src
  WHERE NOT EXISTS (SELECT 1 FROM sym s WHERE s.src = b.src AND s.dst = num.id)),
neg AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY j) AS p FROM fre) WHERE p <= n)"""
_SUMS = "".join(f", count(*) FILTER (label = 1 AND rank <= {k}) AS tp{k}, coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (label = 1 AND rank <= {k}), 0) AS dcg{k}" for k in linkpred.CUTOFFS)
_AT = "".join(f", CASE WHEN tp{k} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit{k}, CAST(tp{k} AS DOUBLE) / least({k}, num_candidates) AS p{k}, CAST(tp{k} AS DOUBLE) / num_true AS r{k}, dcg{k} / list_sum([1.0::DOUBLE / log2(i + 1) FOR i IN range(1, CAST(least({k}, num_true) AS BIGINT) + 1)]) AS ndcg{k}" for k in linkpred.CUTOFFS)
RANKED = f"""{NEG}, cand AS (SELECT src, dst, 1 AS label FROM tru WHERE src IN (SELECT src FROM neg) UNION ALL SELECT src, dst, 0 FROM neg),
scored AS (SELECT c.src, c.dst, c.label, -sqrt(list_sum([(a.v[i] - (b.v[i] + p.params[i])) * (a.v[i] - (b.v[i] + p.params[i])) FOR i IN range(1, len(a.v) + 1)])) AS score FROM cand c JOIN ent a ON c.src = a.id JOIN ent b ON c.dst = b.id, par p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM scored),
tp AS (SELECT *, sum(label) OVER (PARTITION BY src ORDER BY rank) AS hits FROM ranked),
per AS (SELECT src, sum(label) AS num_true, count(*) - sum(label) AS num_negatives, count(*) AS num_candidates, avg(rank) FILTER (label = 1) AS mean_rank, median(rank) FILTER (label = 1) AS median_rank,
  min(rank) FILTER (label = 1) AS best_rank, max(rank) FILTER (label = 1) AS worst_rank, avg(1.0::DOUBLE / rank) FILTER (label = 1) AS mrr, avg(CAST(hits AS DOUBLE) / rank) FILTER (label = 1) AS map{_SUMS} FROM tp GROUP BY src),
met AS (SELECT *{_AT} FROM per)"""
_ROUNDED = "".join(f", hit{k}, round(p{k}, 6) AS p{k}, round(r{k}, 6) AS r{k}, round(CASE WHEN p{k} + r{k} > 0 THEN 2 * p{k} * r{k} / (p{k} + r{k}) ELSE 0 END, 6) AS f{k}, round(ndcg{k}, 6) AS ndcg{k}" for k in linkpred.CUTOFFS)
_MEANS = "".join(f", round(avg(hit{k}), 6) AS hit{k}, round(avg(r{k}), 6) AS r{k}, round(avg(p{k}), 6) AS p{k}, round(avg(ndcg{k}), 6) AS ndcg{k}" for k in linkpred.CUTOFFS)


def _true(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e, known = entities(spark, sf_dir), links(spark, sf_dir)
    return e, known, linkpred.true_links(known.where("src <> dst"), e)


def _lists(spark: SparkSession, sf_dir: str) -> ranking.RankedLists:
    e, known, true = _true(spark, sf_dir)
    with_params = e.join(F.broadcast(relation(spark, sf_dir)))  # one row
    return ranking.RankedLists(true, known, with_params, F.col("params"))


@query("filtered_negatives", f"WITH {NEG} SELECT src, dst FROM neg")
def filtered_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, known, true = _true(spark, sf_dir)
    return ranking.negatives(true, known, e)


@query("score_translation_l2", f"WITH {RANKED} SELECT src, dst, label, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked")
def score_translation_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).rows().select("src", "dst", "label", F.round("score", 6).alias("score"), "rank")


@query("rank_metrics_per_source", f"WITH {RANKED} SELECT src, CAST(num_true AS BIGINT) AS num_true, CAST(num_negatives AS BIGINT) AS num_negatives, num_candidates, round(mean_rank, 6) AS mean_rank, round(median_rank, 6) AS median_rank, CAST(best_rank AS INTEGER) AS best_rank, CAST(worst_rank AS INTEGER) AS worst_rank, round(mrr, 6) AS mrr, round(map, 6) AS map{_ROUNDED} FROM met")
def rank_metrics_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = linkpred.source_metrics(_lists(spark, sf_dir).true_rows())
    r = lambda c, n: F.round(F.col(f"`{c}`"), 6).alias(n)
    at = [r(f"{c}@{k}", f"{n}{k}") for k in linkpred.CUTOFFS for c, n in (("hit", "hit"), ("precision", "p"), ("recall", "r"), ("f1", "f"), ("ndcg", "ndcg"))]
    return m.select("src", "num_true", "num_negatives", "num_candidates", r("mean_rank", "mean_rank"), r("median_rank", "median_rank"), "best_rank", "worst_rank", r("mrr", "mrr"), r("map", "map"), *at)


@query("rank_metrics_summary", f"WITH {RANKED} SELECT count(*) AS num_evaluated_sources, round(avg(num_true), 6) AS avg_links_per_node, round(median(median_rank), 6) AS median_rank, round(avg(mean_rank), 6) AS mean_rank, round(avg(map), 6) AS map, round(avg(mrr), 6) AS mrr{_MEANS} FROM met")
def rank_metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = linkpred.summary(linkpred.source_metrics(_lists(spark, sf_dir).true_rows()))
    names = {c: c for c in ("avg_links_per_node", "median_rank", "mean_rank", "map", "mrr")}
    names |= {f"{c}@{k}": f"{n}{k}" for k in linkpred.CUTOFFS for c, n in (("hit", "hit"), ("recall", "r"), ("precision", "p"), ("ndcg", "ndcg"))}
    return s.select("num_evaluated_sources", *[F.round(F.col(f"`{a}`"), 6).alias(b) for a, b in names.items()])


@query("pr_best_f1", f"""WITH {RANKED}, g AS (SELECT score, sum(label) AS p, count(*) AS n FROM ranked GROUP BY score), c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS taken, sum(p) OVER () AS pos FROM g),
q AS (SELECT score, CAST(tp AS DOUBLE) / taken AS p, CAST(tp AS DOUBLE) / pos AS r FROM c)
SELECT round(score, 6) AS bin_threshold, round(p, 6) AS bin_precision, round(r, 6) AS bin_recall, round(2 * p * r / (p + r), 6) AS bin_f1 FROM q ORDER BY 2 * p * r / (p + r + 1e-8) DESC, score LIMIT 1""")
def pr_best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _lists(spark, sf_dir).best_f1()
    return best.select(*[F.round(c, 6).alias(c) for c in best.columns])


@query("ranked_predictions", f"WITH {KGE}, s AS (SELECT a.id AS src, b.id AS dst, -sqrt(list_sum([(a.v[i] - (b.v[i] + p.params[i])) * (a.v[i] - (b.v[i] + p.params[i])) FOR i IN range(1, len(a.v) + 1)])) AS score FROM ent a JOIN ent b ON a.id <> b.id AND a.id % 20 = 0, par p) SELECT src, dst, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM s) WHERE rank <= 10")
def ranked_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir)
    with_params = e.join(F.broadcast(relation(spark, sf_dir)))  # one row
    found = linkpred.predict(e.where("id % 20 = 0").select(F.col("id").alias("src")), with_params, F.col("params"), 10)
    return found.select("src", "dst", F.round("score", 6).alias("score"), "rank")


@query("score_operators_comparators", f"""WITH {KGE}, pr AS (SELECT a.id, a.v AS l, b.v AS r, p.params AS p FROM ent a JOIN ent b ON b.id = a.id + 1, par p),
o AS (SELECT id, l, 'translation' AS operator, [r[i] + p[i] FOR i IN range(1, 65)] AS w FROM pr UNION ALL SELECT id, l, 'diagonal', [r[i] * p[i] FOR i IN range(1, 65)] FROM pr
  UNION ALL SELECT id, l, 'complex_diagonal', [CASE WHEN i <= 32 THEN r[i] * p[i] - r[i + 32] * p[i + 32] ELSE r[i - 32] * p[i] + r[i] * p[i - 32] END FOR i IN range(1, 65)] FROM pr)
SELECT id, operator, round(list_sum([l[i] * w[i] FOR i IN range(1, 65)]), 6) AS dot, round(list_sum([l[i] * w[i] FOR i IN range(1, 65)]) / (sqrt(list_sum([x * x FOR x IN l])) * sqrt(list_sum([x * x FOR x IN w]))), 6) AS cos,
  round(-sqrt(list_sum([(l[i] - w[i]) * (l[i] - w[i]) FOR i IN range(1, 65)])), 6) AS l2, round(-list_sum([(l[i] - w[i]) * (l[i] - w[i]) FOR i IN range(1, 65)]), 6) AS squared_l2 FROM o""")
def score_operators_comparators(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir)
    pr = e.select("id", F.col("v").alias("l")).join(e.select((F.col("id") - 1).alias("id"), F.col("v").alias("r")), "id").join(F.broadcast(relation(spark, sf_dir)))  # one row
    names = ("translation", "diagonal", "complex_diagonal")
    o = pr.select("id", "l", F.explode(F.array(*[F.struct(F.lit(n).alias("operator"), vec.apply_operator(n, F.col("r"), F.col("params")).alias("w")) for n in names])).alias("o")).select("id", "l", "o.*")
    return o.select("id", "operator", *[F.round(vec.compare(c, F.col("l"), F.col("w")), 6).alias(c) for c in ("dot", "cos", "l2", "squared_l2")])


@query("score_linear_affine", f"""WITH {KGE}, m AS (SELECT list(v ORDER BY id) AS m FROM ent WHERE id < 64), pr AS (SELECT a.id, a.v AS l, b.v AS r, p.params AS p, m.m AS m FROM ent a JOIN ent b ON b.id = a.id + 1, par p, m),
w AS (SELECT id, l, p, [list_sum([m[j][i] * r[i] FOR i IN range(1, 65)]) FOR j IN range(1, 65)] AS w FROM pr)
SELECT id, round(list_sum([l[i] * w[i] FOR i IN range(1, 65)]), 6) AS linear, round(list_sum([l[i] * (w[i] + p[i]) FOR i IN range(1, 65)]), 6) AS affine FROM w""")
def score_linear_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir)
    m = e.where("id < 64").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("m")).select(F.col("m.v").alias("m"))
    pr = e.select("id", F.col("v").alias("l")).join(e.select((F.col("id") - 1).alias("id"), F.col("v").alias("r")), "id").join(F.broadcast(relation(spark, sf_dir))).join(F.broadcast(m))  # one row each
    w = pr.select("id", "l", vec.apply_operator("linear", F.col("r"), F.col("m")).alias("a"), vec.apply_operator("affine", F.col("r"), F.col("m"), F.col("params")).alias("b"))
    return w.select("id", F.round(vec.dot(F.col("l"), F.col("a")), 6).alias("linear"), F.round(vec.dot(F.col("l"), F.col("b")), 6).alias("affine"))


@query("ranking_loss", "SELECT l_orderkey, l_linenumber, round(greatest(0.0, 0.1 - l_discount + l_tax), 6) AS loss FROM lineitem")
def ranking_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(vec.ranking_loss(F.col("l_discount"), F.col("l_tax")), 6).alias("loss"))


@query("subset_sizes", f"WITH {TRIPLES} SELECT CASE WHEN rel = 'has_similarity' THEN 'similar' ELSE 'interacts' END AS subset, count(*) AS subset_num_edges, (SELECT count(DISTINCT n) FROM (SELECT rel AS r, unnest([src, dst]) AS n FROM triples) x WHERE x.r = t.rel) AS subset_num_unique_nodes FROM triples t GROUP BY rel")
def subset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    one = lambda rel, name: linkpred.subset_size(t.where(F.col("rel") == rel)).select(F.lit(name).alias("subset"), "subset_num_edges", "subset_num_unique_nodes")
    return one("has_similarity", "similar").unionByName(one("interacts_with", "interacts"))


@query("experiment_grid_summary", "SELECT operator, comparator, epoch, sample, o * 1000 + c * 100 + epoch * 10 + s AS run FROM (VALUES ('none', 0), ('translation', 1), ('diagonal', 2), ('linear', 3), ('affine', 4)) a(operator, o), (VALUES ('cos', 0), ('dot', 1), ('l2', 2), ('squared_l2', 3)) b(comparator, c), (SELECT unnest(range(1, 31))::INTEGER AS epoch) e, (VALUES ('train', 0), ('test', 1)) d(sample, s)")
def experiment_grid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda c, names: F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("at")) for i, n in enumerate(names)])).alias(c)
    rows = spark.range(1, 31, 1, 1).select(F.col("id").cast("int").alias("epoch"))
    rows = rows.select("*", side("o", ("none", "translation", "diagonal", "linear", "affine"))).select("*", side("c", ("cos", "dot", "l2", "squared_l2"))).select("*", side("s", ("train", "test")))
    run = F.col("o.at") * 1000 + F.col("c.at") * 100 + F.col("epoch") * 10 + F.col("s.at")
    return rows.select(F.col("o.name").alias("operator"), F.col("c.name").alias("comparator"), "epoch", F.col("s.name").alias("sample"), run.alias("run"))
