"""Operators on small tables: null rules, order, alignment, graphs, nearest neighbours, ranking."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import align, graph, linkpred, lookups, relational, simjoin
from strandlake.operators.components import connected_components
from strandlake.store import materialize


def test_null_rules(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, x string")
    assert [r["i"] for r in df.where(relational.not_in(F.col("x"), ["a"])).orderBy("i").collect()] == [2, 3]
    assert [r["i"] for r in df.where(relational.not_like(F.col("x"), "a")).orderBy("i").collect()] == [2, 3]
    twice = df.select("x").unionAll(df.select("x"))
    assert relational.natural_join(twice, df.select("x")).count() == 6
    assert relational.natural_join(df, df.select("x", F.lit(1).alias("more"))).where("x is null").count() == 1


def test_keep_first_and_repairs(spark):
    df = spark.createDataFrame([(1, "a", 9), (0, "a", 8), (2, None, 7), (3, None, 6)], "at int, k string, v int")
    assert sorted((r["at"], r["v"]) for r in relational.keep_first(df, ["k"], ["at"]).collect()) == [(0, 8), (2, 7)]
    assert [r["k"] for r in relational.repair_values(df, "k", {"a": None}).collect()] == [None] * 4
    assert sorted(r["surrogate_id"] for r in relational.surrogate_ids(df.where("k is not null"), "k", "X", ["at"]).collect()) == ["X1"]
    with pytest.raises(ValueError):
        relational.require_columns(df, ["no"])


def test_dense_numbers_of_an_empty_and_a_long_table(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7 % 1000).alias("x"))
    got = relational.dense_numbers(df, "x", "n").orderBy("x").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))
    assert relational.dense_numbers(df.where("x < 0"), "x", "n").count() == 0


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def brute_align(a, b, local, match=2.0, mismatch=-1.0, open_=-0.5, extend=-0.1):
    """Best score by the plain recurrence."""
    n, m, low = len(a), len(b), -1e9
    t = [[[low] * 3 for _ in range(m + 1)] for _ in range(n + 1)]
    t[0][0][0] = 0.0
    best = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                t[i][j][0] = max(max(t[i - 1][j - 1]), 0.0 if local else low) + (match if a[i - 1] == b[j - 1] else mismatch)
            if i:
                t[i][j][1] = max(t[i - 1][j][0] + open_, t[i - 1][j][1] + extend, t[i - 1][j][2] + open_)
            if j:
                t[i][j][2] = max(t[i][j - 1][0] + open_, t[i][j - 1][2] + extend, t[i][j - 1][1] + open_)
            if local and i and j:
                best = max(best, t[i][j][0])
    return best if local else max(t[n][m])


@pytest.mark.parametrize("mode", ["global", "local"])
def test_alignment(mode):
    random.seed(5)
    word = lambda: "".join(random.choice("ACGT") for _ in range(random.randrange(1, 14)))
    a, b = [word() for _ in range(80)], [word() for _ in range(80)]
    score, identity = align.align_batch(a + a, b + a, mode, 2.0, -1.0, -0.5, -0.1)
    assert score[:80] == pytest.approx([brute_align(x, y, mode == "local") for x, y in zip(a, b, strict=True)])
    assert identity[80:] == pytest.approx([100.0] * 80)
    assert (identity >= 0).all() and (identity <= 100).all()


@pytest.mark.parametrize("mode", ["global", "local"])
def test_long_alignment_equals_the_tables(mode):
    rng = random.Random(11)
    for _ in range(150):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randint(1, 45))) for _ in range(2))
        score, identity = align.align_batch([a], [b], mode, 2.0, -1.0, -0.5, -0.1)
        assert align.align_long(a, b, mode, 2.0, -1.0, -0.5, -0.1) == (pytest.approx(score[0]), pytest.approx(identity[0])), (a, b)


def test_long_pairs_take_little_memory(spark):
    import tracemalloc

    rng = random.Random(2)
    a = "".join(rng.choice("ACGT") for _ in range(3000))
    b = a[:1000] + "GATTACA" + a[1040:]
    tracemalloc.start()
    _, identity = align.align_long(a, b, "global", 2.0, -1.0, -0.5, -0.1)
    assert tracemalloc.get_traced_memory()[1] < 20 << 20  # the tables would take 54 MB for choices alone
    tracemalloc.stop()
    assert 98 < identity < 99.5
    got = align.align_pairs(spark.createDataFrame([(a, b), ("ACGT", "ACGT"), (a, None)], "a string, b string"), "a", "b").select("alignment").collect()
    assert [r[0] for r in got] == [pytest.approx(identity), 100.0, 0.0]


def test_alignment_of_nulls(spark):
    df = spark.createDataFrame([("ACGT", "ACGT"), (None, "A"), ("", "A")], "a string, b string")
    assert [r[0] for r in align.align_pairs(df, "a", "b").select("alignment").collect()] == [100.0, 0.0, 0.0]


@pytest.mark.parametrize("metric", ["cos", "dot", "l2", "squared_l2"])
def test_nearest(spark, metric):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 5))
    m[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    with np.errstate(all="ignore"):
        s = {"dot": m @ m.T, "cos": np.nan_to_num(m @ m.T / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1))), "l2": -np.linalg.norm(m[:, None] - m[None], axis=2), "squared_l2": -(np.linalg.norm(m[:, None] - m[None], axis=2) ** 2)}[metric]
    for q, _rank, dst, score in [(r["src"], r["rank"], r["dst"], r["score"]) for r in simjoin.nearest(df, "id", "v", 4, metric).collect()]:
        assert q != dst and score == pytest.approx(s[q, dst])
        others = np.delete(s[q], q)
        assert score >= np.sort(others)[-4] - 1e-9


def test_tanimoto_forms_agree(spark):
    random.seed(2)
    rows = [(i, sorted({random.randrange(25) for _ in range(random.randrange(0, 12))})) for i in range(80)]
    rows += [(100 + i, rows[i % 5][1][::-1]) for i in range(12)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, s array<int>")
    want = sorted((a, b) for a, x in rows for b, y in rows if a < b and x and y and len({*x} & {*y}) / len({*x} | {*y}) >= 0.6)
    assert sorted((r["id_1"], r["id_2"]) for r in simjoin.tanimoto_join(df, "id", "s", 0.6).collect()) == want
    some = simjoin.bucket_candidates(df.where(F.size("s") > 0), "id", "s", 0.6)
    assert set(want) <= {(r["id_1"], r["id_2"]) for r in some.collect()}
    assert "CartesianProduct" not in some._jdf.queryExecution().toString() and "NestedLoop" not in some._jdf.queryExecution().toString()


def test_split_keeps_all_entities_in_train(spark):
    random.seed(4)
    rows = [(f"a{random.randrange(40)}", random.choice("rs"), f"b{random.randrange(40)}") for _ in range(400)]
    got = graph.transductive_split(spark.createDataFrame(rows, "src string, rel string, dst string")).toPandas()
    train = got[got.in_train]
    assert len(got) == len(set(rows)) and 0.7 < len(train) / len(got) < 0.95
    assert set(train.src) == set(got.src) and set(train.dst) == set(got.dst)


def test_core_and_closeness(spark):
    clique = [(i, "r", j) for i in range(4) for j in range(i)]
    df = spark.createDataFrame([(str(a), r, str(b)) for a, r, b in [*clique, (4, "r", 0), (5, "r", 4)]], "src string, rel string, dst string")
    assert {r["node"] for r in graph.k_core(df, 3).collect()} == {"0", "1", "2"}
    assert graph.k_core(df, 9).count() == 0
    near = graph.closeness(df, spark.createDataFrame([("5",)], "node string")).first()
    assert (near["reached"], near["distance"]) == (5, 1 + 2 + 9)
    assert {r["node"]: r["triangles"] for r in graph.triangles(df).collect()} == {str(i): 3 for i in range(4)}


def test_ranking_metrics(spark):
    lists = spark.createDataFrame([("a", "x", 1, 0.9), ("a", "y", 0, 0.8), ("a", "z", 1, 0.7), ("b", "x", 0, 0.5), ("b", "y", 1, 0.5)], "src string, dst string, label int, score double")
    ranked = linkpred.ranked(lists)
    m = {r["src"]: r.asDict() for r in linkpred.source_metrics(ranked, (1, 3)).collect()}
    assert m["a"]["mrr"] == pytest.approx((1 + 1 / 3) / 2) and m["a"]["map"] == pytest.approx((1 + 2 / 3) / 2)
    assert m["b"]["hit@1"] == 0.0 and m["b"]["hit@3"] == 1.0 and m["b"]["precision@3"] == 0.5
    assert m["a"]["ndcg@3"] == pytest.approx((1 + 0.5) / (1 + 1 / np.log2(3)))
    best = linkpred.best_f1(lists).first()
    assert best["bin_threshold"] == 0.5 and best["bin_f1"] == pytest.approx(0.75)
    assert linkpred.best_f1(lists.where("label > 5")).count() == 0


def test_cascade_counts_a_hit_under_its_first_strategy(spark):
    q = spark.createDataFrame([(1, "ACDEF")], "query_id int, query string")
    d = spark.createDataFrame([(1, "ACDEF"), (2, "XXACDEFXX"), (3, "ACDXX"), (4, "WWWWW")], "hit_id int, hit string")
    assert [(r["hit_id"], r["strategy"]) for r in lookups.cascade(q, d).orderBy("place").collect()] == [(1, 1), (2, 2), (3, 2)]


def test_local_identity_counts_the_ends_outside():
    got = lambda a, b, **s: align.align_batch([a], [b], "local", 2.0, -1.0, s.get("open_", -0.5), -0.1)[1][0]
    assert got("ACCGT", "ACG") == pytest.approx(100 * 3 / 5)
    assert got("TTTACGT", "ACGTCC", open_=-5.0) == pytest.approx(100 * 4 / 9)
    assert got("AAAACCCT", "AAAAGGGT", open_=-5.0) == pytest.approx(100 * 5 / 8)  # equal letters outside count
    assert got("AAA", "CCC") == 0


def test_negatives_walk_over_every_entity_once(spark):
    entities = spark.range(37).select("id")
    known = spark.createDataFrame([(0, d) for d in range(1, 30)] + [(5, 6), (7, 5), (9, 9)], "src long, dst long")
    true = linkpred.true_links(known.where("src <> dst"), entities)
    for per_true in (1, 3, 150):
        got = [tuple(r) for r in linkpred.filtered_negatives(true, known, entities, per_true).collect()]
        linked = {(a, b) for a, b in known.collect()} | {(b, a) for a, b in known.collect()}
        assert len(got) == len(set(got)) and not set(got) & linked and all(a != b for a, b in got)
        for src, n in ((0, 29), (5, 1), (7, 1)):
            free = sum(d != src and (src, d) not in linked for d in range(37))
            assert sum(a == src for a, _ in got) == min(n * per_true, free)
    assert linkpred.filtered_negatives(true.limit(0), known, entities).count() == 0


@pytest.mark.parametrize("walk", [1, 7])
def test_negatives_are_the_same_in_any_blocks(spark, walk, monkeypatch):
    entities, known = spark.range(50).select("id"), spark.createDataFrame([(i % 7, i) for i in range(50)], "src long, dst long")
    true = linkpred.true_links(known.where("src <> dst"), entities)
    want = sorted(map(tuple, linkpred.filtered_negatives(true, known, entities, 2).collect()))
    monkeypatch.setattr(linkpred, "WALK", walk)
    assert sorted(map(tuple, linkpred.filtered_negatives(true, known, entities, 2).collect())) == want


def test_blocks_of_vectors_are_not_shuffled_for_each_pair(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 4))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>")
    found = simjoin.nearest(v, "id", "v", 3, "l2")
    assert "REPARTITION" not in found._jdf.queryExecution().executedPlan().toString()
    far = ((m[:, None] - m[None]) ** 2).sum(2) + np.diag(np.full(300, np.inf))
    assert {(r["src"], r["dst"]) for r in found.collect()} == {(i, int(j)) for i in range(300) for j in np.argsort(far[i])[:3]}


def test_negatives_are_made_without_being_shuffled_or_stored(spark, monkeypatch):
    stored = []

    def count(df, label, materialize=linkpred.materialize):
        out = materialize(df, label)
        stored.append(out.count())
        return out

    monkeypatch.setattr(linkpred, "materialize", count)
    monkeypatch.setattr(linkpred, "WALK", 64)
    entities = spark.range(0, 1000).select("id")
    true = spark.createDataFrame([(i % 5, 7 * i % 1000) for i in range(40)], "src long, dst long").where("src <> dst").distinct()
    known = true.unionAll(spark.createDataFrame([(0, i) for i in range(300, 700)], "src long, dst long"))
    got = linkpred.filtered_negatives(true, known, entities, 50)
    rows = [tuple(r) for r in got.collect()]
    near = {(a, b) for r in known.collect() for a, b in ((r["src"], r["dst"]), (r["dst"], r["src"]))}
    assert len(set(rows)) == len(rows) and not set(rows) & near and all(a != b for a, b in rows)
    each = {r["src"]: r["count"] for r in true.groupBy("src").count().collect()}
    for s, n in each.items():
        free = sum((s, b) not in near and b != s for b in range(1000))
        assert sum(a == s for a, _ in rows) == min(50 * n, free)
    assert max(stored) <= 1000 < len(rows)


def test_vectors_are_not_copied_for_each_cell(spark):
    rng = np.random.default_rng(6)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(200, 4)))], "id long, v array<double>")
    found = simjoin.nearest_lsh(v, "id", "v", 3, share=1)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    want = simjoin.nearest(v, "id", "v", 3)
    assert {(r["src"], r["dst"], r["rank"]) for r in found.collect()} == {(r["src"], r["dst"], r["rank"]) for r in want.collect()}


def test_split_keeps_ends_without_a_triple_below_the_share(spark, monkeypatch):
    """The first triple by hash of each end and relation is in train, at any share; least hashes are aggregated as numbers."""
    import hashlib

    rows = [(f"a{i}", "r", f"b{i % 7}") for i in range(40)] + [("a1", "s", None), (None, "s", "b2"), ("lone", "t", "pair")]
    df = spark.createDataFrame(rows, "src string, rel string, dst string")
    h = {r: hashlib.md5("|".join(["42", *[v for v in r if v is not None]]).encode()).hexdigest() for r in rows}
    ends = {}
    for r in rows:
        for part in (r[0] and "e|" + r[0], r[2] and "e|" + r[2], "r|" + r[1]):
            ends[part] = min(ends.get(part, "z"), h[r])
    for share in (0.0, 0.3, 0.8):
        want = {r: int(h[r][:8], 16) / 2**32 < share or h[r] in ends.values() for r in rows}
        assert {tuple(r)[:3]: r[3] for r in graph.transductive_split(df.union(df), share).collect()} == want
    kept = []
    monkeypatch.setattr(graph, "materialize", lambda d, label: kept.append((label, d._jdf.queryExecution().executedPlan().toString())) or materialize(d, label))
    graph.transductive_split(df).count()
    assert "SortAggregate" not in dict(kept)["bare"]


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_core_is_written_again_only_while_nodes_go(spark, monkeypatch, k):
    """Against plain peeling; loops, repeats, directions and null ends don't count."""
    rng = random.Random(k)
    rows = [(rng.choice("abcdefgh"), rng.choice("abcdefghxyz")) for _ in range(22)] + [("a", "a"), ("t1", "t2"), ("t2", "t3"), ("t1", None), ("b", "a"), ("a", "b")]
    left = {tuple(sorted(r)) for r in rows if None not in r and r[0] != r[1]}
    rounds = 0
    while low := {n for e in left for n in e if sum(n in x for x in left) < k}:
        left, rounds = {e for e in left if not low & set(e)}, rounds + 1
    kept = []
    monkeypatch.setattr(graph, "materialize", lambda d, label: kept.append(label) or materialize(d, label))
    assert {tuple(r) for r in graph.k_core(spark.createDataFrame(rows, "src string, dst string"), k).select("node", "neighbour").collect()} == left
    assert kept.count("core") == rounds + 1


@pytest.mark.parametrize("order", ["v", "s"])
def test_dense_numbers_need_one_shuffle(spark, order):
    """1, 2, ... over several partitions, also by a struct; the rows are not shuffled again after they are stored."""
    values = random.Random(3).sample(range(100_000), 5_000)
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("s", F.struct((F.col("v") / 2).alias("half"), "v")).repartition(7)
    got = relational.dense_numbers(df, order, "n")
    assert got.columns == ["v", "s", "n"]
    assert {r["v"]: r["n"] for r in got.collect()} == {v: i + 1 for i, v in enumerate(sorted(values))}
    assert "Window [row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert relational.dense_numbers(df.limit(0), order, "n").count() == 0


def test_tanimoto_join_rules_pairs_out_by_parities(spark):
    rng = random.Random(7)
    sets = {i: sorted(rng.sample(range(40), rng.randint(20, 30))) for i in range(60)}
    want = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= 0.7 * len({*sets[a]} | {*sets[b]})}
    got = simjoin.tanimoto_join(spark.createDataFrame([*sets.items()], "id long, s array<int>"), "id", "s", 0.7)
    assert want and {(r["id_1"], r["id_2"]) for r in got.collect()} == want
    assert "bit_count" in got._jdf.queryExecution().optimizedPlan().toString()  # in the join, before pairs are shuffled
