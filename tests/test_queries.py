"""All registered queries that SQL can express, against DuckDB; the others for their rows."""

from __future__ import annotations

import random

import pytest
from conftest import SF, rows_of

from strandlake import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_runs(spark, name):
    """They have rows and, on a second run, the same ones; their values are held against brute force elsewhere."""
    one, other = (sorted(map(str, plans.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert one and one == other


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_approximate_neighbours_are_the_nearest(spark, sf):
    from strandlake.operators import simjoin
    from strandlake.plans.domain import entities

    e = entities(spark, f"/root/testdata/{sf}")
    want = simjoin.nearest(e, "id", "v", 10, queries=e.where("id % 20 = 0")).select("src", "dst", "rank").toPandas()
    got = plans.QUERIES["knn_lsh"](spark, f"/root/testdata/{sf}").where("src % 20 = 0").select("src", "dst", "rank").toPandas()
    assert got.groupby("src").size().eq(10).all() and not got.duplicated(["src", "dst"]).any()
    recall = len(got.merge(want, on=["src", "dst"])) / len(want)
    print(f"recall@10 {sf}: {recall:.4f}")
    assert recall >= 0.9


def whole_graph(duck):
    sql = "SELECT 'c' || o_custkey AS src, 'i' AS rel, 'p' || l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION SELECT 'p' || l_partkey, 's', 's' || l_suppkey FROM lineitem"
    return duck.sql(sql).fetchall()


def test_graph_queries_without_sql_read_all_edges(spark, duck):
    edges = whole_graph(duck)
    assert plans.QUERIES["edge_buckets"](spark, SF).agg({"n": "sum"}).first()[0] == len(edges)
    near = {}
    for a, _, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    while few := [x for x, y in near.items() if len(y) < 3]:
        for x in few:
            for y in near.pop(x):
                near.get(y, set()).discard(x)
    want = sorted((x, y) for x, ys in near.items() for y in ys if x < y)
    assert sorted(map(tuple, plans.QUERIES["k_core"](spark, SF).collect())) == want


def test_closeness_is_of_all_nodes(spark, duck):
    near = {}
    for a, _, b in whole_graph(duck):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = []
    for x in near:
        hops, edge = {x: 0}, [x]
        for v in edge:
            for y in near[v] - hops.keys():
                hops[y] = hops[v] + 1
                edge.append(y)
        want.append((-(len(hops) - 1) / sum(hops.values()), 1 - len(hops), x))
    got = plans.QUERIES["closeness_centrality"](spark, SF).collect()
    assert sorted(r["node"] for r in got) == sorted(x for _, _, x in sorted(want)[:200])
    assert {r["node"]: r["closeness"] for r in got} == {x: pytest.approx(-c, abs=1e-6) for c, _, x in sorted(want)[:200]}


def test_training_reaches_every_entity(spark, duck):
    got = plans.QUERIES["train_embeddings"](spark, SF).select("kind", "name", "v").toPandas()
    ends = {x for a, _, b in whole_graph(duck) for x in (a, b)}
    assert set(got.name[got.kind == "entity"]) == ends and set(got.name[got.kind == "relation"]) == {"interacts_with", "has_similarity"}
    v = {n: x for k, n, x in got.itertuples(index=False) if k == "entity"}
    p = {n: x for k, n, x in got.itertuples(index=False) if k == "relation"}
    rng, names = random.Random(1), sorted(ends)
    edges = whole_graph(duck)
    score = lambda a, r, b: sum(x * (y + z) for x, y, z in zip(v[a], v[b], p["interacts_with" if r == "i" else "has_similarity"], strict=True))
    wins = [score(a, r, b) > score(a, r, rng.choice(names)) for a, r, b in edges]
    print(f"true edges above a random one: {sum(wins) / len(wins):.3f}")
    assert sum(wins) > 0.6 * len(wins)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rows_are_added_as_by_one_at_a_time():
    import numpy as np

    from strandlake.operators.training import _add_rows

    rng = np.random.default_rng(5)
    for n in (3, 500):
        at, rows, one = rng.integers(0, 40, n), rng.normal(size=(n, 4)), rng.normal(size=(40, 4))
        other = one.copy()
        np.add.at(one, at, rows)
        _add_rows(other, at, rows)
        assert np.allclose(one, other, rtol=0, atol=1e-12)
