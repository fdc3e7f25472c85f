"""Graph reports against exact values of small graphs."""

from __future__ import annotations

import itertools
import random

import pytest
from conftest import SF

from strandlake import plans
from strandlake.operators import graph, graphreport
from strandlake.plans.domain import links, triples
from strandlake.store import materialize


def adjacency(pairs):
    near = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


def exact_cores(near):
    near, out, k = {a: set(b) for a, b in near.items()}, {}, 0
    while near:
        few = [a for a in near if len(near[a]) <= k]
        if not few:
            k += 1
        for a in few:
            out[a] = k
            for b in near.pop(a):
                near.get(b, set()).discard(a)
    return out


def exact_closeness(near):
    out = {}
    for a in near:
        hops, edge = {a: 0}, [a]
        for v in edge:
            for y in near[v] - hops.keys():
                hops[y] = hops[v] + 1
                edge.append(y)
        out[a] = (len(hops) - 1) / sum(hops.values())
    return out


@pytest.fixture(scope="module")
def odd_graph():
    rng = random.Random(4)
    pairs = [(f"a{min(rng.randint(0, 60), rng.randint(0, 60))}", f"a{rng.randint(0, 60)}") for _ in range(260)]
    return pairs + [("a1", "a1"), (None, "a2"), ("lone", "pair"), *[("hub", f"a{i}") for i in range(60)]]


def frame(spark, pairs):
    return spark.createDataFrame([(a, "r", b) for a, b in pairs], "src string, rel string, dst string")


def test_core_numbers(spark, odd_graph):
    assert {r["node"]: r["core"] for r in graphreport.core_numbers(frame(spark, odd_graph)).collect()} == exact_cores(adjacency(odd_graph))
    assert graphreport.core_numbers(frame(spark, odd_graph).limit(0)).count() == 0


def test_core_numbers_of_all_triples(spark):
    pairs = [(r["src"], r["dst"]) for r in triples(spark, SF).select("src", "dst").collect()]
    assert {r["node"]: r["core"] for r in plans.QUERIES["core_numbers"](spark, SF).collect()} == exact_cores(adjacency(pairs))


def test_core_numbers_are_the_same_for_any_number_of_parts(spark, odd_graph, monkeypatch):
    want = exact_cores(adjacency(odd_graph))
    for size in (4_000_000, 150):
        monkeypatch.setattr(graphreport, "TASK_EDGES", size)
        rounds = []
        monkeypatch.setattr(graphreport, "materialize", lambda df, label: rounds.append(label) or materialize(df, label))
        assert {r["node"]: r["core"] for r in graphreport.core_numbers(frame(spark, odd_graph)).collect()} == want
        assert ("known" in rounds) == (size < 4_000_000)  # what fits a task takes no round
        assert graphreport.dense_core(frame(spark, odd_graph), 0.2).count() == 1


def test_dense_core(spark, odd_graph):
    near = adjacency(odd_graph)
    cores = exact_cores(near)
    for density in (0.01, 0.2, 0.3):
        want = []
        for k in sorted(set(cores.values())):
            nodes = {a for a, c in cores.items() if c >= k}
            edges = sum(len(near[a] & nodes) for a in nodes) // 2
            if len(nodes) > 1 and 2 * edges / (len(nodes) * (len(nodes) - 1)) >= density:
                want.append((k, len(nodes), edges))
        got = graphreport.dense_core(frame(spark, odd_graph), density).collect()
        assert [(r["k"], r["nodes"], r["edges"]) for r in got] == want[:1]
    assert graphreport.dense_core(frame(spark, odd_graph), 2.0).count() == 0


def test_sketched_closeness_is_near_the_exact_one(spark):
    near = adjacency((r["src"], r["dst"]) for r in triples(spark, SF).select("src", "dst").collect())
    want = exact_closeness(near)
    got = {r["node"]: r for r in graphreport.sketched_closeness(triples(spark, SF)).collect()}
    assert got.keys() == want.keys()
    error = [abs(got[a]["closeness"] / want[a] - 1) for a in want]
    print(f"closeness by sketches: mean error {sum(error) / len(error):.4f}, largest {max(error):.4f}")
    assert max(error) < 0.03
    top = sorted(want.values(), reverse=True)[199]
    listed = plans.QUERIES["closeness_by_sketches"](spark, SF).collect()
    assert len(listed) == 200 and all(want[r["node"]] > 0.95 * top for r in listed)


def test_sketched_closeness_of_odd_graphs(spark, odd_graph):
    want = exact_closeness(adjacency(odd_graph))
    got = {r["node"]: r["closeness"] for r in graphreport.sketched_closeness(frame(spark, odd_graph)).collect()}
    assert got == {a: pytest.approx(c, rel=0.02) for a, c in want.items()}
    assert graphreport.sketched_closeness(frame(spark, odd_graph).limit(0)).count() == 0


def test_sampled_triangles_are_near_the_exact_number(spark, odd_graph):
    for df, pairs in ((frame(spark, odd_graph), odd_graph), (links(spark, SF), [(r["src"], r["dst"]) for r in links(spark, SF).collect()])):
        near = adjacency(pairs)
        wedges = sum(len(b) * (len(b) - 1) // 2 for b in near.values())
        closed = sum(1 for a in near for x, y in itertools.combinations(near[a], 2) if y in near[x])
        got = graphreport.sampled_triangles(df).first()
        t = closed / wedges
        assert got["wedges"] == wedges and abs(got["sampled"] - 20_000) < 600
        assert abs(got["transitivity"] - t) < 4 * (t * (1 - t) / 20_000) ** 0.5 + 1e-9
        assert got["triangles"] == pytest.approx(got["transitivity"] * wedges / 3)
        assert graphreport.sampled_triangles(df).first() == got  # the same on every run
    assert graphreport.sampled_triangles(frame(spark, [])).first()["triangles"] == 0
    assert graph.triangles(links(spark, SF)).agg({"triangles": "sum"}).first()[0] == closed


def test_triangles_are_the_same_for_any_number_of_colours(spark, odd_graph, monkeypatch):
    near = adjacency(odd_graph)
    want = {a: n for a in near if (n := sum(c in near[b] for b in near[a] for c in near[a]) // 2)}
    for size, table in ((1_000_000, 64 << 20), (40, 64 << 20), (40, 0)):
        monkeypatch.setattr(graph, "TASK_EDGES", size)
        monkeypatch.setattr(graph, "_TABLE", table)
        monkeypatch.setattr(graph, "_WEDGES", 50)
        found = graph.triangles(frame(spark, odd_graph))
        assert {r["node"]: r["triangles"] for r in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # pairs of edges are no rows
    assert graph.triangles(frame(spark, [])).count() == 0


def test_closeness_by_groups_equals_joins(spark, odd_graph, monkeypatch):
    """More sources than a word has bits, sources without edges, and both ways of searching."""
    rng = random.Random(4)
    edges = [(f"a{rng.randrange(150)}", f"a{rng.randrange(150)}") for _ in range(170)] + [("x", "x"), (None, "a1")]
    df = spark.createDataFrame(edges, "src string, dst string")
    sources = spark.createDataFrame([(f"a{i}",) for i in range(0, 150)] + [("x",), ("nowhere",), (None,)], "node string")
    rows = lambda: sorted(map(str, graph.closeness(df, sources).select("node", "reached", "distance", "closeness").collect()))
    found = rows()
    plan = graph.closeness(df, sources)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan  # no join for each step
    monkeypatch.setattr(graph, "SEARCH_ENDS", 0)
    assert rows() == found and len(found) == 153


def test_closeness_of_larger_graphs_is_sketched(spark, odd_graph, monkeypatch):
    want = {r["node"]: r["closeness"] for r in graphreport.sketched_closeness(frame(spark, odd_graph)).collect()}
    assert want == pytest.approx(exact_closeness(adjacency(odd_graph)))
    monkeypatch.setattr(graphreport, "EXACT_STEPS", -1)
    got = graphreport.sketched_closeness(frame(spark, odd_graph))
    assert {r["node"]: r["closeness"] for r in got.collect()} == pytest.approx(want, rel=0.05)
    assert graphreport.sketched_closeness(frame(spark, odd_graph).limit(0)).count() == 0
