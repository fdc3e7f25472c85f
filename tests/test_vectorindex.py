"""The stored vector index against the exact search."""

from __future__ import annotations

import numpy as np
import pytest

from strandlake import plans
from strandlake.operators import simjoin, vectorindex
from strandlake.plans.domain import clustered


def recall(got, want):
    return len(got.merge(want, on=["src", "dst"])) / len(want)


@pytest.mark.parametrize("metric", ["cos", "l2"])
def test_index_finds_the_nearest_among_a_fifth_of_the_rows(spark, tmp_path, metric):
    v, path = clustered(spark, "/root/testdata/sf0.1"), str(tmp_path / "index")
    q = v.where("id % 20 = 0")
    vectorindex.build(v, "id", "v", path, metric)
    want = simjoin.nearest(v, "id", "v", 10, metric, queries=q).toPandas()
    got = vectorindex.search(q, "id", "v", path, 10).toPandas()
    share = vectorindex.scored_share(q, "id", "v", path).first()["share"]
    size = sum(f.stat().st_size for f in (tmp_path / "index").rglob("*.parquet")) / v.count()
    print(f"{metric}: recall@10 {recall(got, want):.3f} of {share:.3f} of the rows, {size:.0f} bytes a row")
    assert recall(got, want) >= 0.9 and share <= 0.2
    same = got.merge(want, on=["src", "dst"])
    assert np.allclose(same.score_x, same.score_y, atol=1e-6)
    assert got.groupby("src")["rank"].apply(lambda r: sorted(r) == list(range(1, 11))).all() and (got.src != got.dst).all()
    everything = vectorindex.search(q, "id", "v", path, 10, probes=10_000, rescore=300).toPandas()
    assert recall(everything, want) == 1.0  # all cells and all rows again: the exact search


def test_query_reads_all_vectors(spark):
    got = plans.QUERIES["vector_index_search"](spark, "/root/testdata/sf0.001").toPandas()
    assert got.src.nunique() == 25 and len(got) == 250


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [0.0, 1.0, 0.0]), (7, [0.9, 0.1, 0.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    path = str(tmp_path / "index")
    vectorindex.build(v, "id", "v", path)
    got = vectorindex.search(v.where("id IN (1, 3, 4)"), "id", "v", path, 2, probes=100).collect()
    assert [(r["src"], r["dst"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2), (1, 7)]
    with pytest.raises(Exception, match="3 numbers"):
        vectorindex.search(spark.createDataFrame([(9, [1.0])], "id long, v array<double>"), "id", "v", path).count()
    with pytest.raises(ValueError):
        vectorindex.build(v, "id", "v", path, "dot")
    vectorindex.build(v.limit(0), "id", "v", str(tmp_path / "none"))
    assert vectorindex.search(v.limit(0), "id", "v", str(tmp_path / "none")).count() == 0


def test_large_cells_and_popular_ones_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectorindex, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vectorindex, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, (rng.normal(size=8) * 0.1 + 1).tolist()) for i in range(300)], "id long, v array<double>")
    path = str(tmp_path / "index")
    vectorindex.build(v, "id", "v", path, "l2", cells=2)
    got = vectorindex.search(v, "id", "v", path, 5, probes=2, rescore=100).toPandas()
    assert recall(got, simjoin.nearest(v, "id", "v", 5, "l2").toPandas()) == 1.0


def test_nearest_centres_are_found_in_bounded_memory():
    import tracemalloc

    import numpy as np

    from strandlake.operators.vectorindex import _nearest

    rng = np.random.default_rng(3)
    m, centres = rng.normal(size=(10_000, 64)), rng.normal(size=(2500, 64))
    for n in (1, 8):
        tracemalloc.start()
        found = _nearest(m, centres, n)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        print(n, peak / 1e6)
        assert peak < 64e6
        far = (centres * centres).sum(1)[None] - 2 * m[:50] @ centres.T
        assert (found[:50] == np.argsort(far, axis=1, kind="stable")[:, :n]).all()
    assert _nearest(m[:0], centres, 8).shape == (0, 8) and _nearest(m[:5], centres[:3], 8).shape == (5, 3)
