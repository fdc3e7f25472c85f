"""Packing by best fit and clustering by weighted deduplication, against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from strandlake.llm import arrow, centroids, packing, tokenbin
from strandlake.llm.queries import queries

WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, window):
    """Tokens in each window, one piece at a time over a list of open windows; which of equal windows is taken is free."""
    windows = []
    for x in sorted(lengths, reverse=True):
        fits = [w for w in windows if window - sum(w) >= x]
        if fits:
            max(fits, key=sum).append(x)
        else:
            windows.append([x])
    return Counter(map(sum, windows))


@pytest.mark.parametrize("seed", range(30))
def test_groups_of_windows_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([8, 16, 64])
    lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 150))]
    if seed % 3 == 0:
        lengths += [rng.randint(1, window)] * 80
    got, seen = Counter(), Counter()
    for n, used, placed in packing.best_fit(Counter(lengths), window):
        assert used == sum(length * per for length, _, per, _ in placed) <= window
        at = 0
        for length, first, per, offset in placed:
            assert offset == at
            at += length * per
            seen.update((length, i) for i in range(first, first + n * per))
        got[used] += n
    assert got == plain_best_fit(lengths, window)
    assert seen == Counter((x, i) for x, n in Counter(lengths).items() for i in range(n))


@pytest.mark.parametrize("counts", [{}, {1500: 1}, {1100: 100_003}, {2048: 5, 3: 1}, {1024: 3}, {2047: 2, 1: 1}, {x: 7 + x % 3 for x in range(1, 2049)}])
def test_plan_pads_no_sequence_by_more_than_a_hundredth(counts):
    runs, blocks = packing.plan(counts, 2048)
    assert len(runs) + len(blocks) < 20_000
    held = Counter()
    for length, lo, hi, sequence, per, _, used, bases in runs + blocks:
        assert lo < hi
        if bases is None:
            assert (hi - lo) % per == 0 and (packing.power_of_two(used) or 2048 - used <= 20)
            assert sequence is not None
        held[length] += hi - lo if (length, lo, hi, sequence, per, _, used, bases) in runs else 0
    assert {x: n for x, n in held.items() if n} == counts


def check_pieces(rows, texts, end):
    """Pieces tile their documents, sequences have no gaps, ids are the library's."""
    tok = Tokenizer.from_file(WORDS)
    want = Counter()
    for d, t in texts:
        want[d, tuple(tok.encode(t or "", add_special_tokens=False).ids + end)] += 1
    by_sequence, pieces = {}, Counter()
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["padded_length"]))
        pieces[r["doc_id"], r["start"], bytes(r["ids"])] += 1
        assert len(r["ids"]) == 4 * r["length"]
    for s in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(s):
            assert offset == at
            at += length
        assert len({p for _, _, p in s}) == 1 and s[0][2] == (at if at & (at - 1) == 0 else 2048) and 2048 - at <= 20 or at & (at - 1) == 0
    for (d, ids), n in want.items():
        cut = [(start, data) for (x, start, data), k in pieces.items() if x == d for _ in range(k)]
        data, at = np.array(ids, "<u4").tobytes(), 0
        found = [(s, b) for s, b in cut if data[4 * s : 4 * s + len(b)] == b]
        assert len(found) >= n or not ids
    assert sum(len(x[2]) * k for x, k in pieces.items()) == 4 * sum(len(ids) * n for (_, ids), n in want.items())


def test_pack_odd_rows(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (None, "one two"), (3, "same words here"), (3, "same words here"), (4, "é " * 5000), (5, "<|endoftext|> x"), (6, " ".join(str(rng.random()) for _ in range(3000)))]
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id long, text string, length int, task string")
    got = packing.pack_documents(docs, WORDS, end_id=1).collect()
    check_pieces(got, rows, [1])
    assert sum(r["doc_id"] == 3 for r in got) >= 2
    assert packing.pack_documents(docs.limit(0), WORDS, end_id=1).count() == 0
    assert packing.pack_documents(docs.where("text = ''"), WORDS).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, WORDS, window=1000)


def test_dissolved_windows_are_cut_at_powers_of_two(spark):
    rows = [(i, " ".join(["word"] * 1099)) for i in range(37)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), WORDS, end_id=1)
    got = got.collect()
    check_pieces(got, rows, [1])
    assert {r["padded_length"] for r in got} <= {1 << b for b in range(12)}
    tiles = {}
    for r in got:
        tiles.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for t in tiles.values():
        assert [s for s, _ in sorted(t)] == [sum(n for _, n in sorted(t)[:i]) for i in range(len(t))] and sum(n for _, n in t) == 1100


def test_pack_query_equals_the_library(spark, duck):
    got = queries()["op11_pack_sequences"](spark, SF).toPandas()
    tok = Tokenizer.from_file(WORDS)
    ids = {d: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}
    for d, g in got.groupby("doc_id"):
        at = 0
        for r in g.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids[d]) and r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    assert set(got.doc_id) == set(ids)
    used = got.groupby("sequence_id").agg(n=("length", "sum"), first=("offset", "min"), padded=("padded_length", "max"))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum().to_numpy()[:-1]])).all()
    assert used.n.max() <= 2048 and 1 - used.n.sum() / used.padded.sum() < 0.01


def test_sequences_hold_their_pieces_and_padding(spark):
    docs = spark.createDataFrame([(i, " ".join(["word"] * (100 + 37 * i))) for i in range(60)], "doc_id long, text string")
    pieces = packing.pack_documents(docs, WORDS, end_id=1)
    whole = packing.sequences(pieces, pad_id=9).collect()
    for s in whole:
        ids = np.frombuffer(s["ids"], "<u4")
        assert len(ids) == 2048 or packing.power_of_two(s["n_tokens"]) and len(ids) == s["n_tokens"]
        assert (ids[s["n_tokens"] :] == 9).all()
    assert sum(s["n_tokens"] for s in whole) == sum(101 + 37 * i for i in range(60))


def test_workers_forget_what_other_operators_remember(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string").coalesce(1)
    schema = T.StructType([T.StructField("n", T.LongType())])

    def held(open_one):
        def work(batches, arrow_schema):
            if open_one:
                tokenbin.open_encoder(WORDS)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([len(tokenbin._encoders)] * batch.num_rows)], schema=arrow_schema)

        return work

    assert arrow.map_arrow(docs, held(True), schema, keeps="ids").first()["n"] == 1
    assert arrow.map_arrow(docs, held(False), schema).first()["n"] == 0


def plain_lloyd(rows, k=8, rounds=10, dims=64):
    """(vec_id, cluster, distance) and centroids with Python's own whole numbers."""
    kept = [(i, [max(-(2**27), min(2**27, int(np.floor(1024 * float(x))))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: ((0, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()) if r[0] is not None else (1, ""), r[1]))
    cs = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        to = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            mine = [v for (_, v), t in zip(kept, to, strict=True) if t == j]
            if mine:
                cs[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return Counter((i, near(v)[1], near(v)[0]) for i, v in kept), cs


def test_clusters_equal_plain_lloyd(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=64).round(2).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(80)] + [(7, rows[7][1]), (7, rows[7][1]), (None, rows[8][1]), (None, rows[9][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [None] * 64), (2004, [float("nan")] + [0.0] * 63), (2005, [float("inf")] * 64), (2006, [1e30] + [0.0] * 63)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, q int, cluster int").repartition(3)
    assigned, found = centroids.cluster_vectors(frame)
    want, cs = plain_lloyd(rows)
    assert Counter(map(tuple, assigned.collect())) == want
    found = {r["cluster"]: r for r in found.collect()}
    assert [found[j]["centroid"] for j in range(8)] == cs
    inertia = Counter()
    for (_, c, d), n in want.items():
        inertia[c] += n * d
    assert {c: r["cluster_inertia"] for c, r in found.items()} == {c: inertia[c] for c in range(8)}
    assert {r["inertia"] for r in found.values()} == {sum(inertia.values())}


def test_clusters_of_few_rows_and_none(spark):
    few = spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], "vec_id long, embedding array<float>")
    assigned, found = centroids.cluster_vectors(few)
    assert sorted((r["vec_id"], r["distance"]) for r in assigned.collect()) == [(0, 0), (1, 0), (2, 0)] and found.count() == 3
    assigned, found = centroids.cluster_vectors(few.limit(0))
    assert assigned.count() == 0 and found.count() == 0 and assigned.columns == ["vec_id", "cluster", "distance"]


def test_hot_vectors_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(centroids, "HOT_SHARE", 10)
    rows = [(i, [float(i % 5 if i < 60 else i)] * 64) for i in range(100)]
    assigned, _ = centroids.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert Counter(map(tuple, assigned.collect())) == plain_lloyd(rows)[0]
    assert assigned.select(F.countDistinct("vec_id")).first()[0] == 100
