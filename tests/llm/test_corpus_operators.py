"""Deduplication, mixing, token output and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import bagminhash as bmh
from strandlake.llm import chaindedup, mixing, queries, suffixdedup, tokenbin
from strandlake.llm.kernel import text_bytes


def union_find(items, links):
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in items}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    wa = rng.integers(1, 9, 60)
    x = np.repeat(shared, wa)
    y = np.concatenate([np.repeat(shared[5:], np.maximum(1, wa + rng.integers(-2, 3, 60))[5:]), rng.integers(0, 1 << 62, 7).astype(np.uint64)])
    agree = []
    for _ in range(30):
        salt = np.uint64(rng.integers(1 << 62))
        sig = bmh.signatures(np.concatenate([bmh.mix(x ^ salt), bmh.mix(y ^ salt)]), np.array([0, len(x), len(x) + len(y)]), 256)
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - bmh.overlap(x, y)) < 0.02


def near_copies(seed):
    random.seed(seed)
    rnd = lambda n: [f"w{random.randrange(400)}" for _ in range(n)]
    texts = [rnd(random.randrange(3, 80)) for _ in range(40)]
    for i in range(60):
        t = list(random.choice(texts[:40]))
        for _ in range(random.choice([0, 1, 2, 6])):
            t[random.randrange(len(t))] = random.choice(["new", "other", f"n{i}"])
        texts.append(t)
    base = rnd(120)
    for i in range(40):
        t = list(base)
        for _ in range(random.randrange(5)):
            t[random.randrange(len(t))] = f"v{i}{random.random()}"
        texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "..."), (903, "One"), (904, "one!"), (905, "a a a a a a"), (906, "a a a a a"), (None, "solo text of a null id")]
    return rows + rows[:2]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = near_copies(seed)
    h, first = bmh.bags(*text_bytes(pa.array([t for _, t in rows])))
    bag = [h[first[i] : first[i + 1]] for i in range(len(rows))]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if bmh.overlap(bag[i], bag[j]) >= 0.8]
    label = union_find(range(len(rows)), pairs)
    ids = defaultdict(list)
    for i, root in label.items():
        ids[root].append(rows[i][0])
    want = sorted(((rows[i][0], min((x for x in ids[r] if x is not None), default=None)) for i, r in label.items()), key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["class_id"]) for r in bmh.near_duplicates(df).collect()), key=str)
    assert got == want
    kept = bmh.drop_near_duplicates(df.withColumn("_n", F.lit("x"))).collect()
    assert len(kept) == len(ids) and {r["_n"] for r in kept} == {"x"}
    text = defaultdict(set)
    for i, t in rows:
        text[i].add(t)
    assert all(r["text"] in text[r["doc_id"]] for r in kept)


def test_near_duplicates_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bmh.near_duplicates(df).count() == 0 and bmh.drop_near_duplicates(df).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.lists(st.integers(0, 30), min_size=1, max_size=40), st.lists(st.integers(0, 30), min_size=1, max_size=40))
def test_prefixes_and_parities_lose_no_pair(x, y, hub):
    x, y, hub = (np.array(v, np.uint64) for v in (x, y, hub))
    tx, ty = bmh.tokens_of(x), bmh.tokens_of(y)
    differ = np.setxor1d(tx, ty).size
    a, b = bmh.parity_map(tx, 5), bmh.parity_map(ty, 5)
    assert sum(int(v).bit_count() for v in (a ^ b).view(np.uint64)) <= differ
    if bmh.overlap(x, y) >= 0.8:
        assert np.intersect1d(bmh.prefix_tokens(x, hub, 0.8), bmh.prefix_tokens(y, hub, 0.8)).size
        assert differ <= (len(x) + len(y)) / 9 + 1e-9


def brute_repeats(rows, length):
    first = {}
    key = lambda i: 1 << 62 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if first[b[a : a + length]] < key(i):
                gone[a : a + length] = b"\1" * length
        spans = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(b)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def repeats(spark, rows, **how):
    cut = suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **how)
    return sorted(((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in cut.collect()), key=str)


@pytest.mark.parametrize("seed,block", [(1, 500), (2, 500), (3, 1 << 20)])
def test_removed_repeats(spark, seed, block):
    random.seed(seed)
    base = "".join(random.choice("abé ") for _ in range(400))
    rows = []
    for i in range(60):
        t = ""
        for _ in range(random.randrange(6)):
            k, a = random.random(), random.randrange(380)
            t += base[a : a + random.randrange(90)] if k < 0.5 else "a" * random.randrange(70) if k < 0.7 else "".join(random.choice("abé ") for _ in range(random.randrange(60)))
        rows.append((i if random.random() < 0.9 else random.choice([None, 3, 5]), t if random.random() < 0.95 else None))
    assert repeats(spark, rows, length=12, gram=4, block_bytes=block) == brute_repeats(rows, 12)


def test_removed_repeats_of_frequent_grams_and_long_texts(spark):
    random.seed(8)
    rows = [(i, "common lead! " + "".join(random.choice("xyz") for _ in range(30))) for i in range(300)] + [(400, "z" * 3000), (401, "z" * 49), (402, "z" * 50)]
    assert repeats(spark, rows, length=16, gram=8, block_bytes=2000) == brute_repeats(rows, 16)
    assert repeats(spark, []) == []
    with pytest.raises(ValueError):
        suffixdedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), length=5, gram=5)


def test_suffix_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in queries.queries()["op5_suffix_dedup"](spark, SF).collect()), key=str)
    assert got == brute_repeats(rows, 50)


def as_runs(x, y):
    return chaindedup.runs_of(np.array(x), np.array(y))


def test_chains_follow_the_best_diagonal():
    x, y, n = as_runs([0, 5, 10, 15, 40, 3], [100, 105, 111, 116, 2, 300])
    assert sorted(zip(x.tolist(), y.tolist(), n.tolist(), strict=True)) == [(0, 100, 10), (3, 300, 5), (10, 111, 10), (40, 2, 5)]
    chains = [[(int(x[i]), int(y[i])) for i in c] for _, c in chaindedup.chain_runs(x, y, n)]
    assert chains[0] == [(0, 100), (10, 111)] and sorted(map(len, chains)) == [1, 1, 2]
    a = np.arange(60)
    b = np.concatenate([np.arange(20), [999], np.arange(20, 60)])
    span = chaindedup.align_chain(a, b, np.array([2, 10, 30, 50]), np.array([2, 10, 31, 51]))
    assert span[:4] == (0, 60, 0, 61) and span[4] == pytest.approx(60 / 61)


def brute_chain(x, y, n, gap, overlap):
    """Score of the best chain of runs, with or without overlaps below a seed."""
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    best = {}
    for at, i in enumerate(order):
        best[i] = float(n[i])
        for j in order[:at]:
            dx, dy = x[i] - x[j] - n[j], y[i] - y[j] - n[j]
            if x[j] < x[i] and y[j] < y[i] and min(dx, dy) >= (-4 if overlap else 0):
                best[i] = max(best[i], best[j] - gap * (max(dx, 0) + max(dy, 0)) + n[i] - max(0, -dx, -dy))
    return max(best.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=25))
def test_fenwick_chains_are_the_best(places):
    x, y, n = as_runs(*zip(*set(places), strict=True))
    got = chaindedup.chain_runs(x, y, n)
    assert sorted(i for _, c in got for i in c) == list(range(len(x)))
    args = x.tolist(), y.tolist(), n.tolist(), chaindedup.GAP_COST
    assert brute_chain(*args, False) - 1e-9 <= got[0][0] <= brute_chain(*args, True) + 1e-9


@pytest.mark.parametrize("gap", [10, 20, 40, 80, 120, 200, 400])
def test_passages_apart_are_found_each(gap):
    rng = np.random.default_rng(gap)
    word = lambda n: rng.integers(0, 1 << 31, n).astype("<u4")
    for n in (50, 50, 120, 300):
        p, q = word(n), word(50)
        a, b = (np.concatenate([word(15), p, word(gap), q, word(15)]) for _ in range(2))
        spans = sorted(s[2:4] for s in chaindedup.stretch_spans(a, b))
        whole = (n + 50) / (n + 50 + gap) >= 0.8
        assert spans == ([(15, 65 + n + gap)] if whole else [(15, 15 + n), (15 + n + gap, 65 + n + gap)])


def test_parts_of_a_chain_keep_their_shifts():
    rng = np.random.default_rng(5)
    word = lambda n: rng.integers(0, 1 << 31, n).astype("<u4")
    p, q = word(60), word(60)
    a = np.concatenate([p, word(90), q[:30], q[31:]])
    b = np.concatenate([p[:25], p[27:], word(70), q])
    out = sorted(chaindedup.stretch_spans(a, b))
    assert [s[:4] for s in out] == [(0, 60, 0, 58), (150, 209, 128, 188)]
    assert [s[4] for s in out] == [pytest.approx(58 / 60), pytest.approx(59 / 60)]


def brute_links(texts, min_words=30, min_identity=0.8):
    """Pairs of different texts that have a passage in common, all pairs of whole texts chained."""
    words = []
    for t in texts:
        data, offsets = text_bytes(pa.array([t], pa.string()))
        starts, ends, _ = chaindedup.word_bounds(data, offsets, chaindedup.ALNUM)
        words.append(chaindedup.span_hashes(data, starts, ends).astype("<u4"))
    return [(i, j) for j in range(len(texts)) for i in range(j) if len(words[i]) and len(words[j]) and chaindedup.stretch_spans(words[i], words[j], min_words, min_identity)]


def hold_against_brute(spark, rows, block, least_recall=1.0):
    """Classes equal the components of all links between different texts, and the links are among them."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in chaindedup.passage_classes(df, block_bytes=block).collect()}
    texts = sorted({t or "" for _, t in rows})
    links = brute_links(texts)
    of, ids = union_find(range(len(texts)), links), defaultdict(list)
    linked = {x for pair in links for x in pair}
    for i, t in rows:
        k = texts.index(t or "")
        ids[of[k] if k in linked or len((t or "").split()) >= 30 else (i,)].append(i)
    want = {i: min(group) for group in ids.values() for i in group}
    assert {i: r["class_id"] for i, r in got.items()} == want
    at = {i: texts.index(t or "") for i, t in rows}
    found = {tuple(sorted((at[i], at[p["partner_id"]]))) for i, r in got.items() for p in r["passages"]}
    found = {p for p in found if p[0] != p[1]}
    assert found <= set(links)
    recall = len(found) / max(1, len(links))
    print(f"links found: {len(found)} of {len(links)}")
    assert recall >= least_recall
    return got


@pytest.mark.parametrize("block", [20_000, 200_000, 4 << 20])
def test_chain_query_against_all_pairs(spark, block):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = hold_against_brute(spark, rows, block)
    if block == chaindedup.BLOCK_BYTES:
        query = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.queries()["op6_chain_dedup"](spark, SF).collect()}
        assert query == {i: (r["class_id"], r["n_links"]) for i, r in got.items()}


@pytest.mark.parametrize("block", [3_000, 1 << 20])
def test_links_that_are_not_transitive(spark, block):
    random.seed(12)
    rnd = lambda n: [f"w{random.randrange(10**9)}" for _ in range(n)]
    base = rnd(200)
    cut = lambda at: [w if (i + at) % 13 > 1 else f"x{at}{i}" for i, w in enumerate(base)]  # noqa: E731  identity 0.85 with the base, 0.7 with the other
    texts = [cut(0), cut(6), base]
    p, q = rnd(60), rnd(61)
    texts += [p, [*p, *q[:3], *p], q, [*q, *q]]  # a passage twice in one text
    passage = rnd(50)
    excerpts = [passage[:29], passage[11:40], passage[21:50]]
    texts += [[*rnd(20), *e, *rnd(20)] for e in excerpts] + [[*rnd(9), *passage, *rnd(9)]] + [[*rnd(20), *e, *rnd(20)] for e in excerpts] + [[*rnd(7), *passage]]
    got = hold_against_brute(spark, [(i, " ".join(t)) for i, t in enumerate(texts)], block)
    assert [(p["start"], p["end"]) for p in got[4]["passages"]] == [(0, 60), (63, 123)]
    assert [(p["start"], p["end"]) for p in got[6]["passages"]] == [(0, 61), (61, 122)]
    assert got[14]["class_id"] == got[10]["class_id"] == 10 and got[2]["n_links"] == 2


@pytest.mark.parametrize("block", [4_000, 1 << 20])
def test_frequent_passages(spark, block):
    random.seed(13)
    rnd = lambda n: [f"w{random.randrange(10**9)}" for _ in range(n)]
    exact, line, fuzzy = rnd(40), rnd(20), rnd(60)
    rows = []
    for i in range(120):  # all seeds are far more frequent than RARE
        kind = i % 4
        vary = list(fuzzy)
        for at in random.sample(range(60), 3):
            vary[at] = f"v{i}{at}"
        a = random.randrange(11)
        body = [exact, exact[a : a + 30], line, vary][kind]
        rows.append((i, " ".join([*rnd(random.randrange(5, 30)), *body, *rnd(random.randrange(5, 30))])))
    got = hold_against_brute(spark, rows, block, least_recall=0.0)
    assert all(got[i]["n_links"] == 0 for i in range(2, 120, 4))


@pytest.mark.parametrize("block", [3_000, 9_000, 1 << 20])
def test_all_links_of_frequent_passages_are_found(spark, block):
    """Copies of one passage with their own words exchanged: every link of all pairs is found, though all seeds are frequent."""
    random.seed(15)
    rnd = lambda n: [f"w{random.randrange(10**9)}" for _ in range(n)]
    base, rows = rnd(60), []
    for i in range(70):
        vary = list(base)
        for at in random.sample(range(60), 4):
            vary[at] = f"v{i}{at}"
        rows.append((i, " ".join([*rnd(random.randrange(5, 30)), *vary, *rnd(random.randrange(5, 30))])))
    got = hold_against_brute(spark, rows, block)
    assert sum(r["n_links"] for r in got.values()) == 2 * len(brute_links([t for _, t in rows]))


def test_pairs_of_seeds_come_in_batches(monkeypatch):
    rng = np.random.default_rng(3)
    h, node = np.sort(rng.integers(0, 9, 300)), rng.integers(0, 25, 300)
    node = node[np.lexsort((node, h))]
    whole = list(chaindedup.all_pairs(h, node))
    monkeypatch.setattr(chaindedup, "MATCHES", 40)
    parts = list(chaindedup.all_pairs(h, node))
    assert len(whole) == 1 < len(parts) and not list(chaindedup.all_pairs(h[:0], node[:0]))
    pairs = lambda found: sorted((int(i), int(j)) for a, b in found for i, j in zip(a, b, strict=True))
    assert pairs(whole) == pairs(parts)
    later = [set(node[j].tolist()) for _, j in parts]
    assert sum(map(len, later)) == len(set().union(*later))


def test_passages_of_odd_rows(spark):
    random.seed(14)
    rnd = lambda n: " ".join(f"w{random.randrange(300)}" for _ in range(n))
    p, long = rnd(45), rnd(40_000)
    rows = [(3, p), (3, p), (None, p), (None, None), (5, None), (6, ""), (7, "one two"), (7, "one two"), (8, f"{rnd(9)} {p}"), (9, long), (10, long), (11, "a " * 5000), (12, "a " * 40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, passages string, class_id int")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in chaindedup.passage_classes(df).collect()), key=str)
    assert got == sorted([(3, 3, 3), (3, 3, 3), (None, 3, 3), (None, None, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0), (7, 7, 0), (8, 3, 1), (9, 9, 1), (10, 9, 1), (11, 11, 1), (12, 11, 1)], key=str)
    assert chaindedup.passage_classes(df.limit(0)).count() == 0


def test_links_of_covered_words_are_kept(spark):
    random.seed(9)
    rnd = lambda n: [f"w{random.randrange(10**9)}" for _ in range(n)]
    d, ends = rnd(132), [rnd(25), rnd(25)]
    cut = lambda at: [w if (i - at) % 22 >= 4 else f"x{at}{i}" for i, w in enumerate(d)]  # noqa: E731  identity 0.82 with d, 0.64 with the other
    rows = [(1, ends[0] + cut(0) + ends[1]), (2, rnd(10) + cut(11) + rnd(10)), (3, ends[0] + d + ends[1]), (4, rnd(40)), (5, d[40:90])]
    got = {r["doc_id"]: r for r in chaindedup.passage_classes(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()}
    assert {p["partner_id"] for p in got[3]["passages"]} == {1, 2}
    assert [got[i]["class_id"] for i in (1, 2, 3, 4, 5)] == [1, 1, 1, 4, 1]
    assert got[3]["n_links"] == 3 and got[2]["n_links"] >= 1


def test_fenwick_tree_gives_prefix_maxima():
    random.seed(4)
    tree, seen = chaindedup.Fenwick(50), []
    for i in range(200):
        place, value = random.randrange(50), (random.random(), i)
        tree.put(place, value)
        seen.append((place, value))
        p = random.randrange(51)
        assert tree.before(p) == max((v for q, v in seen if q < p), default=(float("-inf"), -1))


@pytest.mark.parametrize("block", [15_000, 1 << 20])
def test_fuzzy_passages(spark, block):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    rnd = lambda n: [random.choice(vocabulary) for _ in range(n)]
    passages = [rnd(70) for _ in range(6)]
    rows, truth = [], []
    for i in range(120):
        k, t = (random.randrange(6) if i % 2 else None), rnd(random.randrange(20, 150))
        if k is not None:
            p = list(passages[k])
            for _ in range(random.randrange(3)):
                p[random.randrange(len(p))] = random.choice(vocabulary)
            at = random.randrange(len(t))
            t[at:at] = p
        rows.append((i, " ".join(t)))
        truth.append(k)
    rows += [(500, None), (501, ""), (502, "a b"), (None, " ".join(passages[0])), (1, rows[1][1])]
    got = chaindedup.passage_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), block_bytes=block).collect()
    assert len(got) == len(rows)
    classes = defaultdict(set)
    for r in got:
        k = truth[r["doc_id"]] if r["doc_id"] is not None and r["doc_id"] < 500 else (0 if r["doc_id"] is None else None)
        if k is None:
            assert r["n_links"] == 0 and r["class_id"] == r["doc_id"] and r["passages"] == []
        else:
            assert r["n_links"] > 0 and truth[r["class_id"]] == k
            assert all(p["identity"] >= 0.8 and p["end"] - p["start"] >= 28 for p in r["passages"])
            classes[k].add(r["class_id"])
    assert all(len(c) == 1 for c in classes.values())
    assert chaindedup.passage_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mixing(spark):
    random.seed(6)
    sources = ["b", "a", None, "c", "", "tiny"]
    rows = [(i, random.choices(sources, [5, 3, 2, 8, 1, 0.2])[0], "w " * random.randrange(0, 40)) for i in range(900)] + [(7, "b", None), (None, "b", "x y"), (None, "b", "x y"), (5000, "c", "word " * 300)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, text string, target string")
    mixed = mixing.mix_sources(df).toPandas()
    assert len(mixed) == len(rows)
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += len((t or "").split())
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted((x for x in size if x is not None)) + [None])}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(size)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    for s in size:
        part = mixed[mixed.source.isna()] if s is None else mixed[mixed.source == s]
        assert np.allclose(part.target.astype(float), target[s]) and (part.source_size == size[s]).all()
        assert abs(part.taken.sum() - target[s]) <= part["size"].max() / 2 + 1
    assert (mixed.taken <= 2 * mixed["size"]).all()
    again = mixing.mix_sources(df.repartition(5)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(str, mixed[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert mixing.mix_sources(df.limit(0)).count() == 0


@pytest.mark.parametrize(("copies", "words", "others"), [(100, 1000, 0), (100, 1000, 7), (7, 3, 2), (50, 0, 3), (1, 10, 0)])
def test_mixing_of_repeated_rows_meets_the_target(spark, copies, words, others):
    """Copies of one row are taken as often as comes nearest to the target, not all alike."""
    rows = [(1, "w " * words, "a")] * copies + [(10 + i, "x y z " * (i + 1), "a") for i in range(others)] + [(5, "w " * 10, "b")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mixed = mixing.mix_sources(df).toPandas()
    assert len(mixed) == len(rows) and (mixed.taken <= 2 * mixed["size"]).all()
    for s, part in mixed.groupby("source"):
        nearest = part["size"].max() / 2
        assert abs(part.taken.sum() - part.target.iloc[0]) <= nearest + 1e-6, s
    again = mixing.mix_sources(df.repartition(3)).toPandas()
    assert sorted(again.taken) == sorted(mixed.taken)


def test_mixing_is_native(spark):
    plan = queries.queries()["op2_mix_sources"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_bit_packing_round_trip(bits, ids):
    x = np.array(ids, np.uint64).astype(np.uint32) & np.uint32((1 << bits) - 1)
    assert (tokenbin.unpack(tokenbin.pack(x, bits), len(x), bits) == x).all()
    assert tokenbin.width_of(1 << bits) == bits


def test_shards_give_random_access(tmp_path):
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 1 << 11, n).astype(np.uint32) for n in (0, 5, 300, 1, 64, 0, 77)]
    with open(tmp_path / "s.bits", "wb") as sink:
        w = tokenbin.ShardWriter(sink, 11, block_ids=64)
        for i, d in enumerate(docs):
            w.append(None if i == 3 else i, d)
        w.close()
    r = tokenbin.open_shard(f"file://{tmp_path}/s.bits")
    flat = np.concatenate(docs)
    assert all((a == b).all() for a, b in zip(r.documents(), docs, strict=True))
    assert (r.ids(100, 333) == flat[100:333]).all() and len(r.ids(5, 5)) == 0
    assert r.valid.tolist() == [True, True, True, False, True, True, True]


def test_token_output(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(5, "Hello, world's 12 ÉÑ"), (2, None), (9, ""), (5, "Hello, world's 12 ÉÑ"), (None, "中文 text <|endoftext|> x"), (-3, "word " * 50000), (7, "a" * 500)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, ids string").repartition(3)
    got = sorted((tuple(r) for r in tokenbin.token_output(df, path, 2).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()), key=lambda r: r[1])
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert tokenbin.token_output(df.limit(0), path, 2).count() == 0
    sized = spark.range(1 << 20)
    assert tokenbin.shard_number(sized) == 0 and tokenbin.shard_number(sized, 1 << 13) == 1 << 10  # 8 bytes a row


def test_shards_go_to_the_default_file_system(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    manifest = tokenbin.write_shards(df, public_tokenizers.path("word_bpe_49k.json"), f"{tmp_path}/out", 2)
    assert all(r["uri"].startswith(f"file:{tmp_path}/out/") for r in manifest.collect())
    assert tokenbin.read_shards(manifest).count() == 20


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab the\n\t.,'éÉß中🙂́\x85\x1c\x0bΣİ²µÿ\xa0", "<|endoftext|>", "'s", "'re"]), max_size=14).map("".join), min_size=1, max_size=4))
def test_encoder_is_the_library_s(texts):
    encoder = tokenbin.open_encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.safe
    assert encoder.encode([t.encode() for t in texts]) == encoder._encode(texts)


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in cp.STAGES] == ["quality rules", "near-duplicates", "decontamination", "source mix", "token output"]
    stage = dict(cp.STAGES)
    judged = {r["doc_id"]: r["kept"] for r in queries.queries()["op8_quality_rules"](spark, SF).collect()}
    kept = stage["quality rules"](spark, docs, SF)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in judged.items() if k}
    classes = queries.queries()["op9_near_duplicates"](spark, SF).collect()
    assert {r["doc_id"] for r in stage["near-duplicates"](spark, docs, SF).collect()} == {r["class_id"] for r in classes}
    hit = {r["doc_id"] for r in queries.queries()["op1_decontaminate"](spark, SF).collect() if r["contaminated"]}
    assert {r["doc_id"] for r in stage["decontamination"](spark, docs, SF).collect()} == {r["doc_id"] for r in docs.collect()} - hit
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in queries.queries()["op2_mix_sources"](spark, SF).collect() if r["size"]}
    mixed = stage["source mix"](spark, docs, SF)
    times = defaultdict(int)
    for r in mixed.collect():
        times[r["doc_id"]] += 1
    assert mixed.columns == docs.columns and {i: n for i, n in taken.items() if n} == dict(times)
    out = cp.run(spark, SF).collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in out)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_entry_has_one_query_for_each_operator():
    import re

    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))


@pytest.mark.parametrize("weight", [None, 0.25, 0.5, 8.0])
def test_key_buckets_are_even_for_any_weight(spark, weight):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("source"), F.repeat(F.lit("word "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    keyed = mixing.with_keys(rows, weight=None if weight is None else F.lit(weight))
    cuts = mixing.source_cuts(keyed)
    n = mixing._with_plan(keyed, "source", cuts).groupBy("_source", mixing._bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    for _, of in n.groupby("_source"):
        assert of.n.max() < 3 * of.n.mean() and len(of) > 50


def test_mixing_of_long_texts(spark):
    rows = [(1, "a", "word " * 60_000), (2, "a", "x"), (3, None, None), (4, "b", "y " * 10)]
    mixed = {r["doc_id"]: r for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert [mixed[i]["size"] for i in (1, 2, 3, 4)] == [60_000, 1, 0, 10] and all(r["taken"] <= 2 * r["size"] for r in mixed.values())


def test_near_duplicates_with_clashing_names_and_long_texts(spark):
    random.seed(2)
    long = " ".join(f"w{random.randrange(900)}" for _ in range(60_000))
    rows = [(1, long, "a"), (2, long + " end", "b"), (3, "short", "c"), (4, None, "d"), (4, None, "e"), (5, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, x string").selectExpr("doc_id", "text", "x AS _uid", "x AS _class", "x AS class_id", "x AS n_shingles", "x AS _row")
    got = sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in bmh.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1), (4, 4, 1), (5, 5, 1)]
    kept = bmh.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r["doc_id"], r["_uid"], r["_row"]) for r in kept.collect()) == [(1, "a", "a"), (3, "c", "c"), (4, "d", "d"), (4, "e", "e"), (5, "f", "f")]


def test_dropping_near_duplicates_leaves_no_copy_of_all_texts(spark):
    from strandlake import store

    rows = [(1, "a b c d e f g", "first"), (1, "a b c d e f g", "again"), (2, "A b, c d e f g", "x"), (3, "other words of a text of its own", "y"), (None, None, "z"), (None, None, "z"), (4, "a b c d e f g", "v")]
    before = set(store._made)
    kept = bmh.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, x string").coalesce(1))
    assert not [p for p in set(store._made) - before if "-signed-" in p or "-met-" in p or "-mixed-" in p]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3], rows[4], rows[5]], key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_duplicate_query_against_all_pairs(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    h, first = bmh.bags(*text_bytes(pa.array([t for _, t in rows])))
    bags = [np.sort(h[first[i] : first[i + 1]]) for i in range(len(rows))]
    holders = defaultdict(set)
    for i, bag in enumerate(bags):
        for x in set(bag.tolist()):
            holders[x].add(i)
    met = {(i, j) for s in holders.values() if 1 < len(s) for i in s for j in s if i < j}
    sizes = [len(b) for b in bags]
    links = [(i, j) for i, j in met if min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j]) and bmh.overlap(bags[i], bags[j]) >= 0.8]
    of, ids = union_find(range(len(rows)), links), defaultdict(list)
    for i, root in of.items():
        ids[root].append(rows[i][0])
    got = {r["doc_id"]: r["class_id"] for r in queries.queries()["op9_near_duplicates"](spark, f"/root/testdata/{sf}").collect()}
    assert got == {i: min(group) for group in ids.values() for i in group}


def test_repeats_beside_other_columns_and_in_long_texts(spark):
    random.seed(5)
    long = "".join(random.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long), (2, "x" * 10 + long[1000:201_000] + "y" * 30), (3, ""), (4, None), (4, long[:60])]
    df = spark.createDataFrame([(*r, b"z") for r in rows], "doc_id long, text string, z binary").selectExpr("*", "z AS block", "z AS ids", "z AS kept", "z AS removed")
    cut = suffixdedup.remove_repeats(df, block_bytes=50_000)
    got = sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["removed"]]) for r in cut.collect()), key=str)
    assert got == sorted([(1, 300_000, []), (2, 200_040, [(10, 200_010)]), (3, 0, []), (4, 0, []), (4, 60, [(0, 60)])], key=str)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.integers(1, 30), st.booleans())
def test_multikey_quicksort_groups_equal_rows(seed, n, width, grouped):
    rng = np.random.default_rng(seed)
    rows = rng.integers(0, 2, (n, width)).astype(np.uint8)
    groups = rng.integers(0, 3, n).astype(np.uint64) if grouped else None
    small, suffixdedup.SMALL_ROWS = suffixdedup.SMALL_ROWS, 8
    try:
        order, new = suffixdedup.group_rows(rows, groups)
    finally:
        suffixdedup.SMALL_ROWS = small
    keys = [((int(groups[i]) if grouped else 0), rows[i].tobytes()) for i in order]
    assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)
    assert new.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(n)]


CLASHES = ("n_words", "items", "spans", "target", "SIZE", "times", "kept", "_key", "_uid", "shard", "ids", "contaminated", "base_failed")


def test_pipeline_stages_keep_odd_rows_and_columns(spark, tmp_path):
    import corpus_pipeline as cp

    clean = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:40]
    rows = [tuple(r) for r in clean] + [(9001, None, None, None, None), (9002, "", "xx", "s", 0), (None, clean[0]["text"], None, None, None), (clean[1]["doc_id"], clean[1]["text"], "en", "s", 3), (9003, "word " * 100_000, "en", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, c in enumerate(CLASHES):
        df = df.withColumn(c, F.concat(F.lit(f"{i}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    as_set = lambda d: {tuple(r) for r in d.collect()}
    every = as_set(df)
    spark.conf.set("spark.strandlake.output.dir", str(tmp_path))
    for name, stage in cp.STAGES:
        out = stage(spark, df, SF)
        if name != "token output":
            assert out.schema.simpleString() == df.schema.simpleString()
            assert as_set(out) <= every
            kept = {r["doc_id"] for r in out.collect()}
            assert kept & {r["doc_id"] for r in clean}
            assert (9001 in kept) == (name in ("near-duplicates", "decontamination")) or name == "source mix"
        else:
            assert out.count() == df.count()
        empty = stage(spark, df.limit(0), SF)
        assert empty.count() == 0 and empty.columns == out.columns
    assert any(tmp_path.rglob("*.bits"))
    spark.conf.unset("spark.strandlake.output.dir")


@pytest.mark.parametrize("partitions", [1, 5, 211])
def test_splitters_do_not_depend_on_the_number_of_ranges(spark, partitions):
    from strandlake.llm.suffixdedup import MESSAGE, sample_splitters

    grams = [i.to_bytes(4, "big") for i in range(2000)] + [b"\x00\x00\x01\x00"] * 900
    rows = [(-1 - i, i, b"".join(grams[i::20])) for i in range(20)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        cuts, hot = sample_splitters(spark.createDataFrame(rows, MESSAGE), 16, 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert [bytes(h) for h in hot] == [b"\x00\x00\x01\x00"]
    edges = [0, *[int.from_bytes(bytes(c), "big") for c in cuts], 2000]
    assert 15 <= len(cuts) <= 17 and max(y - x for x, y in zip(edges, edges[1:], strict=False)) <= 130
