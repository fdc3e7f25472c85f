"""Near-duplicate classes by BagMinHash over multisets of word shingles.

A document is the multiset of its shingles of five lower-cased words. A shingle of multiplicity w
stands for the levels 1 .. w. Levels are grouped in dyadic shells, (0, 1], (1, 2], (2, 4] and so
on; each shell of a shingle is one Poisson process whose rate is the number of its levels, and
each of its points falls on a level of the shell and on one of the signature's components. Points
on levels above w are dropped. A component keeps its first point in time. Two documents agree on a
component with a probability of their weighted Jaccard similarity, as they share the processes of
shared levels. Only points up to the time at which all components are expected to be filled are
made, so the work beyond one hash a shingle doesn't grow with the document.

Signatures are banded. Documents of equal multisets are one node; in each bucket every node is
held against the bucket's hub, and the true multiset overlap of such pairs is counted. The hub is
the node with the most company over all of its buckets: of an original and its copies, as a rule,
the original, which is nearer to each copy than these are to each other.
Components of verified pairs merge, and mixed buckets get one more hub from outside the first one's
component. What is still in different components of one bucket is joined by prefixes: in the order
"tokens that the bucket's hub lacks first", two multisets of the wanted similarity share one of the
first (1 - threshold) of their tokens, and their parity maps differ in no more places than the sets
may in tokens, so all other pairs are ruled out exactly inside the join, without being made. Within
a component no pair is made; nothing is capped.

Near copies of a lower similarity than the threshold are no near-duplicates.

Defined cases: null texts and texts without words are in classes of their own; a text of fewer words
than a shingle is one shingle; repeated rows and rows of equal or null ids are kept apart; classes
are named by the least id in them, of ties the row that is stored first stays; very long texts
are signed whole; an empty table gives an empty result; extra columns are kept by
:func:`drop_near_duplicates`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..store import discard, materialize
from .arrow import map_arrow
from .kernel import ALNUM, mix, shingles, slices, span_hashes, text_bytes, word_bounds

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
HUB_ROUNDS = 1

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 1.0 / (1 << 53)


def _times(k: int) -> np.uint64:
    return np.uint64((k * int(_GOLD)) & ((1 << 64) - 1))


def bags(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts with repeats, and the first of each text."""
    starts, ends, first = word_bounds(data, offsets, ALNUM)
    return shingles(span_hashes(data, starts, ends), first, k, whole_short=True)


def bag_digests(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits that are equal for equal multisets, whatever their order."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes ^ np.uint64(salt)), out=total[1:])
        out.append(total[first[1:]] - total[first[:-1]])
    return [row.tobytes() for row in np.stack(out, axis=1)]


def multiplicities(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text: text number, hash and count."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keyed = mix(hashes ^ mix(doc.astype(np.uint64) + _GOLD))
    order = np.argsort(keyed)
    keyed = keyed[order]
    begin = np.flatnonzero(np.concatenate([[True], keyed[1:] != keyed[:-1]])) if len(keyed) else np.zeros(0, np.int64)
    return doc[order[begin]], hashes[order[begin]], np.diff(np.append(begin, len(keyed)))


def _points(sig: np.ndarray, doc: np.ndarray, element: np.ndarray, count: np.ndarray, until: np.ndarray) -> None:
    """Enter into ``sig`` the first point of each component among all points before ``until`` of the text."""
    n, m = sig.shape
    flat = sig.reshape(-1)
    shell, active = 0, np.arange(len(doc))
    while active.size:
        low = 0 if shell == 0 else 1 << (shell - 1)  # levels low+1 .. low+rate
        rate = max(1, low)
        d, e, w = doc[active], element[active], count[active]
        seed = mix(e + _times(shell + 1))
        x, limit, k = np.zeros(len(d)), until[d], 0
        while len(d):
            k += 1
            r = mix(seed + _times(k))
            x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * _UNIT) / rate
            go = x < limit
            d, w, seed, x, limit, r = d[go], w[go], seed[go], x[go], limit[go], r[go]
            r2 = mix(r ^ _GOLD)
            at = d * m + (r2 % np.uint64(m)).astype(np.int64)
            if rate > 1:
                on = low + 1 + ((r2 >> np.uint64(32)) % np.uint64(rate)).astype(np.int64) <= w
                np.minimum.at(flat, at[on], x[on])
            else:
                np.minimum.at(flat, at, x)
        shell += 1
        active = active[count[active] > (1 << (shell - 1))]


def signatures(hashes: np.ndarray, first: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """A row of ``m`` arrival times for each text; infinite for texts without shingles."""
    n = len(first) - 1
    sig = np.full((n, m), np.inf)
    doc, element, count = multiplicities(hashes, first)
    total = np.diff(first).astype(float)
    factor = m * (np.log(m) + 4.0)
    todo = total > 0
    while todo.any():
        use = todo[doc]
        number = np.cumsum(todo) - 1
        part = np.full((int(todo.sum()), m), np.inf)
        _points(part, number[doc[use]], element[use], count[use], factor / total[todo])
        done = np.isfinite(part).all(axis=1)
        places = np.flatnonzero(todo)
        sig[places[done]] = part[done]
        todo[places[done]] = False
        factor *= 2.0
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each text."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    key = np.zeros((len(sig), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = mix(key * _GOLD + bits[:, :, i])
    return key.view(np.int64)


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of hashes."""
    if not len(x) or not len(y):
        return 0.0
    ux, cx = np.unique(x, return_counts=True)
    uy, cy = np.unique(y, return_counts=True)
    at = np.searchsorted(uy, ux)
    at[at == len(uy)] = 0
    same = uy[at] == ux
    both = np.minimum(cx[same], cy[at[same]]).sum()
    return float(both / (len(x) + len(y) - both))


def sign(docs: DataFrame, text_col: str, bands: int, rows: int, shingle: int) -> DataFrame:
    """All columns but the text, then ``_z`` (the text, compressed), ``_digest``, ``_n`` (shingles), ``_bands`` and ``_uid``; stored."""
    rest = [f for f in docs.schema if f.name != text_col]
    schema = T.StructType([*rest, T.StructField("_z", T.BinaryType()), T.StructField("_digest", T.BinaryType()), T.StructField("_n", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType()))])

    def work(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, text_col, 1 << 19):
                column = part.column(text_col)
                h, first = bags(*text_bytes(column), shingle)
                keys = band_keys(signatures(h, first, bands * rows), bands, rows)
                n = np.diff(first)
                where = np.arange(len(n) + 1, dtype=np.int32) * bands
                texts = column.cast(pa.large_binary()).to_pylist()
                new = [
                    pa.array([None if t is None else press.compress(t) for t in texts], pa.binary()),
                    pa.array(bag_digests(h, first), pa.binary()),
                    pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(where), pa.array(keys.ravel())),
                ]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in rest] + new, schema=arrow)

    return materialize(map_arrow(docs, work, schema).withColumn("_uid", F.monotonically_increasing_id()), "signed")


def _with_texts(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs with the compressed texts of both, in order of ``a`` within partitions."""
    z = signed.select("_uid", "_z")
    return pairs.join(z.select(F.col("_uid").alias("b"), F.col("_z").alias("zb")), "b").join(z.select(F.col("_uid").alias("a"), F.col("_z").alias("za")), "a").select("a", "b", "za", "zb")


def _bag_pairs(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[list[int], list[int], list[np.ndarray], list[np.ndarray]]]:
    """Of slices of the rows: a, b and the multisets of both."""
    open_ = zstandard.ZstdDecompressor()
    hub, hub_bag = None, None
    for batch in batches:
        for part in slices(batch, "zb", 1 << 17):
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            texts = [open_.decompress(z) for z in part.column("zb").to_pylist()]
            h, first = bags(*text_bytes(pa.array(texts, pa.large_binary())), shingle)
            hubs = []
            for i, x in enumerate(a):
                if x != hub:
                    hub = x
                    hub_bag = bags(*text_bytes(pa.array([open_.decompress(part.column("za")[i].as_py())], pa.large_binary())), shingle)[0]
                hubs.append(hub_bag)
            yield a, b, hubs, [h[first[i] : first[i + 1]] for i in range(len(b))]


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def verify(pairs: DataFrame, signed: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose multisets overlap enough; stored."""

    def check(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for a, b, hubs, own in _bag_pairs(batches, shingle):
            keep = [i for i in range(len(a)) if overlap(hubs[i], own[i]) >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], schema=schema)

    return materialize(map_arrow(_with_texts(pairs, signed), check, PAIR), "links")


def tokens_of(bag: np.ndarray) -> np.ndarray:
    """A multiset as a set: each occurrence of a hash with its number."""
    u, c = np.unique(bag, return_counts=True)
    number = np.arange(len(bag)) - np.repeat(np.cumsum(c) - c, c)
    return mix(np.repeat(u, c) + number.astype(np.uint64) * _GOLD)


def prefix_tokens(bag: np.ndarray, hub: np.ndarray, threshold: float) -> np.ndarray:
    """The tokens of which two multisets of that similarity share one, in the order: those not in the hub first, then by value."""
    tokens = tokens_of(bag)
    order = np.lexsort((tokens, np.isin(tokens, tokens_of(hub))))
    return tokens[order[: len(tokens) - int(np.ceil(threshold * len(tokens) - 1e-9)) + 1]]


def parity_map(tokens: np.ndarray, hub_tokens: int) -> np.ndarray:
    """Parities of the tokens in hashed places, as 64-bit words; about six places for each token of the hub.

    Two maps differ in no more places than the sets differ in tokens.
    """
    places = 1 << int(np.clip(np.ceil(np.log2(6 * max(1, hub_tokens))), 8, 13))
    odd = np.bincount((tokens % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(pairs: DataFrame, signed: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """For each pair (a, b) the prefix ``tokens`` of b in the order of hub a, and its ``parity`` map; stored."""

    def cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for a, b, hubs, own in _bag_pairs(batches, shingle):
            tokens = [prefix_tokens(x, y, threshold).view(np.int64) for x, y in zip(own, hubs, strict=True)]
            maps = [parity_map(tokens_of(x), len(y)) for x, y in zip(own, hubs, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(tokens, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64()))], schema=schema)

    longs = T.ArrayType(T.LongType())
    return materialize(map_arrow(_with_texts(pairs, signed), cut, T.StructType([*PAIR, T.StructField("tokens", longs), T.StructField("parity", longs)])), "tokens")


def _pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    """Different pairs whose sizes allow the similarity; stored."""
    sized = pairs.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    return materialize(sized.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def _mixed(crowded: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their component ``c`` and their hub's, ``hub_c``; stored."""
    labels = connected_components(links, "a", "b").withColumnRenamed("node", "uid")
    of_hub = labels.select(F.col("uid").alias("hub_uid"), F.col("component").alias("hub_component"))
    placed = crowded.join(labels, "uid", "left").withColumn("hub_uid", F.col("hub.uid")).join(of_hub, "hub_uid", "left")
    placed = materialize(placed.select("key", "uid", "n", "hub", F.coalesce("component", "uid").alias("c"), F.coalesce("hub_component", "hub_uid").alias("hub_c"), "reach"), "placed")
    keys = materialize(placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where(F.col("c0") < F.col("c1")).select("key"), "mixed-keys")
    mixed = materialize(placed.join(keys, "key"), "mixed")
    discard(placed)
    discard(keys)
    return mixed


def near_duplicate_classes(signed: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """``_uid`` of every row and ``_class``, the least ``_uid`` among the nodes of its class."""
    nodes = materialize(signed.where(F.col("_n") > 0).groupBy("_digest").agg(F.min("_uid").alias("node")), "nodes")
    own = signed.select("_uid", "_n", "_bands").join(nodes.select(F.col("node").alias("_uid")), "_uid")
    members = own.select(F.col("_uid").alias("uid"), F.col("_n").alias("n"), F.explode("_bands").alias("key"))
    # What is aggregated by a key is stored before it is joined by that key, so that Spark can split a hot key's rows in the join.
    shared = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1), "shared")
    met = materialize(members.join(shared, "key"), "members")
    central = met.groupBy("uid").agg(F.sum("size").alias("reach"))
    reached = met.drop("size").join(central, "uid")
    reached = materialize(reached, "reached")
    discard(shared)
    discard(met)
    hubs = materialize(reached.groupBy("key").agg(F.max_by(F.struct("uid", "n"), F.struct("reach", -F.col("uid"))).alias("hub")), "hubs")
    crowded = materialize(reached.join(hubs, "key"), "buckets")
    discard(reached)
    discard(hubs)
    tried = _pairs(crowded.where(F.col("uid") != F.col("hub.uid")).select(F.col("hub.uid").alias("a"), F.col("hub.n").alias("na"), F.col("uid").alias("b"), F.col("n").alias("nb")), threshold)
    links = verify(tried, signed, shingle, threshold)
    for _ in range(hub_rounds):
        mixed = _mixed(crowded, links)
        outside = mixed.where(F.col("c") != F.col("hub_c"))
        hubs = materialize(outside.groupBy("key").agg(F.max_by(F.struct("uid", "n", "c"), F.struct("reach", -F.col("uid"))).alias("next")), "hubs")
        new = mixed.join(hubs, "key").where(F.col("c") != F.col("next.c")).select(F.col("next.uid").alias("a"), F.col("next.n").alias("na"), F.col("uid").alias("b"), F.col("n").alias("nb"))
        new = _pairs(new, threshold).join(tried, ["a", "b"], "left_anti")
        tried, links = tried.union(new), links.union(verify(new, signed, shingle, threshold))
        discard(mixed)
        discard(hubs)
    mixed = _mixed(crowded, links)
    of_hub = mixed.select(F.col("hub.uid").alias("a"), F.col("uid").alias("b")).distinct()
    about = mixed.select(F.col("uid").alias("b"), "n", "c").distinct()
    cut = prefixes(of_hub, signed, shingle, threshold)
    token = materialize(cut.select("a", "b", F.explode("tokens").alias("token")).join(about, "b"), "prefixes")
    split = materialize(token.groupBy("a", "token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where(F.col("c0") < F.col("c1")).select("a", "token"), "split")
    met = materialize(token.join(split, ["a", "token"]).join(cut.select("a", "b", "parity"), ["a", "b"]), "met")
    for stored in (crowded, mixed, cut, token, split):
        discard(stored)
    x = met.select("a", "token", F.col("b").alias("ua"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("parity").alias("pa"))
    y = met.select("a", "token", F.col("b").alias("ub"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("parity").alias("pb"))
    apart = F.aggregate(F.zip_with("pa", "pb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    near = apart <= (1 - threshold) / (1 + threshold) * (F.col("na") + F.col("nb")) + 1e-9
    new = x.join(y, ["a", "token"]).where((F.col("ua") < F.col("ub")) & (F.col("ca") != F.col("cb")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & near)
    new = _pairs(new.select(F.col("ua").alias("a"), F.col("ub").alias("b"), "na", "nb"), threshold).join(tried, ["a", "b"], "left_anti")
    links = links.union(verify(new, signed, shingle, threshold))
    discard(met)
    labels = connected_components(links, "a", "b")
    of = nodes.join(labels, "node", "left").select("_digest", F.coalesce("component", "node").alias("_class"))
    return signed.select("_uid", F.when(F.col("_n") > 0, F.col("_digest")).alias("_digest")).join(of, "_digest", "left").select("_uid", F.coalesce("_class", "_uid").alias("_class"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each document: id, ``class_id`` (least id of its class), ``class_size`` (documents) and ``n_shingles``."""
    signed = sign(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")), "text", bands, rows, shingle)
    classes = materialize(near_duplicate_classes(signed, threshold, shingle).join(signed.select("_uid", "_id", "_n"), "_uid"), "classes")
    names = materialize(classes.groupBy("_class").agg(F.min("_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "names")
    discard(signed)
    return classes.join(names, "_class").select(F.col("_id").alias(id_col), "class_id", "class_size", F.col("_n").alias("n_shingles"))


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with one row of each class, that of the least id (null last).

    ``docs`` is read twice: the result leaves out of it what equals a dropped row in id and text, so no
    copy of all texts stays behind. Rows that can't be told apart by id and text are left out together,
    and those of them that stay are stored.
    """
    others = [c for c in docs.columns if c != text_col]
    same = [F.xxhash64(text_col), F.crc32(text_col)]  # 96 bits, beside the id
    signed = sign(docs.select(F.struct(*others).alias("_row"), F.col(text_col).alias("text"), F.struct(F.col(id_col).alias("id"), *[h.alias(f"h{i}") for i, h in enumerate(same)]).alias("_key")), "text", bands, rows, shingle)
    classes = near_duplicate_classes(signed, threshold, shingle).join(signed.select("_uid", F.col("_key.id").alias("_id")), "_uid")
    kept = materialize(classes.groupBy("_class").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_uid")).alias("first")).select(F.col("first._uid").alias("_uid")), "kept")
    stays = signed.select("_uid", "_key").join(kept.withColumn("_stays", F.lit(1)), "_uid", "left")
    told = stays.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.count("_stays").alias("n_stay"))
    gone = materialize(told.where((F.col("n") > 1) | (F.col("n_stay") == 0)).select("_key.*", "n", "n_stay"), "gone")
    alike = gone.where((F.col("n") > 1) & (F.col("n_stay") > 0)).select(F.struct(*[F.col(c) for c in ("id", "h0", "h1")]).alias("_key"))
    rest = signed.join(alike, signed["_key"].eqNullSafe(alike["_key"]), "left_semi").join(kept, "_uid", "left_semi").select("_row", "_z")
    schema = T.StructType([rest.schema["_row"], T.StructField("_text", T.StringType())])

    def restore(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, "_z", 1 << 20):
                texts = [None if z is None else open_.decompress(z).decode("utf-8", "replace") for z in part.column("_z").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(texts, pa.string())], schema=arrow)

    whole = materialize(map_arrow(rest, restore, schema), "alike")
    discard(signed)
    discard(kept)
    again = whole.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), *[h.alias(f"_h{i}") for i, h in enumerate(same)])
    left = row.join(gone, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_h0") == F.col("h0")) & (F.col("_h1").eqNullSafe(F.col("h1"))), "left_anti")
    return left.select("_row.*").unionByName(again)
