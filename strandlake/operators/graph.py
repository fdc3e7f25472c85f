"""Property-graph operators over edge tables (src, rel, dst)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import discard, materialize
from .relational import dense_numbers

#: Edges that a task of :func:`triangles` has about, pairs of edges that it looks at a time, and bytes of its table of pairs of nodes.
TASK_EDGES, _WEDGES, _TABLE = 1_000_000, 4_000_000, 64 << 20
#: Ends of edges up to which a task of :func:`closeness` reads all, bytes of its bits for each node and source, and bytes of bits that it gathers at once.
SEARCH_ENDS, _STATE, _GATHER = 64_000_000, 64 << 20, 8 << 20


def keyed_order(seed: int, *columns: str) -> Column:
    """A random-looking order that depends on the seed and the values only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def symmetric(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Different (node, neighbour) rows of both directions."""
    both = edges.select(F.explode(F.array(F.struct(F.col(src).alias("node"), F.col(dst).alias("neighbour")), F.struct(F.col(dst).alias("node"), F.col(src).alias("neighbour")))).alias("e"))
    return both.select("e.node", "e.neighbour").distinct()


def entity_dictionary(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(entity_id, idx): endpoints numbered from 0 in order of their ids."""
    ends = edges.select(F.explode(F.array(src, dst)).alias("entity_id")).where(F.col("entity_id").isNotNull()).distinct()
    return dense_numbers(ends, "entity_id", "_n").select("entity_id", (F.col("_n") - 1).alias("idx"))


def encode_edges(edges: DataFrame, dictionary: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges by entity numbers; those with unknown ends are left out."""
    a = dictionary.select(F.col("entity_id").alias(src), F.col("idx").alias("src_idx"))
    b = dictionary.select(F.col("entity_id").alias(dst), F.col("idx").alias("dst_idx"))
    return edges.join(a, src).join(b, dst)


def transductive_split(edges: DataFrame, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """Different triples with ``in_train``; every entity and relation of the table is in a training triple.

    Triples are in train if their keyed hash is below the share, or if they are the first by hash
    of one of their ends or of their relation.
    """
    return split_different(materialize(edges.select("src", "rel", "dst").distinct(), "different"), train_share, seed)


def split_different(triples: DataFrame, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """:func:`transductive_split` of stored triples that are different already.

    An end or relation with a triple below the share has its first one in train anyway. So the least
    hashes are summed up as numbers, and the first triples are looked for only of what has none below.
    """
    rows = triples.select("src", "rel", "dst").withColumn("h", keyed_order(seed, "src", "rel", "dst"))
    place = F.conv(F.substring("h", 1, 15), 16, 10).cast("long")
    below = lambda p: F.shiftright(p, 28).cast("double") / float(1 << 32) < train_share  # noqa: E731  by the first 8 of 15 digits
    parts = F.explode(F.array(F.concat(F.lit("e|"), "src"), F.concat(F.lit("e|"), "dst"), F.concat(F.lit("r|"), "rel")))
    least = rows.select(place.alias("p"), parts.alias("part")).groupBy("part").agg(F.min("p").alias("p"))
    bare = materialize(least.where(~below(F.col("p"))).select(F.col("part").alias("_part"), F.col("p").alias("_p")), "bare")
    ends = rows.where(~below(place)).select("h", place.alias("p"), parts.alias("part"))
    ties = ends.join(bare, F.col("part").eqNullSafe(F.col("_part")) & (F.col("p") == F.col("_p")))  # equal in 15 digits; h decides
    first = materialize(ties.groupBy("part").agg(F.min("h").alias("h")).select("h").distinct().withColumn("first", F.lit(True)), "firsts")
    return rows.join(first, "h", "left").select("src", "rel", "dst", (below(place) | F.coalesce("first", F.lit(False))).alias("in_train"))


def split_report(split: DataFrame) -> DataFrame:
    """Triples, nodes and relations of both parts."""
    ends = split.select("in_train", F.explode(F.array("src", "dst")).alias("node")).groupBy("in_train").agg(F.count_distinct("node").alias("n_nodes"))
    rows = split.groupBy("in_train").agg(F.count(F.lit(1)).alias("n_triples"), F.count_distinct("rel").alias("n_relations"))
    return rows.join(ends, "in_train").select(F.when(F.col("in_train"), "train").otherwise("test").alias("part"), "n_triples", "n_nodes", "n_relations")


def label_counts(nodes: DataFrame) -> DataFrame:
    """Nodes of each set of labels."""
    return nodes.groupBy("labels").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "labels")


def relationship_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of each pair of end labels, most frequent first."""
    a = nodes.select(F.col("id").alias("src"), F.col("labels").alias("src_labels"))
    b = nodes.select(F.col("id").alias("dst"), F.col("labels").alias("dst_labels"))
    return edges.join(a, "src").join(b, "dst").groupBy("src_labels", "dst_labels").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src_labels", "dst_labels")


def degrees(edges: DataFrame) -> DataFrame:
    """Number of different neighbours of each node, itself left out."""
    return symmetric(edges).where(F.col("node") != F.col("neighbour")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def top_degrees(edges: DataFrame, n: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(n)


def either_end_in(edges: DataFrame, members: DataFrame, member: str, ordinal: list[str]) -> DataFrame:
    """Edges with an end among the members, by two semi-joins instead of a join on OR."""
    ids = members.select(F.col(member).alias("_m")).distinct()
    a = edges.join(ids, edges["src"] == ids["_m"], "left_semi")
    b = edges.join(ids, edges["dst"] == ids["_m"], "left_semi")
    return a.unionByName(b).dropDuplicates(ordinal)


def oriented(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, from its end of lower degree (ties: lower id), so that no node has many."""
    both = symmetric(edges).where(F.col("node") < F.col("neighbour")).select(F.col("node").alias("a"), F.col("neighbour").alias("b"))
    d = degrees(edges)
    with_d = both.join(d.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    swap = F.struct("db", "b") < F.struct("da", "a")
    return with_d.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("lo"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("hi"))


def _closed(lo: np.ndarray, hi: np.ndarray, n: int, colours: np.ndarray, wanted: list[int]) -> np.ndarray:
    """Triangles that each of n nodes is in, of oriented edges, those with the wanted colours only."""
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    ends = np.searchsorted(lo, lo, "right")
    after = ends - np.arange(len(lo)) - 1  # edges of the same node behind each
    keys = np.sort(np.minimum(lo, hi) * n + np.maximum(lo, hi))
    table = None
    if n * n <= _TABLE:
        table = np.zeros(n * n, bool)
        table[keys] = True
    counts, total = np.zeros(n, np.int64), np.cumsum(after)
    at = 0
    while at < len(lo):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _WEDGES, "right")))
        one = np.repeat(np.arange(at, to), after[at:to])
        other = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(after[at:to]) - after[at:to], after[at:to])
        y, z = hi[one], hi[other]  # y < z
        key = y * n + z
        hit = np.flatnonzero(table[key] if table is not None else keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key)
        x, y, z = lo[one[hit]], y[hit], z[hit]
        mine = (np.sort(np.stack([colours[x], colours[y], colours[z]]), axis=0) == np.array(wanted)[:, None]).all(0)
        for v in (x, y, z):
            counts += np.bincount(v[mine], minlength=n)
        at = to
    return counts


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles each node is in.

    Nodes have colours, as many as keep the edges between three of them near ``TASK_EDGES``. Each
    three colours are a task, which has the edges between them, so an edge is sent once a colour and
    no pair of edges is a row.
    """
    e = materialize(oriented(edges), "oriented")
    n_colours = math.ceil(max(1.0, 9 * e.count() / TASK_EDGES) ** 0.5)
    colour = lambda c: F.pmod(F.xxhash64(c), F.lit(n_colours)).cast("int")
    three = lambda k: F.array_sort(F.array("a", "b", k))
    tasks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n_colours - 1)), three))
    # An edge inside one colour is also in tasks of this colour and any two others.
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n_colours - 1)), lambda i: F.transform(F.sequence(i, F.lit(n_colours - 1)), lambda j: F.array_sort(F.array(F.col("a"), i, j)))))
    sent = e.select("lo", "hi", colour("lo").alias("a"), colour("hi").alias("b")).select("lo", "hi", "a", "b", F.explode(F.when(F.col("a") == F.col("b"), pairs).otherwise(tasks)).alias("task"))

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        k = rows.num_rows
        both = pa.chunked_array([*rows["lo"].chunks, *rows["hi"].chunks]).combine_chunks().dictionary_encode()
        code = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        colours = np.zeros(len(both.dictionary), np.int64)
        colours[code[:k]], colours[code[k:]] = rows["a"].to_numpy(), rows["b"].to_numpy()
        counts = _closed(code[:k], code[k:], len(colours), colours, key[0].as_py())
        some = np.flatnonzero(counts)
        return pa.table({"node": both.dictionary.take(pa.array(some)), "n": pa.array(counts[some])})

    found = sent.groupBy("task").applyInArrow(count, T.StructType([T.StructField("node", e.schema["lo"].dataType), T.StructField("n", T.LongType())]))
    return found.groupBy("node").agg(F.sum("n").alias("triangles"))


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """Undirected edges of the largest part in which every node has k neighbours at least.

    Each pair is stored once; a round only looks for nodes to take away, and writes again what is left if there are some.
    """
    pairs = edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("node"), F.greatest("src", "dst").alias("neighbour"))
    left = materialize(pairs.distinct(), "core")
    while True:
        ends = left.select(F.explode(F.array("node", "neighbour")).alias("node"))
        gone = materialize(ends.groupBy("node").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") < k).select("node"), "gone")
        if gone.isEmpty():
            return left
        new = materialize(left.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "neighbour"), "neighbour", "left_anti").select("node", "neighbour"), "core")
        discard(left)
        discard(gone)
        left = new


def _reached(sources: np.ndarray, begin: np.ndarray, near: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that each of a group of sources reaches, and the sum of their distances; a bit for each source and node, so a step takes a word for 64 sources.

    ``near`` are the neighbours in order of nodes, of which those from ``begin`` on are a node's.
    """
    words = -(-len(sources) // 64)
    seen = np.zeros((n, words), np.uint64)
    k = np.arange(len(sources))
    np.bitwise_or.at(seen, (sources, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
    last, reached, distance = seen.copy(), np.zeros(64 * words, np.int64), np.zeros(64 * words, np.int64)
    some = np.flatnonzero(np.diff(begin))  # nodes with neighbours
    step = max(1, _GATHER // (8 * words))
    cuts = np.unique(np.append(np.searchsorted(begin[some], np.arange(0, len(near), step)), len(some)))
    for hop in itertools.count(1):
        new = np.zeros_like(last)
        for i, j in itertools.pairwise(cuts.tolist()):
            lo, hi = begin[some[i]], begin[some[j - 1] + 1]
            new[some[i:j]] = np.bitwise_or.reduceat(last[near[lo:hi]], begin[some[i:j]] - lo, axis=0)
        new &= ~seen
        if not new.any():
            return reached[: len(sources)], distance[: len(sources)]
        seen |= new
        for at in range(0, n, max(1, _GATHER // (64 * words))):
            found = np.unpackbits(new[at : at + max(1, _GATHER // (64 * words))].astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            reached += found
            distance += hop * found
        last = new


def closeness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, reached, distance, closeness) of the given sources by breadth-first search, until nothing new is reached.

    A task searches from a group of sources at once and reads all numbered edges by blocks; of graphs
    with more than ``SEARCH_ENDS`` ends of edges each step is a join.
    """
    near = materialize(symmetric(edges).where(F.col("node") != F.col("neighbour")), "near")
    asked = materialize(sources.select("node").distinct(), "asked")
    n_ends = near.count()
    sums = _searched(near, n_ends, asked) if n_ends <= SEARCH_ENDS else _joined(near, asked)
    return sums.withColumn("closeness", F.coalesce(F.try_divide(F.col("reached").cast("double"), F.col("distance").cast("double")), F.lit(0.0)))


def _joined(near: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, reached, distance), each step by a join."""
    seen = asked.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops"))
    for hop in itertools.count(1):
        edge = seen.where(F.col("hops") == hop - 1).join(near, "node").select("source", F.col("neighbour").alias("node")).distinct()
        fresh = materialize(edge.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(hop)), "seen")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return seen.groupBy(F.col("source").alias("node")).agg((F.count(F.lit(1)) - 1).alias("reached"), F.sum("hops").cast("long").alias("distance"))


def _searched(near: DataFrame, n_ends: int, asked: DataFrame) -> DataFrame:
    """(node, reached, distance), searched from groups of sources."""
    names = materialize(entity_dictionary(near, "node", "neighbour"), "names")
    n = names.count()
    size = 64 * max(1, min(16, _STATE // (8 * max(1, n))))  # sources in a group
    coded = encode_edges(near, names, "node", "neighbour").select(F.col("src_idx").cast("int").alias("u"), F.col("dst_idx").cast("int").alias("v"))
    blocks = max(1, -(-n_ends // TASK_EDGES))
    adjacent = materialize(coded.groupBy(F.pmod("u", F.lit(blocks)).alias("b")).agg(F.collect_list("u").alias("u"), F.collect_list("v").alias("v")), "adjacent")
    known = asked.join(names.withColumnRenamed("entity_id", "node"), "node")
    groups = max(1, -(-n // size))
    grouped = materialize(known.groupBy(F.pmod("idx", F.lit(groups)).alias("g")).agg(F.collect_list(F.col("idx").cast("int")).alias("sources")).repartition(groups), "groups")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, u, v = None, [], []

        def search() -> pa.RecordBatch:
            a, b = np.concatenate(u), np.concatenate(v)
            begin = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])
            reached, distance = _reached(now[1], begin, b[np.argsort(a, kind="stable")], n)
            return pa.RecordBatch.from_arrays([pa.array(now[1].astype(np.int64)), pa.array(reached), pa.array(distance)], names=["idx", "reached", "distance"])

        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                if now is None or batch.column("g")[i].as_py() != now[0]:
                    if now is not None:
                        yield search()
                    now, u, v = (batch.column("g")[i].as_py(), get("sources")), [], []
                u.append(get("u"))
                v.append(get("v"))
        if now is not None:
            yield search()

    met = grouped.join(adjacent.drop("b").coalesce(1).hint("shuffle_replicate_nl"))  # each group with all blocks, one after the other
    found = met.mapInArrow(work, "idx long, reached long, distance long").join(names, "idx").select(F.col("entity_id").alias("node"), "reached", "distance")
    alone = asked.join(names.withColumnRenamed("entity_id", "node"), "node", "left_anti").select("node", F.lit(0).cast("long").alias("reached"), F.lit(0).cast("long").alias("distance"))
    return found.unionByName(alone)


def edge_buckets(edges: DataFrame, n_partitions: int, n_chunks: int, seed: int = 42) -> DataFrame:
    """Integer edges with the partitions of their ends and a chunk, for bucketed training."""
    dealt = lambda n, *c: (F.conv(F.substring(keyed_order(seed, *c), 1, 8), 16, 10).cast("long") % n).cast("int")
    return edges.withColumns({"src_part": dealt(n_partitions, "src"), "dst_part": dealt(n_partitions, "dst"), "chunk": dealt(n_chunks, "src", "rel", "dst")})


def first_edges(edges: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n edges in keyed order of each source, for sampled reports."""
    place = F.row_number().over(Window.partitionBy("src").orderBy(keyed_order(seed, "src", "dst"), "dst"))
    return edges.withColumn("_p", place).where(F.col("_p") <= n).drop("_p")
