"""Packing of documents into sequences by best-fit decreasing.

Lengths are whole numbers up to the window, so best-fit decreasing needs no piece but only how many
there are of each length: pieces of one length and windows of one remaining capacity are alike and
are placed together. A segment tree indexed by remaining capacity finds the tightest open window.
What the driver holds is bounded by the window, whatever the corpus: a count for each length, and
runs, each of which says where pieces lo .. hi - 1 of a length go. A placement less than halves the
capacity of the windows that it fills, so a window is in at most log2(window) runs of full
placements, and each length adds at most four groups of windows: some 90,000 runs at a window of
2,048, usually a few thousand, which is a proven bound for their broadcast.

A document is encoded once: its ids are cut into full windows and a rest, and each task numbers its
pieces by length. Counts by task and length, summed over the tasks before, make these numbers
global; a piece then looks its window up among the runs. Texts are never shuffled.

Windows that best fit leaves with more than ``window // 100`` tokens of padding are dissolved, unless
their length is a power of two, which needs no padding. Their pieces are cut into blocks of powers
of two, largest first, and packed anew by the same procedure: such blocks leave no gaps but in one
last window, which is split into sequences of powers of two. So no sequence is padded by more than
one hundredth, whatever the lengths are.

Defined cases: a null or empty text is its end id alone, or gives no piece where there is none; null
and repeated ids keep all their rows, each a document of its own; very long texts are full windows
and a rest; equal lengths are placed in order of tasks and rows; an empty table gives an empty
result; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import materialize
from .arrow import map_arrow
from .kernel import slices
from .tokenbin import open_encoder


class OpenWindows:
    """Groups of equal open windows, by remaining capacity, under a segment tree."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.groups: list[list[tuple[int, list]]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        at = self.leaves + capacity
        while at:
            self.tree[at] += n
            at //= 2

    def put(self, capacity: int, group: tuple[int, list]) -> None:
        self.groups[capacity].append(group)
        self._add(capacity, 1)

    def take(self, capacity: int) -> tuple[int, list]:
        self._add(capacity, -1)
        return self.groups[capacity].pop()

    def tightest(self, least: int) -> int | None:
        """Smallest remaining capacity of an open window that is ``least`` or more."""
        at, tree = self.leaves + least, self.tree
        if tree[at]:
            return least
        while at > 1 and not (at % 2 == 0 and tree[at + 1]):
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if tree[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(counts: dict[int, int], window: int) -> list[tuple[int, int, list]]:
    """Best-fit decreasing of ``counts[length]`` pieces; groups (number of windows, tokens in each, placements).

    A placement (length, first, per, offset) says that the group's window w holds, from ``offset``
    on, pieces first + w * per .. of that length, ``per`` of them.
    """
    open_ = OpenWindows(window)
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        first, left = 0, counts[length]
        while left:
            capacity = open_.tightest(length)
            if capacity is None:
                capacity, n, placed = window, left, []  # as many new windows as could be needed
                fresh = True
            else:
                n, placed = open_.take(capacity)
                fresh = False
            per = min(capacity // length, left)
            full = min(n, left // per)
            open_.put(capacity - per * length, (full, [*placed, (length, first, per, window - capacity)]))
            if not fresh and full < n:
                open_.put(capacity, (n - full, [(size, at + full * k, k, offset) for size, at, k, offset in placed]))
            first += full * per
            left -= full * per
    return [(n, window - capacity, placed) for capacity, groups in enumerate(open_.groups) for n, placed in groups]


def power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def plan(counts: dict[int, int], window: int) -> tuple[list[tuple], list[tuple]]:
    """Runs of pieces and runs of blocks.

    A run is (length, lo, hi, sequence, per, offset, used, bases): pieces lo .. hi - 1 of that length
    go, ``per`` to each, to sequences from ``sequence`` on. Where ``bases`` is not None the pieces are
    cut into blocks instead; the blocks of piece lo have these numbers among all blocks of their size.
    """
    sizes = [1 << b for b in range(window.bit_length() - 1, -1, -1)]
    runs, dissolved, sequence = [], [], 0
    for n, used, placed in best_fit(counts, window):
        if window - used <= window // 100 or power_of_two(used):
            runs += [(length, first, first + n * per, sequence, per, offset, used, None) for length, first, per, offset in placed]
            sequence += n
        else:
            dissolved += [(length, first, first + n * per) for length, first, per, _ in placed]
    blocks = dict.fromkeys(sizes, 0)
    for length, lo, hi in dissolved:
        own = [p for p in sizes if length & p]
        runs.append((length, lo, hi, None, None, None, None, [blocks[p] for p in own]))
        for p in own:
            blocks[p] += hi - lo
    block_runs = []
    for n, used, placed in best_fit(blocks, window):
        if used == window:
            block_runs += [(length, first, first + n * per, sequence, per, offset, used, None) for length, first, per, offset in placed]
            sequence += n
            continue
        queue = [[length, first, per] for length, first, per, _ in placed]  # one window, larger blocks first
        for target in (p for p in sizes if used & p):
            filled = 0
            while filled < target:
                length, first, per = queue[0]
                take = min(per, (target - filled) // length)
                block_runs.append((length, first, first + take, sequence, take, filled, target, None))
                filled += take * length
                queue[0][1:] = [first + take, per - take]
                if not queue[0][2]:
                    del queue[0]
            sequence += 1
    return runs, block_runs


_RUNS = T.StructType(
    [T.StructField("length", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("lo", "hi", "sequence", "per", "at", "used")), T.StructField("bases", T.ArrayType(T.LongType()))]
)


def _pieces(docs: DataFrame, tokenizer_path: str, end_id: int | None, window: int, text_col: str, id_col: str) -> DataFrame:
    """Encoded pieces with their task and their number among the task's pieces of the same length, stored."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "doc_tokens", "nth")]
    fields += [T.StructField("length", T.IntegerType()), T.StructField("task", T.IntegerType()), T.StructField("ids", T.BinaryType())]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.spark_partition_id().alias("task"))

    def cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        encoder, seen = open_encoder(tokenizer_path), [0] * (window + 1)
        for batch in batches:
            for part in slices(batch, "text"):
                source, start, total, nth, length, ids = [], [], [], [], [], []
                for d, data in enumerate(encoder.encode(part.column("text").cast(pa.large_binary()).to_pylist())):
                    data += end
                    n = len(data) // 4
                    for at in range(0, n, window):
                        size = min(window, n - at)
                        source.append(d)
                        start.append(at)
                        total.append(n)
                        nth.append(seen[size])
                        length.append(size)
                        ids.append(data[4 * at : 4 * (at + size)])
                        seen[size] += 1
                if source:
                    of = pa.array(source, pa.int64())
                    columns = {"doc_id": part.column("doc_id").take(of), "task": part.column("task").take(of), "start": start, "doc_tokens": total, "nth": nth, "length": length, "ids": ids}
                    yield pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)

    return materialize(map_arrow(rows, cut, T.StructType(fields), keeps="ids"), "pieces")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None = None, window: int = 2048, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, doc_tokens, ids (little-endian uint32),
    sequence_id, offset, and ``padded_length``, the length that the sequence is padded to.

    ``window`` is a power of two.
    """
    if not power_of_two(window):
        raise ValueError("the window must be a power of two")
    spark = docs.sparkSession
    pieces = _pieces(docs, tokenizer_path, end_id, window, text_col, id_col)
    counted = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    numbers = materialize(counted.select("task", "length", "n", before.alias("before")), "numbers")
    counts = {r["length"]: r["n"] for r in numbers.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    runs, block_runs = (spark.createDataFrame(x, _RUNS) for x in plan(counts, window))

    sizes = F.array(*[F.lit(1 << b) for b in range(window.bit_length() - 1, -1, -1)])
    global_nth = F.col("before") + F.col("nth")
    runs = runs.withColumnsRenamed({"length": "run_length"})
    placed = pieces.join(numbers.drop("n"), ["task", "length"]).join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & (global_nth >= F.col("lo")) & (global_nth < F.col("hi")))
    k = global_nth - F.col("lo")
    own = F.filter(sizes, lambda p: F.col("length").bitwiseAND(p) != 0)
    blocks = F.transform(own, lambda p, i: F.struct(p.alias("size"), (F.col("length") - F.col("length").bitwiseAND(2 * p - 1)).alias("from"), (F.col("bases")[i] + k).alias("number")))
    whole = F.array(F.struct(F.col("length").alias("size"), F.lit(0).alias("from"), F.lit(None).cast("long").alias("number")))
    cut = placed.select(
        "doc_id", "start", "doc_tokens", "ids", "length", "used",
        (F.col("sequence") + F.floor(k / F.col("per"))).alias("sequence_id"),
        (F.col("at") + k % F.col("per") * F.col("length")).alias("offset"),
        F.explode(F.when(F.col("bases").isNull(), whole).otherwise(blocks)).alias("b"),
    )
    block_runs = block_runs.select(*[F.col(c).alias(f"b_{c}") for c in block_runs.columns])
    number = F.col("b.number")
    found = cut.join(F.broadcast(block_runs), (F.col("b.size") == F.col("b_length")) & (number >= F.col("b_lo")) & (number < F.col("b_hi")), "left")
    j = number - F.col("b_lo")
    used = F.coalesce("b_used", "used")
    return found.select(
        "doc_id",
        (F.col("start") + F.col("b.from")).alias("start"),
        F.col("b.size").cast("long").alias("length"),
        "doc_tokens",
        F.when(number.isNull(), F.col("ids")).otherwise(F.substr("ids", 4 * F.col("b.from") + 1, 4 * F.col("b.size"))).alias("ids"),
        F.coalesce(F.col("b_sequence") + F.floor(j / F.col("b_per")), "sequence_id").alias("sequence_id"),
        F.coalesce(F.col("b_at") + j % F.col("b_per") * F.col("b.size"), "offset").alias("offset"),
        F.when(used.bitwiseAND(used - 1) == 0, used).otherwise(window).alias("padded_length"),
    )


def sequences(pieces: DataFrame, pad_id: int = 0) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens and ``ids`` padded with ``pad_id``; a group holds one window at most."""
    listed = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"), F.max("padded_length").alias("padded"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return listed.select("sequence_id", "n_tokens", F.rpad(joined, (4 * F.col("padded")).cast("int"), F.lit(int(pad_id).to_bytes(4, "little"))).alias("ids"))
