"""Removal of repeated substrings by a sampled suffix array.

A byte is removed if it lies in a string of ``length`` bytes that also starts in a document with a
smaller id. Suffixes are sampled at anchors: of the ``length - gram + 1`` grams in a window of
``length`` bytes, the one with the least hash (the first of equal ones) is the window's anchor, so
equal windows have equal anchors at equal places and every window belongs to exactly one anchor.

Documents are packed into blocks of a few MB, stored once. Then

1. every block sends 32 bits of each anchor gram's hash to its hash range; what two blocks send is
   sent back, so anchors that stand alone in the corpus drop out before any text is moved;
2. for the others a block sends the suffix at the anchor and the context to its left, cut to the
   windows that belong to the anchor. Equal contexts of a block are one record with its least and
   largest document id, so a passage that is in a third of all documents is one record a block.
   Sampled splitters range-partition the records by their leading bytes; the sample grows with the
   buckets. Frequent leading grams are dealt out by whole windows instead. Each bucket sorts its
   suffixes by multikey quicksort (eight bytes a character), groups equal ones, and compares windows
   of neighbouring suffixes that differ within their reach. Across boundaries the leading grams
   decide: a splitter is one, so equal grams are in one bucket, and suffixes whose grams differ
   can't share a window of this anchor;
3. blocks get the least document of their windows back and cut out what is covered.

Defined cases: null texts are empty; a null id counts as larger than all others, and rows of equal
or null ids don't remove from one another; texts shorter than ``length`` are kept; a text longer
than a block is a block of its own, whole; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import discard, materialize
from .arrow import map_arrow
from .kernel import BYTE_VALUE, _powers, mix, sorted_unique, text_bytes, within

LENGTH, GRAM = 50, 20
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 100_000
#: Bytes of text whose anchors are computed at once.
_PART = 1 << 20
#: Anchors of each block, spread over it, that splitters are sampled from; so the sample grows with the buckets.
SAMPLE_ANCHORS = 64
#: Rows up to which a stretch isn't parted by a pivot.
SMALL_ROWS = 1 << 14
_NO_ID = np.iinfo(np.int64).max

BLOCK = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("valid", T.BinaryType()), T.StructField("lens", T.BinaryType()), T.StructField("z", T.BinaryType()), T.StructField("size", T.LongType())])
MESSAGE = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("block", T.LongType()), T.StructField("data", T.BinaryType())])
RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("kept", T.BinaryType()),
])


def pack_arrays(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays)] + [a.nbytes for a in arrays], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack_arrays(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at = 4 * (len(kinds) + 1)
    out = []
    for size, kind in zip(np.frombuffer(raw, "<u4", len(kinds), 4).tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def group_rows(rows: np.ndarray, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: an order of the rows (uint8) and where a new value begins in it.

    Characters are eight bytes. A stretch of rows that agree before a character is parted there by
    a pivot into smaller, equal and larger ones, and only the equal ones go on to the next
    character; stretches of up to ``SMALL_ROWS`` are finished by :func:`_group_few`.
    ``groups``: numbers that come before the first character.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-max(width, 1) // 8) * 8), np.uint8)
    padded[:, :width] = rows
    chars = [c.astype(np.uint64) for c in padded.view(">u8").T]
    if groups is not None:
        chars.insert(0, groups.astype(np.uint64))
    order, new = np.arange(n), np.zeros(n, bool)
    todo = [(0, n, 0)] if n else []
    while todo:
        lo, hi, c = todo.pop()
        if c == len(chars):
            new[lo] = True
        elif hi - lo <= SMALL_ROWS:
            order[lo:hi], new[lo:hi] = _group_few(order[lo:hi], chars[c:])
        else:
            at = order[lo:hi]
            key = chars[c][at]
            pivot = np.sort(key[:: max(1, len(key) // 64)])[len(key[:: max(1, len(key) // 64)]) // 2]
            less, more = key < pivot, key > pivot
            same = ~(less | more)
            x, y = lo + int(less.sum()), hi - int(more.sum())
            order[lo:hi] = np.concatenate([at[less], at[same], at[more]])
            todo += [part for part in ((lo, x, c), (x, y, c + 1), (y, hi, c)) if part[0] < part[1]]
    return order, new


def _group_few(order: np.ndarray, chars: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of their characters, and where a new value begins; from the second character on only rows that are still tied are sorted."""
    order = order[np.argsort(chars[0][order], kind="stable")]
    first = chars[0][order]
    new = np.ones(len(order), bool)
    new[1:] = first[1:] != first[:-1]
    for char in chars[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not at.size:
            break
        group = np.cumsum(new)[at]
        key = char[order[at]]
        inner = np.lexsort((key, group))
        order[at] = order[at[inner]]
        key, group = key[inner], group[inner]
        same = np.zeros(len(at), bool)
        same[1:] = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
        new[at] = ~same
    return order, new


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: its place, gram hash, and the first and last start of its windows."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 1 + (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    h = mix((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, w = 1, length - gram + 1
    while 2 * span <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < w:
        key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
    start = np.arange(len(key))
    ok = np.repeat(offsets[1:], np.diff(offsets))[: len(key)] - start >= length
    start, place = start[ok], (key[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(start):
        return place, h[place], start, start
    change = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    low, high = start[change], start[np.append(change[1:], len(start)) - 1]
    return place[change], h[place[change]], low, high


def contexts(data: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, gram: int) -> np.ndarray:
    """A row for each anchor: the suffix, the bytes before it from near to far, and how far its windows reach to the left, least and most."""
    left = length - gram
    padded = np.concatenate([np.zeros(left, np.uint8), data, np.zeros(length, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, left + length)[place]
    column = np.arange(-left, length)
    around[(column < (low - place)[:, None]) | (column >= (high + length - place)[:, None])] = 0
    return np.concatenate([around[:, left:], around[:, :left][:, ::-1], (place - high)[:, None].astype(np.uint8), (place - low)[:, None].astype(np.uint8)], axis=1)


class Block:
    """A block's documents and their anchors, in one fixed order."""

    def __init__(self, ids: bytes, valid: bytes, lens: bytes, z: bytes, length: int, gram: int):
        self.length, self.gram = length, gram
        self.ids, self.valid = np.frombuffer(ids, np.int64), np.frombuffer(valid, bool)
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(lens, np.int64))])
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
        parts = []
        d = 0
        while d < len(self.ids):
            upto = max(d + 1, int(np.searchsorted(self.offsets, self.offsets[d] + _PART, side="right")) - 1)
            a, b = self.offsets[d], self.offsets[upto]
            place, h, low, high = anchors(self.data[a:b], self.offsets[d : upto + 1] - a, length, gram)
            parts.append((place + a, h, low + a, high + a))
            d = upto
        self.place, self.hash, self.low, self.high = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.doc = np.searchsorted(self.offsets, self.place, side="right") - 1
        self.doc_id = np.where(self.valid, self.ids, _NO_ID)[self.doc]

    def classes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different contexts of the chosen anchors, sorted: rows, least and largest id; then the anchors in order of classes and each one's class."""
        rows = contexts(self.data, self.place[chosen], self.low[chosen], self.high[chosen], self.length, self.gram)
        order, new = group_rows(rows)
        begin = np.flatnonzero(new)
        ids = self.doc_id[chosen][order]
        if not len(begin):
            return rows, ids, ids, chosen, np.zeros(0, np.int64)
        return rows[order[begin]], np.minimum.reduceat(ids, begin), np.maximum.reduceat(ids, begin), chosen[order], np.cumsum(new) - 1

    def local_repeats(self) -> np.ndarray:
        """Of each anchor, whether its gram's hash is in two documents of the block."""
        order = np.argsort(self.hash)
        h, d = self.hash[order], self.doc[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        if not len(begin):
            return np.zeros(0, bool)
        many = np.minimum.reduceat(d, begin) < np.maximum.reduceat(d, begin)
        out = np.empty(len(h), bool)
        out[order] = np.repeat(many, np.diff(np.append(begin, len(h))))
        return out


def open_blocks(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[int, Block, int]]:
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i].as_py() for c in ("block", "ids", "valid", "lens", "z")}
        yield row["block"], Block(row["ids"], row["valid"], row["lens"], row["z"], length, gram), i


def make_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Blocks of whole documents, with ``block`` as their number; stored."""

    def work(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        ids, valid, lens, texts, size, n_docs = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            data = b"".join(texts)
            row = [np.concatenate(ids).tobytes(), np.concatenate(valid).tobytes(), np.concatenate(lens).tobytes(), zstandard.ZstdCompressor(level=6).compress(data), len(data)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            id_column = batch.column("id")
            known = id_column.is_valid().to_numpy(zero_copy_only=False)
            number = id_column.fill_null(0).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes - size, side="right")) - 1)
                upto = min(upto, at + BLOCK_DOCS - n_docs)
                ids.append(number[at:upto])
                valid.append(known[at:upto])
                lens.append(np.diff(offsets[at : upto + 1]))
                texts.append(data[offsets[at] : offsets[upto]].tobytes())
                size += len(texts[-1])
                n_docs += upto - at
                if size >= block_bytes or n_docs >= BLOCK_DOCS or upto < batch.num_rows:
                    yield flush()
                    ids, valid, lens, texts, size, n_docs = [], [], [], [], 0, 0
                at = upto
        if ids:
            yield flush()

    made = map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), work, BLOCK)
    return materialize(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Messages of one bucket after the other; rows come sorted by bucket."""
    now, blocks, data = None, [], []
    for batch in batches:
        for bucket, block, message in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if bucket != now and blocks:
                yield now, blocks, data
                blocks, data = [], []
            now = bucket
            blocks.append(block)
            data.append(message)
    if blocks:
        yield now, blocks, data


def messages(rows: list[tuple[int, int, bytes]], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def send(rows: DataFrame) -> DataFrame:
    """Messages of a bucket together, in order of buckets."""
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with all messages sent back to them."""
    return blocks.join(answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("answers")), "block", "left")


def ask_grams(blocks: DataFrame, n_buckets: int, length: int, gram: int) -> DataFrame:
    """Phase 1: for each block, 32 bits of the gram hashes that another block has too; and, in buckets below 0, samples of its grams."""

    def ask(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, b, _ in open_blocks(batch, length, gram):
                h = sorted_unique(b.hash)
                bucket = gram_bucket(h, n_buckets)
                order = np.lexsort(((h & np.uint64(0xFFFFFFFF)), bucket))
                low, bucket = (h[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), bucket[order]
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
                rows = [(int(bucket[x]), block, pack_arrays(sorted_unique(low[x:y]))) for x, y in zip(edge, np.append(edge, len(bucket))[1:], strict=True)]
                if len(b.place):
                    at = np.linspace(0, len(b.place) - 1, min(SAMPLE_ANCHORS, len(b.place))).astype(np.int64)
                    rows.append((-1 - block % n_buckets, block, np.lib.stride_tricks.sliding_window_view(b.data, gram)[b.place[at]].tobytes()))
                yield messages(rows, schema)

    def answer(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for bucket, of, data in by_bucket(batches):
            if bucket < 0:  # samples pass
                yield messages([(bucket, block, d) for block, d in zip(of, data, strict=True)], schema)
                continue
            parts = [unpack_arrays(d, "<u4")[0] for d in data]
            value = np.sort(np.concatenate(parts))
            shared = sorted_unique(value[1:][value[1:] == value[:-1]])
            found = [(bucket, block, p[within(p, shared)]) for block, p in zip(of, parts, strict=True)]
            yield messages([(k, block, pack_arrays(p)) for k, block, p in found if len(p)], schema)

    return map_arrow(send(map_arrow(blocks, ask, MESSAGE)), answer, MESSAGE)


def gram_bucket(h: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)


def sample_splitters(answers: DataFrame, n_buckets: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading grams that cut the sampled ones into about even parts, and those too frequent for one part; at most about ``n_buckets`` each.

    Grams are counted, and the counts of those that aren't too frequent are summed up over ranges of
    them, so that the cuts don't depend on the number of ranges.
    """

    def take(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([data[i : i + gram] for i in range(0, len(data), gram)], pa.binary())], schema=schema)

    sampled = map_arrow(answers.where("bucket < 0").select("data"), take, T.StructType([T.StructField("gram", T.BinaryType())]))
    grams = materialize(sampled.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "sample")
    total = grams.agg(F.sum("n")).first()[0] or 0
    often = max(20.0, total / (2 * n_buckets))
    hot = sorted(bytes(r[0]) for r in grams.where(F.col("n") >= often).select("gram").collect())
    cuts = []
    if n_buckets > 1 and total:
        ranges = materialize(grams.where(F.col("n") < often).repartitionByRange("gram").withColumn("part", F.spark_partition_id()), "ranges")
        sums = ranges.groupBy("part").agg(F.sum("n").alias("in_part"))
        each = max(1, (sums.agg(F.sum("in_part")).first()[0] or 0) // n_buckets)
        before = sums.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))  # a row for each range
        upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("gram"))
        placed = ranges.join(F.broadcast(before), "part").withColumn("upto", upto)
        cuts = sorted(bytes(r[0]) for r in placed.where(F.floor(F.col("upto") / each) > F.floor((F.col("upto") - F.col("n")) / each)).select("gram").collect())
        discard(ranges)
    discard(grams)
    matrix = lambda x: np.frombuffer(b"".join(x), np.uint8).reshape(len(x), gram)
    return matrix(cuts), matrix(hot)


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as comparable fixed-width values."""
    return np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel() if rows.size else np.zeros(0, f"V{max(1, rows.shape[1])}")


def cut_places(rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """In sorted rows, the first row not below each cut."""
    lead = [r.tobytes() for r in rows]
    return np.array([bisect.bisect_left(lead, c.tobytes()) for c in cuts], np.int64)


def ask_windows(blocks: DataFrame, cuts: np.ndarray, hot: np.ndarray, n_buckets: int, n_grams: int, length: int, gram: int) -> DataFrame:
    """Phase 2: the least document of windows, for each block's classes of contexts that need it."""
    left = length - gram
    width = length + left + 2
    shared = blocks.sparkSession.sparkContext.broadcast((cuts, hot))  # at most n_buckets short strings

    def ask(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        cuts, hot = shared.value
        for batch in batches:
            for block, b, i in open_blocks(batch, length, gram):
                chosen = chosen_anchors(b, batch.column("answers")[i].as_py(), n_grams)
                rows, least, most, _, _ = b.classes(chosen)
                number = np.arange(len(rows))
                is_hot = np.zeros(len(rows), bool)
                lead = [r.tobytes() for r in rows[:, :gram]]
                for g in hot:
                    g = g.tobytes()
                    is_hot[bisect.bisect_left(lead, g) : bisect.bisect_right(lead, g)] = True
                out = []
                cold = np.flatnonzero(~is_hot)
                place = np.searchsorted(cold, cut_places(rows[:, :gram], cuts))
                edge = np.unique(np.concatenate([[0], place, [len(cold)]]))
                where = np.searchsorted(place, edge[:-1], side="right")
                for bucket, x, y in zip(where, edge[:-1], edge[1:], strict=True):
                    at = cold[x:y]
                    out.append((int(bucket), block, pack_arrays(rows[at], least[at], most[at] - least[at], number[at].astype("<u4"))))
                at = np.flatnonzero(is_hot)
                if len(at):  # a record for each window, dealt by all of its bytes
                    low, high = rows[at, width - 2].astype(np.int64), rows[at, width - 1].astype(np.int64)
                    each = np.repeat(np.arange(len(at)), high - low + 1)
                    reach = np.concatenate([np.arange(a, z + 1) for a, z in zip(low, high, strict=True)])
                    win = rows[at[each]].copy()
                    column = np.arange(length + left)
                    win[:, : length + left][np.where(column < length, column >= (length - reach)[:, None], column - length >= reach[:, None])] = 0
                    win[:, width - 2] = win[:, width - 1] = reach
                    deal = np.zeros(len(win), np.uint64)
                    for c in range(width):
                        deal = mix(deal + win[:, c])
                    deal = (deal % np.uint64(n_buckets)).astype(np.int64)
                    order = np.argsort(deal, kind="stable")
                    edge = np.flatnonzero(np.concatenate([[True], deal[order][1:] != deal[order][:-1]]))
                    for x, y in zip(edge, np.append(edge[1:], len(order)), strict=True):
                        k = order[x:y]
                        a = at[each[k]]
                        out.append((len(cuts) + 1 + int(deal[k[0]]), block, pack_arrays(win[k], least[a], most[a] - least[a], number[a].astype("<u4"))))
                yield messages(out, schema)

    def answer(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for bucket, of, data in by_bucket(batches):
            parts = [unpack_arrays(d, "u1", "<i8", "<i8", "<u4") for d in data]
            size = [len(p[1]) for p in parts]
            rows = np.concatenate([p[0] for p in parts]).reshape(-1, width)
            least = np.concatenate([p[1] for p in parts])
            most = least + np.concatenate([p[2] for p in parts])
            number = np.concatenate([p[3] for p in parts])
            sender = np.repeat(np.arange(len(of)), size)
            at, low, high, first = window_minima(rows, least, most, length, gram)
            order = np.argsort(sender[at], kind="stable")
            at, low, high, first = at[order], low[order], high[order], first[order]
            edge = np.searchsorted(sender[at], np.arange(len(of) + 1))
            yield messages([(bucket, of[s], pack_arrays(number[at[x:y]], low[x:y].astype("u1"), high[x:y].astype("u1"), first[x:y])) for s, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if x < y], schema)

    return map_arrow(send(map_arrow(blocks, ask, MESSAGE)), answer, MESSAGE)


def chosen_anchors(b: Block, answers: list | None, n_grams: int) -> np.ndarray:
    """Anchors whose gram is in two documents, or seems to be."""
    keep = b.local_repeats()
    if answers:
        bucket = np.concatenate([np.full(len(v), a["bucket"], np.uint64) for a in answers for v in unpack_arrays(a["data"], "<u4")])
        value = np.concatenate([v for a in answers for v in unpack_arrays(a["data"], "<u4")]).astype(np.uint64)
        mine = (gram_bucket(b.hash, n_grams).astype(np.uint64) << np.uint64(32)) | (b.hash & np.uint64(0xFFFFFFFF))
        keep |= within(mine, np.sort((bucket << np.uint64(32)) | value))
    return np.flatnonzero(keep)


def window_minima(rows: np.ndarray, least: np.ndarray, most: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Records some of whose documents are not the first with a window: record, reaches of the windows (from, to), and the first document."""
    left = length - gram
    order, new = group_rows(rows)
    kind = np.empty(len(rows), np.int64)
    kind[order] = np.cumsum(new) - 1  # equal contexts
    begin = np.flatnonzero(new)
    one = order[begin]
    first = np.minimum.reduceat(least[order], begin) if len(begin) else least
    same = np.zeros(len(one), bool)
    same[1:] = (rows[one[1:], :gram] == rows[one[:-1], :gram]).all(axis=1)
    family = np.cumsum(~same) - 1  # equal grams, in suffix order
    size = np.bincount(family) if len(family) else np.zeros(0, np.int64)
    alone = size[family] == 1
    low, high = rows[one, -2].astype(np.int64), rows[one, -1].astype(np.int64)
    best = np.repeat(first[:, None], left + 1, axis=1) if not alone.all() else first[:, None]
    if not alone.all():
        several = np.flatnonzero(~alone)
        for reach in range(left + 1):
            at = several[(low[several] <= reach) & (reach <= high[several])]
            if not len(at):
                continue
            r = rows[one[at]]
            window = np.concatenate([r[:, gram : length - reach], r[:, length : length + reach]], axis=1)
            o, n = group_rows(window, family[at].astype(np.uint64))
            start = np.flatnonzero(n)
            least_of = np.minimum.reduceat(first[at[o]], start)
            best[at[o], reach] = np.repeat(least_of, np.diff(np.append(start, len(o))))
    out = []
    solo = np.flatnonzero(alone[kind] & (first[kind] < most))
    out.append((solo, low[kind[solo]], high[kind[solo]], first[kind[solo]]))
    rest = np.flatnonzero(~alone[kind])
    if len(rest):
        k = kind[rest]
        b = best[k]
        column = np.arange(left + 1)
        need = (column >= low[k][:, None]) & (column <= high[k][:, None]) & (b < most[rest][:, None])
        head = need.copy()
        head[:, 1:] &= ~(need[:, :-1] & (b[:, 1:] == b[:, :-1]))
        tail = need.copy()
        tail[:, :-1] &= ~(need[:, 1:] & (b[:, 1:] == b[:, :-1]))
        i, x = np.nonzero(head)
        _, y = np.nonzero(tail)
        out.append((rest[i], x, y, b[i, x]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def cut_blocks(blocks: DataFrame, n_grams: int, length: int, gram: int) -> DataFrame:
    """Phase 3: what is removed from each document."""

    def work(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, b, i in open_blocks(batch, length, gram):
                change = np.zeros(len(b.data) + 1, np.int32)
                second = batch.column("answers2")[i].as_py()
                if second:
                    number, low, high, first = (np.concatenate(x) for x in zip(*[unpack_arrays(a["data"], "<u4", "u1", "u1", "<i8") for a in second], strict=True))
                    chosen = chosen_anchors(b, batch.column("answers")[i].as_py(), n_grams)
                    _, _, _, anchor, of = b.classes(chosen)
                    edge = np.searchsorted(of, np.arange((of[-1] if len(of) else -1) + 2))
                    n = edge[number + 1] - edge[number]
                    each = np.repeat(np.arange(len(number)), n)
                    a = anchor[np.repeat(edge[number] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(each))]
                    use = first[each] < b.doc_id[a]
                    each, p = each[use], b.place[a[use]]
                    np.add.at(change, p - high[each], 1)
                    np.add.at(change, p - low[each] + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                yield from result_rows(b, gone, schema)

    return map_arrow(blocks, work, RESULT)


def result_rows(b: Block, gone: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = []
    for d in range(len(b.ids)):
        x, y = b.offsets[d], b.offsets[d + 1]
        mask = gone[x:y]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
        rows.append({
            "doc_id": int(b.ids[d]) if b.valid[d] else None,
            "n_bytes": int(y - x),
            "removed": [{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()],
            "kept": b.data[x:y][~mask].tobytes() if len(edge) else b.data[x:y].tobytes(),
        })
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: doc_id, ``n_bytes``, ``removed`` (maximal byte spans) and ``kept`` (the other bytes)."""
    if not 0 < gram < length <= 250:
        raise ValueError("0 < gram < length <= 250 is needed")
    blocks = make_blocks(docs, id_col, text_col, block_bytes)
    total = blocks.agg(F.sum("size")).first()[0] or 0
    n_buckets = int(min(max(1, -(-total // block_bytes)), 1 << 20))
    answers = materialize(ask_grams(blocks, n_buckets, length, gram), "grams")
    cuts, hot = sample_splitters(answers, n_buckets, gram)
    asked = materialize(with_answers(blocks, answers.where("bucket >= 0")), "asked")
    discard(blocks)
    discard(answers)
    minima = materialize(ask_windows(asked, cuts, hot, n_buckets, n_buckets, length, gram), "windows")
    second = minima.groupBy("block").agg(F.collect_list(F.struct("data")).alias("answers2"))
    return cut_blocks(asked.join(second, "block", "left"), n_buckets, length, gram)
