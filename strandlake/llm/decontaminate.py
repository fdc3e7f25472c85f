"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (an item of fewer, but
not none, is one window). Windows are the sets of the join; exact containment needs all of a
window's words, so the necessary prefix of a window whose words are ordered by rarity is its
rarest word. Rarity is the number of documents, over the whole corpus, that contain the word.

A document word that is some window's prefix fetches candidate positions; the positional bound
drops windows that would begin before the text or (length bound) end behind it; what is left is
verified by comparing all words of the item-sized window. The work is a scan of the documents
without a shuffle, so hot sources, copies and frequent passages change no task's share.

The benchmark side is cut into blocks of ``block_windows`` pairs of a window and an item, at most
one item's windows more. Beyond the first block the documents are stored with what was found so far
and the block's index is destroyed before the next one is broadcast, so one bounded index is alive at
a time and a benchmark of any size is joined whole. Frequencies are
counted before, in one scan for each ``block_words`` different words of the whole benchmark.

Defined cases: null or empty texts have no words and are never hit; very long texts are judged
whole; repeated rows are judged each on their own; an empty table gives an empty result; an empty benchmark leaves all documents clean; items that share an
``item_id`` are one item; a null ``item_id`` counts as the empty string; columns of the input
that are named like a result column give way to it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import discard, materialize
from .arrow import map_arrow, plus
from .kernel import ALNUM_TRANSLATE, slices, text_list, with_columns

WINDOW = 10
#: Windows with an item each of a broadcast index: about 60 MB as Python objects.
BLOCK_WINDOWS = 200_000
#: Words counted in one scan: about 80 MB as Python objects.
BLOCK_WORDS = 1_000_000

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return text.translate(ALNUM_TRANSLATE).split()


def item_windows(words: list[bytes], window: int) -> set[tuple[bytes, ...]]:
    if len(words) <= window:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + window]) for i in range(len(words) - window + 1)}


def item_words(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[str, list[bytes]]]:
    """Ids and words of the items; a partition of the benchmark at a time."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.encode(F.col(text_col), "UTF-8"))
    for item, text in rows.toLocalIterator():
        yield item, words_of(bytes(text or b""))


def blocks_of_windows(items: Iterator[tuple[str, list[bytes]]], window: int, limit: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    """Windows with the items that hold them, in blocks of about ``limit`` such pairs; a window of many items is in several blocks."""
    block: dict[tuple[bytes, ...], set[str]] = {}
    pairs = 0
    for item, words in items:
        found = item_windows(words, window)
        for w in found:
            block.setdefault(w, set()).add(item)
        pairs += len(found)
        if pairs >= limit:
            yield block
            block, pairs = {}, 0
    if block:
        yield block


def blocks_of_words(items: Iterator[tuple[str, list[bytes]]], limit: int) -> Iterator[frozenset[bytes]]:
    """Words of the items, in blocks of about ``limit``; a word may be in several blocks."""
    block: set[bytes] = set()
    for _, words in items:
        block.update(words)
        if len(block) >= limit:
            yield frozenset(block)
            block = set()
    if block:
        yield frozenset(block)


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> DataFrame:
    """In how many documents each word of the vocabulary occurs, (``word``, ``n``), stored; summed before and after the shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for text in text_list(part.column("text")):
                    seen.update(known.value.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=schema)

    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])
    counted = map_arrow(docs.select(F.col(text_col).alias("text")), count, schema)
    stored = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")), "frequencies")
    known.unpersist()
    return stored


def frequencies_of(vocabulary: frozenset[bytes], tables: list[DataFrame]) -> dict[bytes, int]:
    """Frequencies of the words of one block of windows, looked up in the stored tables."""
    found: dict[bytes, int] = {}
    for table in tables:
        asked = table.sparkSession.createDataFrame(pa.table({"word": pa.array(sorted(vocabulary), pa.binary())}))
        found.update((bytes(w), n) for w, n in table.join(asked, "word", "left_semi").collect())  # at most the block's vocabulary
    return found


def prefix_index(block: dict[tuple[bytes, ...], set[str]], frequency: dict[bytes, int]) -> dict:
    """Rarest word -> (its place in the window, window length) -> window -> items."""
    index: dict = defaultdict(lambda: defaultdict(dict))
    for w, items in block.items():
        at = min(range(len(w)), key=lambda i: (frequency.get(w[i], 0), w[i], i))
        index[w[at]][at, len(w)][b" ".join(w)] = sorted(items)
    return {word: {k: dict(v) for k, v in places.items()} for word, places in index.items()}


def hits(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """Word spans of all occurrences of indexed windows, merged, and the items that they come from."""
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for i, word in enumerate(words):
        if word in index:
            for (at, length), windows in index[word].items():
                begin = i - at
                if begin < 0 or begin + length > len(words):
                    continue
                found = windows.get(b" ".join(words[begin : begin + length]))
                if found is not None:
                    spans.append((begin, begin + length))
                    items.update(found)
    return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (merged [start, end) word ranges that are hit), ``items`` (ids as sorted strings) and ``contaminated``."""
    kept = plus(docs.schema, T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType())))
    span_type, text_at = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), text_col
    sc, out, stored = docs.sparkSession.sparkContext, docs, None
    read = lambda: item_words(benchmark, item_col, item_text_col)
    counted = [document_frequencies(docs, text_col, words) for words in blocks_of_words(read(), block_words)]
    blocks = blocks_of_windows(read(), window, block_windows)
    block, n = next(blocks, {}), 0
    while block is not None:
        vocabulary = frozenset(word for w in block for word in w)
        shared, again = sc.broadcast(prefix_index(block, frequencies_of(vocabulary, counted))), n > 0

        def judge(batches: Iterator[pa.RecordBatch], schema: pa.Schema, shared=shared, again=again) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part in slices(batch, text_at):
                    counts, spans, items = [], [], []
                    before = zip(part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True) if again else None
                    for text in text_list(part.column(text_at)):
                        words = words_of(text)
                        found, of = hits(words, index)
                        if before is not None:
                            had, had_items = next(before)
                            found, of = merge(found + [(s["start"], s["end"]) for s in had]), of.union(had_items)
                        counts.append(len(words))
                        spans.append([{"start": a, "end": b} for a, b in found])
                        items.append(sorted(of))
                    yield with_columns(part, {"n_words": pa.array(np.array(counts, np.int64)), "spans": pa.array(spans, span_type), "items": pa.array(items, pa.list_(pa.string()))}, schema)

        out = map_arrow(out, judge, kept)
        block, n = next(blocks, None), n + 1
        if block is not None:
            before, stored = stored, materialize(out, "judged")
            out = stored
            shared.destroy()
            if before is not None:
                discard(before)
    for table in counted:
        discard(table)
    return out.withColumn("contaminated", F.size("spans") > 0)
