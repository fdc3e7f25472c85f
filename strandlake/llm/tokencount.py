"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are regrouped into slices of about equal bytes whatever their number of rows. Every text
is split at safe boundaries, where no merge of the vocabulary can reach across, so a text of any
length is encoded as short pieces; the lengths of frequent pieces are remembered by the worker in
a table of bounded size. Whether the boundaries are safe is read from the vocabulary; where they
are not, whole texts go to the library.

Defined cases: null and empty texts have no tokens; repeated rows are counted each; an empty table
gives an empty result; extra columns are kept, but for those named like a result column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import REMEMBERED, map_arrow, plus
from .kernel import slices, with_columns

#: Pieces whose lengths a worker remembers at most, and the longest of them in characters.
MEMORY_PIECES, MEMORY_CHARS = 800_000, 64
#: Characters of pieces that go to the library at once.
CALL_CHARS = 1 << 20

_counters: dict[str, PieceCounter | WholeCounter] = {}
REMEMBERED["lengths"] = _counters.clear


class WholeCounter:
    """Lengths by a library's own call on whole texts."""

    def __init__(self, encode_lengths):
        self.encode_lengths = encode_lengths

    def counts(self, texts: list[str]) -> list[int]:
        return self.encode_lengths(texts)


class PieceCounter:
    """Lengths as sums over pieces of the text between safe boundaries.

    ``split`` gives a text's pieces and what to add to their sum.
    """

    def __init__(self, encode_lengths, split):
        self.encode_lengths, self.split, self.known = encode_lengths, split, {}

    def counts(self, texts: list[str]) -> list[int]:
        parts = [self.split(t) for t in texts]
        known = self.known
        missing = [p for p in {p for pieces, _ in parts for p in pieces} if p not in known]
        if len(known) + len(missing) > MEMORY_PIECES:
            known.clear()
            missing = list({p for pieces, _ in parts for p in pieces})
        at = 0
        while at < len(missing):
            upto, size = at, 0
            while upto < len(missing) and (upto == at or size < CALL_CHARS):
                size += len(missing[upto])
                upto += 1
            known.update(zip(missing[at:upto], self.encode_lengths(missing[at:upto]), strict=True))
            at = upto
        out = [sum(map(known.__getitem__, pieces)) + more for pieces, more in parts]
        for p in [p for p in missing if len(p) > MEMORY_CHARS]:
            del known[p]
        return out


def sentencepiece_pieces(text: str) -> tuple[list[str], int]:
    """Pieces that begin at a space (left out, as the library puts one before each text) or a newline.

    A newline is a byte of its own, so nothing merges across it; a piece that begins with one gets
    the library's own space token before it, which is taken off the sum.
    """
    if not text:
        return [], 0
    more = 0
    if "\n" in text and " \n" not in text and text[0] != "\n":
        more = -text.count("\n")
        text = text.replace("\n", " \n")
    pieces = text.split(" ")
    if "" not in pieces:
        return pieces, more
    out: list[str] = []
    spaces = 0
    for p in pieces:
        if p:
            out.append(" " * spaces + p)
            spaces = 0
        else:
            spaces += 1
    if spaces and out:  # spaces at the end belong to the last word
        out[-1] += " " * spaces
    elif spaces:
        out = [text]
    return out, more


def open_counter(path: str) -> PieceCounter | WholeCounter:
    """The counter for a vocabulary file: ``.model`` by sentencepiece, ``.json`` by tokenizers."""
    if path not in _counters:
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            lengths = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
            pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
            space = "▁"
            safe = not any(re.search(f"[^{space}]{space}|[\n ]", p) for p in pieces) and sp.encode("a  b", out_type=str) == [f"{space}a", space, f"{space}b"] and sp.encode("a\nb", out_type=str) == [f"{space}a", "<0x0A>", "b"]
            split = lambda t: ([t], 0) if space in t else sentencepiece_pieces(t)
            _counters[path] = PieceCounter(lengths, split) if safe else WholeCounter(lengths)
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _counters[path] = WholeCounter(lambda texts: [len(e) for e in tok.encode_batch(texts, add_special_tokens=False)])
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens`` (no begin, end or added special tokens)."""

    def count(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        counter = open_counter(tokenizer_path)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(text_col)
                n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                n = counter.counts([t or "" for t in texts.to_pylist()])
                yield with_columns(part, {"n_bytes": n_bytes, "n_tokens": pa.array(np.array(n, np.int64))}, schema)

    return map_arrow(docs, count, plus(docs.schema, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())), keeps="lengths")
