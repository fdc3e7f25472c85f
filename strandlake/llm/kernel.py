"""Vectorised byte-level text kernels shared by the Arrow functions.

Texts are handled as UTF-8 bytes: one concatenated byte array and document offsets. All word
classes used here treat every non-ASCII byte alike, so splitting bytes equals splitting
characters. Hashes are seeded constants and therefore equal in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once by a kernel; longer single texts are handled alone.
SLICE_BYTES = 1 << 20

_ROOT = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_POW: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["up"]) < n:
        with np.errstate(over="ignore"):
            for key, base in (("up", int(_ROOT)), ("down", _inverse(int(_ROOT)))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _POW[key] = np.cumprod(steps)
    return _POW["up"], _POW["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Random value of each byte, by a rule.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _ROOT)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: As BYTE_VALUE, with A-Z as a-z.
LOWER_VALUE = BYTE_VALUE[_LOWER]

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z are lower-cased.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Bytes of `[^\x20\x09-\x0D]`.
NON_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])

#: For bytes.translate: lower-case letters, digits and non-ASCII stay, all else becomes a space.
ALNUM_TRANSLATE = bytes(int(_LOWER[b]) if ALNUM[b] else 32 for b in range(256))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated bytes and document offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_list(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``limit`` bytes of text each, in order."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the number of the first word of each text."""
    inside = table[data]
    change = np.empty(len(data) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
    change[offsets] = True
    edge = np.flatnonzero(change)
    word = inside[edge[:-1]] if len(data) else np.zeros(0, bool)
    starts, ends = edge[:-1][word], edge[1:][word]
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = LOWER_VALUE, block: int = SLICE_BYTES) -> np.ndarray:
    """64-bit hashes of the byte spans (sorted, not overlapping), in blocks of bounded memory."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, base + block, side="right")))
        stop = int(ends[upto - 1])
        up, down = _powers(stop - base + 1)
        total = np.empty(stop - base + 1, np.uint64)
        total[0] = 0
        np.cumsum(values[data[base:stop]] * up[: stop - base], out=total[1:])
        s, e = starts[at:upto] - base, ends[at:upto] - base
        out[at:upto] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _ROOT)
        at = upto
    return out


def shingles(words: np.ndarray, first: np.ndarray, k: int, whole_short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words within texts, and the number of the first window of each text.

    With ``whole_short`` a text of fewer words, but not none, is one window of all its words.
    """
    counts = np.diff(first)
    n = np.maximum(counts - k + 1, 0)
    starts = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first[:-1] - starts[:-1], n) + np.arange(starts[-1])
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        h = h * _ROOT + words[at + i]
    h = mix(h)
    if whole_short and (short := np.flatnonzero((counts > 0) & (counts < k))).size:
        extra = np.empty(len(short), np.uint64)
        for j, d in enumerate(short):
            x = int(counts[d])
            for w in words[first[d] : first[d + 1]].tolist():
                x = (x * int(_ROOT) + w) & 0xFFFFFFFFFFFFFFFF
            extra[j] = x
        extra = mix(extra ^ _ROOT)
        h = np.insert(h, starts[short], extra)
        n[short] = 1
        starts = np.concatenate([[0], np.cumsum(n)])
    return h, starts


def within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """The different values in order, by sorting."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """The batch with columns added, or put in the place of those of the same name."""
    return pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch.column(f.name) for f in schema], schema=schema)
