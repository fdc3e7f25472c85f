"""Pairwise alignment with affine gaps, as an Arrow function over batches of pairs.

All pairs of a batch go through the recurrence together, one cell at a time for every pair, so
numpy works on whole batches. A gap of length L costs ``open + (L - 1) * extend``. Of equal scores
a match is taken before a gap in the second sequence, and that before a gap in the first. Identity is
the share of equal columns among those of both whole sequences, also for local alignments.

Pairs whose tables would be too large go alone, one diagonal at a time: states are kept at every
few hundredth diagonal only, and the choices between two of these are made again on the way back, so
memory grows with the root of the table, and of equal scores the same alignment is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of the tables held at once.
CELLS = 2_000_000

_M, _X, _Y, _STOP = 0, 1, 2, 3


def _codes(texts: list[str], width: int) -> np.ndarray:
    out = np.full((len(texts), width), -1, np.int32)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32)
    return out


def align_batch(a: list[str], b: list[str], mode: str, match: float, mismatch: float, open_: float, extend: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores, and percent of identical columns, of the best alignments of not empty strings."""
    local = mode == "local"
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows, cols, size = int(n.max()), int(m.max()), len(a)
    x, y = _codes(a, rows), _codes(b, cols)
    low = -1e18
    state = np.full((3, 2, cols + 1, size), low)
    back = np.full((3, rows + 1, cols + 1, size), _STOP, np.uint8)
    state[_M, 0, :, :] = 0.0 if local else low
    state[_M, 0, 0, :] = 0.0
    if not local:
        for j in range(1, cols + 1):
            state[_Y, 0, j] = open_ + (j - 1) * extend
            back[_Y, 0, j] = _Y if j > 1 else _M
    best, best_i, best_j = np.zeros(size), np.zeros(size, int), np.zeros(size, int)
    final = np.full((3, size), low)

    def settle(i: int, cur: int) -> None:
        at = n == i
        if at.any():
            k = np.flatnonzero(at)
            final[:, k] = state[:, cur, m[k], k]

    settle(0, 0)
    for i in range(1, rows + 1):
        old, cur = (i - 1) % 2, i % 2
        state[:, cur] = low
        if local:
            state[_M, cur, 0] = 0.0
        else:
            state[_X, cur, 0] = open_ + (i - 1) * extend
            back[_X, i, 0] = _X if i > 1 else _M
        for j in range(1, cols + 1):
            step = np.where(x[:, i - 1] == y[:, j - 1], match, mismatch)
            before = state[:, old, j - 1]
            pick = np.argmax(before, axis=0)
            value = np.take_along_axis(before, pick[None], 0)[0]
            if local:
                pick = np.where(value > 0, pick, _STOP)
                value = np.maximum(value, 0.0)
            state[_M, cur, j] = value + step
            back[_M, i, j] = pick
            for s, prev in ((_X, state[:, old, j]), (_Y, state[:, cur, j - 1])):
                cost = prev + open_
                cost[s] = prev[s] + extend
                pick = np.argmax(cost, axis=0)
                state[s, cur, j] = np.take_along_axis(cost, pick[None], 0)[0]
                back[s, i, j] = pick
            if local:
                better = (state[_M, cur, j] > best) & (i <= n) & (j <= m)
                best = np.where(better, state[_M, cur, j], best)
                best_i, best_j = np.where(better, i, best_i), np.where(better, j, best_j)
        settle(i, cur)
    if local:
        score, now, i, j = best, np.full(size, _M), best_i.copy(), best_j.copy()
        active = score > 0
    else:
        now = np.argmax(final, axis=0)
        score, i, j = final.max(axis=0), n.copy(), m.copy()
        active = np.ones(size, bool)
    same, columns = np.zeros(size, int), np.zeros(size, int)
    each = np.arange(size)
    while active.any():
        if not local:
            active &= (i > 0) | (j > 0)
        k = each[active]
        if not len(k):
            break
        s = now[k]
        columns[k] += 1
        pair = k[s == _M]
        same[pair] += x[pair, i[pair] - 1] == y[pair, j[pair] - 1]
        nxt = back[s, i[k], j[k], k]
        i[k] -= s != _Y
        j[k] -= s != _X
        now[k] = nxt
        if local:
            active[k] = nxt != _STOP
    if local:  # the ends outside are columns too: they lie next to the aligned part, without gaps between
        found = columns > 0
        ahead, behind = np.minimum(i, j), np.minimum(n - best_i, m - best_j)
        for t in range(int(np.where(found, np.maximum(ahead, behind), 0).max(initial=0))):
            k = each[found & (t < ahead)]
            same[k] += x[k, i[k] - 1 - t] == y[k, j[k] - 1 - t]
            k = each[found & (t < behind)]
            same[k] += x[k, best_i[k] + t] == y[k, best_j[k] + t]
        columns += np.where(found, np.maximum(i, j) + np.maximum(n - best_i, m - best_j), 0)
    return score, np.where(columns > 0, 100.0 * same / np.maximum(columns, 1), 0.0)


class _LongPair:
    """One pair of not empty strings by diagonals i + j, each a vector over i."""

    def __init__(self, a: str, b: str, local: bool, match: float, mismatch: float, open_: float, extend: float):
        self.x, self.y = (np.frombuffer(t.encode("utf-32-le"), np.int32) for t in (a, b))
        self.n, self.m, self.local = len(a), len(b), local
        self.match, self.mismatch, self.open, self.extend = match, mismatch, open_, extend

    def first(self) -> np.ndarray:
        out = np.full((3, self.n + 1), -1e18)
        out[_M, 0] = 0.0
        return out

    def step(self, d: int, last: np.ndarray, before: np.ndarray, choices: np.ndarray | None = None) -> np.ndarray:
        """States of diagonal ``d`` from those of the two before it; ``choices`` takes two bits for each state."""
        out = np.full((3, self.n + 1), -1e18)
        s, e = max(1, d - self.m), min(self.n, d - 1) + 1
        if s < e:
            near = np.where(self.x[s - 1 : e - 1] == self.y[d - e : d - s][::-1], self.match, self.mismatch)
            value, pick = self._best(before[:, s - 1 : e - 1])
            if self.local:
                pick[value <= 0] = _STOP
                value = np.maximum(value, 0.0)
            out[_M, s:e] = value + near
            made = pick
            for state, prev, shift in ((_X, last[:, s - 1 : e - 1], 2), (_Y, last[:, s:e], 4)):
                cost = prev + self.open
                cost[state] = prev[state] + self.extend
                out[state, s:e], pick = self._best(cost)
                made = made | pick << shift
            if choices is not None:
                choices[s:e] = made
        for at, state, shift, there in ((0, _Y, 4, d <= self.m), (d, _X, 2, d <= self.n)):
            if there and self.local:
                out[_M, at] = 0.0
                if choices is not None:
                    choices[at] = _STOP
            elif there:
                out[state, at] = self.open + (d - 1) * self.extend
                if choices is not None:
                    choices[at] = (state if d > 1 else _M) << shift
        return out

    @staticmethod
    def _best(states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, x, y = states
        x_better = x > m
        value = np.maximum(m, x)
        y_better = y > value
        return np.maximum(value, y), np.where(y_better, np.uint8(_Y), x_better.view(np.uint8))

    def align(self) -> tuple[float, float]:
        """Score and percent of identical columns, as ``align_batch`` gives them."""
        n, m = self.n, self.m
        every = max(16, int((16 * (n + m)) ** 0.5))
        kept, best = {}, (0.0, 0, 0)
        last, before = self.first(), np.full((3, n + 1), -1e18)
        for d in range(1, n + m + 1):
            if (d - 1) % every == 0:
                span = slice(max(0, d - 2 - m), min(n, d - 1) + 1)
                kept[d] = (span, last[:, span].copy(), before[:, span].copy())
            last, before = self.step(d, last, before), last
            if self.local:
                top = last[_M].max()
                if top >= best[0] and top > 0:
                    i = int(np.flatnonzero(last[_M] == top)[0])
                    if top > best[0] or (i, d - i) < best[1:]:
                        best = (float(top), i, d - i)
        if self.local:
            score, i, j = best
            now = _M
        else:
            now = int(np.argmax(last[:, n]))
            score, i, j = float(last[now, n]), n, m
        end_i, end_j, same, columns = i, j, 0, 0
        base, choices = None, np.zeros((every, n + 1), np.uint8)
        while (score > 0 and now != _STOP) if self.local else i > 0 or j > 0:
            d = i + j
            start = (d - 1) // every * every + 1
            if start != base:
                base = start
                span, *states = kept.pop(start)
                last, before = np.full((3, n + 1), -1e18), np.full((3, n + 1), -1e18)
                last[:, span], before[:, span] = states
                for k in range(start, d + 1):
                    last, before = self.step(k, last, before, choices[k - start]), last
            columns += 1
            state, now = now, choices[d - base, i] >> 2 * now & 3
            if state == _M:
                same += int(self.x[i - 1] == self.y[j - 1])
            i, j = i - (state != _Y), j - (state != _X)
        if self.local and columns:
            ahead, behind = min(i, j), min(n - end_i, m - end_j)
            same += int((self.x[i - ahead : i] == self.y[j - ahead : j]).sum()) + int((self.x[end_i : end_i + behind] == self.y[end_j : end_j + behind]).sum())
            columns += max(i, j) + max(n - end_i, m - end_j)
        return score, 100.0 * same / columns if columns else 0.0


def align_long(a: str, b: str, mode: str, match: float, mismatch: float, open_: float, extend: float) -> tuple[float, float]:
    """Score, and percent of identical columns, of the best alignment of two not empty strings of any length."""
    return _LongPair(a, b, mode == "local", match, mismatch, open_, extend).align()


def alignment_identity(mode: str = "global", match: float = 2.0, mismatch: float = -1.0, open_: float = -0.5, extend: float = -0.1):
    """A function of two string columns: percent of identical columns of both sequences, laid out by the best alignment; 0 with an empty or null one."""
    if mode not in ("global", "local"):
        raise ValueError(f"no such alignment: {mode}")

    @F.pandas_udf("double")
    def identity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            a, b = a.fillna("").tolist(), b.fillna("").tolist()
            out = np.zeros(len(a))
            todo = sorted((k for k in range(len(a)) if a[k] and b[k]), key=lambda k: (len(a[k]), len(b[k])))
            at = 0
            while at < len(todo):
                upto, rows, cols = at, 0, 0
                while upto < len(todo):
                    r, c = max(rows, len(a[todo[upto]])), max(cols, len(b[todo[upto]]))
                    if upto > at and (upto - at + 1) * (r + 1) * (c + 1) > CELLS:
                        break
                    rows, cols, upto = r, c, upto + 1
                k = todo[at:upto]
                if (rows + 1) * (cols + 1) > CELLS:
                    out[k[0]] = align_long(a[k[0]], b[k[0]], mode, match, mismatch, open_, extend)[1]
                    at = upto
                    continue
                out[k] = align_batch([a[q] for q in k], [b[q] for q in k], mode, match, mismatch, open_, extend)[1]
                at = upto
            yield pd.Series(out)

    return identity


def align_pairs(pairs: DataFrame, a: str, b: str, name: str = "alignment", **scoring) -> DataFrame:
    """Pairs with their alignment identity."""
    return pairs.withColumn(name, alignment_identity(**scoring)(F.col(a), F.col(b)))


def register(spark, name: str = "alignment_identity", **scoring) -> Column:
    """Make the function known to SQL."""
    return spark.udf.register(name, alignment_identity(**scoring))
