"""Quality rules: a decision list learned by sequential covering.

One Arrow pass over whole texts counts the statistics of each document. Rules are conjunctions of
thresholds on ratios of these. Each rule is grown condition by condition for the best information
gain on two thirds of the labelled rows, pruned back on the last third, and kept only while it is
precise there; what it covers is taken away before the next rule. The list is emitted as one
ordered Spark conditional expression, so judging stays in the JVM.

The rules are fitted on at most ``FIT_ROWS`` labelled documents, those with the smallest hashes of
their ids; all statistics and verdicts cover every document.

Defined cases: a null or empty text has no words and fails the base check; without labelled rows
of both kinds there are no rules and only the base check rejects; repeated documents are judged
each; of several labels of one document the lowest counts; a null label or id is no label; very long
texts are counted whole; an empty table gives an empty result; columns named like a result column
give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_arrow, plus
from .kernel import BYTE_VALUE, NON_SPACE, mix, shingles, slices, span_hashes, text_bytes, with_columns, word_bounds

FIT_ROWS = 5000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_twins")

#: Ratios that rules may test, as expressions over the counts.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "twin_share": ("n_twins", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_MARK = np.isin(np.arange(256), list(b"!?;:()[]{}=+~^_@\\/\"'`-"))
_UPPER = np.isin(np.arange(256), range(65, 91))
_DIGIT = np.isin(np.arange(256), range(48, 58))
_WORD_CHAR = NON_SPACE & ((np.arange(256) < 128) | (np.arange(256) >= 192))


def _again(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the values by (document, hash) up to mixing, and where one equals the one before it."""
    keyed = mix(hashes ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(keyed, kind="stable")
    keyed = keyed[order]
    same = np.zeros(len(keyed), bool)
    same[1:] = keyed[1:] == keyed[:-1]
    return order, same


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a slice."""
    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets, NON_SPACE)
    words = span_hashes(data, starts, ends, BYTE_VALUE)
    doc = np.repeat(np.arange(n), np.diff(first))

    def per_text(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    h, at = shingles(words, first, 3, whole_short=False)
    n_windows = np.diff(at)
    place = np.repeat(first[:-1] - at[:-1], n_windows) + np.arange(len(h))
    order, same = _again(h, np.repeat(np.arange(n), n_windows))
    same[:-1] |= same[1:]
    found = place[order[same]]
    covered = np.zeros(len(words) + 2, bool)
    for i in range(3):
        covered[found + i] = True

    cut = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets]))
    begin, stop = cut[:-1], cut[1:]
    stop = stop - (data[stop - 1] == 10) if len(stop) else stop
    full = np.searchsorted(starts, begin) < np.searchsorted(starts, stop)
    begin, stop = begin[full], stop[full]
    line_doc = np.searchsorted(offsets, begin, side="right") - 1
    order, again = _again(span_hashes(data, begin, stop, BYTE_VALUE), line_doc)
    twins = np.zeros(len(words), bool)
    twins[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    return {
        "n_words": np.diff(first),
        "word_chars": per_text(_WORD_CHAR),
        "n_symbols": per_text(_SYMBOL),
        "n_dup_lines": np.bincount(line_doc[order[again]], minlength=n),
        "n_repeat_words": np.bincount(doc[covered[: len(words)]], minlength=n),
        "n_lines": np.bincount(line_doc, minlength=n),
        "n_upper": per_text(_UPPER),
        "n_marks": per_text(_MARK),
        "n_digits": per_text(_DIGIT),
        "n_twins": np.bincount(doc[twins], minlength=n),
    }


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns ``COUNTS``."""

    def count(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                found = text_counts(*text_bytes(part.column(text_col)))
                yield with_columns(part, {k: pa.array(v.astype(np.int64)) for k, v in found.items()}, schema)

    return map_arrow(docs, count, plus(docs.schema, *[T.StructField(c, T.LongType()) for c in COUNTS]))


def feature(name: str) -> Column:
    """A ratio; 0 where its divisor is 0."""
    over, under = FEATURES[name]
    return F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return feature(self.feature) > self.threshold if self.above else feature(self.feature) <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Documents that meet all conditions are rejected; precision is as measured on rows held back while it grew."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out &= c.column()
        return out


def _meets(x: np.ndarray, names: list[str], conditions: list[Condition]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for c in conditions:
        v = x[:, names.index(c.feature)]
        ok &= v > c.threshold if c.above else v <= c.threshold
    return ok


def _best_condition(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: int) -> tuple[float, Condition | None]:
    """The condition of the highest FOIL gain over the rows."""
    p, n = bad.sum(), (~bad).sum()
    base = np.log2(p / (p + n))
    best, chosen = 0.0, None
    for j, name in enumerate(names):
        values = np.unique(x[:, j])
        if len(values) < 2:
            continue
        mids = (values[1:] + values[:-1]) / 2
        if len(mids) > cuts:
            mids = mids[np.linspace(0, len(mids) - 1, cuts).astype(int)]
        order = np.argsort(x[:, j], kind="stable")
        below = np.searchsorted(x[order, j], mids, side="right")
        bads = np.concatenate([[0], np.cumsum(bad[order])])
        for above, pos, all_ in ((False, bads[below], below), (True, p - bads[below], len(x) - below)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(pos / np.maximum(all_, 1)) - base), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > best + 1e-9:
                best, chosen = float(gain[i]), Condition(name, above, float(mids[i]))
    return best, chosen


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], min_precision: float = 0.95, max_rules: int = 16, max_conditions: int = 4, min_covered: int = 3, cuts: int = 256) -> list[Rule]:
    """Sequential covering; ``x`` has a row for each labelled document, ``bad`` marks those to reject."""
    bad = bad.astype(bool)
    fold = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    rules: list[Rule] = []
    while len(rules) < max_rules and bad[left & ~fold].any() and (~bad[left & ~fold]).any():
        grow, prune = left & ~fold, left & fold
        conditions: list[Condition] = []
        now = grow.copy()
        while len(conditions) < max_conditions and bad[now].any() and (~bad[now]).any():
            _, c = _best_condition(x[now], bad[now], names, cuts)
            if c is None:
                break
            conditions.append(c)
            now &= _meets(x, names, [c])
        if not conditions:
            break

        def judged(k: int, conditions=conditions, prune=prune) -> tuple[float, float]:
            """Precision and worth of the first k conditions on the rows held back."""
            m = _meets(x, names, conditions[:k]) & prune
            p, n = int((m & bad).sum()), int((m & ~bad).sum())
            return (p / (p + n), (p - n) / (p + n)) if p + n else (0.0, -1.0)

        good = [k for k in range(1, len(conditions) + 1) if judged(k)[0] >= min_precision]
        keep = max(good, key=lambda k: (judged(k)[1], -k), default=len(conditions))
        conditions = conditions[:keep]
        m = _meets(x, names, conditions)
        all_ = m & left
        precision = judged(keep)[0]
        if not good or (all_ & bad).sum() / all_.sum() < min_precision or (all_ & bad).sum() < min_covered:
            left &= ~(m & bad & ~fold)  # no rule; go on with the rest
            if not (m & bad & grow).any():
                break
            max_rules -= 1
            continue
        rules.append(Rule(tuple(conditions), precision, int(all_.sum())))
        left &= ~m
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Rules for label 0, fitted on at most ``fit_rows`` labelled documents that pass the base check."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    some = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")  # at most fit_rows small rows
    names = list(FEATURES)
    got = with_counts(rows, "text").where(~base_failed()).select("id", "label", *[feature(f).alias(f) for f in names]).orderBy(F.xxhash64("id"), "id", *names).limit(fit_rows).toPandas()
    return learn_rules(got[names].to_numpy(float).reshape(len(got), len(names)), (got["label"] == 0).to_numpy(), names)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The decision list: the first rule that fits rejects; none: kept."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), False)
    for r in rules[1:]:
        out = out.when(r.column(), False)
    return out.otherwise(True)


def judge_quality(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``."""
    return with_counts(docs, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
