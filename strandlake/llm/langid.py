"""Language identification by error-correcting output codes.

Each language has a codeword; each bit has a binary classifier (logistic regression on letter
bigrams and hashed trigrams) that separates the languages with a 1 there from those with a 0. The
language whose codeword has the least loss, each bit's loss weighted by how well its classifier
did in fitting, is chosen; a close second flags the document as ambiguous. Texts are judged whole
in one Arrow pass with a fixed-size model.

The model is fitted on at most ``FIT_DOCS`` labelled documents (one for each language at least), an
equal share for each language: those with the smallest hashes of id and text. Every language that
the labels name is learned.

Defined cases: a null or empty text, or one without letters, is ``und`` with score 0; null languages
teach nothing; with no labelled text, as in an empty table, everything is ``und``; of equal losses the
first language in order wins; repeated rows are judged each; very long texts are judged whole;
columns named like a result column give way to it, others are kept.
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
from .kernel import slices, text_bytes, with_columns

FIT_DOCS = 2400
BUCKETS = 4096
UNKNOWN = "und"
#: Rows of histograms held at once.
_ROWS = 256

#: A byte's class: 0 for what is no letter, 1-26 for a-z, the rest for non-ASCII bytes.
_CLASS = np.array([27 + (b - 128) % 37 if b >= 128 else (b | 32) - 96 if chr(b).isalpha() else 0 for b in range(256)], np.int32)
_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit vectors of root counts: bigrams exactly, then trigrams by hash; a row for each text."""
    n = len(offsets) - 1
    framed = np.insert(data, offsets[:-1], 32)  # every text begins with a border
    doc_start = offsets[:-1] + np.arange(n)
    c = _CLASS[framed]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    keep[doc_start] = True
    start = np.cumsum(keep)[doc_start] - 1
    c = c[keep]
    doc = np.repeat(np.arange(n), np.diff(np.append(start, len(c)))).astype(np.int64)
    c = np.append(c, [0, 0])
    two = c[:-2] * 64 + c[1:-1]
    three = ((two.astype(np.int64) * 64 + c[2:]) * 0x9E3779B1 >> 8) % BUCKETS
    inside = np.ones(len(doc), bool)
    inside[np.append(start[1:], len(doc)) - 1] = False  # its trigram would reach into the next text
    counts = np.concatenate(
        [np.bincount(doc * BUCKETS + two, minlength=n * BUCKETS).reshape(n, BUCKETS), np.bincount(doc[inside] * BUCKETS + three[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)],
        axis=1,
    )
    x = np.sqrt(counts, dtype=np.float32)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-9)[:, None]


def has_letters(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data], dtype=np.int64)])
    found = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(ch.isalpha() for ch in texts[int(i)].as_py() or "")
    return found


def code_matrix(n: int) -> np.ndarray:
    """Codewords (+1, -1) of n languages: all splits up to 6 languages, beyond that the random code of the largest least distance."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.maximum(np.arange(n) - 1, 0)[:, None]) & (np.arange(n) > 0)[:, None], 1, -1).astype(np.int8)
    bits = 10 * int(np.ceil(np.log2(n)))
    best, kept = -1, None
    for seed in range(30):
        m = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, bits))
        m = m[:, np.abs(m.sum(axis=0)) < n]
        apart = (m.shape[1] - m.astype(np.int32) @ m.T.astype(np.int32)) // 2 + 10 * bits * np.eye(n, dtype=np.int32)
        if apart.min() > best:
            best, kept = int(apart.min()), m
    return kept


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted mean loss of each language's codeword, a row for each text."""
        f = x @ self.weights + self.bias
        gap = np.logaddexp(0.0, -f[:, None, :] * self.code[None].astype(np.float32))
        return (gap * self.trust).sum(axis=2) / self.trust.sum()

    def decide(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language, score and whether a second one is close."""
        loss = self.losses(x)
        best = np.argmin(loss, axis=1)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * self.code.shape[1])
        score = 1.0 / p.sum(axis=1)
        if loss.shape[1] < 2:
            return best, score, np.zeros(len(best), bool)
        two = np.partition(loss, 1, axis=1)
        return best, score, two[:, 1] - two[:, 0] < margin


def train(x: np.ndarray, lang: np.ndarray, langs: list[str], steps: int = 150, l2: float = 1e-5) -> LanguageModel:
    """All bits' logistic regressions at once, by accelerated gradient steps; languages weigh alike."""
    code = code_matrix(len(langs))
    y = code[lang].astype(np.float32)
    share = (1.0 / np.maximum(np.bincount(lang, minlength=len(langs)), 1))[lang].astype(np.float32)
    share /= share.sum()
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb = w.copy(), b.copy()
    for t in range(steps):
        g = -y / (1.0 + np.exp(np.clip(y * (x @ vw + vb), -30, 30))) * share[:, None]
        nw, nb = vw - 4.0 * (x.T @ g + l2 * vw), vb - 4.0 * g.sum(axis=0)
        k = t / (t + 3.0)
        vw, vb, w, b = nw + k * (nw - w), nb + k * (nb - b), nw, nb
    right = (((x @ w + b) * y > 0) * share[:, None]).sum(axis=0)
    return LanguageModel(langs, code, w, b, np.maximum(right - 0.5, 0.01).astype(np.float32))


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None, fit_docs: int = FIT_DOCS, id_col: str = "doc_id") -> LanguageModel | None:
    """A model from labelled documents; ``where`` says which may teach."""
    rows = docs if where is None else docs.where(where)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return None
    langs = sorted(counts)
    each = max(1, fit_docs // len(langs))
    spark = docs.sparkSession
    part = spark.createDataFrame([(k, min(1.0, 1.5 * each / counts[k] + 20 / counts[k])) for k in langs], "lang string, part double")
    u = (F.shiftrightunsigned(F.xxhash64("id", "text"), 11)).cast("double") / float(1 << 53)
    chosen = rows.withColumn("u", u).drop("id").join(F.broadcast(part), "lang").where(F.col("u") < F.col("part"))  # a row for each language

    def extract(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                for piece in slices(batch.slice(a, _ROWS), "text"):
                    x = features(*text_bytes(piece.column("text")))
                    at = [np.flatnonzero(r) for r in x]
                    yield pa.RecordBatch.from_arrays([piece.column("lang"), piece.column("u"), pa.array([i.astype("<u2").tobytes() for i in at], pa.binary()), pa.array([r[i].tobytes() for r, i in zip(x, at, strict=True)], pa.binary())], schema=schema)

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("u", T.DoubleType()), T.StructField("at", T.BinaryType()), T.StructField("value", T.BinaryType())])
    mine: dict[str, list] = {k: [] for k in langs}
    for r in map_arrow(chosen, extract, schema).orderBy("u", "lang").toLocalIterator():
        if len(mine[r["lang"]]) < each:
            mine[r["lang"]].append((bytes(r["at"]), bytes(r["value"])))
    langs = [k for k in langs if mine[k]]
    x = np.zeros((sum(len(mine[k]) for k in langs), 2 * BUCKETS), np.float32)
    lang = np.repeat(np.arange(len(langs)), [len(mine[k]) for k in langs])
    for row, (at, value) in zip(x, (v for k in langs for v in mine[k]), strict=True):
        row[np.frombuffer(at, "<u2")] = np.frombuffer(value, np.float32)
    return train(x, lang, langs)


def identify_languages(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", margin: float = 0.05) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size for a number of languages

    def judge(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                for part in slices(batch.slice(a, _ROWS), text_col):
                    data, offsets = text_bytes(part.column(text_col))
                    known = has_letters(part.column(text_col), data, offsets) if model else np.zeros(part.num_rows, bool)
                    names, scores, close = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                    if known.any():
                        best, score, near = model.decide(features(data, offsets), margin)
                        names[known] = np.array(model.langs, object)[best[known]]
                        scores[known], close[known] = score[known], near[known]
                    yield with_columns(part, {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores), "ambiguous": pa.array(close)}, schema)

    return map_arrow(docs, judge, plus(docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())))
