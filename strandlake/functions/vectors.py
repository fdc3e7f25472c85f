"""Vector expressions over arrays of numbers: metrics, relation operators, comparators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Products summed in order, as doubles."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalise(a: Column) -> Column:
    """Unit vector; the zero vector stays."""
    length = norm(a)
    return F.when(length > 0, F.transform(doubles(a), lambda x: x / F.when(length > 0, length))).otherwise(doubles(a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 with a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def apply_operator(name: str, rhs: Column, params: Column, shift: Column | None = None) -> Column:
    """A relation's operator applied to the right-hand vector.

    translation: v + p; diagonal: v * p; complex_diagonal: halves are real and imaginary parts;
    linear: matrix (rows in ``params``) times v; affine: the same plus ``shift``.
    """
    v = doubles(rhs)
    if name == "translation":
        return F.zip_with(v, doubles(params), lambda x, p: x + p)
    if name == "diagonal":
        return F.zip_with(v, doubles(params), lambda x, p: x * p)
    if name == "complex_diagonal":
        half = (F.size(v) / 2).cast("int")
        re, im = F.slice(v, F.lit(1), half), F.slice(v, half + 1, half)
        p = doubles(params)
        pre, pim = F.slice(p, F.lit(1), half), F.slice(p, half + 1, half)
        product = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
        real = F.zip_with(product(re, pre), product(im, pim), lambda x, y: x - y)
        return F.concat(real, F.zip_with(product(re, pim), product(im, pre), lambda x, y: x + y))
    if name in ("linear", "affine"):
        out = F.transform(params, lambda row: dot(row, v))
        return out if name == "linear" else F.zip_with(out, doubles(shift), lambda x, p: x + p)
    raise ValueError(f"no such operator: {name}")


def compare(name: str, lhs: Column, rhs: Column) -> Column:
    """Score of two vectors, higher for closer ones."""
    if name == "dot":
        return dot(lhs, rhs)
    if name == "cos":
        return cosine(lhs, rhs)
    if name == "l2":
        return -F.sqrt(squared_distance(lhs, rhs))
    if name == "squared_l2":
        return -squared_distance(lhs, rhs)
    raise ValueError(f"no such comparator: {name}")


def ranking_loss(positive: Column, negative: Column, margin: float = 0.1) -> Column:
    return F.greatest(F.lit(0.0), F.lit(margin) - positive + negative)


def masked_mean(tokens: Column, first: int = 1, last: int = 1) -> Column:
    """Element-wise mean of token vectors without the first and last ones (begin and end marks)."""
    inner = F.slice(tokens, F.lit(first + 1), F.greatest(F.size(tokens) - first - last, F.lit(0)))
    n = F.size(inner)
    width = F.size(F.element_at(inner, 1))
    total = F.aggregate(inner, F.array_repeat(F.lit(0.0), width), lambda s, v: F.zip_with(s, v.cast("array<double>"), lambda x, y: x + y))
    return F.when(n > 0, F.transform(total, lambda x: x / F.when(n > 0, n)))
