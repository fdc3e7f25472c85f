"""Centroid clustering of vectors by weighted deduplication.

Vectors are quantised to whole numbers, identical ones become one with a multiplicity, Lloyd's rounds
run on the different vectors with weighted sums of whole numbers (exact, so the order of tasks
doesn't matter), and the assignments are joined back to the rows. A round scans the stored
different vectors once; each task gives one partial sum for each centroid and component. To the
driver come centroids only.

Rows are joined back by vector. Vectors of more than 1/4096 of the rows, so 4,096 at most, are
broadcast; no other vector brings more than that share of the rows into a task.

Defined cases: vectors that are null, of another number of components, or with a null, NaN or
infinite component are left out; components beyond +-131,072 count as that bound, as squared
distances are 64-bit; the first centroids are the rows with the smallest hashes of their ids, null
ids last, ties by the vector; repeated rows are rows of their own; with fewer rows than centroids
there are as many centroids as rows; an empty table gives an empty result; extra columns, whatever
their names, are not read. An inertia that 64 bits don't hold is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import materialize
from .arrow import map_arrow

#: Largest quantised component: 64 squared differences of such fit in 63 bits.
BOUND = 1 << 27
#: Vectors of more than one in so many rows are broadcast when rows are joined back.
HOT_SHARE = 4096

_CENTROIDS = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("centroid", T.ArrayType(T.LongType()))])
_ASSIGNED = T.StructType(
    [T.StructField("q", T.ArrayType(T.IntegerType())), T.StructField("n", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
)
_SUMS = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("component", T.IntegerType()), T.StructField("total", T.DecimalType(38, 0))])


def quantise(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, q) of the vectors that have ``dims`` finite components; q = floor(scale * x)."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(float(-BOUND))), F.lit(float(BOUND)))).cast("int"))
    return vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == dims) & finite).select(F.col(id_col).alias("id"), whole.alias("q"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("q")
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (ties: the smaller) and the squared distance."""
    squared = np.stack([np.square(x - c).sum(axis=1) for c in centroids], axis=1)
    best = squared.argmin(axis=1)
    return best, squared[np.arange(len(x)), best]


def _weighted_sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Rows and component sums of each non-empty cluster; a row for each cluster and component is collected."""

    def sums(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            x, w = _matrix(batch), batch.column("n").to_numpy()
            best, _ = nearest_centroid(x, centroids)
            for c in np.unique(best).tolist():
                mine, weight = x[best == c], w[best == c]
                low, high = (weight & 0xFFFFF) @ mine, (weight >> 20) @ mine  # neither overflows in a batch
                for i, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
                    total[c, i] = total.get((c, i), 0) + a + (b << 20)
                total[c, -1] = total.get((c, -1), 0) + int(weight.sum())
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in keys], pa.int32()), pa.array([i for _, i in keys], pa.int32()), pa.array([Decimal(total[k]) for k in keys], pa.decimal128(38, 0))], schema=schema
            )

    rows = map_arrow(distinct, sums, _SUMS).groupBy("cluster", "component").agg(F.sum("total").cast("string").alias("total")).collect()
    found: dict[int, dict[int, int]] = {}
    for r in rows:
        found.setdefault(r["cluster"], {})[r["component"]] = int(r["total"])
    return {c: (v[-1], [v[i] for i in range(len(v) - 1)]) for c, v in found.items()}


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """Assignments (id column, cluster, distance) of all vectors kept, and the centroids (cluster, centroid, cluster_inertia, inertia), a row each.

    The first centroids are the vectors with the smallest hexadecimal SHA-256 of ``<seed>:<id>``.
    Rounds end early once no centroid changes, as further ones would change nothing.
    """
    if dims > 64:
        raise ValueError("squared distances of more than 64 components may not fit in 64 bits")
    spark = vectors.sparkSession
    kept = quantise(vectors, id_col, vector_col, dims, scale)
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
    if not first:
        nothing = spark.createDataFrame([], _CENTROIDS)
        inertia = F.lit(None).cast("long")
        return kept.where(F.lit(False)).select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), inertia.alias("distance")), nothing.select("*", inertia.alias("cluster_inertia"), inertia.alias("inertia"))
    centroids = np.array([r["q"] for r in first], np.int64)
    distinct = materialize(kept.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "vectors")
    total = distinct.agg(F.sum("n")).first()[0]
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (n, sums) in _weighted_sums(distinct, centroids).items():
            moved[c] = [s // n for s in sums]
        if (moved == centroids).all():
            break
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                best, distance = nearest_centroid(_matrix(batch), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("n"), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], schema=schema)

    assigned = materialize(map_arrow(distinct, assign, _ASSIGNED), "assigned")
    inertia = F.sum(F.col("n").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)"))
    by_cluster = assigned.groupBy("cluster").agg(inertia.cast("string").alias("s")).collect()  # a row for each cluster
    held = {r["cluster"]: int(r["s"]) for r in by_cluster}
    fits = lambda n: n if n < 1 << 63 else None
    schema = T.StructType([*_CENTROIDS, T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType())])
    rows = [(c, centroids[c].tolist(), fits(held.get(c, 0)), fits(sum(held.values()))) for c in range(len(centroids))]

    often = F.col("n") > max(1, total // HOT_SHARE)
    hot = F.broadcast(assigned.where(often).drop("n"))
    joined = kept.join(hot, "q").unionByName(kept.join(hot, "q", "left_anti").join(assigned.where(~often).drop("n"), "q"))
    return joined.select(F.col("id").alias(id_col), "cluster", "distance"), spark.createDataFrame(rows, schema)
