"""A stored vector index: inverted cells with product-quantised codes, written once and searched by later jobs.

``build`` fits centres of cells and codebooks on a bounded sample, gives every vector its nearest cell
and one byte for each subspace of what is left of it, and writes

    settings/   one row: metric, dimensions, subspaces
    cells/      cell, centre, rows
    codebooks/  subspace, centres
    rows/       cell, id, code, v, in ranges of cells, so that a search reads the cells that it needs

``search`` gives each query its nearest cells, scores their rows by tables of distances between the
query and the codes, in blocks, and scores the best ones again by the vectors themselves. Cells
and queries meet in blocks of bounded size, so neither a large cell nor a popular one is one task.

Defined cases: null and empty vectors aren't indexed and find nothing; vectors of other dimensions
than the first raise an error; equal vectors are rows of their own; ids are different whole
numbers; an empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import compare
from .simjoin import _centres, _unit

#: Rows that centres and codebooks are fitted on at most.
FIT_ROWS = 20_000
#: Numbers in the centres of all cells at most (32 MB); what tasks hold of the index beside their block.
CENTRE_NUMBERS = 1 << 23
#: Rows of a cell, and queries, in a block.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 512
#: Distances to centres, and of a block's queries to its rows, that a task holds at once.
DISTANCES = 1 << 20


def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.size("v") > 0)


def _stack(column: pa.Array, dims: int) -> np.ndarray:
    if len(column) and set(column.value_lengths().unique().to_pylist()) != {dims}:
        raise ValueError(f"vectors of {dims} numbers are expected")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _nearest(m: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, by pieces of ``DISTANCES`` distances."""
    square, found = (centres * centres).sum(1)[None], np.zeros((len(m), min(n, len(centres))), np.int64)
    step = max(1, DISTANCES // len(centres))
    for at in range(0, len(m), step):
        far = square - 2 * m[at : at + step] @ centres.T
        found[at : at + step] = far.argmin(1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]
    return found


def build(vectors: DataFrame, id_col: str, vector_col: str, path: str, metric: str = "cos", cells: int | None = None, subspaces: int = 16, seed: int = 42) -> None:
    """Write an index below ``path``. ``metric`` is cos or l2; there are 4 sqrt(n) cells if not said otherwise; ``subspaces`` is cut down to divide the dimensions."""
    if metric not in ("cos", "l2"):
        raise ValueError(f"no index for the metric {metric}")
    spark = vectors.sparkSession
    rows = _rows(vectors, id_col, vector_col)
    n = rows.count()
    sample = rows.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "id")), "id").limit(FIT_ROWS).select("v").toPandas()
    dims = len(sample["v"][0]) if n else 1
    m = _unit(_stack(pa.array(sample["v"]), dims), metric) if n else np.zeros((1, 1))
    subspaces = next(s for s in range(min(subspaces, dims), 0, -1) if dims % s == 0)
    n_cells = max(1, min(int(4 * n**0.5) if cells is None else cells, CENTRE_NUMBERS // dims, len(m) // 8 or 1))
    centres = _centres(m, n_cells, "l2")
    rest = m - centres[_nearest(m, centres, 1)[:, 0]]
    books = np.stack([_centres(part, min(256, len(part)), "l2") for part in np.split(rest, subspaces, axis=1)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(_stack(batch.column("v"), dims), metric)
                cell = _nearest(x, centres, 1)[:, 0]
                left = np.split(x - centres[cell], subspaces, axis=1)
                code = np.stack([_nearest(part, book, 1)[:, 0] for part, book in zip(left, books, strict=True)], axis=1).astype(np.uint8)
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("id"), codes, batch.column("v").cast(pa.list_(pa.float32()))], names=["cell", "id", "code", "v"])

    placed = rows.mapInArrow(place, "cell int, id long, code binary, v array<float>")
    placed.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    made = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    made.join(stored, "cell", "left").na.fill(0, ["rows"]).write.mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(i, b.ravel().tolist()) for i, b in enumerate(books)], "subspace int, centres array<double>").write.mode("overwrite").parquet(f"{path}/codebooks")
    spark.createDataFrame([(metric, dims, subspaces)], "metric string, dims int, subspaces int").write.mode("overwrite").parquet(f"{path}/settings")


def _probes(spark: SparkSession, path: str, queries: DataFrame, probes: int) -> tuple[DataFrame, dict]:
    """(id, v, cell) of the cells that each query asks, and what the index is made of."""
    settings = spark.read.parquet(f"{path}/settings").first().asDict()
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # CENTRE_NUMBERS at most
    dims, metric = settings["dims"], settings["metric"]
    centres = np.array([r["centre"] for r in cells])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _nearest(_unit(_stack(batch.column("v"), dims), metric), centres, probes).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(list(near), pa.list_(pa.int32()))], names=["id", "v", "cells"])

    asked = queries.mapInArrow(ask, "id long, v array<double>, cells array<int>")
    return asked.select("id", "v", F.explode("cells").alias("cell")), settings | {"centres": centres}


def search(queries: DataFrame, id_col: str, vector_col: str, path: str, k: int = 10, probes: int = 8, rescore: int = 10) -> DataFrame:
    """About the k nearest indexed rows (src, dst, rank, score) of every query, itself left out; scores are exact.

    ``probes`` cells are searched for each query, and ``rescore * k`` rows scored by their vectors.
    """
    spark = queries.sparkSession
    rows = _rows(queries, id_col, vector_col)
    asked, index = _probes(spark, path, rows, probes)
    metric, dims, subspaces, centres = index["metric"], index["dims"], index["subspaces"], index["centres"]
    books = [np.array(r["centres"]).reshape(-1, dims // subspaces) for r in spark.read.parquet(f"{path}/codebooks").orderBy("subspace").collect()]  # 256 centres each
    take = k * rescore

    sizes = spark.read.parquet(f"{path}/cells").select("cell", F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.lit(1)).cast("int").alias("blocks"))
    stored = spark.read.parquet(f"{path}/rows")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    held = stored.select("cell", "id", "code").join(F.broadcast(sizes), "cell").groupBy("cell", block.alias("block")).agg(F.collect_list("id").alias("ids"), F.collect_list("code").alias("codes"))  # about BLOCK_ROWS rows
    n_queries = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("parts"))
    put = asked.join(n_queries, "cell").groupBy("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).agg(F.collect_list("id").alias("q_ids"), F.flatten(F.collect_list("v")).alias("q"))  # about BLOCK_QUERIES
    put = put.join(F.broadcast(sizes), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, ids = (batch.column(c)[i].values.to_numpy() for c in ("q_ids", "ids"))
                q = _unit(batch.column("q")[i].values.to_numpy().reshape(len(q_ids), dims), metric)
                codes = np.frombuffer(b"".join(batch.column("codes")[i].as_py()), np.uint8).reshape(len(ids), subspaces)
                left = np.split(q - centres[batch.column("cell")[i].as_py()], subspaces, axis=1)
                n, step = min(take, len(ids)), max(1, DISTANCES // len(ids))
                for at in range(0, len(q_ids), step):
                    asks = q_ids[at : at + step]
                    far = np.zeros((len(asks), len(ids)))
                    for part, book, code in zip((p[at : at + step] for p in left), books, codes.T, strict=True):
                        far += ((book * book).sum(1)[None] - 2 * part @ book.T + (part * part).sum(1)[:, None])[:, code]
                    far[asks[:, None] == ids[None]] = np.inf
                    top = np.argpartition(far, n - 1, axis=1)[:, :n]
                    src, dst, rough = np.repeat(asks, n), ids[top.ravel()], np.take_along_axis(far, top, 1).ravel()
                    ok = src != dst
                    cell = np.full(ok.sum(), batch.column("cell")[i].as_py(), np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(src[ok]), pa.array(dst[ok]), pa.array(cell), pa.array(rough[ok])], names=["src", "dst", "cell", "rough"])

    near = put.join(held, ["cell", "block"]).select("cell", "q_ids", "q", "ids", "codes").mapInArrow(score, "src long, dst long, cell int, rough double")
    rough = F.row_number().over(Window.partitionBy("src").orderBy("rough", "dst"))
    kept = near.withColumn("_r", rough).where(F.col("_r") <= take).select("src", "dst", "cell")
    found = kept.join(stored.select("cell", F.col("id").alias("dst"), F.col("v").cast("array<double>").alias("y")), ["cell", "dst"]).join(rows.select(F.col("id").alias("src"), F.col("v").alias("x")), "src")
    exact = found.select("src", "dst", compare(metric, F.col("x"), F.col("y")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k)


def scored_share(queries: DataFrame, id_col: str, vector_col: str, path: str, probes: int = 8) -> DataFrame:
    """One row: of all pairs of a query and an indexed row, the ``share`` that a search scores by codes."""
    spark = queries.sparkSession
    rows = _rows(queries, id_col, vector_col)
    asked, _ = _probes(spark, path, rows, probes)
    sizes = spark.read.parquet(f"{path}/cells").select("cell", "rows")
    total = sizes.agg(F.sum("rows").alias("total"))
    met = asked.join(F.broadcast(sizes), "cell").agg(F.sum("rows").alias("met"), F.count_distinct("id").alias("queries"))
    return met.join(F.broadcast(total)).select((F.col("met") / (F.col("queries") * F.col("total"))).alias("share"))  # one row each
