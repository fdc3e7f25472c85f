"""Sinks: delimited text, JSON and text reports, arrays, routed classes and resumable appends."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import without_known
from ..store import qualified

#: Rows of a text report at most.
REPORT_ROWS = 10_000


def write_csv(df: DataFrame, path: str, index: str | None = None, header: bool = True, sep: str = ",", mode: str = "errorifexists") -> None:
    """Delimited text; ``index`` names an ordinal column to put first, without a name."""
    if index:
        df = df.select(F.col(index).alias(""), *[c for c in df.columns if c != index])
    df.write.mode(mode).option("header", header).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def write_triples(df: DataFrame, path: str) -> None:
    """Headerless tab-separated (src, rel, dst)."""
    write_csv(df.select("src", "rel", "dst"), path, header=False, sep="\t")


def write_by_kind(df: DataFrame, path: str, kind: str = "kind") -> None:
    """One folder of files for each class; classes are few, so rows are dealt out by class and a salt."""
    df.write.partitionBy(kind).option("header", True).csv(path)


def write_json_report(df: DataFrame, path: str, groups: Sequence[str], name: str = "results") -> None:
    """One JSON object for each group, with its rows as a list."""
    rest = [c for c in df.columns if c not in groups]
    lists = df.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
    lists.select(F.to_json(F.struct(*groups, name)).alias("value")).write.text(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Append rows whose keys the Parquet table doesn't have yet; a rerun after a failure adds what is missing. Returns the number of rows before."""
    spark = df.sparkSession
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)
    before = 0
    if exists:
        done = spark.read.parquet(path)
        before = done.count()
        df = without_known(df, done, keys)
    df.write.mode("append").parquet(path)
    return before


def split_bad(df: DataFrame, good: str, path: str, bad_path: str) -> None:
    """Rows with a status column: the good ones and, without losing any, the others."""
    df.where(F.col(good)).drop(good).write.parquet(path)
    df.where(~F.coalesce(F.col(good), F.lit(False))).drop(good).write.parquet(bad_path)


def fixed_decimals(column: str, digits: int = 6):
    """A number as text with fixed decimals."""
    return F.format_string(f"%.{digits}f", F.col(column))


def report(df: DataFrame, title: str = "") -> str:
    """A small aggregate as text: a row as lines ``name: value``, several rows as lines of the first column and the others."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a text report has {REPORT_ROWS} rows at most: write a table")
    if len(rows) == 1:
        lines = [f"{k}: {v}" for k, v in rows[0].asDict().items()]
    else:
        lines = [f"{r[0]}: {', '.join(map(str, r[1:]))}" for r in rows]
    return "\n".join([*([title] if title else []), *lines]) + "\n"


def write_arrays(df: DataFrame, columns: Sequence[str], uri: str, name: str = "part") -> DataFrame:
    """Each partition as ``<name>-<number>.npz``, compressed, with an array for each column; arrays of numbers become matrices, so their lengths must agree.

    Returns (file, rows) of what was written, after reading each file back. A task that runs again
    writes the same file. ``uri`` is a folder that pyarrow's file systems open, of Hadoop's default file system where it names none; a partition's columns
    are held in memory.
    """
    schema, uri = df.select(*columns).schema, qualified(df.sparkSession, uri)
    wide = {f.name for f in schema if f.dataType.typeName() == "array"}

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        got = [p for p in parts if len(p)]
        if not got:
            return
        rows = pd.concat(got)
        arrays = {c: np.stack(rows[c].to_list()) if c in wide else rows[c].to_numpy() for c in columns}
        arrays = {c: a.astype(str) if a.dtype == object else a for c, a in arrays.items()}
        held = io.BytesIO()
        np.savez_compressed(held, **arrays)
        files, folder = fs.FileSystem.from_uri(uri)
        files.create_dir(folder, recursive=True)
        path = f"{folder.rstrip('/')}/{name}-{TaskContext.get().partitionId():05d}.npz"
        with files.open_output_stream(path) as out:
            out.write(held.getvalue())
        with files.open_input_file(path) as back, np.load(io.BytesIO(back.read())) as stored:
            if any(stored[c].shape != a.shape or stored[c].dtype != a.dtype for c, a in arrays.items()):
                raise OSError(f"{path} isn't what was written")
        yield pd.DataFrame({"file": [path], "rows": [len(rows)]})

    return df.select(*columns).mapInPandas(write, "file string, rows long")
