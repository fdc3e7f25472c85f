"""Array files (.npy, .npz) as a data source: tasks read ranges of rows by their offsets.

A matrix is cut into ranges of rows of about ``TASK_BYTES``, so a file of any size is read by many
tasks, none of which holds more than a range. Paths are those that pyarrow's file systems open on
the executors (local folders, hdfs, s3, gs), with ``*`` in the last part.

A row has the file, the array's key (its name in an .npz archive, empty for .npy), its shape, the
number of the row in the array, and what the row holds: ``values`` of a matrix's row or of a whole
vector, ``text`` of an array of strings. Arrays of more dimensions are read as matrices of their
first one. Matrices stored by columns, and members that an archive has compressed, are read from
their beginning. Arrays of Python objects are refused.
"""

from __future__ import annotations

import fnmatch
import io
import struct
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that a task reads of a matrix, and rows that it hands on at once.
TASK_BYTES, BATCH_ROWS = 32 << 20, 4096
SCHEMA = "file string, key string, shape array<long>, idx long, values array<double>, text string"
_ARROW = pa.schema([("file", pa.string()), ("key", pa.string()), ("shape", pa.list_(pa.int64())), ("idx", pa.int64()), ("values", pa.list_(pa.float64())), ("text", pa.string())])


@dataclass
class Rows(InputPartition):
    """Rows start .. stop - 1 of an array."""

    uri: str
    key: str
    shape: tuple[int, ...]
    dtype: str
    by_columns: bool
    offset: int  # of the first number, in the file or the archive's member
    start: int
    stop: int


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def listed(uri: str) -> list[str]:
    """Files of a path: itself, those of a folder, or those of a pattern in its last part, sorted."""
    from pyarrow import fs

    store, path = _files(uri)
    head, _, last = path.rpartition("/")
    pattern = last if any(c in last for c in "*?[") else None
    if pattern is None and store.get_file_info(path).type != fs.FileType.Directory:
        return [uri]
    folder = head if pattern else path.rstrip("/")
    prefix = uri[: len(uri) - len(path)]
    found = [i.path for i in store.get_file_info(fs.FileSelector(folder)) if i.is_file and i.path.endswith((".npy", ".npz"))]
    return [prefix + p for p in sorted(found) if pattern is None or fnmatch.fnmatch(p.rpartition("/")[2], pattern)]


def _header(source) -> tuple[tuple[int, ...], np.dtype, bool, int]:
    """Shape, type, order and offset of an .npy stream at its beginning."""
    magic = source.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    wide = magic[6] > 1
    n = struct.unpack("<I" if wide else "<H", source.read(4 if wide else 2))[0]
    read = np.lib.format.read_array_header_2_0 if wide else np.lib.format.read_array_header_1_0
    shape, by_columns, dtype = read(io.BytesIO(struct.pack("<I" if wide else "<H", n) + source.read(n)))
    if dtype.hasobject:
        raise ValueError("arrays of objects are not read")
    return shape, dtype, by_columns, 8 + (4 if wide else 2) + n


def _cut(uri: str, key: str, source, task_bytes: int) -> list[Rows]:
    shape, dtype, by_columns, offset = _header(source)
    strings = dtype.kind in "US"
    n = (int(np.prod(shape)) if strings else shape[0] if len(shape) > 1 else 1) if 0 not in shape else 0
    width = dtype.itemsize * (1 if strings else int(np.prod(shape[1:])) if len(shape) > 1 else max(1, int(np.prod(shape))))
    step = max(1, task_bytes // max(1, width)) if not by_columns or len(shape) < 2 else max(1, n)
    return [Rows(uri, key, tuple(shape), dtype.str, by_columns and len(shape) > 1, offset, at, min(n, at + step)) for at in range(0, n, step)]


class ArrayReader(DataSourceReader):
    def __init__(self, uri: str, task_bytes: int):
        self.uri, self.task_bytes = uri, task_bytes

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for uri in listed(self.uri):
            store, path = _files(uri)
            with store.open_input_file(path) as file:
                if path.endswith(".npz"):
                    with zipfile.ZipFile(file) as archive:
                        for name in archive.namelist():
                            with archive.open(name) as member:
                                out += _cut(uri, name.removesuffix(".npy"), member, self.task_bytes)
                else:
                    out += _cut(uri, "", file, self.task_bytes)
        return out

    def read(self, part: Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file, or no row in any
            return
        store, path = _files(part.uri)
        with store.open_input_file(path) as file:
            if path.endswith(".npz"):
                with zipfile.ZipFile(file) as archive, archive.open(part.key + ".npy") as member:
                    yield from self._rows(part, member)
            else:
                yield from self._rows(part, file)

    def _rows(self, part: Rows, source) -> Iterator[pa.RecordBatch]:
        dtype, strings = np.dtype(part.dtype), np.dtype(part.dtype).kind in "US"
        if part.by_columns:
            source.seek(part.offset)
            whole = np.frombuffer(source.read(dtype.itemsize * int(np.prod(part.shape))), dtype).reshape(part.shape, order="F")
            matrix = whole.reshape(part.shape[0], -1)
            take = lambda a, b: matrix[a:b]
        else:
            width = 1 if strings else int(np.prod(part.shape[1:])) if len(part.shape) > 1 else int(np.prod(part.shape))
            source.seek(part.offset + part.start * width * dtype.itemsize)
            take = lambda a, b: np.frombuffer(source.read((b - a) * width * dtype.itemsize), dtype).reshape(b - a, width)
        for at in range(part.start, part.stop, BATCH_ROWS):
            stop = min(part.stop, at + BATCH_ROWS)
            rows, n = take(at, stop), stop - at
            if strings:
                values, text = pa.nulls(n, pa.list_(pa.float64())), pa.array([x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x) for x in rows[:, 0].tolist()], pa.string())
            else:
                flat = pa.array(np.ascontiguousarray(rows, np.float64).ravel())
                values, text = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * rows.shape[1], pa.int32()), flat), pa.nulls(n, pa.string())
            columns = [pa.array([part.uri] * n), pa.array([part.key] * n), pa.array([list(part.shape)] * n, pa.list_(pa.int64())), pa.array(np.arange(at, stop)), values, text]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


class ArrayFiles(DataSource):
    """``spark.read.format("array_files").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "array_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.options["path"], int(self.options.get("taskBytes", TASK_BYTES)))


def read_arrays(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows of array files; see the module."""
    spark.dataSource.register(ArrayFiles)
    return spark.read.format("array_files").option("taskBytes", task_bytes).load(path)


def find_vector(arrays: DataFrame, candidates: Sequence[str], dims: int) -> DataFrame:
    """One row (file, key, values) for each file: the vector of ``dims`` numbers under the first of the candidate keys that has one, else under the first key at all in order of names.

    A key fits a candidate if it is that or ends in it after a slash.
    """
    vectors = arrays.where((F.size("shape") == 1) & (F.element_at("shape", 1) == dims))
    place = F.coalesce(*[F.when((F.col("key") == c) | F.endswith("key", F.lit("/" + c)), F.lit(i)) for i, c in enumerate(candidates)], F.lit(len(candidates)))
    first = vectors.groupBy("file").agg(F.min_by(F.struct("key", "values"), F.struct(place, "key")).alias("v"))
    return first.select("file", "v.key", "v.values")
