"""Array files as a data source."""

from __future__ import annotations

import json

import numpy as np
import pytest

from strandlake.sources import arrays, files


def found(df):
    return sorted(((r["key"], r["idx"], r["values"], r["text"]) for r in df.collect()), key=str)


def test_matrices_are_read_in_ranges(spark, tmp_path):
    m = np.random.default_rng(0).normal(size=(1000, 7))
    np.save(tmp_path / "m.npy", m.astype(np.float32))
    df = arrays.read_arrays(spark, str(tmp_path / "m.npy"), task_bytes=4000)
    assert df.rdd.getNumPartitions() > 5
    got = {r["idx"]: r["values"] for r in df.collect()}
    assert np.array_equal(np.array([got[i] for i in range(1000)], np.float32), m.astype(np.float32))
    assert {tuple(r["shape"]) for r in df.select("shape").distinct().collect()} == {(1000, 7)}


@pytest.mark.parametrize("compressed", [False, True])
def test_archives_shapes_and_orders(spark, tmp_path, compressed):
    held = {
        "columns": np.asfortranarray(np.arange(12.0).reshape(4, 3)),
        "cube": np.arange(24, dtype=np.int16).reshape(2, 3, 4),
        "vector": np.arange(5, dtype=">f8"),
        "scalar": np.array(3.5),
        "names": np.array(["a", "é", ""]),
        "bytes": np.array([b"x", b"yz"]),
        "none": np.zeros((0, 3)),
        "flags": np.array([[True, False]]),
    }
    (np.savez_compressed if compressed else np.savez)(tmp_path / "a.npz", **held)
    got = found(arrays.read_arrays(spark, str(tmp_path / "*.npz"), task_bytes=16))
    want = [(k, i, row.ravel().astype(float).tolist(), None) for k in ("columns", "cube", "flags") for i, row in enumerate(held[k])]
    want += [("vector", 0, [0.0, 1.0, 2.0, 3.0, 4.0], None), ("scalar", 0, [3.5], None), ("names", 0, None, "a"), ("names", 1, None, "é"), ("names", 2, None, ""), ("bytes", 0, None, "x"), ("bytes", 1, None, "yz")]
    assert got == sorted(want, key=str)


def test_a_file_of_more_than_two_gigabytes_is_many_tasks(tmp_path):
    rows, dims = 600_000, 1000
    path = tmp_path / "large.npy"
    with open(path, "wb") as file:
        np.lib.format.write_array_header_1_0(file, {"descr": "<f4", "fortran_order": False, "shape": (rows, dims)})
        offset = file.tell()
        file.truncate(offset + 4 * rows * dims)  # sparse: zeros take no disk
        file.seek(offset + 4 * dims * (rows - 1))
        file.write(np.arange(dims, dtype="<f4").tobytes())
    assert path.stat().st_size > 2 << 30
    reader = arrays.ArrayReader(str(path), arrays.TASK_BYTES)
    parts = reader.partitions()
    assert len(parts) > 60 and parts[0].start == 0 and parts[-1].stop == rows and all(a.stop == b.start for a, b in zip(parts, parts[1:]))
    batches = list(reader.read(parts[-1]))
    assert sum(b.num_rows for b in batches) == parts[-1].stop - parts[-1].start
    assert batches[-1].column("values")[-1].as_py() == list(map(float, range(dims))) and batches[-1].column("idx")[-1].as_py() == rows - 1


def test_ids_and_faults(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    np.save(tmp_path / "ids.npy", np.array(["a", "b", "c"]))
    (tmp_path / "ids.json").write_text(json.dumps(["a", "b", "c"]))
    for ids in ("ids.npy", "ids.json"):
        got = files.read_npy(spark, str(tmp_path / "v.npy"), 2, str(tmp_path / ids)).collect()
        assert {r["id"]: r["embedding"] for r in got} == {"a": [0, 1], "b": [2, 3], "c": [4, 5]}
    with pytest.raises(Exception, match="shape 3, 2"):
        files.read_npy(spark, str(tmp_path / "v.npy"), 5).collect()
    np.save(tmp_path / "o.npy", np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="objects"):
        arrays.read_arrays(spark, str(tmp_path / "o.npy")).collect()
    (tmp_path / "x.npy").write_bytes(b"no array")
    with pytest.raises(Exception, match="not an array file"):
        arrays.read_arrays(spark, str(tmp_path / "x.npy")).collect()
    (tmp_path / "empty").mkdir()
    assert arrays.read_arrays(spark, str(tmp_path / "empty")).count() == 0


def test_vectors_by_priority_of_keys(spark, tmp_path):
    v = lambda x, n=3: np.full(n, float(x))
    np.savez(tmp_path / "a.npz", **{"model/rhs/translation": v(1), "model/rhs/diagonal": v(2), "model/bias": v(3), "model/wide": v(4, 9)})
    np.savez(tmp_path / "b.npz", **{"z": v(5), "model/other": v(6), "matrix": np.zeros((3, 3))})
    np.savez(tmp_path / "c.npz", wide=v(7, 9))
    rows = arrays.read_arrays(spark, str(tmp_path))
    got = {r["file"][-5:]: (r["key"], r["values"][0]) for r in arrays.find_vector(rows, ["diagonal", "translation"], 3).collect()}
    assert got == {"a.npz": ("model/rhs/diagonal", 2.0), "b.npz": ("model/other", 6.0)}
    got = {r["file"][-5:]: r["key"] for r in arrays.find_vector(rows, ["z", "bias"], 3).collect()}
    assert got == {"a.npz": "model/bias", "b.npz": "z"}
