"""Sources, sinks, lookups and streams on small files."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.plans.pipelines import Experiment, curate_interactions, entity_table, evaluate, similarity_edges
from strandlake.sources import files, requests, sinks
from strandlake.streaming import streams


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,x\n1,"a ""q"", b"\n2,\n')
    df = files.read_csv(spark, str(tmp_path / "a.csv"), files.strings("id", "x"))
    assert [tuple(r) for r in df.collect()] == [("1", 'a "q", b'), ("2", None)]
    (tmp_path / "b.txt").write_text("u;v\n1;2\n")
    assert files.read_sniffed(spark, str(tmp_path / "b.txt"), ["v"]).collect()[0]["v"] == "2"
    with pytest.raises(ValueError):
        files.read_sniffed(spark, str(tmp_path / "b.txt"), ["w"])
    (tmp_path / "c.tsv").write_text("a\tr\tb\n")
    assert tuple(files.read_tsv(spark, str(tmp_path / "c.tsv"), ["src", "rel", "dst"], header=False).first()) == ("a", "r", "b")
    (tmp_path / "d.csv").write_text(",x\n0,p\n1,q\n")
    assert [r["x"] for r in files.read_indexed_csv(spark, str(tmp_path / "d.csv"), files.strings("x")).collect()] == ["p", "q"]


def test_sdf_cif_npy_json(spark, tmp_path):
    record = "name\n\n\n  0  0\nM  END\n> <Ki (nM)>\n12\n\n> <Name>\n{}\n\n$$$$\n"
    (tmp_path / "a.sdf").write_text(record.format("x") + record.format("y").replace("> <Ki (nM)>\n12\n\n", ""))
    assert [(r[1], r[2]) for r in files.read_sdf(spark, str(tmp_path / "a.sdf"), ["Ki (nM)", "Name"]).collect()] == [("12", "x"), (None, "y")]
    (tmp_path / "a.cif").write_text("data_X\n_struct.title 'A b''c'\nloop_\n_e.id\n_e.seq\n1 'AC G'\n2\n;MK\nLV\n;\n# end\n")
    got = files.read_cif(spark, str(tmp_path / "a.cif"), ["_struct.title", "_e.id", "_e.seq", "_no"]).first()
    assert (got["_e.id"], got["_e.seq"], got["_no"]) == (["1", "2"], ["AC G", "MK\nLV"], [])
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    (tmp_path / "ids.json").write_text(json.dumps(["a", "b", "c"]))
    rows = files.read_npy(spark, str(tmp_path / "v.npy"), 2, str(tmp_path / "ids.json")).orderBy("idx").collect()
    assert [(r["id"], r["embedding"]) for r in rows] == [("a", [0, 1]), ("b", [2, 3]), ("c", [4, 5])]


def test_epochs_sort_as_numbers(spark, tmp_path):
    for n in (2, 10):
        (tmp_path / f"epoch_{n}").mkdir()
        (tmp_path / f"epoch_{n}" / "log.txt").write_text("Stats: loss: 1\n")
    assert [r["epoch"] for r in files.read_epochs(spark, f"{tmp_path}/epoch_*").orderBy("epoch").collect()] == [2, 10]


def test_lookups_are_typed_and_kept(spark):
    def client(key):
        if key == "bad":
            raise OSError("down")
        return None if key == "none" else json.dumps({"results": [{"id": key, "score": 1.5}]})

    keys = spark.createDataFrame([("a",), ("a",), ("bad",), ("none",), (None,)], "k string")
    got = requests.fetch(keys, "k", client, requests.Policy(pause=0, retries=1))
    assert sorted((r["key"], r["success"], r["error"]) for r in got.collect()) == [("a", True, None), ("bad", False, "OSError: down"), ("none", False, "not found")]
    assert [tuple(r) for r in requests.flatten_hits(got, "struct<id:string,score:double>").collect()] == [("a", "a", 1.5)]
    assert requests.fetch(keys, "k", client, requests.Policy(pause=0), known=got).where("key = 'a'").count() == 0


def test_pages_cutoffs_and_the_last_of_a_name(spark):
    held = {"a": [{"identifier": f"A{i}", "score": 1 - i / 10} for i in range(7)], "b": [{"identifier": "", "score": 1.0}, {"identifier": "B", "score": None}], "c": []}

    def client(key, start, rows):
        if key == "bad":
            raise OSError("down")
        assert rows <= 3
        return None if key == "none" else json.dumps({"result_set": held[key][start : start + rows]})

    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("bad",), ("none",)], "k string")
    got = requests.fetch_pages(keys, "k", client, rows=3, limit=5, policy=requests.Policy(pause=0, retries=1))
    assert {r["key"]: (r["success"], r["error"]) for r in got.collect()} == {"a": (True, None), "b": (True, None), "c": (True, None), "bad": (False, "OSError: down"), "none": (False, "not found")}
    hits = lambda least: sorted((r["key"], r["identifier"], r["similarity"]) for r in requests.sequence_hits(got, least).collect())
    assert hits(0.0) == [("a", "A0", 100.0), ("a", "A1", 90.0), ("a", "A2", 80.0), ("a", "A3", 70.0), ("a", "A4", 60.0), ("b", "B", 0.0)]
    assert hits(0.8) == [("a", "A0", 100.0), ("a", "A1", 90.0), ("a", "A2", 80.0)]
    assert requests.fetch_pages(keys, "k", client, rows=3, policy=requests.Policy(pause=0), known=got).select("key").distinct().count() == 2
    body = json.loads(spark.range(1).select(requests.sequence_query(F.lit("MKLV"), 0.5, rows=3)).first()[0])
    assert body["query"]["parameters"]["value"] == "MKLV" and body["query"]["parameters"]["identity_cutoff"] == 0.5 and body["request_options"]["paginate"] == {"start": 0, "rows": 3}
    named = spark.createDataFrame([("x", True, json.dumps({"compounds": [{"cid": 1}, {"cid": 2}]}), None), ("y", True, json.dumps({"compounds": []}), None), ("z", False, None, "e")], requests.ANSWERS)
    assert [tuple(r) for r in requests.last_compounds(named, "struct<cid:long>").collect()] == [("x", 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "r", "b", True), ("c", "r", "d", False)], "src string, rel string, dst string, ok boolean")
    sinks.write_triples(df, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 2
    sinks.write_by_kind(df.withColumn("kind", F.col("src")), str(tmp_path / "k"))
    assert (tmp_path / "k" / "kind=a").is_dir()
    sinks.split_bad(df, "ok", str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "bad")).first()["src"] == "c"
    assert sinks.append_new(df, str(tmp_path / "log"), ["src"]) == 0
    assert sinks.append_new(df, str(tmp_path / "log"), ["src"]) == 2
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    sinks.write_json_report(df, str(tmp_path / "j"), ["rel"])
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0])["results"][0]["src"] == "a"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:01", "ACGT"), ("2024-01-01 00:00:02", "ACGT"), ("2024-01-01 00:00:03", "MKLV")], "t string, x string")
    rows.select(F.to_timestamp("t").alias("t"), "x").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("t timestamp, x string").parquet(str(tmp_path / "in"))
    q = streams.append_batches(streams.classify_stream(source, "x", "t").select("x", "check.kind"), str(tmp_path / "out"), ["x"], str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted((r["x"], r["kind"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("ACGT", "DNA"), ("MKLV", "AA")]
    counts = streams.kind_counts(source, "x", "t").writeStream.format("memory").queryName("kinds").outputMode("complete").start()
    counts.processAllAvailable()
    counts.stop()
    assert sorted((r["kind"], r["n"]) for r in spark.table("kinds").collect()) == [("AA", 1), ("DNA", 2)]


def test_plans(spark):
    raw = spark.createDataFrame([(1, 'T"1', "MKLV", "L", "C", None, ">5"), (2, "T1", "MKLV", "L", "C", "7", None), (3, "T2", "mk", "L", "C", "x", None), (4, None, "MK", "L", "C", "1", None)], "at int, name string, seq string, lig string, smi string, kd string, ki string")
    good, bad = curate_interactions(raw, "name", "seq", "lig", "smi", "kd", "ki", "at")
    assert [(r["name"], r["kd"]) for r in good.collect()] == [("T1", 5.0)]
    assert [r["protein_issue"] for r in bad.collect()] == ["Lowercase letters detected"]
    assert entity_table(good, [("name", "seq", "protein"), ("lig", "smi", "small_molecule")], "at").count() == 2
    e = spark.createDataFrame([(i, "ACGT"[: 1 + i % 4], [float(i), 1.0]) for i in range(6)], "id long, v_text string, v array<double>")
    assert similarity_edges(e, "id", "v_text", "v", 2).count() >= 5
    links = spark.createDataFrame([(0, 1), (2, 3)], "src long, dst long")
    metrics, summary, best = evaluate(links, links, e.select("id", "v").withColumn("p", F.array(F.lit(0.0), F.lit(0.0))), F.col("p"), Experiment(negatives=2, cutoffs=(1, 3)))
    assert metrics.count() == 2 and summary.first()["num_evaluated_sources"] == 2 and best.count() == 1
    assert Experiment.from_yaml("epochs: 3\ncutoffs: [1, 2]").cutoffs == (1, 2)
    with pytest.raises(ValueError):
        Experiment.from_yaml("other: 1")


def test_arrays_are_written_by_partition(spark, tmp_path):
    import numpy as np

    from strandlake.sources import sinks

    df = spark.range(10).selectExpr("id", "cast(id as string) AS name", "array(cast(id as float), 0.5f) AS v").repartition(3)
    files = sinks.write_arrays(df, ["id", "name", "v"], f"file://{tmp_path}/out").collect()
    assert sum(r["rows"] for r in files) == 10
    for r in files:
        with np.load(r["file"]) as got:
            assert got["v"].dtype == np.float32 and got["v"].shape == (r["rows"], 2)
            assert (got["v"][:, 0] == got["id"]).all() and got["name"].tolist() == [str(i) for i in got["id"]]
    assert sinks.write_arrays(df.limit(0), ["id"], f"file://{tmp_path}/none").count() == 0
    assert sinks.write_arrays(df, ["id"], f"{tmp_path}/plain").count() == 3  # of Hadoop's default file system


def test_paths_without_scheme_are_of_the_default_file_system(spark):
    from strandlake.store import new_path, qualified, remove

    assert qualified(spark, "/a/b") == "file:/a/b" == qualified(spark, "file:///a/b/")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.c.link./a", "file:///tmp")
    conf.set("fs.defaultFS", "viewfs://c/")
    try:
        assert qualified(spark, "/a/b") == "viewfs://c/a/b" and qualified(spark, "file:/a/b") == "file:/a/b"
    finally:
        conf.set("fs.defaultFS", before)
    path = new_path(spark, "x")
    assert ":/" in path
    remove(spark, path)


def test_reports(spark):
    from strandlake.sources import sinks

    assert sinks.report(spark.sql("SELECT 3 AS n, null AS best"), "Summary") == "Summary\nn: 3\nbest: None\n"
    assert sinks.report(spark.sql("SELECT * FROM VALUES ('a', 1, 2), ('b', 3, 4) AS t(k, x, y) ORDER BY k")) == "a: 1, 2\nb: 3, 4\n"
    with pytest.raises(ValueError):
        sinks.report(spark.range(sinks.REPORT_ROWS + 1))


def test_settings_refer_to_each_other():
    from strandlake.plans.pipelines import Experiment, interpolate

    assert interpolate({"a": {"b": 3}, "c": "${a.b}", "d": "x-${c}", "e": ["${a}"]}) == {"a": {"b": 3}, "c": 3, "d": "x-3", "e": [{"b": 3}]}
    for bad in ({"a": "${b}", "b": "${a}"}, {"a": "${x.y}"}):
        with pytest.raises(ValueError):
            interpolate(bad)
    e = Experiment.from_yaml("scoring:\n  operator: diagonal\nnegatives: ${n.negatives}\nn:\n  negatives: 7\n")
    assert (e.operator, e.negatives) == ("diagonal", 7)
    with pytest.raises(ValueError):
        Experiment.from_yaml("nothing: 1")
