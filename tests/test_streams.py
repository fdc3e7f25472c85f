"""Sessions of streams against brute force, late rows included."""

from __future__ import annotations

from datetime import datetime, timedelta

from conftest import SF
from pyspark.sql import functions as F

from strandlake.streaming import streams

START = datetime(2024, 1, 1)


def plain_sessions(rows, gap):
    out, last = [], {}
    for user, at in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if user in last and at - last[user][2] <= gap:
            last[user][2:] = [at, last[user][3] + 1]
        else:
            last[user] = [user, at, at, 1]
            out.append(last[user])
    return sorted(map(tuple, out), key=str)


def test_sessions_of_a_table(spark):
    rows = [(u, START + timedelta(minutes=m)) for u, m in ((1, 0), (1, 9), (1, 18), (1, 40), (2, 5), (2, 5), (None, 3), (None, 4))]
    df = spark.createDataFrame([*rows, (3, None)], "user long, at timestamp")
    got = sorted((tuple(r) for r in streams.sessions(df, "user", "at", "10 minutes").collect()), key=str)
    assert got == plain_sessions(rows, timedelta(minutes=10))
    assert streams.sessions(df.limit(0), "user", "at").count() == 0


def test_late_rows_of_a_stream_are_dropped(spark, tmp_path):
    """Files come one at a time; a row behind the watermark is in no session, one that is late but allowed joins its own."""
    files = [
        [(1, 0), (1, 5), (2, 3)],
        [(1, 60), (2, 58)],  # the watermark moves to 50
        [(1, 52), (2, 1)],  # allowed, and too late
        [(1, 200), (2, 200)],
        [(1, 400)],
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate(files):
        spark.createDataFrame([(u, START + timedelta(minutes=m)) for u, m in rows], "user long, at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("user long, at timestamp").parquet(source)
        q = streams.sessions(stream, "user", "at", "10 minutes", "10 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(out).select("user", "start", "end", "n").collect()), key=str)
    kept = [(u, START + timedelta(minutes=m)) for rows in files for u, m in rows if (u, m) != (2, 1)]
    closed = [s for s in plain_sessions(kept, timedelta(minutes=10)) if s[2] + timedelta(minutes=10) <= START + timedelta(minutes=390)]
    assert got == closed


def test_sessions_of_an_event_stream_equal_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = streams.sessions(stream, "user_id", "ts", "6 hours", "40 days").writeStream.format("memory").queryName("event_sessions").outputMode("append").start()
    q.processAllAvailable()
    last = events.agg(F.max("ts") + F.expr("INTERVAL 80 DAYS")).first()[0]
    spark.createDataFrame([(None, last)], "user_id long, ts timestamp").write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = sorted((tuple(r) for r in spark.table("event_sessions").where("user_id IS NOT NULL").collect()), key=str)
    assert got == sorted((tuple(r) for r in streams.sessions(events, "user_id", "ts", "6 hours").collect()), key=str) and len(got) > 100
