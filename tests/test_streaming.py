"""Streams give what their batch twins give."""

import pandas as pd
from pyspark.sql import functions as F

from foliant.streaming import events as s

SF = "/root/testdata/sf0.001"


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def source(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for i, day in enumerate(("2024-01-10", "2024-01-20", "2024-02-10")):
        low = ("1970-01-01", "2024-01-10", "2024-01-20")[i]
        events.filter((F.col("ts") >= low) & (F.col("ts") < day)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return events, s.stream(spark, str(tmp_path / "in"), events.schema)


def test_windows(spark, tmp_path):
    events, stream = source(spark, tmp_path)
    got = run(s.windowed(stream, "1 hour", "60 days"), "windows", "complete")
    want = s.windowed(events, "1 hour")
    assert sorted(map(tuple, got.select("event_type", "bucket", "n").collect())) == sorted(map(tuple, want.select("event_type", "bucket", "n").collect()))


def test_replay(spark, tmp_path):
    events, stream = source(spark, tmp_path)
    assert run(s.replayed(stream.union(stream), "60 days"), "replay").count() == events.count()


def test_task_states(spark, tmp_path):
    rows = [(t, x, i) for t, xs in {"a": ["queued", "running", "succeeded", "running"], "b": ["running", "queued", "cancelled"]}.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["task_id", "state", "at"]))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = run(s.task_states(s.stream(spark, str(tmp_path / "in"), df.schema)), "tasks", "update")
    assert {(r.task_id, r.state, r.n) for r in out.collect()} == {("a", "succeeded", 3), ("b", "cancelled", 2)}


def test_queue(spark, tmp_path):
    df = spark.createDataFrame([("a", "put", 0), ("a", "take", 1), ("a", "ack", 2), ("b", "put", 0)], "task_id string, kind string, at int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = run(s.queue_states(s.stream(spark, str(tmp_path / "in"), df.schema), 1000), "queue", "update")
    assert {(r.task_id, r.state) for r in out.collect()} == {("a", "acked"), ("b", "ready")}
