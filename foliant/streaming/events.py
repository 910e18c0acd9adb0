"""Streams of events: windowed counts, replay without repeats, latest task state
and a work queue with a visibility timeout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    """``events`` with a ``ts`` that can carry a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums of each type and fixed window; with ``late``, a watermark,
    the same plan serves a stream and drops its state as windows close."""
    rows = timed(events).withWatermark("ts", late) if late else events
    out = rows.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("w.start").alias("bucket"), "n", "total")


def replayed(events: DataFrame, late: str) -> DataFrame:
    """A stream without the events it has seen within the watermark."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


#: Which states follow which.
NEXT = {None: {"queued"}, "queued": {"running", "cancelled"}, "running": {"succeeded", "failed", "cancelled"}}


def next_state(state: str | None, wanted: str) -> str | None:
    """``wanted`` where it may follow, else the state as it is."""
    return wanted if wanted in NEXT.get(state, set()) else state


def task_states(changes: DataFrame) -> DataFrame:
    """(task_id, state, n) after each batch of a stream of (task_id, state, at);
    changes that may not follow are ignored."""

    def step(key, parts: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        state, n = kept.get if kept.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values("at")
        for wanted in rows["state"]:
            new = next_state(state, wanted)
            n += new != state
            state = new
        kept.update((state, n))
        yield pd.DataFrame({"task_id": [key[0]], "state": [state], "n": [n]})

    return changes.groupBy("task_id").applyInPandasWithState(step, "task_id string, state string, n long", "state string, n long", "update", "NoTimeout")


def queue_states(changes: DataFrame, visible_ms: int) -> DataFrame:
    """A work queue over (task_id, kind: put, take or ack, at): a task taken and not
    acknowledged within ``visible_ms`` is put back and told as ``requeued``."""

    def step(key, parts: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            (state,) = kept.get
            kept.remove() if state == "acked" else kept.update(("ready",))
            told = "requeued" if state == "taken" else state
        else:
            state = kept.get[0] if kept.exists else "new"
            for kind in pd.concat(list(parts)).sort_values("at")["kind"]:
                state = {"put": "ready", "take": "taken" if state == "ready" else state, "ack": "acked"}.get(kind, state)
            kept.update((state,))
            if state == "taken":
                kept.setTimeoutDuration(visible_ms)
            told = state
        yield pd.DataFrame({"task_id": [key[0]], "state": [told]})

    return changes.groupBy("task_id").applyInPandasWithState(step, "task_id string, state string", "state string", "update", "ProcessingTimeTimeout")
