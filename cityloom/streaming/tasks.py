"""Task events: state machine, live status and log, as batch and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# States in the order a task runs through them.
STATES = ["queued", "running", "completed", "failed"]
STATUS = "task long, status string, events long, elapsed_ms long"


def state_of(kind: str) -> Column:
    """State that an event of this kind leads to."""
    known = F.when(F.col(kind) == "click", "running").when(F.col(kind) == "purchase", "completed").when(F.col(kind) == "error", "failed")
    return known.otherwise("queued")


def final_status(events: DataFrame, task: str = "user_id", ts: str = "ts", order: str = "event_id", kind: str = "event_type") -> DataFrame:
    """(task, status, events, elapsed_ms): the state after the last event, and the time from the first to it."""
    e = events.select(F.col(task).alias("task"), F.col(ts).cast("timestamp").alias("ts"), F.col(order).alias("o"), state_of(kind).alias("s"))
    g = e.groupBy("task").agg(F.max_by("s", F.struct("ts", "o")).alias("status"), F.count(F.lit(1)).alias("events"), (F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))).alias("elapsed_ms"))
    return g


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first, last, order, status, n = state.get if state.exists else (None, None, None, "queued", 0)
    for f in frames:
        for ts, o, s in zip(f["ms"], f["o"], f["s"]):
            first = int(ts) if first is None else min(first, int(ts))
            if last is None or (int(ts), int(o)) >= (last, order):
                last, order, status = int(ts), int(o), s
            n += 1
    state.update((first, last, order, status, n))
    yield pd.DataFrame({"task": [key[0]], "status": [status], "events": [n], "elapsed_ms": [last - first]})


def live_status(stream: DataFrame, task: str = "user_id", ts: str = "ts", order: str = "event_id", kind: str = "event_type") -> DataFrame:
    """The same as a stream: a row for each task whose state a batch touches; late events don't turn it back."""
    e = stream.select(F.col(task).alias("task"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.col(order).alias("o"), state_of(kind).alias("s"))
    return e.groupBy("task").applyInPandasWithState(_fold, STATUS, "first long, last long, o long, status string, n long", "update", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """All events from the start and then what is added: a file source."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_rates(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by kind and time window; rows later than the watermark are dropped."""
    e = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
