"""A task's events as a client sees them: what has happened so far, then each event as it comes, and heartbeats in between."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cityloom.streaming.tasks import state_of

#: Milliseconds without an event after which a heartbeat is sent.
HEARTBEAT = 15_000
#: States after which nothing more is to come.
FINAL = ("completed", "failed")
ROWS = "task long, kind string, status string, at timestamp"


class Tail(StatefulProcessor):
    """Keeps the last event's time and state of a task (of events equal in time and number the last state by name); a timer set from it sends heartbeats until an event resets it or the task is over."""

    def __init__(self, interval: int, by_events: bool):
        self.interval, self.by_events = interval, by_events

    def clock(self, timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() if self.by_events else timerValues.getCurrentProcessingTimeInMs()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long, o long, status string")

    def _reset(self, at: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        e = pd.concat(list(rows)).sort_values(["ms", "o", "s"], kind="stable")
        last = self.seen.get() if self.seen.exists() else None
        newest = e.iloc[-1]
        if last is None or (int(newest["ms"]), int(newest["o"]), newest["s"]) >= tuple(last):
            last = (int(newest["ms"]), int(newest["o"]), newest["s"])
            self.seen.update(last)
            self._reset(None if last[2] in FINAL else last[0] + self.interval)
        yield pd.DataFrame({"task": key[0], "kind": "event", "status": e["s"], "at": pd.to_datetime(e["ms"], unit="ms")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the clock may have passed several heartbeats at once
        at, now = expiredTimerInfo.getExpiryTimeInMs(), self.clock(timerValues)
        due = list(range(at, max(at, now) + 1, self.interval))
        self.handle.registerTimer(due[-1] + self.interval)
        yield pd.DataFrame({"task": key[0], "kind": "heartbeat", "status": self.seen.get()[2], "at": pd.to_datetime(due, unit="ms")})

    def close(self) -> None:
        pass


def tail(stream: DataFrame, *, interval: int = HEARTBEAT, late: str = "0 seconds", clock: str = "EventTime", task: str = "user_id", ts: str = "ts", order: str = "event_id", kind: str = "event_type") -> DataFrame:
    """(task, kind, status, at): every event, and a heartbeat for each `interval` of milliseconds that an unfinished task is silent.

    From a source that begins with stored events (tasks.replay) these come
    first.  The clock is the events' own, moved by all tasks' events less `late`,
    or ProcessingTime.  Needs the RocksDB state store.
    """
    e = stream.select(F.col(task).cast("long").alias("task"), F.col(ts).cast("timestamp").alias("ts"), F.col(order).cast("long").alias("o"), state_of(kind).alias("s"))
    e = e.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return e.groupBy("task").transformWithStateInPandas(Tail(interval, clock == "EventTime"), ROWS, "Append", clock)


def silences(events: DataFrame, interval: int = HEARTBEAT, task: str = "user_id", ts: str = "ts", order: str = "event_id", kind: str = "event_type") -> DataFrame:
    """(task, events, heartbeats): what tail() has sent when the clock stands at the last event of all tasks."""
    e = events.select(F.col(task).alias("task"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.col(order).alias("o"), state_of(kind).alias("s"))
    end = e.agg(F.max("ms")).first()[0]
    w = Window.partitionBy("task").orderBy("ms", "o", "s")
    spans = e.withColumn("next", F.lead("ms").over(w))
    # a heartbeat falls due before the next event, or at the clock's time
    quiet = F.when(F.col("next").isNotNull(), F.floor((F.col("next") - F.col("ms") - 1) / interval)).otherwise(F.floor((F.lit(end) - F.col("ms")) / interval))
    beats = F.when(F.col("s").isin(*FINAL), F.lit(0)).otherwise(F.greatest(F.lit(0), quiet))
    return spans.groupBy("task").agg(F.count(F.lit(1)).alias("events"), F.sum(beats).cast("bigint").alias("heartbeats"))
