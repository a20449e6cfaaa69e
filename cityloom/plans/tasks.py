"""Task event plans (ST rows): batch results, and the stream run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.plans.registry import plan, table
from cityloom.session import shared_dir
from cityloom.streaming.tail import silences
from cityloom.streaming.tasks import final_status, live_status, replay, windowed_rates

STATE = "CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'queued' END"
FINAL = f"SELECT user_id AS task, arg_max({STATE}, epoch_us(ts) * 10000000::HUGEINT + event_id) AS status, CAST(count(*) AS BIGINT) AS events, CAST(epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS BIGINT) AS elapsed_ms FROM events GROUP BY user_id"


@plan(FINAL)
def task_final_status(spark: SparkSession, sf: str) -> DataFrame:
    return final_status(table(spark, sf, "events"))


def drained(frame: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over what there is and read the sink; batches are numbered."""
    def write(batch: DataFrame, i: int) -> None:
        batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{folder}/out/batch={i:06d}")

    q = frame.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    spark = frame.sparkSession
    return spark.read.schema(frame.schema.add("batch", "integer")).parquet(*[f"{folder}/out/*"])


@plan(FINAL)
def task_status_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The stateful stream over the events, cut into files; the last update of each task."""
    folder = shared_dir(spark, "task-stream")
    events = table(spark, sf, "events")
    events.repartition(3, "user_id").write.parquet(f"{folder}/in")
    out = drained(live_status(replay(spark, f"{folder}/in", events.schema)), "update", folder)
    return out.groupBy("task").agg(F.max_by(F.struct("status", "events", "elapsed_ms"), "batch").alias("m")).select("task", "m.*")


@plan("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_rates_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_dir(spark, "rate-stream")
    events = table(spark, sf, "events")
    events.write.parquet(f"{folder}/in")
    out = drained(windowed_rates(replay(spark, f"{folder}/in", events.schema), late="0 seconds"), "complete", folder)
    last = out.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("m"))
    return last.select("start", "event_type", "m.n", F.round("m.total", 4).alias("total"))


@plan("SELECT user_id, event_id, to_json({'id': event_id, 'type': event_type}) AS data FROM events")
def event_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Server-sent event payloads."""
    return table(spark, sf, "events").select("user_id", "event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("data"))


#: Milliseconds of silence after which a task's listeners hear a heartbeat; the table's events lie hours apart.
SILENCE = 3_600_000
SILENCES = f"""
WITH e AS (
  SELECT user_id, epoch_ms(ts) AS ms, event_id, CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'queued' END AS s FROM events
), n AS (
  SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id, s) AS nxt, max(ms) OVER () AS last FROM e
)
SELECT user_id AS task, CAST(count(*) AS BIGINT) AS events,
  CAST(sum(CASE WHEN s IN ('completed', 'failed') THEN 0 WHEN nxt IS NOT NULL THEN greatest(0, (nxt - ms - 1) // {SILENCE}) ELSE (last - ms) // {SILENCE} END) AS BIGINT) AS heartbeats
FROM n GROUP BY user_id"""


@plan(SILENCES)
def task_heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    """How many heartbeats the live tail of each task has sent by the time of the last event."""
    return silences(table(spark, sf, "events"), SILENCE)
