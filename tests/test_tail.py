"""The live tail: replayed and new events, heartbeats by a clock that the events move."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cityloom.streaming.tail import silences, tail
from cityloom.streaming.tasks import replay

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def test_replay_tail_and_heartbeats(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source, began = str(tmp_path / "events"), datetime(2024, 5, 1)

        def add(*rows):
            spark.createDataFrame([(i, began + timedelta(seconds=s), u, k) for i, s, u, k in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)

        def run():
            q = tail(replay(spark, source, SCHEMA)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert q.exception() is None
            return [(r["task"], r["kind"], int((r["at"] - began).total_seconds())) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at", "task", "kind").collect()]

        add((1, 0, 7, "view"), (2, 1, 8, "click"))
        run()
        add((3, 20, 9, "purchase"))  # the clock moves past 15 s of silence of 7 and 8
        assert [x for x in run() if x[1] == "event"] == [(7, "event", 0), (8, "event", 1), (9, "event", 20)]
        add((4, 22, 8, "purchase"))  # 8 is over
        add((5, 50, 9, "click"))
        got = run()
        assert [x for x in got if x[1] == "heartbeat"] == [(7, "heartbeat", 15), (8, "heartbeat", 16), (7, "heartbeat", 30), (7, "heartbeat", 45)]
        assert [x[2] for x in got if x[1] == "event"] == [0, 1, 20, 22, 50]
        counts = {r["task"]: (r["events"], r["heartbeats"]) for r in silences(spark.read.parquet(source)).collect()}
        assert counts == {7: (1, 3), 8: (2, 1), 9: (2, 0)}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_heartbeats_stop_where_a_task_ends(spark):
    rows = [(1, 0, 1, "view"), (2, 45, 1, "error"), (3, 300, 2, "view")]
    began = datetime(2024, 5, 1)
    df = spark.createDataFrame([(i, began + timedelta(seconds=s), u, k) for i, s, u, k in rows], SCHEMA)
    assert {r["task"]: r["heartbeats"] for r in silences(df).collect()} == {1: 2, 2: 0}
    assert silences(df.filter(F.lit(False))).count() == 0
