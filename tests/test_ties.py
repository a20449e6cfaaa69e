"""Ties and limits that rounding noise mustn't decide."""

import pytest
from pyspark.sql import functions as F

from cityloom.operators.nearest import nearest_points


def test_noise_breaks_no_tie_of_the_nearest(spark):
    q = spark.createDataFrame([(1, 0.1 + 0.2, 0.0)], "id long, x double, y double")  # 0.30000000000000004
    p = spark.createDataFrame([(5, 0.0, 0.0), (9, 0.6, 0.0)], "near_id long, nx double, ny double")
    assert nearest_points(q, p, 8.0, digits=6).first()["near_id"] == 5
    at_reach = spark.createDataFrame([(5, 8.3 + 1e-9, 0.0), (9, -7.7, 0.0)], "near_id long, nx double, ny double")
    assert nearest_points(q, at_reach, 8.0, digits=6).first()["near_id"] == 5


def number(x: int, y: int) -> int:
    """The id whose derived place is (x, y)."""
    a, b = x * pow(37, -1, 1009) % 1009, y * pow(91, -1, 997) % 997
    return a + 1009 * ((b - a) * pow(1009, -1, 997) % 997)


@pytest.fixture()
def made(spark, tmp_path):
    """A folder with lines of two points and single points at given places."""

    def write(lines, points=()):
        ev = [(number(*p), 10 * i + k, i) for i, line in enumerate(lines) for k, p in enumerate(line)]
        spark.createDataFrame(ev, "event_id long, t long, user_id long").selectExpr("event_id", "timestamp_seconds(t) AS ts", "user_id", "'click' AS event_type", "1.0D AS value").write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        spark.createDataFrame([(number(*p), 1.0) for p in points], "o_orderkey long, o_totalprice double").write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
        return str(tmp_path)

    return write


def test_two_metres_exactly_are_no_junction(spark, made):
    from cityloom.plans import QUERIES

    ks = [(k, 60 + 37 * k) for k in range(3, 20)]  # segments of direction (3, 4), points beside them
    lines = [((x, x), (x + 3 * k, x + 4 * k)) for k, x in ks]
    beside = [(x + 3 * 2 + dx, x + 4 * 2 + dy) for _, x in ks for dx, dy in ((-1, 1), (2, -1), (1, -2), (-1, 2))]
    got = {(r["id"], r["user_id"]) for r in QUERIES["t_junctions"](spark, made(lines, beside)).collect()}
    want = set()
    for p in beside:
        for i, ((ax, ay), (bx, by)) in enumerate(lines):
            rx, ry, x, y = bx - ax, by - ay, p[0] - ax, p[1] - ay
            n, dot = rx * rx + ry * ry, x * rx + y * ry
            if 0 <= dot <= n and (rx * y - ry * x) ** 2 < 4 * n and x * x + y * y >= 4 and (p[0] - bx) ** 2 + (p[1] - by) ** 2 >= 4:
                want.add((number(*p), i))
    assert want and got == want


def test_half_a_metre_exactly_is_a_crossing(spark, made):
    from cityloom.plans import QUERIES

    # the second line of each pair passes (0.3, 0.4) beside the first one's start, half a metre along it
    at = [(80 + 41 * i, 80 + 43 * i, 2 + i) for i in range(15)]
    lines = [line for x, y, k in at for line in (((x, y), (x + 3 * k, y + 4 * k)), ((x + 10, y - 19), (x - 10, y + 21)))]
    got = {(r["ua"], r["ub"]) for r in QUERIES["segment_crossings"](spark, made(lines)).collect()}
    assert {(2 * i, 2 * i + 1) for i in range(15)} <= got


def test_events_of_one_time_and_number_have_an_order(spark):
    from cityloom.streaming.tail import silences

    rows = [(1, 0, 1, "click"), (1, 0, 1, "purchase"), (2, 100, 2, "click")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "user_id long, s long, event_id long, event_type string").selectExpr("user_id", "timestamp_seconds(s) AS ts", "event_id", "event_type")
        got = {r["task"]: r["heartbeats"] for r in silences(df.coalesce(1), 15_000).collect()}
        assert got == {1: 6, 2: 0}  # running comes after completed by name, and is open
