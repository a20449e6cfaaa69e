"""Named query plans over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cityloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The derived geometry views (integer arithmetic, the same in both engines).
VIEWS = {
    "v_pts": "SELECT o_orderkey AS id, CAST((o_orderkey * 37) % 1009 AS DOUBLE) AS x, CAST((o_orderkey * 91) % 997 AS DOUBLE) AS y, round(o_totalprice / 10000, 2) AS z FROM orders",
    "v_tri": "SELECT l_orderkey AS oid, l_linenumber AS ln, CAST((l_orderkey * 17 + l_linenumber * 131) % 1009 AS DOUBLE) AS x0, CAST((l_orderkey * 43 + l_linenumber * 57) % 997 AS DOUBLE) AS y0, CAST(3 + l_linenumber AS DOUBLE) AS s, CAST(l_quantity AS DOUBLE) AS z FROM lineitem",
    "v_box": "SELECT p_partkey AS id, CAST((p_partkey * p_partkey * 31 + p_partkey * 53) % 503 AS DOUBLE) AS x0, CAST((p_partkey * p_partkey * 17 + p_partkey * 29) % 491 AS DOUBLE) AS y0, CAST((p_partkey * p_partkey * 31 + p_partkey * 53) % 503 + 2 + p_size % 19 AS DOUBLE) AS x1, CAST((p_partkey * p_partkey * 17 + p_partkey * 29) % 491 + 2 + (p_partkey * 7) % 17 AS DOUBLE) AS y1, CAST(p_size AS DOUBLE) AS h FROM part",
    "v_line": "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS pos, ts, value AS z, CAST((event_id * 37) % 1009 AS DOUBLE) AS x, CAST((event_id * 91) % 997 AS DOUBLE) AS y FROM events",
}


def plan(oracle: str | None = None, views: str = ""):
    """Register a query; `views` names the derived views that its oracle reads."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            used = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views.split())
            body = oracle.strip()
            if used:
                body = f"WITH RECURSIVE {used}, {body[5:].lstrip().removeprefix('RECURSIVE').lstrip()}" if body.upper().startswith("WITH ") else f"WITH {used} {body}"
            ORACLE_SQL[f.__name__] = body
        return f

    return add


def points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("id"), ((k * 37) % 1009).cast("double").alias("x"), ((k * 91) % 997).cast("double").alias("y"), F.round(F.col("o_totalprice") / 10000, 2).alias("z"))


def triangles(spark: SparkSession, sf: str) -> DataFrame:
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(o.alias("oid"), n.alias("ln"), ((o * 17 + n * 131) % 1009).cast("double").alias("x0"), ((o * 43 + n * 57) % 997).cast("double").alias("y0"), (3 + n).cast("double").alias("s"), F.col("l_quantity").cast("double").alias("z"))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    x0, y0 = (k * k * 31 + k * 53) % 503, (k * k * 17 + k * 29) % 491
    d = lambda c: c.cast("double")
    return table(spark, sf, "part").select(k.alias("id"), d(x0).alias("x0"), d(y0).alias("y0"), d(x0 + 2 + F.col("p_size") % 19).alias("x1"), d(y0 + 2 + (k * 7) % 17).alias("y1"), d(F.col("p_size")).alias("h"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = F.col("event_id")
    return table(spark, sf, "events").select("user_id", F.row_number().over(w).alias("pos"), "ts", F.col("value").alias("z"), ((e * 37) % 1009).cast("double").alias("x"), ((e * 91) % 997).cast("double").alias("y"))
