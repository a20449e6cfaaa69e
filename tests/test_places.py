"""Rows of one place or outline are joined once, and boxes under a larger one linked once, with the same results."""

import random

from pyspark.sql import functions as F

from cityloom.operators.components import connected_components
from cityloom.operators.nearest import nearest_others
from cityloom.operators.spatial_join import touching_links


def test_nearest_others_among_copies(spark):
    r = random.Random(3)
    rows = [(i, float(r.randrange(9)), float(r.randrange(9))) for i in range(60)]
    got = {x["id"]: x["near_id"] for x in nearest_others(spark.createDataFrame(rows, "id long, x double, y double"), spark.createDataFrame(rows, "id long, x double, y double"), 1.0).collect()}
    assert got == {i: min(((x - u) ** 2 + (y - v) ** 2, k) for k, u, v in rows if k != i)[1] for i, x, y in rows}


def test_links_of_touching_boxes(spark):
    r = random.Random(8)
    rows = [(i, x, y, x + r.randrange(9), y + r.randrange(9)) for i in range(150) for x, y in [(float(r.randrange(130)), float(r.randrange(130)))]]
    links = touching_links(spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double"), "id", 4.0)
    touch = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]]
    assert {(min(x), max(x)) for x in links.collect()} <= set(touch)
    parts = lambda e: {x["node"]: x["component"] for x in connected_components(e, "a", "b").collect()}
    assert parts(links) == parts(spark.createDataFrame(touch, "a long, b long"))


def test_copies_of_one_place_make_one_link_each(spark):
    heap = spark.range(3000).select("id", *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 12.0), ("y1", 12.0))])
    assert touching_links(heap, "id", 4.0).distinct().count() == 2999


def test_cell_joins_broadcast_nothing(spark):
    from cityloom.operators.spatial_join import points_in_boxes

    p = spark.createDataFrame([(1, 2.0, 2.0)], "id long, x double, y double")
    b = spark.createDataFrame([(7, 0.0, 0.0, 4.0, 4.0)], "bid long, x0 double, y0 double, x1 double, y1 double")
    met = points_in_boxes(p, b, 1.0)
    assert met.count() == 1 and "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
