"""Sampling with halved steps and reference heights; visible segments behind corners."""

from cityloom.operators.clipping import convex_pieces
from cityloom.operators.nearest import nearest_visible_segments
from cityloom.operators.sampling import reference_heights, samples_in_polygons

RINGS = "id int, rings array<array<struct<x:double,y:double>>>"


def square(x, y, w):
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]


def test_steps_are_halved_only_where_that_gives_more(spark):
    rows = [(1, [square(0.0, 0.0, 20.0)]), (2, [square(0.0, 0.0, 4.0)]), (3, [square(5.0, 5.0, 1.0)]), (6, [square(5.0, 5.0, 1.9)]), (4, []), (5, None)]
    got = {}
    for r in samples_in_polygons(spark.createDataFrame(rows, RINGS), 2.0, 0.5, 10).collect():
        got.setdefault(r["id"], []).append((r["step"], r["x"], r["y"]))
    assert {k: (v[0][0], len(v)) for k, v in got.items()} == {1: (2.0, 100), 2: (1.0, 16), 3: (2.0, 1), 6: (0.5, 16)}
    # half the step gives polygon 3 one sample again, so that the first stays
    assert got[3] == [(2.0, 6.0, 6.0)]
    assert sorted(got[6]) == [(0.5, x / 4, y / 4) for x in range(21, 28, 2) for y in range(21, 28, 2)]


def test_a_polygon_without_samples_isnt_refined(spark):
    # the first centre lies in the hole
    rows = [(1, [square(0.0, 0.0, 2.0), square(0.5, 0.5, 1.0)])]
    assert samples_in_polygons(spark.createDataFrame(rows, RINGS), 2.0, 0.5, 10).count() == 0


def test_reference_heights(spark):
    polygons = spark.createDataFrame([(i, None) for i in (1, 2, 3, 4)], RINGS)
    z = [(1, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 5.0), (1, 2.0, 0.0, 9.0), (1, 3.0, 0.0, 6.0), (1, 9.0, 9.0, None), (2, 4.0, 1.0, None), (2, 3.0, 1.0, float("nan")), (3, 7.0, 7.0, 2.5)]
    got = {r["id"]: tuple(r)[1:] for r in reference_heights(polygons, spark.createDataFrame(z, "id int, x double, y double, z double")).collect()}
    assert got == {1: (1.0, 0.0, 5.5, "ok"), 2: (3.0, 1.0, None, "sample_failed"), 3: (7.0, 7.0, 2.5, "ok"), 4: (None, None, None, "missing_sample_points")}


def test_walls_hide_nearer_segments(spark):
    # a U of two arms: from the left arm the right one's line is nearer, but hidden
    ring = [(0.0, 0.0), (6.0, 0.0), (6.0, 8.0), (4.0, 8.0), (4.0, 2.0), (2.0, 2.0), (2.0, 8.0), (0.0, 8.0)]
    pieces = convex_pieces(spark.createDataFrame([(1, [ring])], RINGS)).withColumnRenamed("id", "g")
    lines = [(1, "right", 5.0, 3.0, 5.0, 8.0), (1, "floor", 0.0, 0.5, 6.0, 0.5), (2, "elsewhere", 1.0, 7.0, 1.5, 7.0)]
    segments = spark.createDataFrame(lines, "g int, name string, ax double, ay double, bx double, by double").selectExpr("*", "least(ax, bx) x0", "least(ay, by) y0", "greatest(ax, bx) x1", "greatest(ay, by) y1")
    queries = spark.createDataFrame([(1, 1, 1.0, 7.0), (2, 1, 4.5, 7.0), (3, 1, 5.0, 4.0), (4, 2, 1.0, 7.0), (5, 1, 2.0, 8.0)], "id int, g int, x double, y double")
    got = {r["id"]: r["name"] for r in nearest_visible_segments(queries, segments, pieces, ["name"], "g", 1.0, 14.0).collect()}
    # along a wall counts as within; a query in a group without pieces sees only what it stands on
    assert got == {1: "floor", 2: "right", 3: "right", 4: "elsewhere", 5: "floor"}
