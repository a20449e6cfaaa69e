"""Plans whose sides the planner takes for smaller than they are, and steps whose work must not grow with the square of the density."""

import re

from pyspark.sql import functions as F


def test_points_of_a_raster_are_never_broadcast(spark):
    from cityloom.operators import rasters as R

    # two rows made many, beside corners from a table that looks large
    points = spark.range(2).select(F.col("id").alias("k"), (F.col("id") * 2.0 + 1).alias("x"), (F.col("id") * 2.0 + 2).alias("y")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(50))))
    edges = spark.range(3_000_000).groupBy((F.col("id") % 2).alias("k")).agg((F.min("id") * 0.0).alias("left"), (F.max("id") * 0.0 + 10.0).alias("top"))
    field = spark.createDataFrame([(0, 4, 0, 0.6), (1, 3, 1, 0.8)], "k long, row long, col long, f double")
    got = R.scored(points, field, edges, "k")
    assert "BuildLeft" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 100 and got.filter("score > 0").count() == 100


def test_outliers_among_copies_of_places(spark):
    import random

    from cityloom.operators.iterative import local_medians, outlier_round

    rnd = random.Random(5)
    rows = [(i, float(rnd.randrange(-9, 40)), float(rnd.randrange(-9, 40)), rnd.choice([None, round(rnd.uniform(0, 12), 1)] + [round(rnd.uniform(0, 12), 1)] * 9)) for i in range(4000)]
    rows += [(5000 + i, 900.0, 900.0, z) for i, z in enumerate([1.0, 2.0, 7.5, 20.0])] + [(6000 + i, 700.0, 700.0, z) for i, z in enumerate([1.0, 99.0])]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double").repartition(3)
    got = outlier_round(p, 7.0, 5.0)
    # pairs are no rows: all that is joined is the points with those that go
    assert sum("Join" in line for line in got._jdf.queryExecution().executedPlan().toString().splitlines()) == 1
    known = p.filter("z IS NOT NULL")
    high = {r["id"] for r in p.join(local_medians(known, 7.0), "id").filter("n >= 3 AND z > median + 5").collect()}
    assert len(high) > 50 and {r["id"] for r in got.collect()} == {r[0] for r in rows} - high


SMALL = "/root/testdata/sf0.001"


def joins(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]


def test_containers_are_looked_up_by_centres(spark):
    from cityloom import plans

    v = [r.asDict() for r in plans.spatial.boxes(spark, SMALL).collect()]
    size = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    shared = lambda a, b: max(0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) * max(0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))
    hold = {}
    for a in v:
        found = [(size(b), b["id"]) for b in v if size(b) > size(a) and shared(a, b) >= 0.7 * size(a)]
        if found:
            hold[a["id"]] = min(found)[1]
    got = plans.QUERIES["containment_parent"](spark, SMALL)
    assert len(joins(got)) == 1 and {r["id"]: r["parent"] for r in got.collect()} == hold
    same = {(a["id"], b["id"]) for a in v for b in v if a["id"] < b["id"] and shared(a, b) >= 0.5 * size(a) and shared(a, b) >= 0.5 * size(b)}
    got = plans.QUERIES["dedupe_pairs"](spark, SMALL)
    assert "cx" in got._jdf.queryExecution().executedPlan().toString() and {(r["a_id"], r["b_id"]) for r in got.collect()} == same


def test_footprints_are_spread_before_the_work(spark):
    from cityloom.plans import overlay, shapes

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert overlay.shapes(spark, SMALL).rdd.getNumPartitions() == n and shapes.shapes(spark, SMALL).rdd.getNumPartitions() == n


def test_boxes_under_a_lid_are_not_compared(spark):
    from cityloom.operators.spatial_join import under_lids

    rows = [(i, 0.0, 0.0, 9.0, 9.0, i) for i in range(300)] + [(1000, 3.0, 3.0, 10.0, 5.0, 500), (1001, 5.0, 5.0, 5.0, 8.0, 900), (1002, 8.0, 1.0, 8.5, 2.0, 1)]
    b = spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double, h int")
    got = {}
    for r in under_lids(b, F.struct("h", "id"), 4.0).collect():
        got.setdefault((r["_cx"], r["_cy"]), set()).add((r["id"], r["x0"], r["y0"], r["x1"], r["y1"]))
    # only the highest of the stack is left where it covers a cell; all are where none does
    assert got[(0, 0)] == {(299, 0.0, 0.0, 4.0, 4.0), (1000, 3.0, 3.0, 4.0, 4.0)}
    assert got[(1, 1)] == {(299, 4.0, 4.0, 8.0, 8.0), (1000, 4.0, 4.0, 8.0, 5.0)}
    assert len(got[(2, 0)]) == 302 and (1002, 8.0, 1.0, 8.5, 2.0) in got[(2, 0)]


def test_no_task_unites_a_whole_component(spark):
    from cityloom import jts
    from cityloom.plans.overlay import UNION_TILE, tile_unions

    jts.register(spark)
    rows = [(1, i, 4.0 * i, 0.0, f"POLYGON (({4 * i} 0, {4 * i + 5} 0, {4 * i + 5} 5, {4 * i} 5, {4 * i} 0))") for i in range(64)]
    tiles = tile_unions(spark.createDataFrame(rows, "component int, id int, x0 double, y0 double, grown string")).withColumn("area", jts.measure("area", F.col("part"))).collect()
    assert UNION_TILE == 16 and len(tiles) == 16 and {len(t["ids"]) for t in tiles} == {4}
    assert sorted(i for t in tiles for i in t["ids"]) == list(range(64)) and {t["area"] for t in tiles} == {17 * 5.0}


def test_groups_that_meet_in_space_without_all_pairs(spark, monkeypatch):
    from cityloom.operators.components import connected_components
    from cityloom.operators.spatial_join import touching_links
    from cityloom.plans import models

    row = lambda i, g, x, h, w=9.0: (i, g, h, x, 0.0, x + w, 9.0)
    # a dense group that meets, one whose heights lie apart, one that meets only across a border, one of small boxes, one without heights
    rows = [row(i, 1, 0.0, 10.0 + i) for i in range(300)] + [row(400 + i, 2, 100.0, 3.0**i) for i in range(4)] + [row(500, 3, 200.0, 8.0), row(501, 3, 209.0, 9.0)]
    rows += [row(600, 4, 300.0, 5.0, 1.0), row(601, 4, 300.5, 6.0, 1.0), row(700, 5, 400.0, None), row(701, 5, 400.0, 3.0)]
    g = spark.createDataFrame(rows, "id int, group int, h double, x0 double, y0 double, x1 double, y1 double")
    searched = []
    pairs = models.boxes_with_boxes
    monkeypatch.setattr(models, "boxes_with_boxes", lambda a, b, *rest: (searched.append(a.count()), pairs(a, b, *rest))[1])
    assert {r["group"] for r in models.meeting_groups(g).collect()} == {1, 3, 4}
    assert searched and searched[0] < 20
    # boxes that share only a border aren't linked
    links = connected_components(touching_links(g, "id", 4.0, overlap=True), "a", "b").groupBy("component").count().collect()
    assert sorted(r["count"] for r in links) == [2, 2, 4, 300]


def test_segments_meet_points_only_along_their_way(spark):
    import math
    import random

    from cityloom.operators.nearest import nearest_segments
    from cityloom.operators.spatial_join import points_near_segments

    rnd = random.Random(3)
    at = lambda: float(rnd.randrange(-60, 60))
    segs = [(i, at(), at(), at(), at()) for i in range(60)] + [(60, 5.0, -40.0, 5.0, 40.0), (61, -40.0, 7.0, 40.0, 7.0), (62, 300.0, 300.0, 300.0, 300.0)]
    pts = [(i, at(), at()) for i in range(300)] + [(300 + i, 3.0, 4.0) for i in range(200)] + [(900, 301.0, 300.0)]

    def dist(p, s):
        rx, ry = s[3] - s[1], s[4] - s[2]
        n = rx * rx + ry * ry
        t = min(1.0, max(0.0, ((p[1] - s[1]) * rx + (p[2] - s[2]) * ry) / n)) if n else 0.0
        return round(math.hypot(p[1] - s[1] - rx * t, p[2] - s[2] - ry * t), 6)

    p = spark.createDataFrame(pts, "id int, x double, y double")
    s = spark.createDataFrame(segs, "k int, ax double, ay double, bx double, by double")
    rows = [(r["id"], r["k"]) for r in points_near_segments(p, s, 4.0, 3.0).select("id", "k").collect()]
    near = {(a[0], b[0]) for a in pts for b in segs if dist(a, b) <= 3.0}
    # each pair once, none lost, and not all whose bounds meet
    assert len(rows) == len(set(rows)) and near <= set(rows)
    bounds = sum(min(b[1], b[3]) - 3 <= a[1] <= max(b[1], b[3]) + 3 and min(b[2], b[4]) - 3 <= a[2] <= max(b[2], b[4]) + 3 for a in pts for b in segs)
    assert len(rows) < bounds / 3
    best = {r["id"]: (r["dist"], r["k"]) for r in nearest_segments(p, s, ["k"], 1.0).collect()}
    assert best == {a[0]: min((dist(a, b), b[0]) for b in segs) for a in pts}


def test_reference_samples_of_one_place_meet_once(spark):
    from cityloom import plans

    text = plans.QUERIES["reference_samples"](spark, SMALL)._jdf.queryExecution().analyzed().toString()
    # places on one side, outlines on the other
    assert re.search(r"Deduplicate \[[xy]#\d+, [xy]#\d+\]", text) and re.search(r"Aggregate \[x0#\d+, y0#\d+, s#\d+, ln#\d+\]", text)


def test_planes_from_sums_of_places(spark):
    import random

    from cityloom.functions import stats as S

    rnd = random.Random(8)
    rows = [(k, float(rnd.randrange(9)), float(rnd.randrange(9)), None if rnd.random() < 0.1 else rnd.uniform(0, 3)) for k in range(5) for _ in range(400)]
    rows += [(10, 1.0, 1.0, 2.0)] * 5 + [(11, float(i), 2.0 * i, 1.0) for i in range(9)] + [(12, float(i % 3), float(i // 3), 9.0 * i) for i in range(9)] + [(13, float(i % 3), float(i), None) for i in range(9)]
    p = spark.createDataFrame(rows, "k int, x double, y double, z double")
    want = {r["k"]: r["p"] for r in p.groupBy("k").agg(S.plane("x", "y", "z").alias("p")).collect()}
    places = p.groupBy("k", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.count("z").alias("m"), F.coalesce(F.sum("z"), F.lit(0.0)).alias("z"))
    assert places.count() < len(rows) / 3
    got = {r["k"]: r["p"] for r in places.groupBy("k").agg(*S.plane_sums(*(F.col(c) for c in ("n", "m", "x", "y", "z")))).select("k", S.plane_of_sums().alias("p")).collect()}
    assert {k for k in want if want[k]} == {k for k in got if got[k]} == set(range(5))
    for k in range(5):
        assert all(abs(want[k][c] - got[k][c]) < 1e-9 for c in "abc")


def test_areas_of_overlays_without_their_text(spark):
    from cityloom import jts, plans

    jts.register(spark)
    box = lambda a, b, c, d: f"POLYGON (({a} {b}, {c} {b}, {c} {d}, {a} {d}, {a} {b}))"
    shapes = [box(0, 0, 4, 4), box(2, 1, 7, 3), box(4, 0, 6, 2), box(9, 9, 10, 10), "POLYGON ((0 0, 5 1, 1 5, 0 0))", "POLYGON EMPTY"]
    t = spark.createDataFrame([(a, b) for a in shapes for b in shapes], "a string, b string")
    of = lambda op: jts.measure("area", jts.overlay(op, F.col("a"), F.col("b")))
    got = t.select(jts.measure("shared area", F.col("a"), F.col("b")), of("intersection"), jts.measure("rest area", F.col("a"), F.col("b")), of("difference")).collect()
    assert len(got) == 36 and all(abs(r[0] - r[1]) < 1e-9 and abs(r[2] - r[3]) < 1e-9 for r in got)
    # footprints become text before they meet, not once a pair
    plan = plans.QUERIES["polygon_overlay"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    met = next(i for i, line in enumerate(plan) if "Join" in line)
    assert not any("POLYGON" in line for line in plan[:met]) and any("POLYGON" in line for line in plan[met:])
