"""Pairs by their places: points of one place and faces of one outline meet once, and what was near before isn't made again."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cityloom.plans import QUERIES, spatial


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("step", [1.0, 0.7])
def test_new_intersections_of_odd_boxes(spark, monkeypatch, step):
    r = random.Random(4)
    at = lambda: r.randrange(0, 40) * step
    rows = [(i, *(x := (at(), at())), x[0] + r.randrange(0, 7) * step, x[1] + r.randrange(0, 7) * step) for i in range(220)] + [(500, None, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    monkeypatch.setattr(spatial, "boxes", lambda spark, sf: df)
    over = lambda a, b: a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]
    moved = lambda a: (a[0], a[1] + a[0] % 3 - 1, a[2] + a[0] % 5 - 2, a[3] + a[0] % 3 - 1, a[4] + a[0] % 5 - 2)
    want = sorted((a[0], b[0]) for a in rows[:-1] for b in rows[:-1] if a[0] < b[0] and over(moved(a), moved(b)) and not over(a, b))
    got = QUERIES["new_intersections"](spark, "")
    assert want and sorted(map(tuple, got.collect())) == want
    # pairs go to no aggregate
    assert "Aggregate" not in plan_of(got)


def copies(spark):
    """Points, segments and faces of few places, each several times; one point has no place."""
    p = spark.range(60).select("id", (F.col("id") % 7 * 2.0).alias("x"), (F.col("id") % 5 * 3.0).alias("y"), F.lit(1.0).alias("z"))
    p = p.union(spark.createDataFrame([(99, None, 1.0, 1.0)], p.schema))
    t = spark.range(40).select(F.col("id").alias("oid"), (F.col("id") % 4 + 1).cast("int").alias("ln"), (F.col("id") % 8 * 1.0).alias("x0"), (F.col("id") % 2 * 2.0).alias("y0"), (F.col("id") % 4 + 4.0).alias("s"), (F.col("id") * 1.0).alias("z"))
    b = spark.range(5).select("id", (F.col("id") * 3.0).alias("x0"), F.lit(2.0).alias("y0"), (F.col("id") * 3.0 + 2).alias("x1"), F.lit(5.0).alias("y1"), F.lit(1.0).alias("h"))
    return p, t, b


@pytest.mark.parametrize("name", ["all_heights_at_point", "triangles_in_box", "points_within_tolerance", "t_junctions"])
def test_copies_meet_once(spark, monkeypatch, name):
    p, t, b = copies(spark)
    s = spark.createDataFrame([(1, 1, 0.0, 1.0, 14.0, 11.0), (1, 2, 14.0, 11.0, 1.0, 11.0)], "user_id long, pos int, ax double, ay double, bx double, by double")
    for k, df in (("points", p), ("triangles", t), ("boxes", b), ("segments", s)):
        monkeypatch.setattr(spatial, k, lambda spark, sf, df=df: df)
    got = QUERIES[name](spark, "")
    points, faces, boxes, lines = ([r.asDict() for r in df.collect()] for df in (p.filter("x IS NOT NULL"), t, b, s))
    if name == "all_heights_at_point":
        inside = lambda q, f: (u := (q["x"] - f["x0"]) / f["s"]) >= 0 and (v := (q["y"] - f["y0"]) / f["s"]) >= 0 and u + v <= 1
        want = [(q["id"], f["oid"], f["ln"], round(f["z"] + f["ln"] * (q["x"] - f["x0"]) / f["s"], 6)) for q in points for f in faces if inside(q, f)]
    elif name == "triangles_in_box":
        meet = lambda c, f: f["x0"] <= c["x1"] and f["y0"] <= c["y1"] and max(c["x0"] - f["x0"], 0) + max(c["y0"] - f["y0"], 0) <= f["s"]
        want = [(c["id"], f["oid"], f["ln"]) for c in boxes for f in faces if meet(c, f)]
    elif name == "points_within_tolerance":
        want = [(a["id"], c["id"]) for a in points for c in points if a["id"] < c["id"] and (a["x"] - c["x"]) ** 2 + (a["y"] - c["y"]) ** 2 <= 100]
    else:
        want = []
        for q in points:
            for e in lines:
                rx, ry, x, y = e["bx"] - e["ax"], e["by"] - e["ay"], q["x"] - e["ax"], q["y"] - e["ay"]
                n, k = rx * rx + ry * ry, (x * rx + y * ry) / (rx * rx + ry * ry)
                if (rx * y - ry * x) ** 2 < 4 * n and 0 <= k <= 1 and x * x + y * y >= 4 and (x - rx) ** 2 + (y - ry) ** 2 >= 4:
                    want.append((q["id"], e["user_id"], e["pos"]))
    rows = sorted(tuple(r)[: len(want[0])] for r in got.collect())
    assert want and len(rows) == len(want) and all(g == pytest.approx(w) for g, w in zip(rows, sorted(want)))
    # an array of what shares a place or an outline is told apart after the join
    plan = plan_of(got)
    assert re.search(r"Generate explode\((ids|near_ids|faces)#", plan).start() < plan.index("Join")


def test_a_text_is_parsed_once(spark):
    from cityloom import jts

    jts.register(spark)
    loader = spark._jsparkSession.artifactManager().classloader()
    kind = loader.loadClass(jts.CLASS)
    f, known = kind.getDeclaredConstructor(None).newInstance(None), kind.getDeclaredField("PARSED")
    known.setAccessible(True)
    a, b = "POLYGON ((0 0, 8 0, 8 8, 0 8, 0 0))", "POLYGON ((4 4, 9 4, 9 9, 4 9, 4 4))"
    for _ in range(3):
        assert (f.call("shared area", a, b, 0.0), f.call("rest area", a, b, 0.0)) == ("16.0", "48.0")
    seen = known.get(None).get()
    assert seen.containsKey(a) and seen.containsKey(b)
    first = seen.get(a)
    f.call("difference", a, b, 0.0)
    assert first.equals(seen.get(a)) and seen.size() <= 16384
