"""What touches what, without pairs of boxes as rows: against all pairs, on odd places as well."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cityloom.operators import spatial_join as S

BOX = ("x0", "y0", "x1", "y1")
SMALL = "/root/testdata/sf0.001"


def some_boxes(seed: int, n: int, step: float) -> list[tuple]:
    """Boxes on a lattice, some of no width, some larger than many cells."""
    r = random.Random(seed)
    at = lambda: round(r.randrange(-60, 60) * step, 3)
    rows = [(i, *(x := (at(), at())), x[0] + r.randrange(0, 9) * step, x[1] + r.randrange(0, 9) * step, r.randrange(1, 9) * 1.0) for i in range(n)]
    return rows + [(n, -20.0, -20.0, 30.0, -3.0, 4.0), (n + 1, 5.0, 5.0, 2.0, 6.0, 1.0), (n + 2, None, 0.0, 1.0, 1.0, 1.0)]


def sound(rows: list[tuple]) -> list[tuple]:
    return [r for r in rows if r[1] is not None and r[1] <= r[3] and r[2] <= r[4]]


def touch(a: tuple, b: tuple) -> bool:
    return a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]


def joined(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]


@pytest.mark.parametrize("step", [1.0, 0.7])
def test_steps_over_touching_boxes(spark, step):
    from cityloom.operators.iterative import breadth_first_boxes

    rows = some_boxes(3, 260, step)
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double, h double")
    seeds = {r[0]: r[5] for r in rows if r[0] % 41 == 0}
    want, front, known = {(k, z, 0) for k, z in seeds.items()}, {(k, z) for k, z in seeds.items()}, set(seeds)
    ok, level = {r[0]: r for r in sound(rows)}, 0
    while front:
        level += 1
        front = {(b[0], z) for k, z in front if k in ok for b in ok.values() if b[0] not in known and touch(ok[k], b)}
        want |= {(k, z, level) for k, z in front}
        known |= {k for k, _ in front}
    got = breadth_first_boxes(df, df.filter("id % 41 = 0").select("id", F.col("h").alias("z")), "id", 4.0, ("z",))
    assert level > 2 and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_levels_need_no_pairs(spark, monkeypatch):
    from cityloom.plans import QUERIES, graphs

    # the former plans began with all pairs of touching footprints
    monkeypatch.setattr(graphs, "box_pairs", None)
    assert QUERIES["nearest_reliable"](spark, SMALL).count() > 0 and QUERIES["propagate_node_z"](spark, SMALL).count() > 0


@pytest.mark.parametrize("step", [1.0, 0.7])
def test_least_value_of_what_is_touched(spark, step):
    rows, faces = some_boxes(5, 200, step), some_boxes(6, 150, step)
    a = spark.createDataFrame(faces, "id long, a0 double, b0 double, a1 double, b1 double, h double").drop("h")
    b = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double, h double")
    got = S.least_touching(a, b, "h", 4.0, ("a0", "b0", "a1", "b1"), BOX)
    want = {f[1:5]: min(z) for f in sound(faces) if (z := [r[5] for r in sound(rows) if touch(f, r)])}
    assert {tuple(r[:4]): r["h"] for r in got.collect()} == want


def test_boxes_under_a_lower_one_are_no_rows(spark):
    # a thousand boxes over one cell, the lowest of which covers it: one part is left there
    b = spark.range(1000).select(F.lit(0.5).alias("x0"), F.lit(0.5).alias("y0"), F.lit(3.5).alias("x1"), F.lit(3.5).alias("y1"), (F.col("id") + 2.0).alias("h"))
    b = b.union(spark.createDataFrame([(0.0, 0.0, 4.0, 4.0, 1.0)], b.schema))
    a = spark.range(1000).select((F.col("id") * 0.001).alias("a0"), F.lit(1.0).alias("b0"), F.lit(2.0).alias("a1"), F.lit(2.0).alias("b1"))
    from pyspark.sql import Observation

    seen = Observation("met")
    got = S.least_touching(a, b, "h", 4.0, ("a0", "b0", "a1", "b1"), BOX)
    assert {r["h"] for r in got.observe(seen, F.count(F.lit(1)).alias("n")).collect()} == {1.0} and seen.get["n"] == 1000


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_clearance_needs_no_pairs(spark, monkeypatch):
    from cityloom.plans import QUERIES, spatial

    monkeypatch.setattr(spatial, "boxes_with_boxes", None)
    assert QUERIES["terrain_clearance"](spark, SMALL).count() > 0


@pytest.mark.parametrize(("share", "scale"), [(0.95, 1.0), (0.7, 0.013), (0.95, 31.0), (1.0, 0.3)])
def test_alike_boxes_are_found_at_any_size(spark, share, scale):
    r = random.Random(9)
    rows = []
    for i in range(400):
        x, y, w, h = (r.randrange(-9, 9) * scale, r.randrange(-9, 9) * scale, r.randrange(1, 60) * scale, r.randrange(1, 5) * scale)
        rows += [(2 * i, x, y, x + w, y + h), (2 * i + 1, x + r.choice([0, 0, 0.02, -0.03]) * w, y, x + w * r.choice([1, 1, 1.02]), y + h * r.choice([1, 1.01]))]
    rows += [(900, 3.0, 3.0, 3.0, 5.0), (901, 5.0, 5.0, 1.0, 1.0), (902, None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    a, b = (df.toDF(*[f"{p}_{c}" for c in df.columns]) for p in "ab")
    met = [(m[0], m[1]) for m in S.alike_boxes(a, b, share, *[tuple(f"{p}_{c}" for c in BOX) for p in "ab"]).select("a_id", "b_id").collect()]
    area = lambda m: (m[3] - m[1]) * (m[4] - m[2])
    ok = [m for m in rows if m[1] is not None and m[1] < m[3] and m[2] < m[4]]
    both = lambda m, n: max(0.0, min(m[3], n[3]) - max(m[1], n[1])) * max(0.0, min(m[4], n[4]) - max(m[2], n[2]))
    want = {(m[0], n[0]) for m in ok for n in ok if both(m, n) >= share * max(area(m), area(n))}
    assert len(want) > len(ok) and want <= set(met) and len(met) == len(set(met))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_copies_meet_only_what_is_alike(spark, monkeypatch):
    from cityloom.operators import solvers
    from cityloom.plans import QUERIES

    seen = []
    monkeypatch.setattr(solvers, "without_copies", lambda members, pairs: seen.append(pairs) or members)
    QUERIES["dedupe_members"](spark, SMALL)
    assert "_kw" in seen[0]._jdf.queryExecution().analyzed().toString()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_copies_of_faces_make_no_more_links(spark, monkeypatch):
    from cityloom.plans import QUERIES, meshes

    once, links = meshes.triangles, []
    # the same faces again under other keys
    more = lambda spark, sf: once(spark, sf).union(once(spark, sf).withColumn("oid", F.col("oid") + 1_000_000))
    linked = meshes.connected_components
    monkeypatch.setattr(meshes, "connected_components", lambda e, *by: links.append(e.count()) or linked(e, *by))
    one = {r["face"]: r["part"] for r in QUERIES["mesh_components"](spark, SMALL).collect()}
    monkeypatch.setattr(meshes, "triangles", more)
    two = {r["face"]: r["part"] for r in QUERIES["mesh_components"](spark, SMALL).collect()}
    assert links[0] == links[1]
    assert two == one | {k + 10_000_000: v for k, v in one.items()}
