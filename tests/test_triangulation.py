"""Triangulations against empty circles, counts and areas; heights against a search through all triangles."""

import numpy as np
import pytest

from cityloom.operators import triangulation as tr


def check(p, triangles, slack=1e-9):
    t = np.array(triangles)
    x, y, r = np.array([tr.circle(p, *row) for row in t]).T
    for i in range(len(t)):
        d = np.hypot(p[:, 0] - x[i], p[:, 1] - y[i])
        assert (d >= r[i] * (1 - slack) - 1e-9).all(), t[i]
    edges = np.sort(np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [0, 2]]]), axis=1)
    _, times = np.unique(edges, axis=0, return_counts=True)
    assert times.max() <= 2
    # Euler: triangles = 2 n - 2 - hull edges
    assert len(t) == 2 * len(np.unique(t)) - 2 - (times == 1).sum()


CASES = {
    "even": lambda r: r.uniform(0, 100, (600, 2)),
    "clusters": lambda r: np.concatenate([r.normal(c, 0.5, (250, 2)) for c in ((0, 0), (80, 3), (40, 90))] + [r.uniform(0, 100, (30, 2))]),
    "ring": lambda r: np.concatenate([np.column_stack([50 * np.cos(a), 50 * np.sin(a)]) for a in [np.sort(r.uniform(0, 6.28, 300))]] + [r.normal(0, 3, (200, 2))]),
    "line and far point": lambda r: np.concatenate([np.column_stack([np.arange(300.0), r.uniform(0, 1e-3, 300)]), [[150.0, 4000.0]]]),
}


@pytest.mark.parametrize("name", CASES)
def test_circles_are_empty_whatever_the_tiles(spark, name):
    p = CASES[name](np.random.default_rng(3))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double").repartition(4)
    got = [tuple(r) for r in tr.delaunay(df, most=160, shift=1e-12).collect()]
    assert len(set(got)) == len(got)
    check(p, got)
    whole, open_ = tr.stars(p, np.arange(len(p)), (-np.inf, -np.inf, np.inf, np.inf), (0, 0, 0, 0))
    assert not open_ and set(got) == set(whole)


def test_lattice_has_one_triangulation(spark):
    df = spark.range(1024).selectExpr("id", "cast(id % 32 as double) x", "cast(id div 32 as double) y")
    t = tr.with_corners(tr.delaunay(df, most=80), df, "x", "y")
    area = t.selectExpr("abs((x_b - x_a) * (y_c - y_a) - (x_c - x_a) * (y_b - y_a)) / 2 AS area").filter("area > 0.01").collect()
    assert len(area) == 2 * 31 * 31 and all(r["area"] == 0.5 for r in area)


def test_heights_on_below_and_beside(spark):
    r = np.random.default_rng(8)
    p = r.uniform(0, 60, (300, 2))
    z = np.sin(p[:, 0] / 9) * 5 + p[:, 1] / 7
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(p, z))], "id long, x double, y double, z double")
    t = tr.delaunay(df, most=64, shift=1e-12)
    q = r.uniform(-10, 70, (200, 2))
    got = {m["id"]: (m["z"], m["source"]) for m in tr.heights(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(q)], "id long, x double, y double"), df, t, 4.0).collect()}
    faces = [tuple(m) for m in t.collect()]
    for i, s in enumerate(q):
        want = None
        for a, b, c in faces:
            m = np.linalg.solve(np.vstack([p[[a, b, c]].T, np.ones(3)]), [*s, 1])
            if (m >= -1e-9).all():
                want = (m @ z[[a, b, c]], "linear")
        want = want or (z[((p - s) ** 2).sum(1).argmin()], "nearest")
        assert got[i][1] == want[1] and abs(got[i][0] - want[0]) < 1e-6


def test_few_equal_and_missing_points(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 0.0), (4, 0.0, 1.0), (5, None, 1.0), (None, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    assert [tuple(r) for r in tr.delaunay(df).collect()] == [(1, 3, 4)]
    assert tr.delaunay(df.filter("id < 4")).count() == 0 and tr.delaunay(df.limit(0)).count() == 0
