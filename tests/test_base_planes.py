"""Planes by consensus: outliers, steep ground, few points."""

import random

import pytest

from cityloom.operators.base_planes import ransac_planes
from cityloom.operators.bands import height_bands


def test_planes_and_fallbacks(spark):
    r = random.Random(2)
    at = [(r.uniform(0, 50), r.uniform(0, 50)) for _ in range(60)]
    rows = [("plane", x, y, 0.2 * x - 0.1 * y + 3) for x, y in at] + [("plane", x, y, 90.0 + i) for i, (x, y) in enumerate(at[:20])]
    rows += [("steep", x, y, 3.0 * x) for x, y in at]  # no plane below 25 degrees holds three of a draw
    rows += [("two", 0.0, 0.0, 4.0), ("two", 1.0, 0.0, 8.0), ("line", 0.0, 0.0, 1.0), ("line", 1.0, 1.0, 1.0), ("line", 2.0, 2.0, 7.0), ("null", None, 1.0, 1.0)]
    got = {m["k"]: m for m in ransac_planes(spark.createDataFrame(rows, "k string, x double, y double, z double"), "k").collect()}
    assert set(got) == {"plane", "steep", "two", "line"}
    p = got["plane"]
    assert (round(p["a"], 6), round(p["b"], 6), round(p["c"], 6), p["inliers"], p["source"]) == (0.2, -0.1, 3.0, 60, "ransac")
    assert (got["two"]["a"], got["two"]["c"], got["two"]["source"]) == (0.0, 6.0, "median") and (got["line"]["c"], got["line"]["source"]) == (1.0, "median")
    assert got["steep"]["source"] in ("median", "drawn", "ransac") and got["steep"]["a"] ** 2 + got["steep"]["b"] ** 2 <= 0.2175


def greedy(rows, width, least):
    out, left = [], sorted(rows)
    while True:
        best = None
        for z in sorted({z for z, _ in left}):
            inside = [x for x in left if x[0] >= z and x[0] - z <= width]
            if len(inside) >= least:
                rank = (sum(a for _, a in inside), len(inside), z - inside[-1][0], -z)
                best = max(best, (rank, inside), key=lambda b: b[0]) if best else (rank, inside)
        if not best:
            return out
        inside = best[1]
        out.append((len(out) + 1, inside[0][0], inside[-1][0], float(best[0][0]), len(inside)))
        left = [x for x in left if not inside[0][0] <= x[0] <= inside[-1][0]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bands_taken_together_are_those_taken_one_by_one(spark, seed):
    r = random.Random(seed)
    groups = {k: [(r.randrange(0, 400) / 20, float(r.randrange(1, 6))) for _ in range(n)] for k, n in ((1, 150), (2, 40), (3, 1), (4, 2))}
    df = spark.createDataFrame([(k, z, a) for k, v in groups.items() for z, a in v] + [(1, None, 5.0)], "k long, z double, area double")
    got = {}
    for m in height_bands(df, "k", width=0.3).orderBy("k", "band").collect():
        got.setdefault(m["k"], []).append((m["band"], m["z_min"], m["z_max"], m["area"], m["n"]))
    want = {k: greedy(v, 0.3, 2) for k, v in groups.items()}
    assert got == {k: v for k, v in want.items() if v}
