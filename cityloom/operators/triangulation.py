"""Delaunay triangulation of any number of points, and heights on it.

Points fall into tiles that are cut in four until a tile and its eight
neighbours hold at most `most` points; each tile sees half a tile beyond its
edges.  In a tile the triangles around each of its own points are found, and a
triangle is certain if what its circumcircle covers of the whole extent lies in
what the tile sees.  Points with uncertain triangles go on to the next pass,
which has larger tiles, because there are fewer of them.  A triangle that is
still missing has three such corners and an empty circumcircle, so it is among
the triangles of those points; the others among these lie upon triangles already
certain and are dropped by their centres.

Points are told apart by where they are: of several in one place that with the
smallest id stays.  Four points on one circle are no ambiguity, since all tiles
see each point shifted by the same tiny step, which its id decides; `shift` is
the step as a part of the mean distance of points.  The number of points in one
task is bounded by `most` as long as passes shrink; where they don't (points on
one circle around nothing), it is raised fourfold.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityloom.operators.nearest import nearest_points
from cityloom.session import cut

MOST = 1024
SHIFT = 1e-4
#: Levels that tiles are cut beyond the first; a place denser than that stays one tile.
DEEPEST = 24


def apex(p: np.ndarray, a: int, b: int) -> int:
    """The corner on the left of the edge from a to b whose circle through both holds no point on that side; -1 if there is none."""
    d, v = p[b] - p[a], p - p[a]
    side = d[0] * v[:, 1] - d[1] * v[:, 0]
    side[[a, b]] = 0
    left = np.flatnonzero(side > 0)
    if not len(left):
        return -1
    w = v[left]
    return int(left[np.argmin((w * (w - d)).sum(1) / side[left])])


def circle(p: np.ndarray, a: int, b: int, c: int) -> tuple[float, float, float]:
    d, e = p[b] - p[a], p[c] - p[a]
    k = 2 * (d[0] * e[1] - d[1] * e[0])
    u = np.array([e[1] * (d @ d) - d[1] * (e @ e), d[0] * (e @ e) - e[0] * (d @ d)]) / k
    return float(p[a, 0] + u[0]), float(p[a, 1] + u[1]), float(np.hypot(*u))


def stars(p: np.ndarray, own: np.ndarray, seen: tuple[float, ...], extent: tuple[float, ...]) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Certain triangles around the `own` points, and own points that have others."""
    known: dict[tuple[int, int], int] = {}

    def third(a: int, b: int) -> int:
        if (a, b) not in known:
            c = apex(p, a, b)
            known[a, b] = c
            if c >= 0:
                known[b, c], known[c, a] = a, b
        return known[a, b]

    def inside(x0: float, y0: float, x1: float, y1: float) -> bool:
        return all((max(x0, extent[0]) >= seen[0], max(y0, extent[1]) >= seen[1], min(x1, extent[2]) <= seen[2], min(y1, extent[3]) <= seen[3]))

    sure: dict[tuple[int, int, int], bool] = {}
    open_ = []
    for v in own.tolist():
        d = ((p - p[v]) ** 2).sum(1)
        d[v] = np.inf
        first = int(d.argmin())
        complete, u, turns = True, first, [(v, first)]
        while (c := third(v, u)) >= 0:
            turns.append((v, c))
            u = c
            if u == first:
                break
        if u != first or len(turns) == 1:  # the hull: on from the first neighbour the other way round
            complete = all(extent[i] >= seen[i] for i in (0, 1)) and all(extent[i] <= seen[i] for i in (2, 3))
            u = first
            while (c := third(u, v)) >= 0:
                turns.append((v, c))
                u = c
        for a, b in turns:
            if (c := known.get((a, b), -1)) >= 0:
                t = tuple(sorted((a, b, c)))
                if t not in sure:
                    x, y, r = circle(p, *t)
                    sure[t] = inside(x - r, y - r, x + r, y + r)
                complete &= sure[t]
        if not complete:
            open_.append(v)
    return [t for t, s in sure.items() if s], open_


def _tiled(points: DataFrame, x0: float, y0: float, side: float, most: int, n: int) -> tuple[DataFrame, list[int]]:
    """Points with the tile of their own (level, i, j), and the levels there are."""
    at = lambda c, o, level: F.floor((F.col(c) - o) * (2.0**level / side)).cast("long")
    level = max(0, math.floor(math.log(max(n / most, 1), 4)))
    last, open_, done, levels = level + DEEPEST, points, None, []
    while True:
        here = open_.withColumns({"level": F.lit(level), "i": at("px", x0, level), "j": at("py", y0, level)})
        if level < last:
            counts = points.groupBy(at("px", x0, level).alias("i"), at("py", y0, level).alias("j")).agg(F.count(F.lit(1)).alias("n"))
            near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
            around = counts.withColumn("_i", near).withColumn("_j", near).groupBy((F.col("i") + F.col("_i")).alias("i"), (F.col("j") + F.col("_j")).alias("j")).agg(F.sum("n").alias("n"))
            fit = cut(around.filter(F.col("n") <= most).select("i", "j"))
            settled = cut(here.join(fit, ["i", "j"]).select(*points.columns, "level", "i", "j"))
            open_ = cut(here.join(fit, ["i", "j"], "left_anti").select(*points.columns))
        else:
            settled, open_ = cut(here), open_.limit(0)
        if not settled.isEmpty():
            done = settled if done is None else done.unionByName(settled)
            levels.append(level)
        if open_.isEmpty():
            return cut(done), levels
        level += 1


def _pass(points: DataFrame, extent: tuple[float, ...], most: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Certain triangles (a, b, c) of points (id, px, py), and the ids of points with others."""
    x0, y0 = extent[:2]
    side = max(extent[2] - x0, extent[3] - y0) * (1 + 1e-9) or 1.0
    kind = points.schema["id"].dataType.simpleString()
    result = f"a {kind}, b {kind}, c {kind}"
    if n <= most:
        frame = points.withColumns({"level": F.lit(0), "i": F.lit(0), "j": F.lit(0), "own": F.lit(True)})
    else:
        tiles, levels = _tiled(points, x0, y0, side, most, n)
        cells = []
        for level in levels:
            k = 2.0**level / side
            for dx in (-0.5, 0.5):
                for dy in (-0.5, 0.5):
                    i, j = (F.floor((F.col(c) - o) * k + d).cast("long") for c, o, d in (("px", x0, dx), ("py", y0, dy)))
                    cells.append(F.struct(F.lit(level).alias("level"), i.alias("i"), j.alias("j")))
        sent = tiles.withColumnsRenamed({"level": "_l", "i": "_i", "j": "_j"}).withColumn("t", F.explode(F.array_distinct(F.array(*cells))))
        own = (F.col("t.level") == F.col("_l")) & (F.col("t.i") == F.col("_i")) & (F.col("t.j") == F.col("_j"))
        frame = sent.select("id", "px", "py", "t.*", own.alias("own")).join(tiles.select("level", "i", "j").distinct(), ["level", "i", "j"], "left_semi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids, p, own = pdf["id"].to_numpy(), pdf[["px", "py"]].to_numpy(float), np.flatnonzero(pdf["own"].to_numpy())
        if len(ids) < 3:
            return pd.DataFrame({"a": ids[own] if n > most else ids[:0], "b": None, "c": None})
        s = side / 2.0 ** int(pdf["level"].iloc[0])
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        seen = (x0 + (i - 0.5) * s, y0 + (j - 0.5) * s, x0 + (i + 1.5) * s, y0 + (j + 1.5) * s) if n > most else (-np.inf, -np.inf, np.inf, np.inf)
        found, open_ = stars(p, own, seen, extent)
        rows = [(ids[t[0]], ids[t[1]], ids[t[2]]) for t in found] + [(ids[v], None, None) for v in open_]
        return pd.DataFrame(rows, columns=["a", "b", "c"])

    out = cut(frame.groupBy("level", "i", "j").applyInPandas(run, result))
    return cut(out.filter("c IS NOT NULL").distinct()), out.filter("c IS NULL").select(F.col("a").alias("id")).distinct()


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def with_corners(triangles: DataFrame, points: DataFrame, *columns: str) -> DataFrame:
    """Triangles (a, b, c) with columns of their corners: x_a, y_a, ..."""
    out = triangles
    for n in "abc":
        out = out.join(points.select(F.col("id").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in columns]), n)
    return out


def located(points: DataFrame, triangles: DataFrame, xy: tuple[str, str] = ("x", "y"), names: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Pairs of a point and a triangle (x_a, y_a, ...) around it, with its weights u, v, w; triangles meet points in cells of their own size."""
    xs, ys = ([F.col(f"{n}_{c}") for c in "abc"] for n in names)
    x, y = (F.col(c) for c in xy)
    wide = F.greatest(F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys), F.lit(1e-9))
    sized = triangles.withColumn("_size", F.ceil(F.log2(wide)).cast("int"))
    sizes = [r["_size"] for r in sized.select("_size").distinct().collect()]  # logarithms of extents
    if not sizes:
        sizes = [0]
    power = F.pow(F.lit(2.0), F.col("_size"))
    cells = lambda e: F.explode(F.sequence(F.floor(F.least(*e) / power).cast("long"), F.floor(F.greatest(*e) / power).cast("long")))
    right = sized.withColumn("_cx", cells(xs)).withColumn("_cy", cells(ys))
    left = points.withColumn("_size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    left = left.withColumns({"_cx": F.floor(x / power).cast("long"), "_cy": F.floor(y / power).cast("long")})
    (xa, xb, xc), (ya, yb, yc) = xs, ys
    area = cross(xb - xa, yb - ya, xc - xa, yc - ya)
    u = cross(xb - x, yb - y, xc - x, yc - y) / area
    v = cross(xc - x, yc - y, xa - x, ya - y) / area
    met = left.join(right, ["_size", "_cx", "_cy"]).filter(area != 0).withColumns({"u": u, "v": v}).withColumn("w", 1 - F.col("u") - F.col("v"))
    return met.filter("least(u, v, w) >= -1e-9").drop("_size", "_cx", "_cy")


def delaunay(points: DataFrame, most: int = MOST, shift: float = SHIFT) -> DataFrame:
    """Triangles (a, b, c), ids in ascending order, of points (id, x, y)."""
    kept = points.filter("x IS NOT NULL AND y IS NOT NULL AND id IS NOT NULL").groupBy("x", "y").agg(F.min("id").alias("id"))
    kept = cut(kept)
    e = kept.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(n + c) for c in "xy" for n, f in (("l", F.min), ("h", F.max))]).first()
    n = e["n"]
    if n < 3:
        return points.sparkSession.createDataFrame([], ", ".join(f"{c} {points.schema['id'].dataType.simpleString()}" for c in "abc"))
    step = shift * (math.sqrt((e["hx"] - e["lx"]) * (e["hy"] - e["ly"]) / n) or (e["hx"] - e["lx"] + e["hy"] - e["ly"]) / n)
    by = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * step
    shifted = cut(kept.select("id", (F.col("x") + by(1)).alias("px"), (F.col("y") + by(2)).alias("py")))
    extent = (e["lx"] - step, e["ly"] - step, e["hx"] + step, e["hy"] + step)
    left, certain, size = shifted, None, n
    while True:
        found, open_ = _pass(left, extent, most, size)
        if certain is not None:
            corners = with_corners(found, shifted, "px", "py")
            centres = corners.select("a", "b", "c", *[((F.col(f"{c}_a") + F.col(f"{c}_b") + F.col(f"{c}_c")) / 3).alias(c) for c in ("px", "py")])
            whole = with_corners(certain, shifted, "px", "py").drop("a", "b", "c")
            over = located(centres, whole, ("px", "py"), ("px", "py")).select("a", "b", "c").distinct()
            found = found.join(over, ["a", "b", "c"], "left_anti")
        certain = found if certain is None else cut(certain.unionByName(found))
        if size <= most:
            return certain
        left = cut(left.join(open_, "id", "left_semi"))
        now = left.count()
        if not now:
            return certain
        if now > size * 0.7:
            most *= 4
        size = now


def heights(samples: DataFrame, points: DataFrame, triangles: DataFrame, first: float) -> DataFrame:
    """(id, z, source) of samples (id, x, y): linear on the triangle around them, else of the nearest point, else 0.

    points (id, x, y, z); `first` is where the search for the nearest begins.
    """
    met = located(samples.select("id", "x", "y"), with_corners(triangles, points, "x", "y", "z"))
    z = F.col("u") * F.col("z_a") + F.col("v") * F.col("z_b") + F.col("w") * F.col("z_c")
    on = cut(met.groupBy("id").agg(F.min_by(z, F.struct("a", "b", "c")).alias("on")))
    rest = samples.select("id", "x", "y").join(on, "id", "left_anti")
    near = nearest_points(rest, points.select(F.col("id").alias("near_id"), F.col("x").alias("nx"), F.col("y").alias("ny")), first)
    near = near.join(points.select(F.col("id").alias("near_id"), F.col("z").alias("nz")), "near_id").select("id", "nz")
    all_ = samples.select("id").join(on, "id", "left").join(near, "id", "left")
    source = F.when(F.col("on").isNotNull(), "linear").when(F.col("nz").isNotNull(), "nearest").otherwise("none")
    return all_.select("id", F.coalesce("on", "nz", F.lit(0.0)).alias("z"), source.alias("source"))
