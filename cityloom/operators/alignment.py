"""Footprint alignment to a score field: coarse shift and template, then shift and rotation in turn.

Groups whose centres share a tile of a field are searched in one call, with the
block of the field that their points can reach, and dealt over several such
calls; blocks come from an equality join on tiles of cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityloom.operators.rasters import PIXEL
from cityloom.session import spread

# Spans and steps of the searches in metres and degrees, outline templates, rounds.
COARSE, COARSE_STEP, FINE, FINE_STEP = 5.0, 0.5, 1.0, 0.25
ANGLE, ANGLE_STEP, ROUNDS = 5.0, 1.0, 10
TEMPLATES = (0.0, -0.5, 0.5)
#: Cells along a tile by which fields and groups meet, a power of two.
TILE = 32
#: Over how many calls the groups of a tile are dealt.
DEALT = 16


def span(middle: float, reach: float, step: float) -> np.ndarray:
    return np.round(middle + np.arange(-round(reach / step), round(reach / step) + 1) * step, 6)


class Raster:
    """A block of a field as a dense array over its cells, 0 where it has none."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, left: float, top: float):
        if not len(rows):
            rows, cols, values = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1)
        self.r0, self.c0, self.left, self.top = int(rows.min()) - 1, int(cols.min()) - 1, left, top
        self.f = np.zeros((int(rows.max()) - self.r0 + 2, int(cols.max()) - self.c0 + 2))
        self.f[rows - self.r0, cols - self.c0] = values

    def at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Field between cells, 0 outside."""
        v, u = (self.top - y) / PIXEL - self.r0, (x - self.left) / PIXEL - self.c0
        r, c = np.floor(v).astype(np.int64), np.floor(u).astype(np.int64)
        ok = (r >= 0) & (c >= 0) & (r < self.f.shape[0] - 1) & (c < self.f.shape[1] - 1)
        r, c, a, b = np.where(ok, r, 0), np.where(ok, c, 0), v - r, u - c
        got = self.f[r, c] * (1 - a) * (1 - b) + self.f[r + 1, c] * a * (1 - b) + self.f[r, c + 1] * (1 - a) * b + self.f[r + 1, c + 1] * a * b
        return np.where(ok, got, 0.0)


def search(raster: Raster, x: np.ndarray, y: np.ndarray, centre: tuple[float, float], axes: np.ndarray, half: np.ndarray, angles: np.ndarray, dxs: np.ndarray, dys: np.ndarray) -> tuple[float, float, float, float] | None:
    """(score, angle, dx, dy) of the best allowed candidate; of equal scores the least movement; None if none is allowed."""
    dx, dy = (g.ravel() for g in np.meshgrid(dxs, dys, indexing="ij"))
    ok = (np.abs(np.stack([dx, dy], 1) @ axes.T) <= half + 1e-9).all(1)
    dx, dy = dx[ok], dy[ok]
    if not len(dx):
        return None
    c, s = np.cos(np.radians(angles))[:, None], np.sin(np.radians(angles))[:, None]
    px, py = centre[0] + (x - centre[0]) * c - (y - centre[1]) * s, centre[1] + (x - centre[0]) * s + (y - centre[1]) * c
    # angle by angle, and all shifts of each
    turn = np.repeat(np.arange(len(angles)), len(dx))
    dx, dy = np.tile(dx, len(angles)), np.tile(dy, len(angles))
    cost = np.round(dx**2 + dy**2 + np.abs(angles)[turn] * 1e-3, 12)
    score, rows = np.empty(len(dx)), max(1, 200_000 // len(x))
    for lo in range(0, len(dx), rows):  # a block of candidates at a time
        part = slice(lo, lo + rows)
        score[part] = raster.at(px[turn[part]] + dx[part, None], py[turn[part]] + dy[part, None]).mean(1)
    score = np.clip(score, 0, 1)
    i = np.lexsort((cost, -np.round(score, 12)))[0]
    return float(score[i]), float(angles[turn[i]]), float(dx[i]), float(dy[i])


def aligned(outlines: DataFrame, field: DataFrame, edges: DataFrame, key: str, group: str) -> DataFrame:
    """(key, group, applied, dx, dy, degrees, template, score, reason) of each group of outline points against its patch's field.

    outlines as for coarse_search, without points where a group has none; field
    (key, row, col, f) and edges (key, left, top) from the raster operators.
    Groups that can't be aligned keep their place and say why.
    """
    kinds = {c: outlines.schema[c].dataType.simpleString() for c in (key, group)}
    names = [key, group, "applied", "dx", "dy", "degrees", "template", "score", "reason"]

    fields = ["x", "y", "cx", "cy", "half_x", "half_y", "ax", "ay"]

    def one(p: np.ndarray, raster: Raster | None) -> tuple:
        def failed(why: str) -> tuple:
            return (False, 0.0, 0.0, 0.0, 0.0, 0.0, why)

        known = p[~np.isnan(p[:, :2]).any(1)]
        if not len(known):
            return failed("no_member_boundary_points")
        cx, cy, half_x, half_y, ax, ay = map(float, p[0, 2:])
        if not np.isfinite([cx, cy]).all():
            return failed("invalid_group_geometry")
        if not (half_x > 0 and half_y > 0 and np.isfinite([ax, ay]).all()):
            return failed("invalid_translation_constraint")
        if raster is None:
            return failed("empty_distance_field")
        x, y, centre = known[:, 0].copy(), known[:, 1].copy(), (cx, cy)
        axes, half = np.array([[ax, ay], [-ay, ax]], float), np.array([half_x, half_y], float)
        r = np.hypot(x - centre[0], y - centre[1])
        best = None
        for t in TEMPLATES:
            k = np.divide(np.maximum(0.0, r + t), r, out=np.ones_like(r), where=r > 1e-9) if t else np.ones_like(r)
            tx, ty = centre[0] + (x - centre[0]) * k, centre[1] + (y - centre[1]) * k
            got = search(raster, tx, ty, centre, axes, half, np.zeros(1), span(0, COARSE, COARSE_STEP), span(0, COARSE, COARSE_STEP))
            rank = (-round(got[0], 12), round(got[2] ** 2 + got[3] ** 2 + abs(t) * 1e-4, 12))
            if best is None or rank < best[0]:
                best = (rank, t, tx, ty, got)
        _, template, x, y, (_, _, dx, dy) = best
        dxs, dys = span(dx, FINE, FINE_STEP), span(dy, FINE, FINE_STEP)
        turns = span(0, ANGLE, ANGLE_STEP)
        score, _, dx, dy = search(raster, x, y, centre, axes, half, np.zeros(1), dxs, dys)
        angle = 0.0
        for _ in range(ROUNDS):
            before = (angle, dx, dy)
            _, _, dx, dy = search(raster, x, y, centre, axes, half, np.array([angle]), dxs, dys)
            score, angle, _, _ = search(raster, x, y, centre, axes, half, turns, np.array([dx]), np.array([dy]))
            if (angle, dx, dy) == before:
                break
        return (True, dx, dy, angle, template, score, None)

    def run(k: tuple, p: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if p.empty:
            return pd.DataFrame(columns=names)
        p = p.sort_values([group, "x", "y"])
        left, top = float(p["left"].iloc[0]), float(p["top"].iloc[0])
        raster = Raster(f["row"].to_numpy(np.int64), f["col"].to_numpy(np.int64), f["f"].to_numpy(float), left, top) if np.isfinite([left, top]).all() else None
        group_of, v = p[group], p[fields].to_numpy(float)
        codes = pd.factorize(group_of, use_na_sentinel=False)[0]
        first = np.append(0, np.flatnonzero(codes[1:] != codes[:-1]) + 1)
        ends = np.append(first[1:], len(p))
        return pd.DataFrame([(k[0], group_of.iloc[lo], *one(v[lo:hi], raster)) for lo, hi in zip(first, ends)], columns=names)

    # only patches with a field have a raster
    placed = edges.join(field.select(key).distinct(), key, "left_semi")
    located = outlines.join(placed, key, "left")
    result = f"`{key}` {kinds[key]}, `{group}` {kinds[group]}, applied boolean, dx double, dy double, degrees double, template double, score double, reason string"
    chunk = ["_r", "_c", "_d"]
    # a group without a centre has a chunk too
    tile = lambda v: F.coalesce(F.floor(v / PIXEL / TILE).cast("bigint"), F.lit(0))
    w = Window.partitionBy(key, group)
    located = located.withColumns({"_x": F.first("cx").over(w), "_y": F.first("cy").over(w)})
    located = located.withColumns({"_r": tile(F.col("top") - F.col("_y")), "_c": tile(F.col("_x") - F.col("left")), "_d": F.pmod(F.xxhash64(group), F.lit(DEALT))}).drop("_x", "_y")
    met = blocks(located, field, key, chunk)
    # few bytes mean much work here: not to be gathered in a task or two
    located = spread(located, key, *chunk)
    return located.groupBy(key, *chunk).cogroup(met.groupBy("patch", *[f"of{c}" for c in chunk])).applyInPandas(run, result)


def blocks(located: DataFrame, field: DataFrame, key: str, chunk: list[str]) -> DataFrame:
    """(patch, of..., row, col, f): the cells that the outlines of a chunk of groups reach when they are shifted, turned and widened as far as the search goes."""
    vx, vy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    reach = F.sqrt(vx * vx + vy * vy) + COARSE + FINE + max(TEMPLATES)
    cell = lambda v, d: F.floor(v / PIXEL).cast("bigint") + d
    least = {"r0": cell(F.col("top") - F.col("cy") - reach, -1), "c0": cell(F.col("cx") - F.col("left") - reach, -1)}
    most = {"r1": cell(F.col("top") - F.col("cy") + reach, 2), "c1": cell(F.col("cx") - F.col("left") + reach, 2)}
    g = located.groupBy(key, *chunk).agg(*[F.min(v).alias(k) for k, v in least.items()], *[F.max(v).alias(k) for k, v in most.items()])
    g = g.filter("r0 <= r1 AND c0 <= c1").select(key, *[F.col(c).alias(f"of{c}") for c in chunk], "r0", "r1", "c0", "c1")
    tile = lambda v: F.floor(v / TILE).cast("bigint")
    g = g.withColumn("_tr", F.explode(F.sequence(tile(F.col("r0")), tile(F.col("r1"))))).withColumn("_tc", F.explode(F.sequence(tile(F.col("c0")), tile(F.col("c1")))))
    f = field.withColumns({"_tr": tile(F.col("row")), "_tc": tile(F.col("col"))})
    met = f.join(g, [key, "_tr", "_tc"]).filter("row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1")
    return met.select(F.col(key).alias("patch"), *[f"of{c}" for c in chunk], "row", "col", "f")
