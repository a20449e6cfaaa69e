"""Section rasters: burning, weights, distance field, bilinear scores and the coarse search, all as joins and aggregates.

Rows count downwards from a raster's upper edge, columns from its left edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityloom.session import cut, maybe_broadcast, spread

#: Metres: cell width, margin around what is rastered, reach of a weight, distance of burned samples.
PIXEL, MARGIN, REACH, SAMPLE = 2.0, 8.0, 2.0, 0.5


def bounds(segments: DataFrame, key: str) -> DataFrame:
    """(key, left, top): the corner that cells are counted from, a margin outside the segments (key, ax, ay, bx, by)."""
    return segments.groupBy(key).agg((F.min(F.least("ax", "bx")) - MARGIN).alias("left"), (F.max(F.greatest("ay", "by")) + MARGIN).alias("top"))


def row_of(y: Column) -> Column:
    return (F.col("top") - y) / PIXEL


def column_of(x: Column) -> Column:
    return (x - F.col("left")) / PIXEL


def located(df: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """df with the corner of its key.  The corners are counted and broadcast if they are few; df never is: the planner doesn't know how many rows a generator made."""
    return df.hint("merge").join(maybe_broadcast(edges, 64), key)


def burned(segments: DataFrame, key: str, edges: DataFrame | None = None) -> DataFrame:
    """(key, row, col, n): heights whose segments pass a cell, each height once.

    segments (key, height, ax, ay, bx, by) are sampled at most half a metre
    apart; a sample in the cell of the one before goes before anything is
    aggregated.  edges from bounds(), where they are stored already.
    """
    edges = cut(bounds(segments, key)) if edges is None else edges
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    s = segments.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) / SAMPLE).cast("int")))
    at = located(s, edges, key).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    row, col = (lambda i: F.floor(row_of(F.col("ay") + dy * (i / F.col("_n"))))), (lambda i: F.floor(column_of(F.col("ax") + dx * (i / F.col("_n")))))
    i, last = F.col("_i"), F.col("_i") - 1
    cell = at.filter((i == 0) | (row(i) != row(last)) | (col(i) != col(last))).select(key, "height", row(i).alias("row"), col(i).alias("col"))
    return cell.distinct().groupBy(key, "row", "col").agg(F.count(F.lit(1)).alias("n"))


def weight(n: Column) -> Column:
    """How much a cell that so many heights pass tells about a wall."""
    return F.when(n < 4, 0.0).when(n <= 15, 0.6).when(n <= 28, 0.8).otherwise(1.0)


def distance_field(counts: DataFrame, key: str, reach: float = REACH) -> DataFrame:
    """(key, row, col, f): the largest weight around, each falling linearly to 0 at `reach`; cells at 0 are left out."""
    span = int(reach // PIXEL)
    near = F.sequence(F.lit(-span), F.lit(span))
    w = counts.select(key, "row", "col", weight(F.col("n")).alias("_w")).filter("_w > 0")
    v = w.withColumn("_dr", F.explode(near)).withColumn("_dc", F.explode(near))
    away = F.sqrt(F.col("_dr") * F.col("_dr") + F.col("_dc") * F.col("_dc")) * PIXEL
    fall = F.col("_w") * F.greatest(F.lit(0.0), 1 - away / reach)
    return v.groupBy(key, (F.col("row") + F.col("_dr")).alias("row"), (F.col("col") + F.col("_dc")).alias("col")).agg(F.max(fall).alias("f")).filter("f > 0")


def corners(field: DataFrame, key: str) -> DataFrame:
    """(key, row, col, f00, f01, f10, f11): what a bilinear look-up in this cell needs, so that it is one join."""
    both = F.sequence(F.lit(0), F.lit(1))
    spread = field.withColumn("_i", F.explode(both)).withColumn("_j", F.explode(both)).select(key, (F.col("row") - F.col("_i")).alias("row"), (F.col("col") - F.col("_j")).alias("col"), "_i", "_j", "f")
    take = lambda i, j: F.coalesce(F.max(F.when((F.col("_i") == i) & (F.col("_j") == j), F.col("f"))), F.lit(0.0)).alias(f"f{i}{j}")
    return spread.groupBy(key, "row", "col").agg(take(0, 0), take(0, 1), take(1, 0), take(1, 1))


def scored(points: DataFrame, field: DataFrame, edges: DataFrame, key: str, out: str = "score") -> DataFrame:
    """points (key, x, y, ...) with the field between cells, 0 where nothing is burned; edges from bounds(), stored."""
    p = located(points, edges, key).withColumns({"_v": row_of(F.col("y")), "_u": column_of(F.col("x"))})
    p = p.withColumns({"row": F.floor("_v"), "col": F.floor("_u")})
    dr, dc = F.col("_v") - F.col("row"), F.col("_u") - F.col("col")
    value = F.col("f00") * (1 - dr) * (1 - dc) + F.col("f10") * dr * (1 - dc) + F.col("f01") * (1 - dr) * dc + F.col("f11") * dr * dc
    met = p.hint("merge").join(maybe_broadcast(cut(corners(field, key)), 96), [key, "row", "col"], "left")
    return met.withColumn(out, F.coalesce(value, F.lit(0.0))).drop("_v", "_u", "row", "col", "left", "top", "f00", "f01", "f10", "f11")


def coarse_search(outlines: DataFrame, field: DataFrame, edges: DataFrame, key: str, group: str, steps: Sequence[float], offsets: Sequence[float] = (0.0, -0.5, 0.5)) -> DataFrame:
    """(group, dx, dy, template, score): the shift and outline template with the best mean score.

    outlines (key, group, x, y, cx, cy, half_x, half_y, ax, ay): sampled outline
    points of each group, its centre and the half spans of the rectangle around
    it, whose first axis is (ax, ay).  A shift may not leave the rectangle's half
    spans.  Templates move points towards or from the centre.  Of equal scores
    the smaller movement wins.
    """
    values = F.array(*[F.lit(float(s)) for s in steps])
    t = spread(outlines, group).withColumn("template", F.explode(F.array(*[F.lit(float(o)) for o in offsets]))).withColumn("dx", F.explode(values)).withColumn("dy", F.explode(values))
    along = F.abs(F.col("dx") * F.col("ax") + F.col("dy") * F.col("ay"))
    aside = F.abs(F.col("dy") * F.col("ax") - F.col("dx") * F.col("ay"))
    t = t.filter((along <= F.col("half_x") + 1e-9) & (aside <= F.col("half_y") + 1e-9))
    vx, vy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    r = F.sqrt(vx * vx + vy * vy)
    grow = F.when(r > 1e-9, F.greatest(F.lit(0.0), r + F.col("template")) / r).otherwise(F.lit(1.0))
    moved = t.select(key, group, "template", "dx", "dy", (F.col("cx") + vx * grow + F.col("dx")).alias("x"), (F.col("cy") + vy * grow + F.col("dy")).alias("y"))
    s = scored(moved, field, edges, key).groupBy(group, "template", "dx", "dy").agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("score"))), 9).alias("score"))
    cost = F.round(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.abs("template") * 1e-4, 9)
    best = F.min_by(F.struct("dx", "dy", "template", "score"), F.struct(-F.col("score"), cost, "template", "dx", "dy"))
    return s.groupBy(group).agg(best.alias("_b")).select(group, "_b.*")
