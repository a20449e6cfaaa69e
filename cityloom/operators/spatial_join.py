"""Spatial joins by grid cells: an equality join on cells, then box and exact tests.

A bare band condition plans as a nested loop; keyed by cells it is a hash or
sort-merge join whose cost follows the local density.  Points fall into one
cell, boxes into every cell they touch; a pair of boxes is kept only in the cell
of its overlap's lower corner, so no duplicate arises and none must be removed.
Both sides are shuffled by their cells: the planner's sizes don't know how many
cells a row is sent to, so that a broadcast it chose would be far larger than it
thinks, and would leave the pairs to the few tasks that read the small table.
Adaptive execution splits cells that hold too many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Box = tuple[str, str, str, str]  # names of min x, min y, max x, max y


def cell_of(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("bigint")


def with_point_cell(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumns({"_cx": cell_of(F.col(x), size), "_cy": cell_of(F.col(y), size)})


def with_box_cells(df: DataFrame, box: Box, size: float, pad: float = 0.0) -> DataFrame:
    """A row for each cell that the padded box touches (rows with a null or inverted box vanish)."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    ok = df.filter((x0 <= x1) & (y0 <= y1))
    wide = ok.withColumn("_cx", F.explode(F.sequence(cell_of(x0 - pad, size), cell_of(x1 + pad, size))))
    return wide.withColumn("_cy", F.explode(F.sequence(cell_of(y0 - pad, size), cell_of(y1 + pad, size))))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, exact: Column | None = None, xy: tuple[str, str] = ("x", "y"), box: Box = ("x0", "y0", "x1", "y1"), how: str = "inner", pad: float = 0.0) -> DataFrame:
    """Pairs of a point and a box around it (closed), and further `exact`; or a semi or anti join of points."""
    x, y = (F.col(c) for c in xy)
    x0, y0, x1, y1 = (F.col(c) for c in box)
    left, right = with_point_cell(points, *xy, size), with_box_cells(boxes, box, size, pad)
    on = (left["_cx"] == right["_cx"]) & (left["_cy"] == right["_cy"]) & x.between(x0 - pad, x1 + pad) & y.between(y0 - pad, y1 + pad)
    joined = left.hint("merge").join(right, on if exact is None else on & exact, how)
    return joined.drop("_cx", "_cy")


def boxes_with_boxes(a: DataFrame, b: DataFrame, size: float, box_a: Box, box_b: Box, exact: Column | None = None, pad: float = 0.0) -> DataFrame:
    """Pairs of boxes that touch once `a` is padded, each pair once."""
    left, right = with_box_cells(a, box_a, size, pad), with_box_cells(b, box_b, size)
    ax0, ay0, ax1, ay1 = (F.col(c) for c in box_a)
    bx0, by0, bx1, by1 = (F.col(c) for c in box_b)
    meet = (ax0 - pad <= bx1) & (bx0 <= ax1 + pad) & (ay0 - pad <= by1) & (by0 <= ay1 + pad)
    once = (left["_cx"] == cell_of(F.greatest(ax0 - pad, bx0), size)) & (left["_cy"] == cell_of(F.greatest(ay0 - pad, by0), size))
    on = (left["_cx"] == right["_cx"]) & (left["_cy"] == right["_cy"]) & meet & once
    return left.hint("merge").join(right, on if exact is None else on & exact).drop("_cx", "_cy")


def points_near_segments(points: DataFrame, segments: DataFrame, size: float, pad: float, xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Pairs of a point and a segment (ax, ay, bx, by) whose line passes within `pad`, among them all pairs at most `pad` apart.

    A segment is sent only to the cells that it passes within the pad, not to all of its bounds.
    """
    x, y, ax, ay, bx, by = (F.col(c) for c in (*xy, "ax", "ay", "bx", "by"))
    wide = segments.filter("ax IS NOT NULL AND ay IS NOT NULL AND bx IS NOT NULL AND by IS NOT NULL").withColumn("_cx", F.explode(F.sequence(cell_of(F.least(ax, bx) - pad, size), cell_of(F.greatest(ax, bx) + pad, size))))
    # from where to where the segment lies near the cell's column
    at = lambda v: F.when(ax == bx, F.lit(None)).otherwise((v - ax) / (bx - ax))
    p, q = at(F.col("_cx") * size - pad), at((F.col("_cx") + 1) * size + pad)
    clamp = lambda t: F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    y0 = ay + (by - ay) * F.when(ax == bx, 0.0).otherwise(clamp(p))
    y1 = ay + (by - ay) * F.when(ax == bx, 1.0).otherwise(clamp(q))
    # a little more, for what is lost in rounding
    right = wide.withColumn("_cy", F.explode(F.sequence(cell_of(F.least(y0, y1) - pad - 1e-6, size), cell_of(F.greatest(y0, y1) + pad + 1e-6, size))))
    left = with_point_cell(points, *xy, size)
    rx, ry = bx - ax, by - ay
    across = rx * (y - ay) - ry * (x - ax)
    on = (left["_cx"] == right["_cx"]) & (left["_cy"] == right["_cy"]) & (across * across <= (rx * rx + ry * ry) * (pad * pad) * (1 + 1e-9) + 1e-9)
    return left.hint("merge").join(right, on).drop("_cx", "_cy")


def under_lids(boxes: DataFrame, rank: Column, size: float, box: Box = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """Boxes cut to the cells that they enter, with their rank as _rank, less those that lie there under one of higher rank that covers the cell."""
    cells = with_box_cells(boxes.withColumn("_rank", rank), box, size).filter(enters_cell(size, box))
    lids = cells.filter(covers_cell(size, box)).groupBy("_cx", "_cy").agg(F.max("_rank").alias("_lid"))
    left = cells.join(lids.hint("merge"), ["_cx", "_cy"], "left").filter(F.col("_lid").isNull() | (F.col("_rank") >= F.col("_lid"))).drop("_lid")
    return left.withColumns(cut_to_cell(size, box))


def points_near_points(a: DataFrame, b: DataFrame, radius: float, xy_a: tuple[str, str], xy_b: tuple[str, str], exact: Column | None = None) -> DataFrame:
    """Pairs at most `radius` apart: cells as wide as the radius, each point of `a` sent to its 3 x 3 neighbours."""
    ax, ay, bx, by = (F.col(c) for c in (*xy_a, *xy_b))
    near = F.sequence(F.lit(-1), F.lit(1))
    left = a.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).withColumns({"_cx": cell_of(ax, radius) + F.col("_dx"), "_cy": cell_of(ay, radius) + F.col("_dy")}).drop("_dx", "_dy")
    right = with_point_cell(b, *xy_b, radius)
    d2 = (ax - bx) * (ax - bx) + (ay - by) * (ay - by)
    on = (left["_cx"] == right["_cx"]) & (left["_cy"] == right["_cy"]) & (d2 <= radius * radius)
    return left.hint("merge").join(right, on if exact is None else on & exact).drop("_cx", "_cy")


def covers_cell(size: float, box: Box = ("x0", "y0", "x1", "y1")) -> Column:
    """Whether a row of with_box_cells covers all of its cell."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    return (x0 <= F.col("_cx") * size) & (y0 <= F.col("_cy") * size) & (x1 >= (F.col("_cx") + 1) * size) & (y1 >= (F.col("_cy") + 1) * size)


def enters_cell(size: float, box: Box = ("x0", "y0", "x1", "y1")) -> Column:
    """Whether a row of with_box_cells has some area in its cell, not only a border."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    return (x0 < x1) & (y0 < y1) & (x0 < (F.col("_cx") + 1) * size) & (y0 < (F.col("_cy") + 1) * size) & (x1 > F.col("_cx") * size) & (y1 > F.col("_cy") * size)


def touching_links(boxes: DataFrame, key: str, size: float, box: Box = ("x0", "y0", "x1", "y1"), overlap: bool = False) -> DataFrame:
    """(a, b): links between boxes that touch (closed; or share some area) whose connected components are those of all such pairs.

    Whatever reaches into a cell that some box covers touches that box, so that
    one link to it stands for all pairs there; only in cells without such a box
    are pairs made.  Boxes of one outline are linked to their first beforehand.
    """
    x0, y0, x1, y1 = (F.col(c) for c in box)
    whole = boxes.select(key, *box).filter((x0 < x1) & (y0 < y1) if overlap else (x0 <= x1) & (y0 <= y1))
    first = whole.groupBy(*box).agg(F.min(key).alias("_first"))
    same = whole.join(first, list(box)).filter(F.col("_first") != F.col(key)).select(F.col(key).alias("a"), F.col("_first").alias("b"))
    cells = with_box_cells(first.withColumnRenamed("_first", key), box, size)
    cells = cells.filter(enters_cell(size, box)) if overlap else cells
    hubs = cells.groupBy("_cx", "_cy").agg(F.min(F.when(covers_cell(size, box), F.col(key))).alias("_hub"))
    told = cells.join(hubs.hint("merge"), ["_cx", "_cy"])
    star = told.filter(F.col("_hub") != F.col(key)).select(F.col(key).alias("a"), F.col("_hub").alias("b"))
    left, right = (told.filter("_hub IS NULL").select("_cx", "_cy", *[F.col(c).alias(f"{t}{c}") for c in (key, *box)]) for t in ("_l", "_r"))
    c = lambda t, i: F.col(f"{t}{box[i]}")
    under = (lambda p, q: p < q) if overlap else (lambda p, q: p <= q)
    meet = under(c("_l", 0), c("_r", 2)) & under(c("_r", 0), c("_l", 2)) & under(c("_l", 1), c("_r", 3)) & under(c("_r", 1), c("_l", 3))
    pairs = left.hint("merge").join(right, ["_cx", "_cy"]).filter(meet & (F.col(f"_l{key}") < F.col(f"_r{key}")))
    return same.union(star).union(pairs.select(f"_l{key}", f"_r{key}"))


def cut_to_cell(size: float, box: Box = ("x0", "y0", "x1", "y1")) -> dict[str, Column]:
    """The sides of a row of with_box_cells within its cell."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    part = (F.greatest(x0, F.col("_cx") * size), F.greatest(y0, F.col("_cy") * size), F.least(x1, (F.col("_cx") + 1) * size), F.least(y1, (F.col("_cy") + 1) * size))
    return dict(zip(box, part))


def touched_boxes(front: DataFrame, boxes: DataFrame, key: str, size: float, carry: tuple[str, ...] = (), box: Box = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """(key, carry), each once: boxes with what the boxes of `front` that they touch (closed) carry.

    No pairs of boxes are made: front boxes are cut to cells, where parts of one
    outline that carry the same are one part, and one that covers its cell
    stands for all there, since whatever reaches into the cell touches it.
    """
    cells = with_box_cells(front.select(*carry, *box), box, size).withColumn("_lid", covers_cell(size, box))
    parts = cells.withColumns(cut_to_cell(size, box)).select("_cx", "_cy", "_lid", *carry, *[F.col(c).alias(f"_f{c}") for c in box]).distinct()
    lid = F.max("_lid").over(Window.partitionBy("_cx", "_cy", *carry))
    parts = parts.withColumn("_any", lid).filter("_lid OR NOT _any").drop("_lid", "_any")
    left = with_box_cells(boxes.select(key, *box), box, size)
    x0, y0, x1, y1 = (F.col(c) for c in box)
    fx0, fy0, fx1, fy1 = (F.col(f"_f{c}") for c in box)
    on = (left["_cx"] == parts["_cx"]) & (left["_cy"] == parts["_cy"]) & (x0 <= fx1) & (fx0 <= x1) & (y0 <= fy1) & (fy0 <= y1)
    return left.hint("merge").join(parts, on).select(key, *carry).distinct()


def least_touching(shapes: DataFrame, boxes: DataFrame, value: str, size: float, shape: Box, box: Box) -> DataFrame:
    """(shape, value): each outline of `shapes` that touches boxes (closed), with the least value among them.

    A box counts in a cell only if its value lies below that of every box that
    covers the cell: whatever reaches into the cell touches those, too.
    """
    cells = with_box_cells(boxes.select(value, *box), box, size)
    lid = F.min(F.when(covers_cell(size, box), F.col(value))).over(Window.partitionBy("_cx", "_cy"))
    low = cells.withColumns({"_lid": lid, "_covers": covers_cell(size, box)}).filter(F.col("_lid").isNull() | (F.col(value) < F.col("_lid")) | ((F.col(value) == F.col("_lid")) & F.col("_covers")))
    parts = low.withColumns(cut_to_cell(size, box)).groupBy("_cx", "_cy", *box).agg(F.min(value).alias(value))
    left = with_box_cells(shapes.select(*shape).distinct(), shape, size)
    sx0, sy0, sx1, sy1 = (F.col(c) for c in shape)
    x0, y0, x1, y1 = (F.col(c) for c in box)
    on = (left["_cx"] == parts["_cx"]) & (left["_cy"] == parts["_cy"]) & (sx0 <= x1) & (x0 <= sx1) & (sy0 <= y1) & (y0 <= sy1)
    return left.hint("merge").join(parts, on).groupBy(*shape).agg(F.min(value).alias(value))


def alike_boxes(a: DataFrame, b: DataFrame, share: float, box_a: Box, box_b: Box) -> DataFrame:
    """Pairs of boxes among which are all that share `share` (above 0) of both their areas, each pair once.

    Such boxes are nearly as wide and as deep and nearly in one place: they meet
    by classes of their sides and by cells in proportion to those, so that it
    doesn't matter how many others a box touches.
    """
    step, slack = 1.25, 1 + 1e-9
    kind = lambda side: F.floor(F.log(side) / F.log(F.lit(step)))
    place = lambda v, k: F.floor(v / (F.pow(F.lit(step), k) * 0.25))

    def sides(df: DataFrame, box: Box) -> DataFrame:
        x0, y0, x1, y1 = (F.col(c) for c in box)
        return df.filter((x0 < x1) & (y0 < y1)).withColumns({"_w": x1 - x0, "_h": y1 - y0})

    left, right = sides(a, box_a), sides(b, box_b)
    for s, k, c, v in (("_w", "_kw", "_cx", 0), ("_h", "_kh", "_cy", 1)):
        # the other's side is at least this share of one's own, and the other way round; what lies beside the overlap is the rest
        left = left.withColumn(k, F.explode(F.sequence(kind(F.col(s) * share / slack), kind(F.col(s) / share * slack))))
        away = F.col(s) * ((1 - share) / share) * slack + F.abs(F.col(box_a[v])) * 1e-12
        left = left.withColumn(c, F.explode(F.sequence(place(F.col(box_a[v]) - away, F.col(k)), place(F.col(box_a[v]) + away, F.col(k)))))
        right = right.withColumn(k, kind(F.col(s))).withColumn(c, place(F.col(box_b[v]), F.col(k)))
    keys = ["_kw", "_kh", "_cx", "_cy"]
    return left.drop("_w", "_h").hint("merge").join(right.drop("_w", "_h"), keys).drop(*keys)
