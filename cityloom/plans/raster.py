"""Section rasters: slicing, burning, weights, scores, coarse search, deferred groups (R rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.functions import geometry as G
from cityloom.operators import rasters as R
from cityloom.plans.registry import boxes, plan, points, triangles
from cityloom.session import cut

#: The triangles of a patch (k) are folded into a square of so many metres, so that walls stand above each other.
FOLD = 60


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """(k, height, segment): each whole height that a triangle spans cuts it once; shorter cuts than 0.3 m don't count."""
    return segments(triangles(spark, sf).withColumns({"k": F.col("oid") % 20, "x0": F.col("x0") % FOLD, "y0": F.col("y0") % FOLD}))


def outline_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The different sections: triangles that fall onto each other in a patch are cut once.  For what doesn't count them."""
    t = triangles(spark, sf).select((F.col("oid") % 20).alias("k"), (F.col("x0") % FOLD).alias("x0"), (F.col("y0") % FOLD).alias("y0"), "s", "z", "ln")
    return segments(t.distinct())


def segments(t: DataFrame) -> DataFrame:
    x, y, s, z, n = (F.col(c) for c in ("x0", "y0", "s", "z", "ln"))
    low, high = F.ceil(z), F.floor(z + n)
    # a sequence whose end lies below its start would count down
    crossed = t.filter(low <= high).withColumn("height", F.explode(F.sequence(low, high)))
    c = G.plane_section(G.vertex(x, y, z), G.vertex(x + s, y, z + n), G.vertex(x, y + s, z), F.col("height").cast("double"))
    ends = crossed.select("k", "height", c.alias("c")).filter("size(c) = 2").select("k", "height", *[F.get("c", i)[a].alias(b) for i, a, b in ((0, "x", "ax"), (0, "y", "ay"), (1, "x", "bx"), (1, "y", "by"))])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return ends.filter(F.sqrt(dx * dx + dy * dy) >= 0.3)


# A plane at h cuts a right triangle that rises by ln along x at u = (h - z) / ln: a line parallel to its y leg, shortened by u.
SECT = f"SELECT * FROM (SELECT k, h AS height, x0 + s * u AS ax, y0 AS ay, x0 + s * u AS bx, y0 + s * (1 - u) AS by_ FROM (SELECT oid % 20 AS k, x0 % {FOLD} AS x0, y0 % {FOLD} AS y0, s, h, (h - z) / ln AS u FROM (SELECT *, unnest(range(CAST(ceil(z) AS BIGINT), CAST(floor(z + ln) AS BIGINT) + 1)) AS h FROM v_tri)) WHERE u < 1) WHERE by_ - ay >= 0.3"


@plan(f"SELECT k, height, CAST(count(*) AS BIGINT) AS n, round(sum(by_ - ay), 4) AS length FROM ({SECT}) GROUP BY k, height", "v_tri")
def section_lengths(spark: SparkSession, sf: str) -> DataFrame:
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return sections(spark, sf).groupBy("k", "height").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.sqrt(dx * dx + dy * dy)), 4).alias("length"))


# 8 m of margin, rows from above, samples half a metre apart
EDGE = f"SELECT k, min(ax) - 8 AS x_min, max(by_) + 8 AS y_max FROM ({SECT}) GROUP BY k"
BURN = f"SELECT k, row_, col_, count(DISTINCT height) AS n FROM (SELECT c.k, height, CAST(floor((y_max - (ay + (by_ - ay) * (i / m))) / 2) AS BIGINT) AS row_, CAST(floor((ax - x_min) / 2) AS BIGINT) AS col_ FROM (SELECT *, unnest(range(m + 1)) AS i FROM (SELECT *, CAST(greatest(1, ceil((by_ - ay) / 0.5)) AS BIGINT) AS m FROM ({SECT}))) c JOIN ({EDGE}) e ON e.k = c.k) GROUP BY k, row_, col_"


@plan(f'SELECT k, row_ AS "row", col_ AS col, CAST(n AS BIGINT) AS n FROM ({BURN})', "v_tri")
def section_count(spark: SparkSession, sf: str) -> DataFrame:
    return R.burned(outline_sections(spark, sf), "k")


FIELD = f"SELECT k, row_, col_, CASE WHEN n <= 15 THEN 0.6 WHEN n <= 28 THEN 0.8 ELSE 1.0 END::DOUBLE AS f FROM ({BURN}) WHERE n >= 4"


@plan(f'SELECT k, row_ AS "row", col_ AS col, CASE WHEN n < 4 THEN 0.0 WHEN n <= 15 THEN 0.6 WHEN n <= 28 THEN 0.8 ELSE 1.0 END::DOUBLE AS w FROM ({BURN})', "v_tri")
def raster_weight(spark: SparkSession, sf: str) -> DataFrame:
    return R.burned(outline_sections(spark, sf), "k").select("k", "row", "col", R.weight(F.col("n")).alias("w"))


def field(spark: SparkSession, sf: str) -> DataFrame:
    return R.distance_field(R.burned(outline_sections(spark, sf), "k"), "k")


def placed_field(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The field, stored, and the corners that its cells are counted from."""
    s = outline_sections(spark, sf)
    edges = cut(R.bounds(s, "k"))
    return cut(R.distance_field(R.burned(s, "k", edges), "k")), edges


# cells are as wide as the weights reach: a neighbour is at 0
@plan(f'SELECT k, row_ AS "row", col_ AS col, f FROM ({FIELD})', "v_tri")
def distance_field(spark: SparkSession, sf: str) -> DataFrame:
    return field(spark, sf)


@plan(f'SELECT k, row_ + dr AS "row", col_ + dc AS col, round(max(w * (1 - sqrt(dr * dr + dc * dc) * 2 / 5.0)), 6) AS f FROM (SELECT k, row_, col_, f AS w FROM ({FIELD})), (SELECT unnest(range(-2, 3)) AS dr), (SELECT unnest(range(-2, 3)) AS dc) WHERE sqrt(dr * dr + dc * dc) * 2 < 5.0 GROUP BY 1, 2, 3', "v_tri")
def wide_distance_field(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a reach of five metres, over several cells."""
    return R.distance_field(R.burned(outline_sections(spark, sf), "k"), "k", 5.0).select("k", "row", "col", F.round("f", 6).alias("f"))


@plan(f"""WITH f AS MATERIALIZED ({FIELD}), q AS (SELECT p.id, p.id % 20 AS k, (p.x % {FOLD} - x_min) / 2 AS u, (y_max - p.y % {FOLD}) / 2 AS v FROM v_pts p JOIN ({EDGE}) e ON e.k = p.id % 20), n AS (SELECT q.*, CAST(floor(v) AS BIGINT) + dr AS r, CAST(floor(u) AS BIGINT) + dc AS c, abs(1 - dr - (v - floor(v))) * abs(1 - dc - (u - floor(u))) AS w FROM q, (SELECT unnest([0, 1]) AS dr), (SELECT unnest([0, 1]) AS dc))
SELECT n.id, round(sum(n.w * coalesce(f.f, 0)), 6) AS score FROM n LEFT JOIN f ON f.k = n.k AND f.row_ = n.r AND f.col_ = n.c GROUP BY n.id""", "v_tri v_pts")
def bilinear_score(spark: SparkSession, sf: str) -> DataFrame:
    """Field value between cells, 0 where nothing is burned."""
    q = points(spark, sf).select("id", (F.col("id") % 20).alias("k"), (F.col("x") % FOLD).alias("x"), (F.col("y") % FOLD).alias("y"))
    return R.scored(q, *placed_field(spark, sf), "k").select("id", F.round("score", 6).alias("score"))


def outlines(spark: SparkSession, sf: str, step: float = 0.5) -> DataFrame:
    """(k, id, x, y, cx, cy, half_x, half_y, ax, ay): outlines of footprints within the folded patches, sampled."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    x0, y0 = F.col("x0") % FOLD, F.col("y0") % FOLD
    v = boxes(spark, sf).select((F.col("id") % 20).alias("k"), "id", (x0 + w / 2).alias("cx"), (y0 + h / 2).alias("cy"), (w / 2).alias("half_x"), (h / 2).alias("half_y"), F.lit(1.0).alias("ax"), F.lit(0.0).alias("ay"), F.explode(F.slice(G.sides(F.slice(G.box_ring(x0, y0, x0 + w, y0 + h), 1, 4)), 1, 4)).alias("e"))
    ex, ey = F.col("e.bx") - F.col("e.ax"), F.col("e.by") - F.col("e.ay")
    n = F.greatest(F.lit(1), F.floor(F.sqrt(ex * ex + ey * ey) / step)).cast("int")
    t = v.withColumn("n", n).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return t.select("k", "id", (F.col("e.ax") + ex * (F.col("j") / F.col("n"))).alias("x"), (F.col("e.ay") + ey * (F.col("j") / F.col("n"))).alias("y"), "cx", "cy", "half_x", "half_y", "ax", "ay")


# Sides of 4 m steps; shifts of -2.5, 0 and 2.5 m within the half spans; templates 0, -.5, .5.
SEARCH = f"""WITH f AS MATERIALIZED ({FIELD}), e AS MATERIALIZED ({EDGE}), b AS (SELECT id, id % 20 AS k, x0 % {FOLD} AS x0, y0 % {FOLD} AS y0, x1 - x0 AS w, y1 - y0 AS h FROM v_box),
s AS (SELECT *, unnest([0, 1, 2, 3]) AS side FROM b), n AS (SELECT *, CAST(greatest(1, floor(CASE WHEN side % 2 = 0 THEN w ELSE h END / 4)) AS BIGINT) AS n FROM s), j AS (SELECT *, unnest(range(n)) / n AS t FROM n),
p AS (SELECT id, k, w, h, x0 + w / 2 AS cx, y0 + h / 2 AS cy, CASE side WHEN 0 THEN x0 + w * t WHEN 1 THEN x0 + w WHEN 2 THEN x0 + w - w * t ELSE x0 END AS x, CASE side WHEN 0 THEN y0 WHEN 1 THEN y0 + h * t WHEN 2 THEN y0 + h ELSE y0 + h - h * t END AS y FROM j),
c AS (SELECT p.*, o, dx, dy, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS r FROM p, (SELECT unnest([0.0, -0.5, 0.5]::DOUBLE[]) AS o), (SELECT unnest([-2.5, 0.0, 2.5]::DOUBLE[]) AS dx), (SELECT unnest([-2.5, 0.0, 2.5]::DOUBLE[]) AS dy) WHERE abs(dx) <= w / 2 + 1e-9 AND abs(dy) <= h / 2 + 1e-9),
m AS (SELECT c.id, c.k, o, dx, dy, (cx + (x - cx) * (greatest(0, r + o) / r) + dx - e.x_min) / 2 AS u, (e.y_max - (cy + (y - cy) * (greatest(0, r + o) / r) + dy)) / 2 AS v FROM c JOIN e ON e.k = c.k),
g AS (SELECT m.*, i, l, CAST(floor(v) AS BIGINT) + i AS r, CAST(floor(u) AS BIGINT) + l AS cc, abs(1 - i - (v - floor(v))) * abs(1 - l - (u - floor(u))) AS wt FROM m, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS l)),
a AS (SELECT g.id, o, dx, dy, round(least(1, greatest(0, 4 * avg(wt * coalesce(f.f, 0)))), 9) AS score FROM g LEFT JOIN f ON f.k = g.k AND f.row_ = g.r AND f.col_ = g.cc GROUP BY g.id, o, dx, dy)
SELECT id, dx, dy, o AS template, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, round(dx * dx + dy * dy + abs(o) * 1e-4, 9), o, dx, dy) AS rn FROM a) WHERE rn = 1"""


@plan(SEARCH, "v_tri v_box")
def grid_search_best(spark: SparkSession, sf: str) -> DataFrame:
    """Coarse shift and outline template of each footprint with the best mean score; of equal ones that with the least movement."""
    best = R.coarse_search(outlines(spark, sf, 4.0), *placed_field(spark, sf), "k", "id", [-2.5, 0.0, 2.5])
    return best.select("id", "dx", "dy", "template", F.round("score", 6).alias("score"))


@plan("SELECT id, CASE WHEN (x1 - x0) * (y1 - y0) < 15 THEN 'small_group_excluded' WHEN id % 97 = 0 THEN 'special_component_group_excluded' END AS reason FROM v_box", "v_box")
def deferred_groups(spark: SparkSession, sf: str) -> DataFrame:
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return boxes(spark, sf).select("id", F.when(area < 15, "small_group_excluded").when(F.col("id") % 97 == 0, "special_component_group_excluded").alias("reason"))


@plan("SELECT id, CAST(t AS INT) AS template, round((x1 - x0) / 2 + o, 6) AS half_x, round((y1 - y0) / 2 + o, 6) AS half_y FROM v_box, (SELECT unnest([0, 1, 2]) AS t, unnest([0.0, -0.5, 0.5]) AS o)", "v_box")
def footprint_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Half spans of a footprint as it is, drawn in and pushed out by half a metre."""
    half = lambda a, b: F.round((F.col(b) - F.col(a)) / 2 + F.col("o"), 6)
    return boxes(spark, sf).select("*", F.posexplode(F.array(F.lit(0.0), F.lit(-0.5), F.lit(0.5))).alias("template", "o")).select("id", "template", half("x0", "x1").alias("half_x"), half("y0", "y1").alias("half_y"))
