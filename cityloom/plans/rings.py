"""Ground between buildings and flat land: transition rings, patch planes, base heights (P-10, P-12, P-13, X-05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.functions import geometry as G, stats as S, text
from cityloom.operators.lines import even_walk
from cityloom.operators.nearest import nearest_points
from cityloom.operators.spatial_join import points_in_boxes
from cityloom.plans.registry import boxes, plan, points
from cityloom.plans.spatial import BOX_CELL
from cityloom.session import cut

# The study area's extent grown by t of the transition's width (twice the model's height, 60 m at least), walked at 8 m; the
# ground there is that of the nearest sample, eased to the flat height at t = 1.
RING_SQL = """WITH a AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, 2 * greatest(30, max(z)) AS w FROM v_pts), t AS (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS t), r AS (SELECT t, x0 - w * t AS x0, y0 - w * t AS y0, x1 + w * t - x0 + w * t AS lx, y1 + w * t - y0 + w * t AS ly FROM a, t),
n AS (SELECT *, 2 * (lx + ly) AS total, CAST(floor(2 * (lx + ly) / 8) AS BIGINT) AS n FROM r), k AS (SELECT *, unnest(range(n)) AS k FROM n), d AS (SELECT *, k * (total / n) AS d FROM k),
p AS (SELECT t, k, CASE WHEN d <= lx THEN x0 + d WHEN d <= lx + ly THEN x0 + lx WHEN d <= 2 * lx + ly THEN x0 + lx - (d - lx - ly) ELSE x0 END AS x, CASE WHEN d <= lx THEN y0 WHEN d <= lx + ly THEN y0 + (d - lx) WHEN d <= 2 * lx + ly THEN y0 + ly ELSE y0 + ly - (d - 2 * lx - ly) END AS y FROM d),
b AS (SELECT p.t, p.k, p.x, p.y, min({'d2': round((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y), 6), 'id': s.id, 'z': s.z}) AS m FROM p, v_pts s GROUP BY ALL)
SELECT t, k, round(x, 4) AS x, round(y, 4) AS y, round((0.5 + 0.5 * cos(pi() * t)) * m.z + (0.5 - 0.5 * cos(pi() * t)) * 12, 6) AS z FROM b"""


@plan(RING_SQL, "v_pts")
def transition_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Control rings around the study area whose heights lead from the ground to the flat land."""
    p = points(spark, sf)
    a = p.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), (2 * F.greatest(F.lit(30.0), F.max("z"))).alias("w"))
    d = F.col("w") * F.col("t")
    r = a.withColumn("t", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).select("t", F.posexplode(G.box_ring(F.col("x0") - d, F.col("y0") - d, F.col("x1") + d, F.col("y1") + d)).alias("pos", "p")).select("t", "pos", "p.x", "p.y")
    walked = even_walk(r, "t", 8.0).withColumn("id", F.struct("t", "k"))
    b = p.select(F.col("id").alias("near_id"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    near = nearest_points(walked, b, 16.0, digits=6).join(p.select(F.col("id").alias("near_id"), "z"), "near_id").select("id", "z")
    ease = 0.5 - 0.5 * F.cos(F.pi() * F.col("t"))
    return walked.join(near, "id").select("t", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round((1 - ease) * F.col("z") + ease * 12, 6).alias("z"))


# Samples on a slope with some noise; a patch with fewer than three, or too steep a plane, lies flat at their median.
BASE_SQL = """WITH s AS (SELECT b.id, b.x0, b.y0, b.x1, b.y1, p.x, p.y, p.x * 0.0487 + p.z / 41.7 AS z FROM v_box b JOIN v_pts p ON p.x BETWEEN b.x0 - 6 AND b.x1 + 6 AND p.y BETWEEN b.y0 - 6 AND b.y1 + 6),
r AS (SELECT id, count(*) AS n, covar_pop(x, y) AS cxy, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, z) AS cxz, covar_pop(y, z) AS cyz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, median(z) AS med, any_value(x0) AS x0, any_value(y0) AS y0, any_value(x1) AS x1, any_value(y1) AS y1 FROM s GROUP BY id),
f AS (SELECT *, CASE WHEN n >= 3 AND vx * vy - cxy * cxy > 1e-4 * vx * vy THEN (cxz * vy - cyz * cxy) / (vx * vy - cxy * cxy) END AS a, CASE WHEN n >= 3 AND vx * vy - cxy * cxy > 1e-4 * vx * vy THEN (cyz * vx - cxz * cxy) / (vx * vy - cxy * cxy) END AS b FROM r),
g AS (SELECT *, a IS NOT NULL AND sqrt(a * a + b * b) <= tan(radians(25)) AS ok FROM f), h AS (SELECT id, ok, CASE WHEN ok THEN a ELSE 0 END AS a, CASE WHEN ok THEN b ELSE 0 END AS b, CASE WHEN ok THEN mz - a * mx - b * my ELSE med END AS c, x0, y0, x1, y1 FROM g)
SELECT id, CASE WHEN ok THEN 'plane' ELSE 'median' END AS source, round(least(a * x0 + b * y0, a * x1 + b * y0, a * x0 + b * y1, a * x1 + b * y1) + c, 6) AS ground, round(greatest(a * x0 + b * y0, a * x1 + b * y0, a * x0 + b * y1, a * x1 + b * y1) + c, 6) AS top FROM h"""


@plan(BASE_SQL, "v_box v_pts")
def patch_base_planes(spark: SparkSession, sf: str) -> DataFrame:
    """Plane of the ground samples within 6 m of a patch, else their median, and the outline's lowest and highest base."""
    p = points(spark, sf).select("x", "y", (F.col("x") * 0.0487 + F.col("z") / 41.7).alias("z"))
    v = boxes(spark, sf).select("id", "x0", "y0", "x1", "y1")
    # points of one place meet a patch once, and only their sums are shuffled; places are counted from its corner
    places = p.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.count("z").alias("k"), F.coalesce(F.sum("z"), F.lit(0.0)).alias("z"))
    met = points_in_boxes(places, v, BOX_CELL, pad=6.0)
    sums = S.plane_sums(F.col("n"), F.col("k"), F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), F.col("z"))
    f = met.groupBy("id", "x0", "y0", "x1", "y1").agg(*sums).select("id", "x0", "y0", "x1", "y1", S.plane_of_sums().alias("q"))
    f = cut(f.withColumn("p", F.when(F.col("q").isNotNull(), F.struct("q.a", "q.b", (F.col("q.c") - F.col("q.a") * F.col("x0") - F.col("q.b") * F.col("y0")).alias("c")))).drop("q"))
    # the few without a plane are searched again
    flat = points_in_boxes(p.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n")), f.filter("p IS NULL").select("id", "x0", "y0", "x1", "y1"), BOX_CELL, pad=6.0)
    f = f.join(flat.groupBy("id").agg(F.percentile("z", 0.5, F.col("n")).alias("m")).hint("merge"), "id", "left")
    a, b, c = F.coalesce("p.a", F.lit(0.0)), F.coalesce("p.b", F.lit(0.0)), F.coalesce("p.c", "m")
    heights = F.transform(F.slice(G.box_ring(*(F.col(k) for k in ("x0", "y0", "x1", "y1"))), 1, 4), lambda q: a * q["x"] + b * q["y"] + c)
    return f.select("id", F.when(F.col("p").isNull(), "median").otherwise("plane").alias("source"), F.round(F.array_min(heights), 6).alias("ground"), F.round(F.array_max(heights), 6).alias("top"))


@plan("WITH v AS (SELECT id, 0.01 * x0 + 0.02 * y0 AS ground, CASE WHEN id % 3 = 0 THEN h END AS height, CASE WHEN id % 3 = 1 THEN id % 7 END AS levels FROM v_box) SELECT id, CASE WHEN height > 0 THEN height WHEN levels > 0 THEN levels * 3.5 ELSE 10.5 END AS relative, CASE WHEN height > 0 THEN 'osm_height' WHEN levels > 0 THEN 'osm_levels' ELSE 'osm_default' END AS source, round(ground + CASE WHEN height > 0 THEN height WHEN levels > 0 THEN levels * 3.5 ELSE 10.5 END, 6) AS roof_z FROM v", "v_box")
def tagged_roof_heights(spark: SparkSession, sf: str) -> DataFrame:
    """Roofs from tags: the lowest ground under a footprint plus its tagged height, storeys or the default."""
    ring = F.slice(G.box_ring(*(F.col(k) for k in ("x0", "y0", "x1", "y1"))), 1, 4)
    ground = F.array_min(F.transform(ring, lambda p: 0.01 * p["x"] + 0.02 * p["y"]))
    t = text.height(F.when(F.col("id") % 3 == 0, F.col("h").cast("string")), F.when(F.col("id") % 3 == 1, (F.col("id") % 7).cast("string")))
    v = boxes(spark, sf).select("id", ground.alias("ground"), t.alias("t"))
    return v.select("id", F.col("t.z").alias("relative"), F.col("t.source").alias("source"), F.round(F.col("ground") + F.col("t.z"), 6).alias("roof_z"))
