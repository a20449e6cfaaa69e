"""Nearest segments, interpolation with fallbacks, area input (G-27, J-16, S-04, X-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.functions import geojson, geometry as G
from cityloom.operators.nearest import nearest_others, nearest_segments
from cityloom.plans.registry import boxes, plan, points
from cityloom.plans.spatial import HITS, SEGMENTS, segments, tops
from cityloom.session import cut


@plan(f"""WITH s AS ({SEGMENTS}), d AS (SELECT q.id, s.user_id, s.pos, q.x, q.y, s.ax, s.ay, s.az, s.bz, s.bx - s.ax AS rx, s.by_ - s.ay AS ry FROM v_pts q CROSS JOIN s),
t AS (SELECT *, least(1, greatest(0, ((x - ax) * rx + (y - ay) * ry) / (rx * rx + ry * ry))) AS t FROM d), e AS (SELECT id, user_id, pos, az, bz, t, round(sqrt((x - ax - rx * t) * (x - ax - rx * t) + (y - ay - ry * t) * (y - ay - ry * t)), 6) AS dist FROM t)
SELECT id, m.user_id, CAST(m.pos AS INT) AS pos, m.dist, round(m.az + (m.bz - m.az) * m.t, 6) AS z FROM (SELECT id, min({{'dist': dist, 'user_id': user_id, 'pos': pos, 't': t, 'az': az, 'bz': bz}}) AS m FROM e GROUP BY id)""", "v_line v_pts")
def nearest_segment(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest segment of each point, however far, and its height at the foot."""
    s = cut(segments(spark, sf))
    best = nearest_segments(points(spark, sf), s, ["user_id", "pos"], 1.0)
    z = F.round(F.col("az") + (F.col("bz") - F.col("az")) * F.col("t"), 6)
    return best.join(s.select("user_id", "pos", "az", "bz").hint("merge"), ["user_id", "pos"]).select("id", "user_id", "pos", "dist", z.alias("z"))


@plan(f"""WITH h AS ({HITS}), m AS (SELECT id, max(height) AS z FROM h GROUP BY id), q AS (SELECT * FROM v_pts WHERE id NOT IN (SELECT id FROM m)), n AS (SELECT q.id, arg_min(p.z, ((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) * 1000000 + p.id) AS z FROM q JOIN v_pts p ON p.id <> q.id GROUP BY q.id)
SELECT q.id, round(coalesce(m.z, n.z, 0), 6) AS z, CASE WHEN m.z IS NOT NULL THEN 'mesh' WHEN n.z IS NOT NULL THEN 'nearest' ELSE 'none' END AS source FROM v_pts q LEFT JOIN m ON m.id = q.id LEFT JOIN n ON n.id = q.id""", "v_pts v_tri")
def interpolated_height(spark: SparkSession, sf: str) -> DataFrame:
    """Height on the mesh, else of the nearest sample; 0 where there is no other sample."""
    p = points(spark, sf)
    mesh = cut(tops(spark, sf).select("id", F.col("height").alias("mz")))
    near = nearest_others(p.join(mesh, "id", "left_anti"), p, 2.0)
    nz = near.join(p.select(F.col("id").alias("near_id"), F.col("z").alias("nz")), "near_id").select("id", "nz")
    j = p.select("id").join(mesh, "id", "left").join(nz, "id", "left")
    source = F.when(F.col("mz").isNotNull(), "mesh").when(F.col("nz").isNotNull(), "nearest").otherwise("none")
    return j.select("id", F.round(F.coalesce("mz", "nz", F.lit(0.0)), 6).alias("z"), source.alias("source"))


@plan("SELECT id, id % 4 = 0 AS valid, CASE WHEN id % 4 = 0 THEN CAST(5 AS INT) END AS positions FROM v_box", "v_box")
def area_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Area input: features as text, three in four of them broken, open or of another kind."""
    ring = G.box_ring(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    good = geojson.feature(ring, id=F.col("id"))
    open_ = geojson.feature(F.slice(ring, 1, 4), id=F.col("id"))
    text = F.when(F.col("id") % 4 == 0, good).when(F.col("id") % 4 == 1, open_).when(F.col("id") % 4 == 2, F.replace(good, F.lit("Polygon"), F.lit("Point"))).otherwise(F.substring(good, 1, 40))
    r = boxes(spark, sf).select("id", geojson.single_polygon(text).alias("r"))
    return r.select("id", F.col("r").isNotNull().alias("valid"), F.when(F.col("r").isNotNull(), F.size(F.get("r", 0))).alias("positions"))
