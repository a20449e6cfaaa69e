"""Ground as one triangulation, and heights on it (G-27, P-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.operators import triangulation as tr
from cityloom.plans.registry import boxes, plan, points
from cityloom.session import cut

#: The flat frame around the surveyed ground: a square with an anchor every STEP metres.
LOW, HIGH, STEP = -128, 1152, 64

FRAME = f"""
  SELECT CAST({LOW} + {STEP} * (k % 20) AS DOUBLE) AS u, k // 20 AS side, -1 - k AS id FROM range(80) t(k)
"""
VERTICES = f"""
v AS (
  SELECT min(id) AS id, x, y, arg_min(z, id) AS z FROM v_pts GROUP BY x, y
), f AS (
  SELECT id,
    CASE side WHEN 0 THEN u WHEN 1 THEN {HIGH} WHEN 2 THEN {LOW + HIGH} - u ELSE {LOW} END AS x,
    CASE side WHEN 0 THEN {LOW} WHEN 1 THEN u WHEN 2 THEN {HIGH} ELSE {LOW + HIGH} - u END AS y
  FROM ({FRAME})
)"""


def frame(spark: SparkSession) -> DataFrame:
    """Anchors (id, x, y, z) around the ground, counter-clockwise from the lower left corner, at height 0."""
    k = F.col("k")
    u, side = (LOW + STEP * (k % 20)).cast("double"), F.floor(k / 20)
    low, high, back = F.lit(float(LOW)), F.lit(float(HIGH)), LOW + HIGH - u
    x = F.when(side == 0, u).when(side == 1, high).when(side == 2, back).otherwise(low)
    y = F.when(side == 0, low).when(side == 1, u).when(side == 2, high).otherwise(back)
    return spark.range(80).withColumnRenamed("id", "k").select((-1 - k).alias("id"), x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))


def ground(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices (id, x, y, z): surveyed points, one a place, and the frame."""
    p = points(spark, sf).groupBy("x", "y").agg(F.min("id").alias("id"), F.min_by("z", "id").alias("z"))
    return cut(p.select("id", "x", "y", "z").union(frame(spark)))


MESH_SQL = f"""
WITH {VERTICES.strip()}
SELECT CAST(count(*) AS BIGINT) AS vertices, CAST(2 * count(*) - 2 - 80 AS BIGINT) AS faces, CAST({(HIGH - LOW) ** 2} AS DOUBLE) AS area,
  CAST(80 AS BIGINT) AS boundary_edges, CAST(0 AS BIGINT) AS overused_edges, CAST(0 AS BIGINT) AS unfit_edges, min(z) AS lowest, max(z) AS highest
FROM (SELECT id, z FROM v UNION ALL SELECT id, 0 FROM f)"""


@plan(MESH_SQL, "v_pts")
def terrain_mesh(spark: SparkSession, sf: str) -> DataFrame:
    """What one triangulation of the ground must satisfy: Euler's count of faces, the frame's area, a boundary of frame edges only, and no corner within the circle of the face across an edge."""
    v = ground(spark, sf)
    t = cut(tr.with_corners(tr.delaunay(v), v, "x", "y", "z"))
    xs, ys, zs = ([F.col(f"{n}_{c}") for c in "abc"] for n in "xyz")
    area = F.abs(tr.cross(xs[1] - xs[0], ys[1] - ys[0], xs[2] - xs[0], ys[2] - ys[0])) / 2
    faces = cut(t.withColumn("area", area).filter("area > 0.01"))
    whole = faces.agg(F.count(F.lit(1)).alias("faces"), F.round(F.sum("area"), 3).alias("area"), F.min(F.least(*zs)).alias("lowest"), F.max(F.greatest(*zs)).alias("highest"))

    place = lambda c: F.struct(F.col(f"x_{c}").alias("x"), F.col(f"y_{c}").alias("y"))
    side = lambda a, b, c: F.struct(F.col(a).alias("p"), F.col(b).alias("q"), place(a).alias("pp"), place(b).alias("pq"), place(c).alias("o"))
    edges = faces.select(F.explode(F.array(side("a", "b", "c"), side("b", "c", "a"), side("a", "c", "b"))).alias("e")).select("e.*")
    met = edges.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n"), F.first("pp").alias("pp"), F.first("pq").alias("pq"), F.min("o").alias("o1"), F.max("o").alias("o2"))
    # the angles at both corners across an edge add up to half a turn at most
    dot = lambda o: (F.col("pp.x") - o["x"]) * (F.col("pq.x") - o["x"]) + (F.col("pp.y") - o["y"]) * (F.col("pq.y") - o["y"])
    turn = lambda o: F.abs(tr.cross(F.col("pp.x") - o["x"], F.col("pp.y") - o["y"], F.col("pq.x") - o["x"], F.col("pq.y") - o["y"]))
    both = F.atan2(turn(F.col("o1")), dot(F.col("o1"))) + F.atan2(turn(F.col("o2")), dot(F.col("o2")))
    told = met.agg(F.count_if(F.col("n") == 1).alias("boundary_edges"), F.count_if(F.col("n") > 2).alias("overused_edges"), F.count_if((F.col("n") == 2) & (both > 3.1416)).alias("unfit_edges"))
    parts = v.agg(F.count(F.lit(1)).alias("vertices")).unionByName(whole, True).unionByName(told, True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


SAMPLES = "SELECT id, (x0 + x1) * 1.5e0 - 190 AS x, (y0 + y1) * 1.5e0 - 190 AS y FROM v_box"
HEIGHTS_SQL = f"""
WITH {VERTICES.strip()}, g AS (
  SELECT id, x, y, x / 4 - y / 8 + 40 AS z FROM (SELECT id, x, y FROM v UNION ALL SELECT id, x, y FROM f)
), s AS (
  {SAMPLES}
), o AS (
  SELECT * FROM s WHERE NOT (x BETWEEN {LOW} AND {HIGH} AND y BETWEEN {LOW} AND {HIGH})
), n AS (
  SELECT o.id, arg_min(g.z, struct_pack(d2 := (o.x - g.x) * (o.x - g.x) + (o.y - g.y) * (o.y - g.y), id := g.id)) AS z
  FROM o CROSS JOIN g GROUP BY o.id
)
SELECT s.id, CAST(round(coalesce(n.z, s.x / 4 - s.y / 8 + 40), 6) AS DOUBLE) AS z, CASE WHEN n.z IS NULL THEN 'linear' ELSE 'nearest' END AS source
FROM s LEFT JOIN n ON n.id = s.id"""


@plan(HEIGHTS_SQL, "v_pts v_box")
def terrain_heights(spark: SparkSession, sf: str) -> DataFrame:
    """Heights at samples on and beside the triangulated ground; on a plane, so that interpolation is exact whatever the triangles."""
    v = ground(spark, sf).withColumn("z", F.col("x") / 4 - F.col("y") / 8 + 40)
    at = lambda c: (F.col(f"{c}0") + F.col(f"{c}1")) * 1.5 - 190
    s = boxes(spark, sf).select("id", at("x").alias("x"), at("y").alias("y"))
    return tr.heights(s, v, tr.delaunay(v), 16.0).select("id", F.round("z", 6).alias("z"), "source")
