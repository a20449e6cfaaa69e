"""Roof planes of footprints (P-05, W-01, W-02, X-16 to X-19, X-55)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom import jts
from cityloom.functions import geometry as G
from cityloom.operators import roofs as R
from cityloom.plans.overlay import shapes
from cityloom.plans.registry import plan
from cityloom.plans.spatial import box, box_pairs

# Every footprint is a range, and what others share with it are flat pieces of roof at their heights; the ground rises by 1 in 100
# eastwards and 1 in 200 northwards.  Heights are whole metres, so that a band holds one height, and corners too, so that cells tell areas.
ROOF_SQL = """WITH r AS (SELECT *, x0 * 0.01 + y0 * 0.005 AS terrain FROM v_box),
q AS (SELECT r.id, r.terrain, b.h AS z, greatest(r.x0, b.x0) AS x0, greatest(r.y0, b.y0) AS y0, least(r.x1, b.x1) AS x1, least(r.y1, b.y1) AS y1 FROM r JOIN v_box b ON r.x0 < b.x1 AND b.x0 < r.x1 AND r.y0 < b.y1 AND b.y0 < r.y1),
k AS (SELECT * FROM q WHERE z > terrain + 2), c AS (SELECT id, z, count(*) AS n, sum((x1 - x0) * (y1 - y0)) AS area, any_value(terrain) AS terrain FROM k GROUP BY id, z HAVING count(*) >= 2),
x AS (SELECT DISTINCT id, z, i, unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT))) AS j FROM (SELECT *, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT))) AS i FROM k SEMI JOIN c ON c.id = k.id AND c.z = k.z)),
v AS (SELECT id, z, count(*) AS visible FROM (SELECT id, i, j, max(z) AS z FROM x GROUP BY id, i, j) GROUP BY id, z), a AS (SELECT c.*, coalesce(v.visible, 0) AS visible FROM c LEFT JOIN v ON v.id = c.id AND v.z = c.z),
g AS (SELECT *, max(z) OVER (PARTITION BY id) - min(z) OVER (PARTITION BY id) AS span, count(*) OVER (PARTITION BY id) AS many FROM a WHERE visible >= 1), o AS (SELECT *, many >= 2 AND span >= 8 AND z <= terrain + 6 AS near FROM g),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY near, visible DESC, n DESC, area DESC, z) AS rn FROM o) WHERE rn = 1), t AS (SELECT id, count(*) AS clusters, sum(visible) AS total FROM a GROUP BY id)
SELECT r.id, m.id IS NOT NULL AS resolved, m.z AS roof_z, CASE WHEN m.id IS NULL THEN 'no_valid_cluster' END AS reason, CAST(coalesce(t.clusters, 0) AS BIGINT) AS clusters, CAST(coalesce(m.visible, 0) AS DOUBLE) AS visible_area, round(coalesce(m.visible / t.total, 0), 6) AS area_ratio FROM r LEFT JOIN m ON m.id = r.id LEFT JOIN t ON t.id = r.id"""


@plan(ROOF_SQL, "v_box")
def roof_planes(spark: SparkSession, sf: str) -> DataFrame:
    """The roof height of every footprint from the pieces over it, or why there is none."""
    ranges = shapes(spark, sf).select("id", "g", (F.col("x0") * 0.01 + F.col("y0") * 0.005).alias("terrain"))
    a, b = box("a_"), box("b_")
    inner = [F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])]
    met = box_pairs(spark, sf).withColumns(dict(zip(("x0", "y0", "x1", "y1"), inner))).filter("x0 < x1 AND y0 < y1")
    own = shapes(spark, sf).select("id", F.col("id").alias("piece"), F.col("h").alias("z"), "x0", "y0", "x1", "y1")
    both = met.select(F.col("a_id").alias("id"), F.col("b_id").alias("piece"), F.col("b_h").alias("z"), "x0", "y0", "x1", "y1").union(met.select("b_id", "a_id", "a_h", "x0", "y0", "x1", "y1")).union(own)
    pieces = both.join(ranges.select("id", "terrain"), "id").filter(F.col("z") > F.col("terrain") + R.CLEARANCE)
    pieces = pieces.select("id", "piece", "z", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"), jts.polygon_text(G.box_ring(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))).alias("g"))
    found = R.clusters(pieces, ranges, "id", "piece")
    out = R.roof_planes(found, ranges, "id")
    return out.select("id", "resolved", "roof_z", "reason", "clusters", F.round("visible_area", 6).alias("visible_area"), F.round("area_ratio", 6).alias("area_ratio"))
