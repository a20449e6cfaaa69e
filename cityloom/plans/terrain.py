"""Terrain, domain and flow-case plans, and the supporting rows (P-09 to P-19, X rows, A-05 and later)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.functions import geo, geometry as G, text
from cityloom.operators.ordering import numbered
from cityloom.operators.spatial_join import points_in_boxes
from cityloom.plans.registry import boxes, lines, plan, points, table, triangles
from cityloom.plans.spatial import BOX_CELL, HITS, tops


def grid(spark: SparkSession, x0: int, x1: int, y0: int, y1: int, step: int) -> DataFrame:
    """Regular points; columns are made by the rows' tasks, no grid is built on the driver."""
    columns = (x1 - x0) // step + 1
    total = columns * ((y1 - y0) // step + 1)
    i = F.col("id")
    return spark.range(total).select(i.alias("cell"), (x0 + (i % columns) * step).cast("double").alias("x"), (y0 + F.floor(i / columns) * step).cast("double").alias("y"))


GRID = "SELECT i AS cell, CAST((i % 101) * 10 AS DOUBLE) AS x, CAST((i // 101) * 10 AS DOUBLE) AS y FROM (SELECT unnest(range(101 * 100)) AS i)"


@plan(f"WITH g AS ({GRID}), f AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM v_box b WHERE g.x BETWEEN b.x0 AND b.x1 AND g.y BETWEEN b.y0 AND b.y1)), h AS (SELECT f.cell, max(t.z + t.ln * ((f.x - t.x0) / t.s)) AS z FROM f JOIN v_tri t ON f.x BETWEEN t.x0 AND t.x0 + t.s AND f.y BETWEEN t.y0 AND t.y0 + t.s AND (f.x - t.x0) / t.s + (f.y - t.y0) / t.s <= 1 - 1e-9 GROUP BY f.cell) SELECT cell, round(z, 6) AS z FROM h WHERE z > 0", "v_box v_tri")
def terrain_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Mesh heights on a regular grid outside buildings."""
    free = points_in_boxes(grid(spark, 0, 1000, 0, 990, 10), boxes(spark, sf), BOX_CELL, how="left_anti")
    t = triangles(spark, sf).withColumns({"tx1": F.col("x0") + F.col("s"), "ty1": F.col("y0") + F.col("s")})
    met = points_in_boxes(free, t, 16.0, box=("x0", "y0", "tx1", "ty1"))
    u, v = (F.col("x") - F.col("x0")) / F.col("s"), (F.col("y") - F.col("y0")) / F.col("s")
    h = met.filter(u + v <= 1 - 1e-9).withColumn("h", F.col("z") + F.col("ln") * u).groupBy("cell").agg(F.max("h").alias("z"))
    return h.filter("z > 0").select("cell", F.round("z", 6).alias("z"))


@plan("SELECT id, CAST(ring AS INT) AS ring, round(z + (12 - z) * (0.5 - 0.5 * cos(pi() * ring / 4)), 6) AS z FROM v_pts, (SELECT unnest([1, 2, 3]) AS ring)", "v_pts")
def ease_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Heights of three rings between the terrain and the flat ground, eased by a cosine."""
    p = points(spark, sf).withColumn("ring", F.explode(F.sequence(F.lit(1), F.lit(3))))
    e = 0.5 - 0.5 * F.cos(F.pi() * F.col("ring") / 4)
    return p.select("id", "ring", F.round(F.col("z") + (12 - F.col("z")) * e, 6).alias("z"))


@plan("SELECT x, y FROM (SELECT CAST((i % 40) * 25 + 12.5 AS DOUBLE) AS x, CAST((i // 40) * 25 + 12.5 AS DOUBLE) AS y FROM (SELECT unnest(range(1600)) AS i)) WHERE NOT (x BETWEEN 200 AND 800 AND y BETWEEN 200 AND 800)")
def flat_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """A grid of half-offset points in the domain outside the transition."""
    g = grid(spark, 0, 975, 0, 975, 25).select((F.col("x") + 12.5).alias("x"), (F.col("y") + 12.5).alias("y"))
    return g.filter(~(F.col("x").between(200, 800) & F.col("y").between(200, 800)))


@plan("SELECT event_id, round(1.5 * pow(0.1 * value, 2), 8) AS k, round(pow(0.09, 0.75) * pow(1.5 * pow(0.1 * value, 2), 1.5) / 10, 8) AS epsilon FROM events")
def inlet_turbulence(spark: SparkSession, sf: str) -> DataFrame:
    k = 1.5 * F.pow(0.1 * F.col("value"), 2)
    return table(spark, sf, "events").select("event_id", F.round(k, 8).alias("k"), F.round(F.pow(F.lit(0.09), F.lit(0.75)) * F.pow(k, F.lit(1.5)) / 10, 8).alias("epsilon"))


@plan("SELECT id, round((x0 + x1) / 2 * 0.01 + (y0 + y1) / 2 * 0.02 + 3 + h, 6) AS top, round(least(x0 * 0.01 + y0 * 0.02, x1 * 0.01 + y0 * 0.02, x0 * 0.01 + y1 * 0.02, x1 * 0.01 + y1 * 0.02) + 3, 6) AS ground FROM v_box", "v_box")
def base_heights(spark: SparkSession, sf: str) -> DataFrame:
    """A patch's plane over its outline: lowest vertex as ground, centre plus height as top."""
    z = lambda x, y: x * 0.01 + y * 0.02 + 3
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    ring = F.slice(G.box_ring(x0, y0, x1, y1), 1, 4)
    return boxes(spark, sf).select("id", F.round(z((x0 + x1) / 2, (y0 + y1) / 2) + F.col("h"), 6).alias("top"), F.round(F.array_min(F.transform(ring, lambda p: z(p["x"], p["y"]))), 6).alias("ground"))


# covered: one solid over floor 0.5, interior 3 and cover 0.3; viaduct: the floor; uncovered: floor, and cover above the open interior.
SLABS_SQL = """WITH b AS (SELECT id, h, CASE id % 3 WHEN 0 THEN 'covered' WHEN 1 THEN 'viaduct' ELSE 'uncovered' END AS kind FROM v_box)
SELECT id, CAST(0 AS INT) AS part, kind, h AS low, h + 3.8 AS high FROM b WHERE kind = 'covered'
UNION ALL SELECT id, 0, kind, h, h + 0.5 FROM b WHERE kind <> 'covered'
UNION ALL SELECT id, 1, kind, h + 3.5, h + 3.8 FROM b WHERE kind = 'uncovered'"""


@plan(f"SELECT id, part, kind, low, round(high, 6) AS high FROM ({SLABS_SQL})", "v_box")
def extrude_by_bridge(spark: SparkSession, sf: str) -> DataFrame:
    """Solids of a walkway above its base: one through all if covered, the floor of a viaduct, else floor and cover with air between."""
    kind = F.when(F.col("id") % 3 == 0, "covered").when(F.col("id") % 3 == 1, "viaduct").otherwise("uncovered")
    v = boxes(spark, sf).select("id", F.col("h").alias("base"), kind.alias("kind"))
    slabs = G.bridge_slabs(F.col("kind"), F.col("base"), floor=0.5, interior=3.0, cover=0.3)
    return v.select("id", "kind", F.posexplode(slabs).alias("part", "s")).select("id", "part", "kind", F.col("s.low").alias("low"), F.round("s.high", 6).alias("high"))


@plan("SELECT (min(x0) + max(x1)) / 2 AS ox, (min(y0) + max(y1)) / 2 AS oy, CAST(count(*) AS BIGINT) AS n FROM v_box", "v_box")
def shared_origin(spark: SparkSession, sf: str) -> DataFrame:
    return boxes(spark, sf).agg(((F.min("x0") + F.max("x1")) / 2).alias("ox"), ((F.min("y0") + F.max("y1")) / 2).alias("oy"), F.count(F.lit(1)).alias("n"))


REGION_SQL = """WITH b AS (SELECT id, x0, y0, x1 - x0 AS sx, y1 - y0 AS sy, CASE WHEN id % 11 = 0 THEN 0 ELSE h END AS sz, CASE WHEN id % 13 = 0 THEN NULL ELSE (id % 90) * pi() / 180 END AS t FROM v_box),
n AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM b WHERE sx > 0 AND sy > 0 AND sz > 0 AND t IS NOT NULL)
SELECT id, 'walkwayBox' || n AS name, printf('origin (%.2f %.2f 0.00); span (%.2f %.2f %.2f)', x0, y0, sx, sy, sz) AS place, printf('e1 (%.8f %.8f 0.00000000); e3 (0.00000000 0.00000000 1.00000000)', cos(t), sin(t)) AS axes, 'levels ((1E15 5))' AS levels FROM n"""


@plan(REGION_SQL, "v_box")
def refinement_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Rotated refinement boxes: those with finite numbers and positive spans, named in order, written out."""
    t = F.when(F.col("id") % 13 != 0, F.radians((F.col("id") % 90).cast("double")))
    v = boxes(spark, sf).select("id", F.array("x0", "y0", F.lit(0.0)).alias("origin"), F.array(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.when(F.col("id") % 11 == 0, 0.0).otherwise(F.col("h"))).alias("span"), F.array(F.cos(t), F.sin(t), F.lit(0.0)).alias("e1"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("e3"), F.lit(5).alias("level"))
    ok = v.filter(G.finite_vector(F.col("origin")) & G.finite_vector(F.col("span")) & G.finite_vector(F.col("e1")) & G.finite_vector(F.col("e3")) & F.forall("span", lambda s: s > 0))
    three = lambda c, d: F.concat(F.lit("("), F.array_join(F.transform(c, lambda x: F.format_string(f"%.{d}f", x)), " "), F.lit(")"))
    place = F.concat(F.lit("origin "), three("origin", 2), F.lit("; span "), three("span", 2))
    axes = F.concat(F.lit("e1 "), three("e1", 8), F.lit("; e3 "), three("e3", 8))
    n = numbered(ok, ["id"], "n")
    return n.select("id", F.concat(F.lit("walkwayBox"), F.col("n").cast("string")).alias("name"), place.alias("place"), axes.alias("axes"), F.format_string("levels ((1E15 %d))", "level").alias("levels"))


@plan("SELECT p_partkey AS id, 'wall ' || p_size || ' z ' || p_brand || ' {{missing}}' AS text, true AS leftover FROM part")
def case_template(spark: SparkSession, sf: str) -> DataFrame:
    """Placeholders filled in, those left over reported."""
    from functools import reduce

    fields = {"size": F.col("p_size").cast("string"), "brand": F.col("p_brand")}
    filled = reduce(lambda t, kv: F.replace(t, F.lit("{{" + kv[0] + "}}"), kv[1]), fields.items(), F.lit("wall {{size}} z {{brand}} {{missing}}"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), filled.alias("text")).withColumn("leftover", F.col("text").contains("{{"))


@plan("SELECT event_id, json_extract_string(props, '$.k') IS NULL AS no_k, json_valid(props) AS valid FROM events")
def props_validation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").isNull().alias("no_k"), F.try_parse_json("props").isNotNull().alias("valid"))


@plan("SELECT user_id, array_agg({'x': round(x + 0.0, 6), 'v': value}.v ORDER BY ts, event_id) AS speeds, round(min(value), 6) AS low, round(max(value), 6) AS high, CAST(count(*) AS BIGINT) AS vertices FROM (SELECT *, (event_id * 37) % 1009 AS x FROM events WHERE value >= 0) GROUP BY user_id HAVING count(*) >= 2")
def streamline_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Valid stream lines with their speeds in order."""
    e = table(spark, sf, "events").filter("value >= 0")
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("p"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.count(F.lit(1)).alias("vertices"))
    return g.filter("vertices >= 2").select("user_id", F.transform("p", lambda x: x["value"]).alias("speeds"), "low", "high", "vertices")


@plan(f"WITH h AS ({HITS}), m AS (SELECT id, max(height) AS z FROM h GROUP BY id) SELECT id % 20 AS k, CAST(count(*) AS BIGINT) AS n, round(min(z), 6) AS low, round(max(z), 6) AS high FROM m GROUP BY 1", "v_pts v_tri")
def sampled_ranges(spark: SparkSession, sf: str) -> DataFrame:
    m = tops(spark, sf).select("id", F.col("height").alias("z"))
    return m.groupBy((F.col("id") % 20).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("z"), 6).alias("low"), F.round(F.max("z"), 6).alias("high"))


@plan("SELECT user_id, round(x + 300 * sin(radians(d)), 6) AS ex, round(y + 300 * cos(radians(d)), 6) AS ey FROM (SELECT user_id, x, y, (user_id * 17) % 360 AS d FROM v_line WHERE pos = 1)", "v_line")
def wind_arrows(spark: SparkSession, sf: str) -> DataFrame:
    d = (F.col("user_id") * 17) % 360
    a = geo.from_flow_axes(F.lit(300.0), F.lit(0.0), d)
    return lines(spark, sf).filter("pos = 1").select("user_id", F.round(F.col("x") + a["x"], 6).alias("ex"), F.round(F.col("y") + a["y"], 6).alias("ey"))


@plan("SELECT id, CASE WHEN h > 40 THEN 'high' WHEN h > 20 THEN 'middle' ELSE 'low' END AS cls, printf('%.7f,%.7f', x0 / 7, y0 / 7) AS node_key FROM v_box", "v_box")
def point_keys(spark: SparkSession, sf: str) -> DataFrame:
    cls = F.when(F.col("h") > 40, "high").when(F.col("h") > 20, "middle").otherwise("low")
    return boxes(spark, sf).select("id", cls.alias("cls"), text.point_key(F.col("x0") / 7, F.col("y0") / 7, 7).alias("node_key"))
