"""Scalar functions: projections, tiles, parsing, colours, ring geometry (T, S and G rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.functions import geo, geometry as G, text
from cityloom.plans.registry import boxes, plan, points, table, triangles


# WGS84 to the grid step by step: geocentric, datum shift, geodetic on the local ellipsoid, transverse Mercator.
GRID_SQL = """WITH p AS (SELECT id, radians(114.0::DOUBLE + x / 5000) AS lon, radians(22.2::DOUBLE + y / 5000) AS lat FROM v_pts),
k AS (SELECT 6378137.0::DOUBLE AS wa, 1 / 298.257223563::DOUBLE AS wf, 6378388.0::DOUBLE AS ia, 1 / 297.0::DOUBLE AS if_, radians(0.067753::DOUBLE / 3600) AS rx, radians(-2.24365::DOUBLE / 3600) AS ry, radians(-1.15883::DOUBLE / 3600) AS rz, 1 - 1.09425e-6 AS m, radians(22 + 18 / 60 + 43.68::DOUBLE / 3600) AS lat0, radians(114 + 10 / 60 + 42.80::DOUBLE / 3600) AS lon0),
g AS (SELECT p.id, p.lat AS wlat, k.*, 2 * wf - wf * wf AS we2, 2 * if_ - if_ * if_ AS e2, wa / sqrt(1 - (2 * wf - wf * wf) * pow(sin(lat), 2)) AS nu, lat, lon FROM p, k),
c AS (SELECT *, (nu * cos(lat) * cos(lon) + 162.619) / m AS u, (nu * cos(lat) * sin(lon) + 276.959) / m AS v, (nu * (1 - we2) * sin(lat) + 161.764) / m AS w FROM g),
s AS (SELECT *, u + rz * v - ry * w AS sx, -rz * u + v + rx * w AS sy, ry * u - rx * v + w AS sz FROM c),
d AS (SELECT *, atan2(sy, sx) AS lam, sqrt(sx * sx + sy * sy) AS r, atan2(sz * ia, sqrt(sx * sx + sy * sy) * ia * (1 - if_)) AS t0 FROM s),
e AS (SELECT *, atan2(sz + e2 / (1 - e2) * ia * (1 - if_) * pow(sin(t0), 3), r - e2 * ia * pow(cos(t0), 3)) AS phi, e2 / (1 - e2) AS ep FROM d),
f AS (SELECT *, ia / sqrt(1 - e2 * pow(sin(phi), 2)) AS n, pow(tan(phi), 2) AS t, ep * pow(cos(phi), 2) AS cc, (lam - lon0) * cos(phi) AS a, 1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * pow(e2, 3) / 256 AS m0, 3.0 / 8 * (e2 + e2 * e2 / 4 + 15 * pow(e2, 3) / 128) AS m2, 15.0 / 256 * (e2 * e2 + 3 * pow(e2, 3) / 4) AS m4, 35 * pow(e2, 3) / 3072 AS m6 FROM e)
SELECT id, round(836694.05 + n * (a + (1 - t + cc) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * cc - 58 * ep) * pow(a, 5) / 120), 3) AS easting,
round(819069.80 + ia * (m0 * (phi - lat0) - m2 * (sin(2 * phi) - sin(2 * lat0)) + m4 * (sin(4 * phi) - sin(4 * lat0)) - m6 * (sin(6 * phi) - sin(6 * lat0))) + n * tan(phi) * (a * a / 2 + (5 - t + 9 * cc + 4 * cc * cc) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * cc - 330 * ep) * pow(a, 6) / 720), 3) AS northing, round(cos(wlat), 9) AS z_scale FROM f"""


@plan(GRID_SQL, "v_pts")
def projection(spark: SparkSession, sf: str) -> DataFrame:
    """Grid coordinates of points around the study area (the way back is tested as a round trip)."""
    lat = F.lit(22.2) + F.col("y") / 5000
    g = points(spark, sf).select("id", lat.alias("lat"), geo.to_grid(F.lit(114.0) + F.col("x") / 5000, lat).alias("g"))
    return g.select("id", F.round("g.x", 3).alias("easting"), F.round("g.y", 3).alias("northing"), F.round(geo.mercator_scale(F.col("lat")), 9).alias("z_scale"))


@plan()
def unprojection(spark: SparkSession, sf: str) -> DataFrame:
    """Grid metres back to degrees."""
    b = points(spark, sf).select("id", geo.from_grid(F.col("x") + 834000, F.col("y") + 815000).alias("b"))
    return b.select("id", F.round("b.lon", 8).alias("lon"), F.round("b.lat", 8).alias("lat"))


# to the grid, whose SQL is that of `projection`, and back again
@plan("SELECT id, CAST(round(114 + x / 5000, 7) AS DOUBLE) AS lon, CAST(round(22.2e0 + y / 5000, 7) AS DOUBLE) AS lat FROM v_pts", "v_pts")
def projected_back(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees of the grid coordinates that `projection` gives."""
    g = points(spark, sf).select("id", geo.to_grid(F.lit(114.0) + F.col("x") / 5000, F.lit(22.2) + F.col("y") / 5000).alias("g"))
    b = g.select("id", geo.from_grid(F.col("g.x"), F.col("g.y")).alias("b"))
    return b.select("id", F.round("b.lon", 7).alias("lon"), F.round("b.lat", 7).alias("lat"))


@plan("SELECT id, round(degrees(x * 1000 / 6378137.0), 9) AS lon, round(degrees(atan(sinh(y * 1000 / 6378137.0))), 9) AS lat FROM v_pts", "v_pts")
def web_mercator(spark: SparkSession, sf: str) -> DataFrame:
    ll = geo.from_mercator(F.col("x") * 1000, F.col("y") * 1000)
    return points(spark, sf).select("id", F.round(ll["lon"], 9).alias("lon"), F.round(ll["lat"], 9).alias("lat"))


@plan("SELECT id, 2 * x - y + 5 AS tx, x + 3 * y - 7 AS ty, z + 0.5 * x AS tz FROM v_pts", "v_pts")
def tile_transform(spark: SparkSession, sf: str) -> DataFrame:
    m = [2.0, 1.0, 0.5, 0.0, -1.0, 3.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 5.0, -7.0, 0.0, 1.0]
    tx, ty, tz = geo.transformed(m, F.col("x"), F.col("y"), F.col("z"))
    return points(spark, sf).select("id", tx.alias("tx"), ty.alias("ty"), tz.alias("tz"))


@plan("SELECT id, round(2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)), 4) AS walk, round(2 * 6371008.8 * atan2(sqrt(h), sqrt(1 - h)), 4) AS attach FROM (SELECT id, pow(sin(radians(y / 10000) / 2), 2) + cos(radians(22.2)) * cos(radians(22.2 + y / 10000)) * pow(sin(radians(x / 10000) / 2), 2) AS h FROM v_pts)", "v_pts")
def haversine_distances(spark: SparkSession, sf: str) -> DataFrame:
    at = (F.lit(114.0), F.lit(22.2), F.lit(114.0) + F.col("x") / 10000, F.lit(22.2) + F.col("y") / 10000)
    return points(spark, sf).select("id", F.round(geo.haversine(*at, geo.WALK_RADIUS), 4).alias("walk"), F.round(geo.haversine(*at, geo.ATTACH_RADIUS), 4).alias("attach"))


@plan("SELECT id, ((id * 7 - 5000) % 360 + 360) % 360 + 0.0 AS angle, round(x * sin(radians(id % 360)) + y * cos(radians(id % 360)), 6) AS along, round(x * cos(radians(id % 360)) - y * sin(radians(id % 360)), 6) AS across FROM v_pts", "v_pts")
def flow_basis(spark: SparkSession, sf: str) -> DataFrame:
    a = geo.flow_axes(F.col("x"), F.col("y"), F.col("id") % 360)
    return points(spark, sf).select("id", geo.normal_angle((F.col("id") * 7 - 5000).cast("double")).alias("angle"), F.round(a["along"], 6).alias("along"), F.round(a["across"], 6).alias("across"))


@plan("SELECT id, round(x * cos(radians(t)) - y * sin(radians(t)) + 3, 6) AS rx, round(x * sin(radians(t)) + y * cos(radians(t)) - 2, 6) AS ry FROM (SELECT *, id % 90 AS t FROM v_pts)", "v_pts")
def rigid_transform(spark: SparkSession, sf: str) -> DataFrame:
    r = G.rigid(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(-2.0), F.col("id") % 90)
    return points(spark, sf).select("id", F.round(r["x"], 6).alias("rx"), F.round(r["y"], 6).alias("ry"))


PATHS = "SELECT c_custkey AS id, (CASE c_custkey % 8 WHEN 0 THEN '02' WHEN 1 THEN '03' WHEN 2 THEN '12' WHEN 3 THEN '13' WHEN 4 THEN '20' WHEN 5 THEN '21' WHEN 6 THEN '30' ELSE '31' END) || CAST(c_custkey % 8 AS VARCHAR) || CAST((c_custkey // 8) % 8 AS VARCHAR) || CAST((c_custkey // 64) % 8 AS VARCHAR) || CAST((c_custkey // 3) % 8 AS VARCHAR) AS path FROM customer"
FOLD = """f AS (SELECT id, path, 2 AS k, -180::DOUBLE + 90::DOUBLE * (2 * (CAST(path[1] AS INT) % 2) + CAST(path[2] AS INT) % 2) AS w, CASE WHEN path[1] < '2' THEN -90::DOUBLE ELSE 0::DOUBLE END AS s, -90::DOUBLE + 90::DOUBLE * (2 * (CAST(path[1] AS INT) % 2) + CAST(path[2] AS INT) % 2) AS e, CASE WHEN path[1] < '2' THEN 0::DOUBLE ELSE 90::DOUBLE END AS n FROM p
UNION ALL SELECT id, path, k + 1, CASE WHEN whole OR d % 2 = 0 THEN w ELSE (w + e) / 2 END, ns, CASE WHEN whole OR d % 2 = 1 THEN e ELSE (w + e) / 2 END, nn FROM (SELECT *, (nn = 90 OR ns = -90) AS whole FROM (SELECT *, CASE WHEN d % 4 < 2 THEN (n + s) / 2 ELSE n END AS nn, CASE WHEN d % 4 < 2 THEN s ELSE (n + s) / 2 END AS ns FROM (SELECT *, CAST(path[k + 1] AS INT) AS d FROM f WHERE k < length(path)))))"""


def octant_paths(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    roots = F.array(*[F.lit(r) for r in ("02", "03", "12", "13", "20", "21", "30", "31")])
    digit = lambda c: (c % 8).cast("string")
    return table(spark, sf, "customer").select(k.alias("id"), F.concat(F.get(roots, (k % 8).cast("int")), digit(k), digit(F.floor(k / 8)), digit(F.floor(k / 64)), digit(F.floor(k / 3))).alias("path"))


@plan(f"WITH RECURSIVE p AS ({PATHS}), {FOLD} SELECT id, path, CAST(w AS DOUBLE) AS w, CAST(s AS DOUBLE) AS s, CAST(e AS DOUBLE) AS e, CAST(n AS DOUBLE) AS n, path[1:2] || translate(path[3:], '4567', '0123') AS flat FROM f WHERE k = length(path)")
def octant_box(spark: SparkSession, sf: str) -> DataFrame:
    p = octant_paths(spark, sf).withColumn("b", geo.tile_box(F.col("path")))
    return p.select("id", "path", "b.*", geo.flat_tile_path(F.col("path")).alias("flat"))


@plan(f"WITH RECURSIVE p AS ({PATHS}), {FOLD} SELECT DISTINCT path[1:2] || translate(path[3:], '4567', '0123') AS flat FROM f WHERE k = length(path) AND e >= 100 AND w <= 130 AND n >= 50 AND s <= 80")
def tile_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles that meet an area: one row a tile, so a box test replaces the descent."""
    p = octant_paths(spark, sf).withColumn("b", geo.tile_box(F.col("path")))
    return p.filter("b.e >= 100 AND b.w <= 130 AND b.n >= 50 AND b.s <= 80").select(geo.flat_tile_path(F.col("path")).alias("flat")).distinct()


@plan("SELECT tx, ty, CAST(count(*) AS BIGINT) AS n, array_agg(id ORDER BY id) AS ids FROM (SELECT id, CAST(floor((113.8 + x / 1000 + 180) / 360 * 4096) AS BIGINT) AS tx, CAST(floor((1 - ln(tan(radians(22.1 + y / 2000)) + 1 / cos(radians(22.1 + y / 2000))) / pi()) / 2 * 4096) AS BIGINT) AS ty FROM v_pts) GROUP BY tx, ty", "v_pts")
def xyz_tile(spark: SparkSession, sf: str) -> DataFrame:
    t = geo.xyz_tile(F.lit(113.8) + F.col("x") / 1000, F.lit(22.1) + F.col("y") / 2000, 12)
    return points(spark, sf).select("id", t["x"].alias("tx"), t["y"].alias("ty")).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))


@plan("SELECT raw, CASE WHEN regexp_full_match(raw, '[0-9]{1,9}') THEN CAST(raw AS BIGINT) END AS coordinate FROM (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '-' || p_size WHEN 2 THEN p_size || '.5' ELSE 'z' || p_size END AS raw FROM part)")
def tile_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    s, t = F.col("p_size"), F.col("p_size").cast("string")
    raw = F.when(s % 4 == 0, t).when(s % 4 == 1, F.concat(F.lit("-"), t)).when(s % 4 == 2, F.concat(t, F.lit(".5"))).otherwise(F.concat(F.lit("z"), t))
    return table(spark, sf, "part").select(raw.alias("raw")).distinct().select("raw", geo.tile_coordinate(F.col("raw")).alias("coordinate"))


@plan("WITH r AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN p_size || ' m' WHEN 1 THEN 'abc' END AS h, CASE p_size % 2 WHEN 0 THEN CAST(p_size % 9 - 1 AS VARCHAR) END AS l FROM part), v AS (SELECT *, TRY_CAST(regexp_extract(h, '-?\\d+(?:\\.\\d+)?') AS DOUBLE) AS hv, TRY_CAST(regexp_extract(l, '-?\\d+(?:\\.\\d+)?') AS DOUBLE) AS lv FROM r) SELECT id, CASE WHEN hv > 0 THEN hv WHEN lv > 0 THEN lv * 3.5 ELSE 10.5 END AS z, CASE WHEN hv > 0 THEN 'osm_height' WHEN lv > 0 THEN 'osm_levels' ELSE 'osm_default' END AS source FROM v")
def osm_height_fallback(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    h = F.when(s % 3 == 0, F.concat(s.cast("string"), F.lit(" m"))).when(s % 3 == 1, F.lit("abc"))
    lv = F.when(s % 2 == 0, (s % 9 - 1).cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.height(h, lv).alias("x")).select("id", "x.z", "x.source")


@plan("SELECT p_partkey AS id, least(30, greatest(1, p_size)) + 0.0 AS step, ((p_partkey * 13 - 400) % 360 + 360) % 360 + 0.0 AS wind, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN p_brand ELSE 'Brand#11' END AS brand, p_size % 2 = 0 AS flag FROM part")
def config_coerce(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    word = F.when(s % 2 == 0, F.lit(" TRUE ")).otherwise(F.lit("off"))
    return table(spark, sf, "part").select(k.alias("id"), text.clamped(s.cast("string"), 1, 30, 3).alias("step"), geo.normal_angle((k * 13 - 400).cast("double")).alias("wind"), text.choice(F.col("p_brand"), ["Brand#11", "Brand#12"], "Brand#11").alias("brand"), text.truth(word, False).alias("flag"))


@plan("SELECT p_partkey AS id, regexp_replace(p_name, '[^a-zA-Z0-9_-]', '_', 'g') AS safe, CASE WHEN lower(trim(p_type)) = 'covered' THEN 'covered' ELSE 'uncovered' END AS bridge, substr(sha1(p_name || '|' || p_size), 1, 12) AS cache, CAST(round((p_partkey * 137.508) % 360) AS INT) AS hue FROM part")
def safe_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.safe_name(F.col("p_name")).alias("safe"), text.bridge_kind(F.col("p_type")).alias("bridge"), text.cache_key(F.col("p_name"), F.col("p_size").cast("string")).alias("cache"), text.golden_hue(F.col("p_partkey")).alias("hue"))


# Each channel by itself: red rises from .4 to .5; green in two ramps up to .4 and two down from .5; blue falls from .4 to .5.
RAMP_SQL = """WITH n AS (SELECT event_id, least(1, greatest(0, (value - 10) / 80)) AS t FROM events)
SELECT event_id, round(CASE WHEN t <= 0.4 THEN 0 WHEN t <= 0.5 THEN (t - 0.4) / 0.1 ELSE 1 END, 6) + 0.0 AS red,
round(CASE WHEN t <= 0.25 THEN 2 * t WHEN t <= 0.4 THEN 0.5 + (t - 0.25) / 0.3 WHEN t <= 0.5 THEN 1 WHEN t <= 0.75 THEN 1 - 2 * (t - 0.5) ELSE 2 - 2 * t END, 6) + 0.0 AS green,
round(CASE WHEN t <= 0.4 THEN 1 WHEN t <= 0.5 THEN 1 - (t - 0.4) / 0.1 ELSE 0 END, 6) + 0.0 AS blue FROM n"""


@plan(RAMP_SQL)
def colour_ramp(spark: SparkSession, sf: str) -> DataFrame:
    c = text.speed_colour(F.col("value"), F.lit(10.0), F.lit(90.0))
    return table(spark, sf, "events").select("event_id", *[F.round(c[k], 6).alias(n) for k, n in (("r", "red"), ("g", "green"), ("b", "blue"))])


LABELS_SQL = """SELECT p_partkey AS id, CASE WHEN ms < 1000 THEN printf('%d ms', ms) ELSE printf('%d.%d s', (ms + 50) // 1000, ((ms + 50) // 100) % 10) END AS took, printf('%d.%02ds (%dms)', (ms + 5) // 1000, ((ms + 5) // 10) % 100, ms) AS logged,
CASE p_size % 7 WHEN 0 THEN 'Database "citywind" does not exist.' WHEN 1 THEN 'PostgreSQL authentication failed. Check POSTGRES_USER and POSTGRES_PASSWORD.' WHEN 2 THEN 'Cannot connect to PostgreSQL. Check host/port and service status.' WHEN 3 THEN 'Required OSM tables are missing in schema "public".' WHEN 4 THEN 'Required OSM columns are missing in schema "public".' WHEN 5 THEN 'OSM query failed: ' || p_brand ELSE 'OSM query failed: unknown error' END AS message FROM (SELECT *, p_partkey % 3000 AS ms FROM part)"""


@plan(LABELS_SQL)
def display_labels(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_size") % 7
    code = F.get(F.array(*[F.lit(c) for c in ("3D000", "28P01", "ECONNREFUSED", "42P01", "42703", "99999", "99999")]), kind)
    ms = F.col("p_partkey") % 3000
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.duration(ms).alias("took"), text.logged_duration(ms).alias("logged"), text.database_message(code, F.when(kind == 5, F.col("p_brand")), "citywind", "public").alias("message"))


def own_box() -> tuple:
    return tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))


@plan("SELECT id, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x0 AS bx0, y1 AS by1 FROM v_box", "v_box")
def shoelace_area(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("r")
    v = boxes(spark, sf).withColumn("r", G.box_ring(*own_box()))
    return v.select("id", G.ring_area(r).alias("area"), F.round(G.ring_centroid(r)["x"], 6).alias("cx"), F.round(G.ring_centroid(r)["y"], 6).alias("cy"), G.bounds(r)["x0"].alias("bx0"), G.bounds(r)["y1"].alias("by1"))


@plan("SELECT id, greatest(0, (x1 - x0) * (y1 - y0) - (x1 - x0) * (y1 - y0) / 4) AS area FROM v_box", "v_box")
def area_minus_holes(spark: SparkSession, sf: str) -> DataFrame:
    x0, y0, x1, y1 = own_box()
    hole = G.box_ring(x0 + (x1 - x0) / 4, y0 + (y1 - y0) / 4, x1 - (x1 - x0) / 4, y1 - (y1 - y0) / 4)
    return boxes(spark, sf).select("id", G.polygon_area(F.array(G.box_ring(x0, y0, x1, y1), hole)).alias("area"))


@plan("SELECT p.id, p.x >= 100 AND p.x <= 600 AND p.y >= 100 AND p.y <= 600 AND p.x + p.y <= 900 AS inside FROM v_pts p", "v_pts")
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    """A square with one corner cut off; the boundary counts as inside."""
    ring = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((100, 100), (600, 100), (600, 300), (300, 600), (100, 600), (100, 100))])
    return points(spark, sf).select("id", G.in_ring(ring, F.col("x"), F.col("y")).alias("inside"))


@plan("SELECT oid, CAST(ln AS INT) AS ln, round(s / sqrt(ln * ln + s * s), 6) AS normal_z, s * s / 2 AS area, z AS z_min, z + ln AS z_max, round((3 * z + ln) / 3, 6) AS z_mean FROM v_tri", "v_tri")
def triangle_metrics(spark: SparkSession, sf: str) -> DataFrame:
    t = triangles(spark, sf)
    x, y, s, z = (F.col(c) for c in ("x0", "y0", "s", "z"))
    m = G.triangle_metrics(G.vertex(x, y, z), G.vertex(x + s, y, z + F.col("ln")), G.vertex(x, y + s, z))
    return t.withColumn("m", m).select("oid", "ln", F.round("m.normal_z", 6).alias("normal_z"), "m.area", "m.z_min", "m.z_max", F.round("m.z_mean", 6).alias("z_mean"))


@plan("WITH h AS (SELECT *, z + 0.5 AS cut FROM v_tri) SELECT oid, CAST(ln AS INT) AS ln, round(least(x0 + s * 0.5 / ln, x0 + s * (0.5 / ln)), 6) AS ax, round(y0, 6) AS ay, round(x0 + s * (0.5 / ln), 6) AS bx, round(y0 + s - s * (0.5 / ln), 6) AS by_ FROM h", "v_tri")
def plane_section(spark: SparkSession, sf: str) -> DataFrame:
    """Where a horizontal plane half a metre above the lower side cuts each triangle."""
    x, y, s, z, n = (F.col(c) for c in ("x0", "y0", "s", "z", "ln"))
    c = G.plane_section(G.vertex(x, y, z), G.vertex(x + s, y, z + n), G.vertex(x, y + s, z), z + 0.5)
    return triangles(spark, sf).withColumn("c", c).select("oid", "ln", *[F.round(F.get("c", i)[k], 6).alias(a) for i, k, a in ((0, "x", "ax"), (0, "y", "ay"), (1, "x", "bx"), (1, "y", "by_"))])


@plan("SELECT id, CAST(generate_subscripts(r, 1) - 1 AS INT) AS i, unnest(r).x AS x, unnest(r).y AS y FROM (SELECT id, [{'x': x0, 'y': y0}, {'x': x1, 'y': y0}, {'x': x1, 'y': y1}, {'x': x0, 'y': y1}, {'x': x0, 'y': y0}] AS r FROM v_box)", "v_box")
def closed_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Rings with doubled vertices and without closure, cleaned."""
    x0, y0, x1, y1 = own_box()
    raw = F.array(G.point(x0, y0), G.point(x0, y0), G.point(x1, y0), G.point(x1, y1), G.point(x1, y1), G.point(x0, y1))
    return boxes(spark, sf).select("id", F.posexplode(G.closed_ring(raw)).alias("i", "p")).select("id", "i", "p.x", "p.y")


@plan("SELECT id, round(x + x * 2 / sqrt(x * x + y * y), 6) AS ox, round(y + y * 2 / sqrt(x * x + y * y), 6) AS oy FROM v_pts WHERE x > 0 OR y > 0", "v_pts")
def radial_offset(spark: SparkSession, sf: str) -> DataFrame:
    o = G.radial_offset(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(2.0))
    return points(spark, sf).filter("x > 0 OR y > 0").select("id", F.round(o["x"], 6).alias("ox"), F.round(o["y"], 6).alias("oy"))


@plan("SELECT event_id, CAST(k AS INT) AS k, round(x + 0.5 * cos(radians((k % 6) * 60)), 6) AS hx, round(y + 0.5 * sin(radians((k % 6) * 60)), 6) AS hy FROM (SELECT event_id, CAST((event_id * 37) % 1009 AS DOUBLE) AS x, CAST((event_id * 91) % 997 AS DOUBLE) AS y FROM events), (SELECT unnest(range(7)) AS k)")
def sample_hexagons(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    h = G.hexagon(((e * 37) % 1009).cast("double"), ((e * 91) % 997).cast("double"), 0.5)
    return table(spark, sf, "events").select("event_id", F.posexplode(h).alias("k", "p")).select("event_id", "k", F.round("p.x", 6).alias("hx"), F.round("p.y", 6).alias("hy"))
