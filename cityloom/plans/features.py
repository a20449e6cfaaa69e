"""Feature records: members, groups, states, previews, inspection, section files, probes (S-05, S-06, T-04, J-22, IO-14, X rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityloom.functions import geo, geometry as G, text
from cityloom.operators.lines import span, with_next
from cityloom.operators.rasters import MARGIN
from cityloom.plans.raster import EDGE, SECT, sections
from cityloom.plans.registry import boxes, lines, plan, points, table, triangles

# Kinds of buildings that may be members.
MEMBER_TYPES = "building building_part building_commercial building_residential".split()
MEMBER = "array<struct<fullId:string, osmType:string, geometry:struct<type:string, coordinates:array<array<array<double>>>>, osmHeight:string, osmBuildingLevels:string>>"


def finite_mean(c: Column) -> Column:
    return F.avg(F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c))


@plan("SELECT p_partkey AS id, CAST(CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 5 = 1 THEN 1 WHEN p_size % 5 = 2 THEN 2 ELSE 1 END AS INT) AS members, CASE WHEN p_size % 5 <> 0 THEN 'w' || p_partkey END AS first_id, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS VARCHAR) END AS height FROM part")
def parsed_members(spark: SparkSession, sf: str) -> DataFrame:
    """Members read from JSON: those with an id, an allowed type and a polygon with coordinates; other records and broken text give none."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    good = F.concat(F.lit('{"fullId":"w'), k, F.lit('","osmType":"building","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},"osmHeight":'), s.cast("string"), F.lit(',"osmBuildingLevels":null}'))
    other = F.replace(good, F.lit('"osmType":"building"'), F.lit('"osmType":"fence"'))
    empty = F.replace(good, F.lit("[[[0,0],[1,0],[1,1],[0,0]]]"), F.lit("[]"))
    point = F.replace(good, F.lit('"type":"Polygon"'), F.lit('"type":"Point"'))
    nameless = F.regexp_replace(good, '"fullId":"[^"]*",', "")
    part = F.replace(good, F.lit('"osmType":"building"'), F.lit('"osmType":"building_part"'))
    doc = lambda *m: F.concat(F.lit("["), F.concat_ws(",", *m), F.lit("]"))
    raw = F.when(s % 5 == 0, F.lit("no json")).when(s % 5 == 1, doc(good, other, empty)).when(s % 5 == 2, doc(good, part, point)).when(s % 5 == 3, doc(nameless, good)).otherwise(doc(point, good, empty))
    ok = lambda m: m["fullId"].isNotNull() & m["osmType"].isin(MEMBER_TYPES) & m["geometry"]["type"].isin("Polygon", "MultiPolygon") & (F.size(m["geometry"]["coordinates"]) > 0)
    v = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.filter(F.coalesce(F.from_json(raw, MEMBER), F.array().cast(MEMBER)), ok).alias("m"))
    return v.select("id", F.size("m").alias("members"), F.get("m", 0)["fullId"].alias("first_id"), F.get("m", 0)["osmHeight"].alias("height"))


@plan("SELECT id, printf('[[%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f]]', x0, y0, x1, y0, x1, y1, x0, y1, x0, y0) AS key FROM v_box", "v_box")
def geometry_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Outlines as text at eight decimals, by which equal geometries are known."""
    noise = G.box_ring(*(F.col(c) + 1e-10 for c in ("x0", "y0", "x1", "y1")))
    return boxes(spark, sf).select("id", text.ring_key(noise).alias("key"))


@plan("WITH c AS (SELECT id, i, CASE WHEN i IN (1, 2) THEN x + 3 ELSE x - 3 END AS bx, CASE WHEN i IN (2, 3) THEN y + 2 ELSE y - 2 END AS by_ FROM v_pts, (SELECT unnest([0, 1, 2, 3]) AS i)) SELECT id, CAST(i AS INT) AS corner, round(degrees((1000 * bx + 12700000) / 6378137.0), 9) AS lon, round(degrees(atan(sinh((1000 * by_ + 2540000) / 6378137.0))), 9) AS lat FROM c", "v_pts")
def box_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """The four lower corners of a tile's box, moved by the tile's transform into web-mercator and then to degrees."""
    m = [1000.0, 0.0, 0.0, 0.0, 0.0, 1000.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 12_700_000.0, 2_540_000.0, 0.0, 1.0]
    sign = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    corner = F.array(*[F.struct((F.col("x") + a * 3.0).alias("x"), (F.col("y") + b * 2.0).alias("y"), (F.col("z") - 1.0).alias("z")) for a, b in sign])
    v = points(spark, sf).select("id", F.posexplode(corner).alias("corner", "p"))
    x, y, _ = geo.transformed(m, F.col("p.x"), F.col("p.y"), F.col("p.z"))
    ll = geo.from_mercator(x, y)
    return v.select("id", "corner", F.round(ll["lon"], 9).alias("lon"), F.round(ll["lat"], 9).alias("lat"))


LAYERS = {"click": "Terrain Sample Points", "view": "Walkway Sample Points", "purchase": "Walkway Footprints", "error": "Study Area"}
LAYER_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LAYERS.items()) + " END"


@plan(f"WITH f AS (SELECT event_id, {LAYER_SQL} AS layer, user_id % 50 AS feature, CAST((event_id * 37) % 1009 AS DOUBLE) AS x, CAST((event_id * 91) % 997 AS DOUBLE) AS y FROM events), h AS (SELECT layer, feature, min(event_id) AS first_seen FROM f WHERE layer IS NOT NULL AND x BETWEEN 494 AND 506 AND y BETWEEN 394 AND 606 GROUP BY layer, feature) SELECT layer, CAST(count(*) AS BIGINT) AS n, array_agg(feature ORDER BY first_seen) AS features, min(first_seen) AS first_seen FROM h GROUP BY layer")
def inspected_features(spark: SparkSession, sf: str) -> DataFrame:
    """What lies in a box around a click: features of known layers, each once, grouped by layer in the order they were met."""
    e = table(spark, sf, "events")
    known = F.lit(None).cast("string")
    for k, v in LAYERS.items():
        known = F.when(F.col("event_type") == k, v).otherwise(known)
    f = e.select("event_id", known.alias("layer"), (F.col("user_id") % 50).alias("feature"), ((F.col("event_id") * 37) % 1009).cast("double").alias("x"), ((F.col("event_id") * 91) % 997).cast("double").alias("y"))
    near = f.filter(F.col("layer").isNotNull() & F.col("x").between(500 - 6, 500 + 6) & F.col("y").between(500 - 106, 500 + 106))
    once = near.groupBy("layer", "feature").agg(F.min("event_id").alias("first_seen"))
    g = once.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("first_seen", "feature"))).alias("f"), F.min("first_seen").alias("first_seen"))
    return g.select("layer", "n", F.transform("f", lambda x: x["feature"]).alias("features"), "first_seen")


@plan("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN ['full_id', 'osm_type', 'height', 'building:levels'] WHEN 1 THEN ['full_id', 'osm_type', 'bridge'] ELSE ['brand', 'size'] END AS names, CASE p_size % 3 WHEN 0 THEN ['w' || p_partkey, NULL, CAST(p_size AS VARCHAR), NULL] WHEN 1 THEN ['w' || p_partkey, NULL, NULL] ELSE [p_brand, CAST(p_size AS VARCHAR)] END AS values FROM part")
def layer_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Properties by layer: the layer's own in their order, null where missing; other layers keep theirs."""
    k, s = F.concat(F.lit("w"), F.col("p_partkey").cast("string")), F.col("p_size")
    layer = F.when(s % 3 == 0, "osm_building").when(s % 3 == 1, "osm_elevated_walkway").otherwise("other")
    has = F.when(layer == "other", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), s.cast("string"))).when(layer == "osm_building", F.create_map(F.lit("height"), s.cast("string"), F.lit("full_id"), k, F.lit("extra"), F.lit("x"))).otherwise(F.create_map(F.lit("full_id"), k))
    wanted = {"osm_building": ["full_id", "osm_type", "height", "building:levels"], "osm_elevated_walkway": ["full_id", "osm_type", "bridge"]}
    names = F.map_keys(has)
    for name, fields in wanted.items():
        names = F.when(layer == name, F.array(*map(F.lit, fields))).otherwise(names)
    v = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), names.alias("names"), has.alias("has"))
    return v.select("id", "names", F.transform("names", lambda n: F.try_element_at(F.col("has"), n)).alias("values"))


@plan(f"WITH s AS (SELECT k, height, ax, ay, bx, by_, row_number() OVER (PARTITION BY k ORDER BY height, ax, ay, by_) AS n FROM ({SECT})), o AS (SELECT k, (min(ax) + max(ax)) / 2 AS ox, (min(ay) + max(by_)) / 2 AS oy, min(height) AS oz FROM s GROUP BY k), e AS ({EDGE}) SELECT s.k, n, printf('v %.4f %.4f %d', ax - ox, ay - oy, CAST(height - oz AS BIGINT)) AS first_vertex, printf('l %d %d', 2 * n - 1, 2 * n) AS line, round(ax - x_min, 4) AS from_left FROM s JOIN o ON o.k = s.k JOIN e ON e.k = s.k", "v_tri")
def section_files(spark: SparkSession, sf: str) -> DataFrame:
    """Section segments as OBJ lines around their patch's centre, numbered within it, and their place from the raster's left edge."""
    s = sections(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("height", "ax", "ay", "by")).cast("bigint"))
    o = s.groupBy("k").agg(((F.min("ax") + F.max("ax")) / 2).alias("ox"), ((F.min("ay") + F.max("by")) / 2).alias("oy"), F.min("height").alias("oz"), (F.min(F.least("ax", "bx")) - MARGIN).alias("left"))
    j = s.join(o, "k")
    vertex = F.format_string("v %.4f %.4f %d", F.col("ax") - F.col("ox"), F.col("ay") - F.col("oy"), (F.col("height") - F.col("oz")).cast("bigint"))
    return j.select("k", "n", vertex.alias("first_vertex"), F.format_string("l %d %d", F.col("n") * 2 - 1, F.col("n") * 2).alias("line"), F.round(F.col("ax") - F.col("left"), 4).alias("from_left"))


# Probes half a metre from an edge's ends and a metre apart; one in the middle of a short edge.
PROBE_SQL = """WITH n AS (SELECT user_id, pos, x, y, z, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM v_line WINDOW w AS (PARTITION BY user_id ORDER BY pos)), e AS (SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) / 100 AS len FROM n WHERE nx IS NOT NULL AND (nx <> x OR ny <> y)),
d AS (SELECT *, unnest(CASE WHEN len <= 1 THEN [len / 2] ELSE list_transform(range(CAST(floor(len - 1 + 1e-9) AS BIGINT) + 1), lambda i: 0.5 + i) END) AS dist FROM e)
SELECT user_id, pos, round(dist, 6) AS dist, round(z * (1 - dist / len) + nz * (dist / len) + CASE WHEN user_id % 3 = 0 THEN 0.5 ELSE 3.8 END, 6) AS z FROM d"""


@plan(PROBE_SQL, "v_line")
def edge_probes(spark: SparkSession, sf: str) -> DataFrame:
    """Places along every edge where its modelled top is compared with the mesh (lengths in hundreds of metres here)."""
    s = with_next(lines(spark, sf), "user_id", "pos", ["x", "y", "z"]).filter("n_x IS NOT NULL").withColumn("len", span() / 100).filter("len > 0")
    places = F.when(F.col("len") <= 1, F.array(F.col("len") / 2)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.col("len") - 1 + 1e-9), F.lit(0)).cast("int")), lambda i: i + 0.5))
    top = F.when(F.col("user_id") % 3 == 0, 0.5).otherwise(3.8)
    v = s.withColumn("dist", F.explode(places)).withColumn("t", F.col("dist") / F.col("len"))
    return v.select("user_id", "pos", F.round("dist", 6).alias("dist"), F.round(F.col("z") * (1 - F.col("t")) + F.col("n_z") * F.col("t") + top, 6).alias("z"))


@plan("SELECT oid, CAST(ln AS INT) AS ln, z AS z_min FROM v_tri WHERE oid % 2 = 1", "v_tri")
def downward_faces(spark: SparkSession, sf: str) -> DataFrame:
    """Faces whose normal points down (every other one is turned here), with their lowest height; upright ones don't count."""
    x, y, s, z, n = (F.col(c) for c in ("x0", "y0", "s", "z", "ln"))
    a, b, c = G.vertex(x, y, z), G.vertex(x + s, y, z + n), G.vertex(x, y + s, z)
    turned = F.col("oid") % 2 == 1
    p, q = F.when(turned, c).otherwise(b), F.when(turned, b).otherwise(c)
    t = triangles(spark, sf).select("oid", "ln", a.alias("a"), p.alias("b"), q.alias("c"))
    area = G.triangle_normal(F.col("a"), F.col("b"), F.col("c"))["z"]
    return t.filter(area < -1e-9).select("oid", "ln", F.least("a.z", "b.z", "c.z").alias("z_min"))


# Features of alignment groups: eight footprints a patch, two of them a group; every seventh has no group id, every eleventh no score.
STATE_SQL = """WITH f AS (SELECT id, id // 8 AS patch, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN '' ELSE 'g' || (id % 8) // 2 END AS gid, (id % 8) // 2 AS gindex, CASE WHEN id % 11 = 0 THEN NULL ELSE (id % 10) / 10 END AS score, (id % 5) - 2.0 AS dx, (id % 3) - 1.0 AS dy FROM v_box)
SELECT patch, coalesce(nullif(gid, ''), 'group-index-' || gindex) AS "group", CAST(count(*) AS BIGINT) AS members, min(id) AS first_member, round(coalesce(avg(score), 0), 6) AS score, round(avg(dx), 6) AS dx, round(avg(dy), 6) AS dy, coalesce(avg(score), 0) > 0.75 AS strong FROM f GROUP BY ALL"""


def aligned_features(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    gid = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, "").otherwise(F.concat(F.lit("g"), F.floor(k % 8 / 2).cast("string")))
    score = F.when(k % 11 != 0, (k % 10) / 10)
    f = boxes(spark, sf).select("id", F.floor(k / 8).alias("patch"), gid.alias("gid"), F.floor(k % 8 / 2).alias("gindex"), score.alias("score"), ((k % 5) - 2).cast("double").alias("dx"), ((k % 3) - 1).cast("double").alias("dy"), "x0", "y0")
    return f.withColumn("group", F.coalesce(F.nullif("gid", F.lit("")), F.concat(F.lit("group-index-"), F.col("gindex").cast("string"))))


@plan(STATE_SQL, "v_box")
def group_states(spark: SparkSession, sf: str) -> DataFrame:
    """Groups by id, or by position where they have none: members, the means of finite scores and shifts, strong above 0.75."""
    g = aligned_features(spark, sf).groupBy("patch", "group").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first_member"), F.coalesce(finite_mean(F.col("score")), F.lit(0.0)).alias("s"), finite_mean(F.col("dx")).alias("mx"), finite_mean(F.col("dy")).alias("my"))
    return g.select("patch", "group", "members", "first_member", F.round("s", 6).alias("score"), F.round("mx", 6).alias("dx"), F.round("my", 6).alias("dy"), (F.col("s") > 0.75).alias("strong"))


@plan("""WITH f AS (SELECT id, x0, y0, id // 8 AS patch, CASE WHEN id % 7 IN (0, 1) THEN 'group-index-' || (id % 8) // 2 ELSE 'g' || (id % 8) // 2 END AS grp, CASE WHEN id % 11 = 0 THEN NULL ELSE (id % 10) / 10 END AS score, (id % 5) - 2.0 AS dx, (id % 3) - 1.0 AS dy FROM v_box),
s AS (SELECT patch, grp, coalesce(avg(score), 0) AS score, avg(dx) AS dx, avg(dy) AS dy FROM f GROUP BY patch, grp), b AS (SELECT patch, arg_max({'dx': dx, 'dy': dy, 'grp': grp}, {'score': score, 'grp': grp}) AS m FROM s WHERE score > 0.75 GROUP BY patch)
SELECT f.id, CASE WHEN s.score > 0.75 OR b.m IS NULL THEN 'own' ELSE 'source' END AS shift, CASE WHEN s.score > 0.75 OR b.m IS NULL THEN NULL ELSE b.m.grp END AS source, round(f.x0 + CASE WHEN s.score > 0.75 OR b.m IS NULL THEN f.dx ELSE b.m.dx END, 6) AS x, round(f.y0 + CASE WHEN s.score > 0.75 OR b.m IS NULL THEN f.dy ELSE b.m.dy END, 6) AS y FROM f JOIN s ON s.patch = f.patch AND s.grp = f.grp LEFT JOIN b ON b.patch = f.patch""", "v_box")
def corrected_features(spark: SparkSession, sf: str) -> DataFrame:
    """Members of weak groups stand where their patch's best strong group's shift puts their original, without rotation; others keep their own."""
    f = aligned_features(spark, sf)
    s = f.groupBy("patch", "group").agg(F.coalesce(finite_mean(F.col("score")), F.lit(0.0)).alias("s"), finite_mean(F.col("dx")).alias("sx"), finite_mean(F.col("dy")).alias("sy"))
    best = s.filter("s > 0.75").groupBy("patch").agg(F.max_by(F.struct("group", "sx", "sy"), F.struct("s", "group")).alias("m"))
    j = f.join(s.select("patch", "group", "s"), ["patch", "group"]).join(best, "patch", "left")
    own = (F.col("s") > 0.75) | F.col("m").isNull()
    at = lambda c, d, e: F.round(F.col(c) + F.when(own, F.col(d)).otherwise(F.col(f"m.{e}")), 6)
    return j.select("id", F.when(own, "own").otherwise("source").alias("shift"), F.when(~own, F.col("m.group")).alias("source"), at("x0", "dx", "sx").alias("x"), at("y0", "dy", "sy").alias("y"))


@plan("SELECT user_id, CAST(count(*) AS BIGINT) AS points, round(sum(len), 4) AS length FROM (SELECT *, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS len FROM v_line WINDOW w AS (PARTITION BY user_id ORDER BY pos)) GROUP BY user_id HAVING count(*) >= 2 AND sum(len) >= 1e-6", "v_line")
def parsed_ways(spark: SparkSession, sf: str) -> DataFrame:
    """Ways of two points at least and of some length."""
    s = with_next(lines(spark, sf), "user_id", "pos", ["x", "y"]).withColumn("len", span())
    g = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("points"), F.sum("len").alias("l"))
    return g.filter("points >= 2 AND l >= 1e-6").select("user_id", "points", F.round("l", 4).alias("length"))


@plan("SELECT oid, CAST(ln AS INT) AS ln, z AS z_min, z + ln AS z_max FROM v_tri WHERE oid % 6 <> 0 AND ln <> 3", "v_tri")
def sound_triangles(spark: SparkSession, sf: str) -> DataFrame:
    """Triangles with finite vertices and some area in the plane (every sixth has a vertex that is none here, every third of an order is a line)."""
    x, y, s, z, n = (F.col(c) for c in ("x0", "y0", "s", "z", "ln"))
    a = G.vertex(x, y, F.when(F.col("oid") % 6 == 0, F.lit(float("nan"))).otherwise(z))
    b, c = G.vertex(x + s, y, z + n), G.vertex(F.when(n == 3, x + 2 * s).otherwise(x), F.when(n == 3, y).otherwise(y + s), z)
    t = triangles(spark, sf).select("oid", "ln", F.array(a, b, c).alias("v"))
    ok = F.forall("v", lambda p: G.finite_vector(F.array(p["x"], p["y"], p["z"])))
    area = F.abs(G.triangle_normal(F.get("v", 0), F.get("v", 1), F.get("v", 2))["z"]) / 2
    zs = F.transform("v", lambda p: p["z"])
    return t.filter(ok & (area > 1e-12)).select("oid", "ln", F.array_min(zs).alias("z_min"), F.array_max(zs).alias("z_max"))
