"""Mesh plans: edges, cleaning, visible roofs, clearance, walls, OBJ and table outputs (G-28 to G-34, P-01 to P-08, IO rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityloom.functions import geometry as G
from cityloom.functions.stats import at_place, ranked, upper_place
from cityloom.operators.components import connected_components
from cityloom.operators.ordering import numbered
from cityloom.operators.spatial_join import points_in_boxes
from cityloom.plans.registry import boxes, plan, table, triangles
from cityloom.plans.spatial import TRI_CELL, corners, tri_boxes
from cityloom.session import cut

CORNERS = "SELECT oid, ln, [printf('%d,%d', CAST(x0 AS BIGINT), CAST(y0 AS BIGINT)), printf('%d,%d', CAST(x0 + s AS BIGINT), CAST(y0 AS BIGINT)), printf('%d,%d', CAST(x0 AS BIGINT), CAST(y0 + s AS BIGINT))] AS v FROM v_tri"
EDGE = f"SELECT oid, ln, least(v[i], v[i % 3 + 1]) AS a, greatest(v[i], v[i % 3 + 1]) AS b FROM ({CORNERS}), (SELECT unnest([1, 2, 3]) AS i)"


def faces(spark: SparkSession, sf: str) -> DataFrame:
    """(oid, ln, v): vertex keys of each face."""
    k = lambda x, y: F.format_string("%d,%d", x.cast("bigint"), y.cast("bigint"))
    x, y, s = F.col("x0"), F.col("y0"), F.col("s")
    return triangles(spark, sf).select("oid", "ln", F.array(k(x, y), k(x + s, y), k(x, y + s)).alias("v"))


def mesh_edges(f: DataFrame) -> DataFrame:
    pairs = F.transform(F.col("v"), lambda p, i: F.struct(F.least(p, F.get("v", (i + 1) % 3)).alias("a"), F.greatest(p, F.get("v", (i + 1) % 3)).alias("b")))
    return f.select("oid", "ln", F.explode(pairs).alias("e")).select("oid", "ln", "e.a", "e.b")


@plan(f"SELECT uses, CAST(count(*) AS BIGINT) AS edges FROM (SELECT a, b, CAST(count(*) AS BIGINT) AS uses FROM ({EDGE}) GROUP BY a, b) GROUP BY uses", "v_tri")
def edge_manifold_count(spark: SparkSession, sf: str) -> DataFrame:
    """Edges by the number of faces that use them: two each in a watertight mesh."""
    return mesh_edges(faces(spark, sf)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("uses")).groupBy("uses").agg(F.count(F.lit(1)).alias("edges"))


@plan(f"SELECT a, b FROM ({EDGE}) GROUP BY a, b HAVING count(*) = 1", "v_tri")
def boundary_edges(spark: SparkSession, sf: str) -> DataFrame:
    return mesh_edges(faces(spark, sf)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("a", "b")


@plan(f"SELECT min(oid) AS oid, CAST(min(ln) AS INT) AS first_ln, CAST(count(*) AS BIGINT) AS copies FROM ({CORNERS}) GROUP BY list_sort(v)", "v_tri")
def mesh_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """Faces with the same vertices once."""
    return faces(spark, sf).groupBy(F.array_sort("v").alias("k")).agg(F.min("oid").alias("oid"), F.min("ln").alias("first_ln"), F.count(F.lit(1)).alias("copies")).drop("k")


@plan(f"""WITH RECURSIVE f AS (SELECT oid * 10 + ln AS f, unnest(v) AS p FROM ({CORNERS})), e AS (SELECT DISTINCT a.f AS u, b.f AS w FROM f a JOIN f b ON a.p = b.p AND a.f <> b.f), r AS (SELECT DISTINCT f, f AS root FROM f UNION SELECT e.w, r.root FROM r JOIN e ON e.u = r.f) SELECT f AS face, min(root) AS part FROM r GROUP BY f""", "v_tri")
def mesh_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected parts of a mesh: vertices, each named by its first face, are linked by faces, of which those with the same vertices are one."""
    f = faces(spark, sf).select((F.col("oid") * 10 + F.col("ln")).alias("face"), "v")
    one = cut(f.groupBy("v").agg(F.min("face").alias("same")))
    ends = one.select("same", F.explode("v").alias("p"))
    first = ends.groupBy("p").agg(F.min("same").alias("first"))
    met = cut(ends.hint("merge").join(first, "p").groupBy("same").agg(F.min("first").alias("least"), F.collect_set("first").alias("firsts")))
    found = connected_components(met.select("least", F.explode("firsts").alias("first")), "least", "first")
    named = met.join(found, F.col("least") == F.col("node"), "left").select("same", F.coalesce("component", "least").alias("part"))
    part = one.join(named.hint("merge"), "same").select("v", "part")
    return f.join(part.hint("merge"), "v").groupBy("face").agg(F.min("part").alias("part"))


VISIBLE = """g AS (SELECT oid % 50 AS k, oid, ln, z, s, x0, y0, unnest(range(CAST(floor(x0 / 2) AS BIGINT), CAST(floor((x0 + s) / 2) AS BIGINT) + 1)) AS cx FROM v_tri), q AS (SELECT *, unnest(range(CAST(floor(y0 / 2) AS BIGINT), CAST(floor((y0 + s) / 2) AS BIGINT) + 1)) AS cy FROM g), h AS (SELECT *, cx * 2 + 1.0 AS px, cy * 2 + 1.0 AS py FROM q), i AS (SELECT *, z + ln * ((px - x0) / s) AS hz FROM h WHERE px >= x0 AND py >= y0 AND (px - x0) + (py - y0) <= s)"""


def cell_heights(spark: SparkSession, sf: str) -> DataFrame:
    """(k, cx, cy, oid, ln, hz): heights of faces over the centres of 2 m cells."""
    cells = lambda a: F.sequence(F.floor(F.col(a) / 2), F.floor((F.col(a) + F.col("s")) / 2))
    t = triangles(spark, sf).withColumn("cx", F.explode(cells("x0"))).withColumn("cy", F.explode(cells("y0")))
    px, py = F.col("cx") * 2 + 1.0, F.col("cy") * 2 + 1.0
    inside = (px >= F.col("x0")) & (py >= F.col("y0")) & ((px - F.col("x0")) + (py - F.col("y0")) <= F.col("s"))
    return t.filter(inside).select((F.col("oid") % 50).alias("k"), "cx", "cy", "oid", "ln", (F.col("z") + F.col("ln") * ((px - F.col("x0")) / F.col("s"))).alias("hz"))


@plan(f"WITH {VISIBLE}, t AS (SELECT *, max(hz) OVER (PARTITION BY k, cx, cy) AS top FROM i) SELECT DISTINCT oid, CAST(ln AS INT) AS ln FROM t WHERE hz >= top - 0.35", "v_tri")
def top_visible_triangles(spark: SparkSession, sf: str) -> DataFrame:
    """Faces that are topmost, or nearly, over some cell of their patch."""
    top = F.max("hz").over(Window.partitionBy("k", "cx", "cy"))
    return cell_heights(spark, sf).withColumn("top", top).filter("hz >= top - 0.35").select("oid", "ln").distinct()


@plan("SELECT oid, CAST(ln AS INT) AS ln, round(z + ln, 6) AS top FROM v_tri WHERE s / sqrt(ln * ln + s * s) >= 0.9 AND z + ln > 2 + oid % 30", "v_tri")
def roof_clearance(spark: SparkSession, sf: str) -> DataFrame:
    """Nearly flat faces more than two metres above their terrain."""
    s, n = F.col("s"), F.col("ln")
    ok = (s / F.sqrt(n * n + s * s) >= 0.9) & (F.col("z") + n > F.col("oid") % 30 + 2)
    return triangles(spark, sf).filter(ok).select("oid", "ln", F.round(F.col("z") + n, 6).alias("top"))


GRID = "g AS (SELECT *, unnest(range(CAST(x1 - x0 AS BIGINT))) AS i FROM v_box), c AS (SELECT *, x0 + i + 0.5 AS px, y0 + j + 0.5 AS py FROM (SELECT *, unnest(range(CAST(y1 - y0 AS BIGINT))) AS j FROM g))"


def interior_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Cell centres of a one-metre grid inside each footprint."""
    n = lambda a, b: F.sequence(F.lit(0), (F.col(b) - F.col(a)).cast("int") - 1)
    v = boxes(spark, sf).withColumn("i", F.explode(n("x0", "x1"))).withColumn("j", F.explode(n("y0", "y1")))
    return v.select("id", (F.col("x0") + F.col("i") + 0.5).alias("x"), (F.col("y0") + F.col("j") + 0.5).alias("y"))


@plan(f"WITH {GRID} SELECT id, CAST(count(*) AS BIGINT) AS n, min(px) AS x_min, max(py) AS y_max FROM c GROUP BY id", "v_box")
def sample_grid(spark: SparkSession, sf: str) -> DataFrame:
    return interior_samples(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x_min"), F.max("y").alias("y_max"))


REF = f"WITH {GRID}, h AS (SELECT c.id, c.px, c.py, max(t.z + t.ln * ((c.px - t.x0) / t.s)) AS z FROM c JOIN v_tri t ON c.px >= t.x0 AND c.px <= t.x0 + t.s AND c.py >= t.y0 AND c.py <= t.y0 + t.s AND (c.px - t.x0) / t.s + (c.py - t.y0) / t.s <= 1 - 1e-9 GROUP BY ALL), m AS (SELECT id, list_sort(array_agg(round(z, 6))) AS v FROM h GROUP BY id)"


@plan(f"{REF} SELECT id, CAST(len(v) AS BIGINT) AS n, v[len(v) // 2 + 1] AS z FROM m", "v_box v_tri")
def reference_height(spark: SparkSession, sf: str) -> DataFrame:
    """Median mesh height over the sample grid of a footprint."""
    # samples of one place and triangles of one outline meet once; of such triangles the highest is highest everywhere
    samples = interior_samples(spark, sf)
    t = tri_boxes(spark, sf).groupBy("x0", "y0", "tx1", "ty1", "s", "ln").agg(F.max("tz").alias("tz"))
    met = points_in_boxes(samples.select("x", "y").distinct(), t, TRI_CELL, box=("x0", "y0", "tx1", "ty1"))
    a = corners()
    u, v = (F.col("x") - F.col("x0")) / F.col("s"), (F.col("y") - F.col("y0")) / F.col("s")
    top = met.filter(u + v <= 1 - 1e-9).withColumn("h", a[0]["z"] + F.col("ln") * u).groupBy("x", "y").agg(F.max("h").alias("z"))
    z = samples.hint("merge").join(top, ["x", "y"])
    r = ranked(z.select("id", F.round("z", 6).alias("z")), "id", "z")
    return r.groupBy("id").agg(F.sum("_n").alias("n"), at_place(upper_place()).alias("z"))


@plan("SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size + 0.0 END, CASE WHEN p_size % 2 = 0 THEN p_retailprice / 100 END, p_size / 10 + 0.5) AS roof_z, CASE WHEN p_size % 3 = 0 THEN 'cluster' WHEN p_size % 2 = 0 THEN 'sample' ELSE 'adapted' END AS source FROM part")
def roof_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Roof height from the main cluster, else a sample, else a little above the base."""
    s = F.col("p_size")
    cluster, sample = F.when(s % 3 == 0, s.cast("double")), F.when(s % 2 == 0, F.col("p_retailprice") / 100)
    z = F.coalesce(cluster, sample, s / 10 + 0.5)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), z.alias("roof_z"), F.when(cluster.isNotNull(), "cluster").when(sample.isNotNull(), "sample").otherwise("adapted").alias("source"))


@plan("SELECT id, CAST(i AS INT) AS i, CASE i WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x1 ELSE x0 END AS ax, CASE i WHEN 0 THEN y0 WHEN 1 THEN y0 WHEN 2 THEN y1 ELSE y1 END AS ay, 0.0 AS z_low, h AS z_high FROM v_box, (SELECT unnest([0, 1, 2, 3]) AS i)", "v_box")
def extruded_walls(spark: SparkSession, sf: str) -> DataFrame:
    """A wall for each side of a footprint, from the ground to its height."""
    ring = F.slice(G.box_ring(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))), 1, 4)
    return boxes(spark, sf).select("id", "h", F.posexplode(G.sides(ring)).alias("i", "e")).select("id", "i", F.col("e.ax").alias("ax"), F.col("e.ay").alias("ay"), F.lit(0.0).alias("z_low"), F.col("h").alias("z_high"))


@plan("SELECT id, x0 - 2 AS x0, y0 - 2 AS y0, x1 + 2 AS x1, y1 + 2 AS y1, (x1 - x0 + 4) * (y1 - y0 + 4) AS area FROM v_box", "v_box")
def mitre_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """Box footprints grown by two metres with mitred corners."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    v = boxes(spark, sf).select("id", (x0 - 2).alias("x0"), (y0 - 2).alias("y0"), (x1 + 2).alias("x1"), (y1 + 2).alias("y1"))
    return v.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))


@plan("WITH a AS (SELECT *, sqrt((x1 - x0) * (y1 - y0)) * 0.08 AS d0, (x1 - x0) * (y1 - y0) AS area FROM v_box), d AS (SELECT *, least(2, greatest(0.2, d0)) AS d FROM a), k AS (SELECT id, area, unnest(range(6)) AS k, d, x1 - x0 AS w, y1 - y0 AS h FROM d), o AS (SELECT id, k, d / pow(2, k) AS inset, greatest(0, w - 2 * d / pow(2, k)) * greatest(0, h - 2 * d / pow(2, k)) AS left_, area FROM k), g AS (SELECT id, arg_min(inset, k) AS inset, arg_min(left_, k) AS left_ FROM o WHERE inset >= 0.1 AND left_ > 0 AND left_ >= 0.4 * area GROUP BY id) SELECT a.id, round(coalesce(g.inset, 0), 6) AS inset, round(coalesce(g.left_, a.area), 6) AS area FROM a LEFT JOIN g ON g.id = a.id", "v_box")
def adaptive_inset(spark: SparkSession, sf: str) -> DataFrame:
    """Footprints drawn in by 0.08 of their size, the inset halved while it is 0.1 m or more until two fifths are kept; else as they are."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    d = F.least(F.lit(2.0), F.greatest(F.lit(0.2), F.sqrt(w * h) * 0.08))
    tries = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.struct((d / F.pow(F.lit(2.0), k)).alias("inset"), (F.greatest(F.lit(0.0), w - 2 * d / F.pow(F.lit(2.0), k)) * F.greatest(F.lit(0.0), h - 2 * d / F.pow(F.lit(2.0), k))).alias("area")))
    ok = boxes(spark, sf).withColumn("t", F.get(F.filter(tries, lambda t: (t["inset"] >= 0.1) & (t["area"] > 0) & (t["area"] >= 0.4 * w * h)), 0))
    return ok.select("id", F.round(F.coalesce("t.inset", F.lit(0.0)), 6).alias("inset"), F.round(F.coalesce(F.col("t.area"), w * h), 6).alias("area"))


@plan("WITH f AS (SELECT row_number() OVER (ORDER BY oid, ln) AS n, x0, y0, z, s, ln FROM v_tri) SELECT n, printf('f %d %d %d', 3 * n - 2, 3 * n - 1, 3 * n) AS line FROM f", "v_tri")
def obj_faces(spark: SparkSession, sf: str) -> DataFrame:
    """OBJ face lines with vertex numbers that go on over all faces."""
    f = numbered(triangles(spark, sf).select("oid", "ln"), ["oid", "ln"], "n")
    return f.select("n", F.format_string("f %d %d %d", F.col("n") * 3 - 2, F.col("n") * 3 - 1, F.col("n") * 3).alias("line"))


@plan("SELECT min(x0) AS x_min, min(y0) AS y_min, min(z) AS z_min, max(x0 + s) AS x_max, max(y0 + s) AS y_max, max(z + ln) AS z_max, CAST(3 * count(*) AS BIGINT) AS vertices FROM v_tri", "v_tri")
def obj_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return triangles(spark, sf).agg(F.min("x0").alias("x_min"), F.min("y0").alias("y_min"), F.min("z").alias("z_min"), F.max(F.col("x0") + F.col("s")).alias("x_max"), F.max(F.col("y0") + F.col("s")).alias("y_max"), F.max(F.col("z") + F.col("ln")).alias("z_max"), (3 * F.count(F.lit(1))).alias("vertices"))


@plan("SELECT p_partkey, '\"' || replace(p_name, '\"', '\"\"') || '\",' || p_size AS line FROM part")
def csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Text quoted, quotes doubled."""
    quoted = F.concat(F.lit('"'), F.replace("p_name", F.lit('"'), F.lit('""')), F.lit('",'), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", quoted.alias("line"))
