"""Flow domains: plan, boundary, corners, fallback layout and block mesh (A-16, P-14 to P-16, X-44, X-45)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.functions import geo
from cityloom.operators import flow_case as C
from cityloom.plans.registry import boxes, plan, points

WIND = 45.0

# Corners of the study area, the extent of all samples, in the axes of the wind.
STUDY_SQL = """a AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, max(z) AS h, min(z) AS low FROM v_pts), k AS (SELECT a.*, unnest([x0, x0, x1, x1]) AS x, unnest([y0, y1, y0, y1]) AS y FROM a),
b AS (SELECT any_value(h) AS h, any_value(low) AS low, min(x * sin(radians(45)) + y * cos(radians(45))) AS a0, max(x * sin(radians(45)) + y * cos(radians(45))) AS a1, min(x * cos(radians(45)) - y * sin(radians(45))) AS c0, max(x * cos(radians(45)) - y * sin(radians(45))) AS c1 FROM k),
d AS (SELECT h, low, a0 - 5 * h AS a0, a1 + 15 * h AS a1, c0 - 5 * h AS c0, c1 + 5 * h AS c1, low - 5 AS bottom, 6 * h AS top FROM b)"""


def domain(spark: SparkSession, sf: str) -> DataFrame:
    """One row: 5 H upstream, 15 H downstream, 5 H aside, up to 6 H, from 5 m below the lowest ground."""
    a = points(spark, sf).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max("z").alias("h"), F.min("z").alias("low"))
    corners = [(F.col(x), F.col(y)) for x in ("x0", "x1") for y in ("y0", "y1")]
    h = F.col("h")
    b = a.withColumn("s", C.projected(corners, F.lit(WIND)))
    return b.select("h", "low", (F.col("s.a0") - 5 * h).alias("a0"), (F.col("s.a1") + 15 * h).alias("a1"), (F.col("s.c0") - 5 * h).alias("c0"), (F.col("s.c1") + 5 * h).alias("c1"), (F.col("low") - 5).alias("bottom"), (6 * h).alias("top"))


@plan(f"WITH {STUDY_SQL} SELECT h, round(a0, 4) AS inlet, round(a1, 4) AS outlet, round(c0, 4) AS side_low, round(c1, 4) AS side_high, round(bottom, 4) AS bottom, round(top, 4) AS top FROM d", "v_pts")
def domain_plan(spark: SparkSession, sf: str) -> DataFrame:
    names = {"a0": "inlet", "a1": "outlet", "c0": "side_low", "c1": "side_high", "bottom": "bottom", "top": "top"}
    return domain(spark, sf).select("h", *[F.round(c, 4).alias(n) for c, n in names.items()])


@plan(f"WITH {STUDY_SQL}, v AS (SELECT unnest(range(8)) AS i), p AS (SELECT i, CASE WHEN i % 4 IN (0, 3) THEN a0 ELSE a1 END AS a, CASE WHEN i % 4 < 2 THEN c1 ELSE c0 END AS c, CASE WHEN i < 4 THEN bottom ELSE top END AS z FROM v, d) SELECT CAST(i AS INT) AS i, round(a * sin(radians(45)) + c * cos(radians(45)), 4) AS x, round(a * cos(radians(45)) - c * sin(radians(45)), 4) AS y, round(z, 4) AS z FROM p", "v_pts")
def domain_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """The eight corners of the domain: the ground's, from the inlet's far side round, then the top's."""
    corner = lambda a, c, z: F.struct(F.col(a).alias("a"), F.col(c).alias("c"), F.col(z).alias("z"))
    order = [("a0", "c1"), ("a1", "c1"), ("a1", "c0"), ("a0", "c0")]
    v = domain(spark, sf).select(F.posexplode(F.array(*[corner(a, c, z) for z in ("bottom", "top") for a, c in order])).alias("i", "p"))
    at = geo.from_flow_axes(F.col("p.a"), F.col("p.c"), F.lit(WIND))
    return v.select("i", F.round(at["x"], 4).alias("x"), F.round(at["y"], 4).alias("y"), F.round("p.z", 4).alias("z"))


@plan(f"WITH {STUDY_SQL}, v AS (SELECT unnest(range(5)) AS i), p AS (SELECT i, CASE WHEN i % 4 IN (0, 3) THEN a0 ELSE a1 END AS a, CASE WHEN i % 4 < 2 THEN c0 ELSE c1 END AS c FROM v, d) SELECT CAST(i AS INT) AS i, round(114 + (a * sin(radians(45)) + c * cos(radians(45))) / (111320 * cos(radians(22.2))), 8) AS lon, round(22.2 + (a * cos(radians(45)) - c * sin(radians(45))) / 110540, 8) AS lat FROM p", "v_pts")
def domain_boundary(spark: SparkSession, sf: str) -> DataFrame:
    """The domain's outline as a closed ring of degrees around the origin."""
    order = [("a0", "c0"), ("a1", "c0"), ("a1", "c1"), ("a0", "c1"), ("a0", "c0")]
    v = domain(spark, sf).select(F.posexplode(F.array(*[F.struct(F.col(a).alias("a"), F.col(c).alias("c")) for a, c in order])).alias("i", "p"))
    at = geo.from_flow_axes(F.col("p.a"), F.col("p.c"), F.lit(WIND))
    return v.select("i", F.round(F.lit(114.0) + at["x"] / (geo.DEGREE_X * F.cos(F.radians(F.lit(22.2)))), 8).alias("lon"), F.round(F.lit(22.2) + at["y"] / geo.DEGREE_Y, 8).alias("lat"))


@plan("WITH s AS (SELECT min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(h) AS z1 FROM v_box), t AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM v_pts), c AS (SELECT least(s.x0, t.x0) AS x0, least(s.y0, t.y0) AS y0, greatest(s.x1, t.x1) AS x1, greatest(s.y1, t.y1) AS y1, least(0, t.z0) AS z0, greatest(s.z1, t.z1) AS z1, s.z1 - least(0, t.z0) AS h FROM s, t) SELECT y0 - greatest(5 * h, 100) AS along_low, y1 + greatest(5 * h, 100) AS along_high, x0 - greatest(5 * h, 100) AS across_low, x1 + greatest(5 * h, 100) AS across_high, floor(z0 - 5) + 0.0 AS bottom, z1 + 3 * h AS top FROM c", "v_box v_pts")
def fallback_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Domain from the extents of structure and terrain alone, for a wind from the north."""
    s = boxes(spark, sf).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.lit(0.0).alias("z0"), F.max("h").alias("z1"), F.max("h").alias("s1"))
    t = points(spark, sf).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.min("z").alias("z0"), F.max("z").alias("z1"), F.lit(None).cast("double").alias("s1"))
    c = s.unionByName(t).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("z0").alias("z0"), F.max("z1").alias("z1"), (F.max("s1") - F.min("z0")).alias("h"))
    pad = F.greatest(F.col("h") * 5, F.lit(100.0))
    return c.select((F.col("y0") - pad).alias("along_low"), (F.col("y1") + pad).alias("along_high"), (F.col("x0") - pad).alias("across_low"), (F.col("x1") + pad).alias("across_high"), F.floor(F.col("z0") - 5).cast("double").alias("bottom"), (F.col("z1") + F.col("h") * 3).alias("top"))


def breaks_sql(name: str, d: str, s: str) -> str:
    """Places along an axis, step by step; `d` and `s` prefix the columns of domain and structure."""
    return f"""{name}1 AS (SELECT {d}0 AS p0, {d}1 AS p1, {s}0 AS s0, {s}1 AS s1, reach, greatest(({d}1 - {d}0) * 0.18, least(220, greatest(120, reach * 0.5))) AS rim, greatest(({d}1 - {d}0) * 0.25, least(600, greatest(180, {s}1 - {s}0 + reach))) AS wide FROM w),
{name}2 AS (SELECT *, least(greatest(s0 - reach, p0 + rim), p1 - rim - wide) AS lo FROM {name}1), {name}3 AS (SELECT *, least(greatest(s1 + reach, lo + wide), p1 - rim) AS hi FROM {name}2),
{name}4 AS (SELECT p0, p1, CASE WHEN hi - lo < wide THEN greatest(p0 + rim, (s0 + s1) / 2 - wide / 2) ELSE lo END AS lo, CASE WHEN hi - lo < wide THEN least(p1 - rim, (s0 + s1) / 2 + wide / 2) ELSE hi END AS hi FROM {name}3),
{name} AS (SELECT CASE WHEN lo > p0 AND hi < p1 AND hi > lo THEN [p0, lo, hi, p1] ELSE [p0, p0 + (p1 - p0) / 3, p1 - (p1 - p0) / 3, p1] END AS v FROM {name}4)"""


MESH_SQL = f"""WITH {STUDY_SQL}, q AS (SELECT min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(h) AS top FROM v_box), e AS (SELECT q.top, unnest([x0, x0, x1, x1]) AS x, unnest([y0, y1, y0, y1]) AS y FROM q),
z AS (SELECT any_value(top) AS built, min(x * sin(radians(45)) + y * cos(radians(45))) AS sa0, max(x * sin(radians(45)) + y * cos(radians(45))) AS sa1, min(x * cos(radians(45)) - y * sin(radians(45))) AS sc0, max(x * cos(radians(45)) - y * sin(radians(45))) AS sc1 FROM e),
w AS (SELECT d.*, z.*, greatest(z.built - d.low, 1) AS reach FROM d, z), {breaks_sql('al', 'a', 'sa')}, {breaks_sql('ac', 'c', 'sc')},
v1 AS (SELECT bottom, top - bottom AS tall, top, low, reach, least(greatest(low + greatest(reach, 120), bottom + (top - bottom) * 0.12), bottom + (top - bottom) * 0.28) AS lo FROM w), v2 AS (SELECT *, least(greatest(low + greatest(reach * 2.5, 260), lo + tall * 0.12), bottom + tall * 0.6) AS mid FROM v1),
ve AS (SELECT CASE WHEN lo > bottom AND mid > lo AND mid < top THEN [bottom, lo, mid, top] ELSE [bottom, bottom + tall * 0.18, bottom + tall * 0.45, top] END AS v FROM v2), i AS (SELECT unnest([0, 1, 2]) AS i),
n AS (SELECT i, greatest(1, floor((al.v[i + 2] - al.v[i + 1]) / CASE i WHEN 1 THEN 35 ELSE 90 END + 0.5)) AS x, greatest(1, floor((ac.v[4 - i] - ac.v[3 - i]) / CASE i WHEN 1 THEN 35 ELSE 90 END + 0.5)) AS y, greatest(1, floor((ve.v[i + 2] - ve.v[i + 1]) / CASE i WHEN 0 THEN 25 WHEN 1 THEN 40 ELSE 90 END + 0.5)) AS z FROM i, al, ac, ve)
SELECT CAST(a.i AS INT) AS ix, CAST(b.i AS INT) AS iy, CAST(c.i AS INT) AS iz, CAST(a.x * b.y * c.z AS BIGINT) AS cells FROM n a, n b, n c"""


@plan(MESH_SQL, "v_pts v_box")
def block_mesh_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cell counts of the 3 x 3 x 3 blocks of a domain: fine around the structure and near the ground."""
    q = boxes(spark, sf).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("h").alias("built"))
    s = C.projected([(F.col(x), F.col(y)) for x in ("x0", "x1") for y in ("y0", "y1")], F.lit(WIND))
    one = F.lit(1).alias("one")  # a row on either side
    w = domain(spark, sf).select("*", one).join(q.select(s.alias("s"), "built", one), "one").withColumn("reach", F.greatest(F.col("built") - F.col("low"), F.lit(1.0)))
    c = F.col
    w = w.select(C.horizontal_breaks(c("a0"), c("a1"), c("s.a0"), c("s.a1"), c("reach")).alias("along"), C.horizontal_breaks(c("c0"), c("c1"), c("s.c0"), c("s.c1"), c("reach")).alias("across"), C.vertical_breaks(c("bottom"), c("top"), c("low"), c("reach")).alias("up"))
    n = w.select(C.counts(c("along"), (C.OUTER, C.CORE, C.OUTER)).alias("x"), C.counts(F.reverse("across"), (C.OUTER, C.CORE, C.OUTER)).alias("y"), C.counts(c("up"), (C.LOWER, C.MIDDLE, C.UPPER)).alias("z"))
    b = n.select("y", "z", F.posexplode("x").alias("ix", "nx")).select("ix", "nx", "z", F.posexplode("y").alias("iy", "ny")).select("ix", "nx", "iy", "ny", F.posexplode("z").alias("iz", "nz"))
    return b.select("ix", "iy", "iz", (c("nx") * c("ny") * c("nz")).alias("cells"))
