"""Alignment and clipping plans (R-08, R-11, G-16, P-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.functions import geometry as G
from cityloom.operators.alignment import aligned
from cityloom.operators.clipping import clipped_to_box, fan
from cityloom.plans.raster import EDGE, FIELD, FOLD, outlines, placed_field
from cityloom.plans.registry import boxes, plan, triangles


#: Sides in steps of so many metres.
SIDE = 6.0
ROUNDS_SQL = 10


def scoring(name: str, candidates: str, outline: str, x: str = "px", y: str = "py") -> str:
    """CTEs that end in `name` (id, o, a, dx, dy, score): mean field at the outline's points, turned by a degrees and shifted."""
    return f"""
{name}_u AS (
  SELECT c.id, c.o, c.a, c.dx, c.dy, e.k,
    (p.cx + (p.{x} - p.cx) * cos(radians(c.a)) - (p.{y} - p.cy) * sin(radians(c.a)) + c.dx - e.x_min) / 2 AS u,
    (e.y_max - (p.cy + (p.{x} - p.cx) * sin(radians(c.a)) + (p.{y} - p.cy) * cos(radians(c.a)) + c.dy)) / 2 AS v
  FROM ({candidates}) c JOIN {outline} p ON p.id = c.id AND p.o = c.o JOIN e ON e.k = p.k
), {name}_q AS (
  SELECT *, CAST(floor(v) AS BIGINT) AS r, CAST(floor(u) AS BIGINT) AS l, v - floor(v) AS dv, u - floor(u) AS du FROM {name}_u
), {name} AS MATERIALIZED (
  SELECT q.id, q.o, q.a, q.dx, q.dy, round(least(1, greatest(0, avg(
    coalesce(f00.f, 0) * (1 - dv) * (1 - du) + coalesce(f10.f, 0) * dv * (1 - du) + coalesce(f01.f, 0) * (1 - dv) * du + coalesce(f11.f, 0) * dv * du))), 12) AS score
  FROM {name}_q q
    LEFT JOIN f f00 ON f00.k = q.k AND f00.row_ = q.r AND f00.col_ = q.l LEFT JOIN f f10 ON f10.k = q.k AND f10.row_ = q.r + 1 AND f10.col_ = q.l
    LEFT JOIN f f01 ON f01.k = q.k AND f01.row_ = q.r AND f01.col_ = q.l + 1 LEFT JOIN f f11 ON f11.k = q.k AND f11.row_ = q.r + 1 AND f11.col_ = q.l + 1
  GROUP BY q.id, q.o, q.a, q.dx, q.dy
)"""


def chosen(name: str, scores: str, cost: str) -> str:
    """The best score, then the least movement, then the first tried."""
    order = f"score DESC, round({cost}, 12), o = 0.5, o = -0.5, a, dx, dy"
    return f"{name} AS MATERIALIZED (SELECT id, o, a, dx, dy, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order}) AS rn FROM {scores}) WHERE rn = 1)"


def alignment_sql() -> str:
    steps = lambda n, step: "[" + ", ".join(f"{i * step}" for i in range(-n, n + 1)) + "]::DOUBLE[]"
    fit = "abs(s.dx) <= w / 2 + 1e-9 AND abs(s.dy) <= h / 2 + 1e-9"
    move = "dx * dx + dy * dy + abs(a) * 1e-3"
    coarse = f"SELECT s.* FROM (SELECT id, w, h, o, 0.0 AS a, unnest(d) AS dx, dy FROM (SELECT id, w, h, o, {steps(10, 0.5)} AS d, unnest({steps(10, 0.5)}) AS dy FROM b, t)) s WHERE {fit}"
    parts = [
        f"f AS MATERIALIZED ({FIELD})", f"e AS MATERIALIZED ({EDGE})", "t AS (SELECT unnest([0.0, -0.5, 0.5]::DOUBLE[]) AS o)",
        f"b AS MATERIALIZED (SELECT id, id % 20 AS k, x0 % {FOLD} AS x0, y0 % {FOLD} AS y0, x1 - x0 AS w, y1 - y0 AS h FROM v_box)",
        f"n AS (SELECT *, CAST(greatest(1, floor(CASE WHEN side % 2 = 0 THEN w ELSE h END / {SIDE})) AS BIGINT) AS n FROM (SELECT *, unnest([0, 1, 2, 3]) AS side FROM b))",
        "i AS (SELECT *, unnest(range(n)) / n AS s FROM n)",
        """p AS (SELECT id, k, w, h, x0 + w / 2 AS cx, y0 + h / 2 AS cy, CASE side WHEN 0 THEN x0 + w * s WHEN 1 THEN x0 + w WHEN 2 THEN x0 + w - w * s ELSE x0 END AS x,
        CASE side WHEN 0 THEN y0 WHEN 1 THEN y0 + h * s WHEN 2 THEN y0 + h ELSE y0 + h - h * s END AS y FROM i)""",
        "r AS (SELECT *, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS r FROM p, t)",
        "g AS MATERIALIZED (SELECT *, cx + (x - cx) * greatest(0, r + o) / r AS px, cy + (y - cy) * greatest(0, r + o) / r AS py FROM r)",
        scoring("c", coarse, "g"), chosen("c0", "c", "dx * dx + dy * dy + abs(o) * 1e-4"),
        "h AS MATERIALIZED (SELECT c0.id, c0.o, w, h, dx AS mx, dy AS my FROM c0 JOIN b ON b.id = c0.id)",
        f"m AS MATERIALIZED (SELECT id, o, s.dx, s.dy FROM (SELECT id, o, w, h, round(mx + i, 6) AS dx, round(my + unnest({steps(4, 0.25)}), 6) AS dy FROM (SELECT *, unnest({steps(4, 0.25)}) AS i FROM h)) s WHERE {fit})",
    ]
    last = "z0"
    parts.append("z0 AS (SELECT id, o, 0.0 AS a, 0.0 AS dx, 0.0 AS dy, 0.0 AS score FROM c0)")
    for i in range(1, ROUNDS_SQL + 1):
        parts += [scoring(f"s{i}", f"SELECT m.id, m.o, l.a, m.dx, m.dy FROM m JOIN {last} l ON l.id = m.id", "g"), chosen(f"y{i}", f"s{i}", move)]
        turns = f"SELECT id, o, unnest({steps(5, 1.0)}) AS a, dx, dy FROM y{i}"
        parts += [scoring(f"v{i}", turns, "g"), chosen(f"z{i}", f"v{i}", move)]
        last = f"z{i}"
    return f"WITH {', '.join(parts)} SELECT id, true AS applied, dx, dy, a AS degrees, o AS template, round(score, 6) AS score, CAST(NULL AS VARCHAR) AS reason FROM {last}"


@plan(alignment_sql(), "v_tri v_box")
def align_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Shift, rotation and template of each footprint that fit its patch's raster best (the oracle goes through all rounds, also where nothing changes any more)."""
    # the field counts heights, not sections, so that triangles of one outline are cut once; stored, since it is read twice
    got = aligned(outlines(spark, sf, SIDE), *placed_field(spark, sf), "k", "id")
    return got.select("id", "applied", "dx", "dy", "degrees", "template", F.round("score", 6).alias("score"), "reason")


@plan("SELECT count(*) AS n, round(sum(area), 4) AS area FROM (SELECT CASE WHEN x0 + s <= 300 AND y0 + s <= 300 AND x0 >= 100 AND y0 >= 100 THEN s * s / 2 END AS area FROM v_tri WHERE x0 >= 100 AND y0 >= 100 AND x0 + s <= 300 AND y0 + s <= 300)", "v_tri")
def clipped_inside(spark: SparkSession, sf: str) -> DataFrame:
    """Triangles inside the window come back whole, the area of their parts is theirs."""
    t = clipped(spark, sf).filter("x0 >= 100 AND y0 >= 100 AND x0 + s <= 300 AND y0 + s <= 300")
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 4).alias("area"))


def clipped(spark: SparkSession, sf: str) -> DataFrame:
    """Triangles cut to the window (100, 100)-(300, 300), with the area that is left."""
    x, y, s, z, n = (F.col(c) for c in ("x0", "y0", "s", "z", "ln"))
    corners = F.array(G.vertex(x, y, z), G.vertex(x + s, y, z + n), G.vertex(x, y + s, z))
    near = triangles(spark, sf).filter("x0 <= 300 AND y0 <= 300 AND x0 + s >= 100 AND y0 + s >= 100")
    c = near.withColumn("c", clipped_to_box(corners, *(F.lit(float(v)) for v in (100, 100, 300, 300))))
    area = F.aggregate(F.transform(fan(F.col("c")), lambda t: G.triangle_metrics(t["a"], t["b"], t["c"])["area"]), F.lit(0.0), lambda a, b: a + b)
    return c.withColumn("area", area)


@plan("SELECT oid, CAST(ln AS INT) AS ln, round((s - (100 - x0)) * (s - (100 - x0)) / 2, 6) AS area FROM v_tri WHERE x0 < 100 AND x0 + s > 100 AND y0 >= 100 AND y0 + s <= 300", "v_tri")
def clipped_at_edge(spark: SparkSession, sf: str) -> DataFrame:
    """Triangles that reach over the window's left side keep the similar triangle beyond it."""
    t = clipped(spark, sf).filter("x0 < 100 AND x0 + s > 100 AND y0 >= 100 AND y0 + s <= 300")
    return t.select("oid", "ln", F.round("area", 6).alias("area"))


@plan("SELECT id, h FROM v_box WHERE (x1 - x0) * (y1 - y0) >= 15", "v_box")
def eligible_groups(spark: SparkSession, sf: str) -> DataFrame:
    return boxes(spark, sf).filter((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= 15).select("id", "h")
