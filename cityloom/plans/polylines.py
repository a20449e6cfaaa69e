"""Line plans: densify, walks, distance along, junction splits, widths (G-19 to G-25, I-02, I-09, I-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityloom.functions import geometry as G
from cityloom.operators.lines import densified, even_walk, span, walked, with_next
from cityloom.plans.registry import boxes, lines, plan

NEXT = "SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS len FROM (SELECT user_id, pos, x, y, z, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM v_line WINDOW w AS (PARTITION BY user_id ORDER BY pos))"


@plan(f"SELECT user_id, pos, CAST(i AS INT) AS i, round(coalesce(x + (nx - x) * (i / n), x), 6) AS x, round(coalesce(y + (ny - y) * (i / n), y), 6) AS y, round(coalesce(z + (nz - z) * (i / n), z), 6) AS z FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, CAST(coalesce(greatest(ceil(len / 50), 1), 1) AS BIGINT) AS n FROM ({NEXT})))", "v_line")
def densify(spark: SparkSession, sf: str) -> DataFrame:
    d = densified(lines(spark, sf), "user_id", 50.0)
    return d.select("user_id", "pos", "i", *[F.round(c, 6).alias(c) for c in ("x", "y", "z")])


@plan(f"SELECT user_id, pos, CAST(j AS INT) AS i, round(x + (nx - x) * (j / n), 6) AS x, round(y + (ny - y) * (j / n), 6) AS y FROM (SELECT *, unnest(range(n)) AS j FROM (SELECT *, CAST(greatest(1, floor(len / 40)) AS BIGINT) AS n FROM ({NEXT}) WHERE nx IS NOT NULL))", "v_line")
def ring_walk_a(spark: SparkSession, sf: str) -> DataFrame:
    return walked(lines(spark, sf), "user_id", 40.0).select("user_id", "pos", "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# The walk told from the points' side: each looks for the first segment whose end it doesn't pass.
WALK_SQL = f"""WITH s AS (SELECT *, sum(len) OVER (PARTITION BY user_id ORDER BY pos) AS fin FROM ({NEXT}) WHERE len > 0), t AS (SELECT user_id, max(fin) AS total, greatest(1, floor(max(fin) / 60)) AS n FROM s GROUP BY user_id HAVING max(fin) >= 0.01),
k AS (SELECT *, unnest(range(CAST(n AS BIGINT))) AS k FROM t), h AS (SELECT k.user_id, k.k, k.k * (k.total / k.n) AS d, min(s.pos) AS pos FROM k JOIN s ON s.user_id = k.user_id AND s.fin >= k.k * (k.total / k.n) GROUP BY ALL)
SELECT h.user_id, h.k, round(x + (nx - x) * ((d - (fin - len)) / len), 4) AS x, round(y + (ny - y) * ((d - (fin - len)) / len), 4) AS y FROM h JOIN s ON s.user_id = h.user_id AND s.pos = h.pos"""


@plan(WALK_SQL, "v_line")
def ring_walk_b(spark: SparkSession, sf: str) -> DataFrame:
    return even_walk(lines(spark, sf), "user_id", 60.0).select("user_id", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@plan("SELECT id, side, CAST(k AS INT) AS k, CASE side WHEN 0 THEN x0 + k * 0.5 WHEN 1 THEN x1 WHEN 2 THEN x1 - k * 0.5 ELSE x0 END AS x, CASE side WHEN 0 THEN y0 WHEN 1 THEN y0 + k * 0.5 WHEN 2 THEN y1 ELSE y1 - k * 0.5 END AS y FROM (SELECT *, unnest(range(CAST(2 * CASE WHEN side % 2 = 0 THEN x1 - x0 ELSE y1 - y0 END AS BIGINT))) AS k FROM v_box, (SELECT CAST(unnest([0, 1, 2, 3]) AS INT) AS side))", "v_box")
def boundary_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Outlines sampled every half metre."""
    v = boxes(spark, sf)
    s = v.select("id", F.posexplode(F.slice(G.sides(F.slice(G.box_ring(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))), 1, 4)), 1, 4)).alias("side", "e"))
    dx, dy = F.col("e.bx") - F.col("e.ax"), F.col("e.by") - F.col("e.ay")
    n = (F.sqrt(dx * dx + dy * dy) * 2).cast("int")
    each = s.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("k") / F.col("n")
    return each.select("id", "side", "k", (F.col("e.ax") + dx * t).alias("x"), (F.col("e.ay") + dy * t).alias("y"))


@plan(f"""WITH s AS (SELECT *, sum(len) OVER w AS fin, sum(len) OVER (PARTITION BY user_id) AS total FROM ({NEXT}) WHERE len > 0 WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, CAST(q AS INT) AS q, round(z + (nz - z) * ((total * q / 4 - (fin - len)) / len), 4) AS z FROM s, (SELECT unnest([1, 2, 3]) AS q) WHERE total * q / 4 > fin - len AND total * q / 4 <= fin""", "v_line")
def height_along(spark: SparkSession, sf: str) -> DataFrame:
    """Heights at the quarters of each line's length."""
    w = Window.partitionBy("user_id")
    s = with_next(lines(spark, sf), "user_id", "pos", ["x", "y", "z"]).withColumn("len", span()).filter("len > 0")
    s = s.withColumns({"fin": F.sum("len").over(w.orderBy("pos")), "total": F.sum("len").over(w)}).withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(3))))
    want = F.col("total") * F.col("q") / 4
    hit = s.filter((want > F.col("fin") - F.col("len")) & (want <= F.col("fin")))
    return hit.select("user_id", "q", F.round(F.col("z") + (F.col("n_z") - F.col("z")) * ((want - (F.col("fin") - F.col("len"))) / F.col("len")), 4).alias("z"))


@plan(f"WITH c AS (SELECT *, unnest([0.25, 0.5]::DOUBLE[]) AS t FROM ({NEXT}) WHERE nx IS NOT NULL), p AS (SELECT user_id, pos, 0::DOUBLE AS t, x, y, z FROM ({NEXT}) WHERE nx IS NOT NULL UNION ALL SELECT user_id, pos, t, x + (nx - x) * t, y + (ny - y) * t, z + (nz - z) * t FROM c) SELECT user_id, pos, CAST(t AS DOUBLE) AS t, round(x, 6) AS ax, round(z, 6) AS az, CAST(coalesce(lead(t) OVER (PARTITION BY user_id, pos ORDER BY t), 1::DOUBLE) AS DOUBLE) AS t_end FROM p", "v_line")
def split_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments cut at given places, heights interpolated."""
    s = with_next(lines(spark, sf), "user_id", "pos", ["x", "y", "z"]).filter("n_x IS NOT NULL")
    p = s.withColumn("t", F.explode(F.array(F.lit(0.0), F.lit(0.25), F.lit(0.5))))
    at = lambda c: F.round(F.col(c) + (F.col(f"n_{c}") - F.col(c)) * F.col("t"), 6)
    end = F.coalesce(F.lead("t").over(Window.partitionBy("user_id", "pos").orderBy("t")), F.lit(1.0))
    return p.select("user_id", "pos", "t", at("x").alias("ax"), at("z").alias("az"), end.alias("t_end"))


@plan(f"WITH s AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far, first_value(z) OVER (PARTITION BY user_id ORDER BY pos) AS za, first_value(z) OVER (PARTITION BY user_id ORDER BY pos DESC) AS zb, sum(len) OVER (PARTITION BY user_id) AS total FROM ({NEXT})) SELECT user_id, pos, round(za + (zb - za) * (so_far / total), 6) AS z FROM s WHERE total > 0", "v_line")
def rewrite_edge_heights(spark: SparkSession, sf: str) -> DataFrame:
    """Heights along a line interpolated between its end nodes."""
    w = Window.partitionBy("user_id")
    s = with_next(lines(spark, sf), "user_id", "pos", ["x", "y"]).withColumn("len", F.coalesce(span(), F.lit(0.0)))
    s = s.withColumns({"at": F.sum("len").over(w.orderBy("pos")) - F.col("len"), "total": F.sum("len").over(w), "za": F.first("z").over(w.orderBy("pos")), "zb": F.first("z").over(w.orderBy(F.desc("pos")))})
    return s.filter("total > 0").select("user_id", "pos", F.round(F.col("za") + (F.col("zb") - F.col("za")) * (F.col("at") / F.col("total")), 6).alias("z"))


@plan(f"SELECT user_id, pos, round(x + ox, 6) AS lx, round(y + oy, 6) AS ly, round(x - ox * 2, 6) AS rx, round(y - oy * 2, 6) AS ry FROM (SELECT *, -(ny - y) / len * 1.5 AS ox, (nx - x) / len * 1.5 AS oy FROM ({NEXT}) WHERE len > 0)", "v_line")
def offset_strips(spark: SparkSession, sf: str) -> DataFrame:
    """Corners of a strip of its own width to the left and right of each segment's start."""
    s = with_next(lines(spark, sf), "user_id", "pos", ["x", "y"]).withColumn("len", span()).filter("len > 0")
    ox, oy = -(F.col("n_y") - F.col("y")) / F.col("len") * 1.5, (F.col("n_x") - F.col("x")) / F.col("len") * 1.5
    return s.select("user_id", "pos", F.round(F.col("x") + ox, 6).alias("lx"), F.round(F.col("y") + oy, 6).alias("ly"), F.round(F.col("x") - ox * 2, 6).alias("rx"), F.round(F.col("y") - oy * 2, 6).alias("ry"))


@plan(f"SELECT user_id, CAST(count(*) FILTER (len < 1e-6) AS BIGINT) AS degenerate, CAST(count(*) FILTER (z > 0 OR nz > 0) AS BIGINT) AS with_height FROM ({NEXT}) WHERE nx IS NOT NULL GROUP BY user_id", "v_line")
def centre_lines(spark: SparkSession, sf: str) -> DataFrame:
    s = with_next(lines(spark, sf), "user_id", "pos", ["x", "y", "z"]).filter("n_x IS NOT NULL").withColumn("len", span())
    return s.groupBy("user_id").agg(F.count_if(F.col("len") < 1e-6).alias("degenerate"), F.count_if((F.col("z") > 0) | (F.col("n_z") > 0)).alias("with_height"))


@plan("SELECT user_id, array_agg({'x': x, 'y': y, 'z': coalesce(z, 0)}.z ORDER BY pos) AS heights, coalesce(array_agg(z ORDER BY pos)[100], array_agg(z ORDER BY pos)[-1], 0) AS padded FROM v_line GROUP BY user_id", "v_line")
def ragged_heights(spark: SparkSession, sf: str) -> DataFrame:
    """Height lists shorter than wanted: the last value, else 0."""
    v = lines(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("z", F.lit(0.0)).alias("z")))).alias("v"))
    z = v.select("user_id", F.transform("v", lambda p: p["z"]).alias("heights"))
    return z.withColumn("padded", F.coalesce(F.get("heights", 99), F.element_at("heights", -1), F.lit(0.0)))
