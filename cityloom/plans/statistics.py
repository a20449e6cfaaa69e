"""Robust aggregates, bands, rankings and line windows (A and W rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityloom.functions import stats as S
from cityloom.plans.registry import lines, plan, points, table


ARR = "SELECT l_suppkey, list_sort(array_agg(l_extendedprice)) AS v, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_suppkey"


@plan(f"SELECT l_suppkey, v[n // 2 + 1] AS m FROM ({ARR})")
def upper_median(spark: SparkSession, sf: str) -> DataFrame:
    return S.ranked(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice").groupBy("l_suppkey").agg(S.at_place(S.upper_place()).alias("m"))


@plan("SELECT l_suppkey, round(median(l_extendedprice), 6) AS m FROM lineitem GROUP BY l_suppkey")
def mid_median(spark: SparkSession, sf: str) -> DataFrame:
    return S.median_of(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice").select("l_suppkey", F.round("m", 6).alias("m"))


WMED = "SELECT l_suppkey, l_quantity AS z, sum(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber) AS cw, sum(l_linenumber) OVER (PARTITION BY l_suppkey) AS tw FROM lineitem"


@plan(f"SELECT l_suppkey, min(z) AS m FROM ({WMED}) WHERE cw >= tw / 2 GROUP BY l_suppkey")
def weighted_median(spark: SparkSession, sf: str) -> DataFrame:
    # weights of equal values are summed first, so that windows run over distinct values
    v = table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_quantity").alias("z")).agg(F.sum("l_linenumber").alias("w"))
    part = Window.partitionBy("l_suppkey")
    cum = v.withColumns({"cw": F.sum("w").over(part.orderBy("z")), "tw": F.sum("w").over(part)})
    return cum.filter(F.col("cw") >= F.col("tw") / 2).groupBy("l_suppkey").agg(F.min("z").alias("m"))


@plan(f"WITH m AS (SELECT l_suppkey, min(z) AS m FROM ({WMED}) WHERE cw >= tw / 2 GROUP BY l_suppkey), d AS (SELECT l.l_suppkey, abs(l_quantity - m) AS z, l_linenumber AS w FROM lineitem l JOIN m ON m.l_suppkey = l.l_suppkey), c AS (SELECT l_suppkey, z, sum(w) OVER (PARTITION BY l_suppkey ORDER BY z) AS cw, sum(w) OVER (PARTITION BY l_suppkey) AS tw FROM d) SELECT l_suppkey, min(z) AS mad FROM c WHERE cw >= tw / 2 GROUP BY l_suppkey")
def weighted_mad(spark: SparkSession, sf: str) -> DataFrame:
    m = weighted_median(spark, sf)
    d = table(spark, sf, "lineitem").join(m, "l_suppkey").groupBy("l_suppkey", F.abs(F.col("l_quantity") - F.col("m")).alias("z")).agg(F.sum("l_linenumber").alias("w"))
    part = Window.partitionBy("l_suppkey")
    cum = d.withColumns({"cw": F.sum("w").over(part.orderBy("z")), "tw": F.sum("w").over(part)})
    return cum.filter(F.col("cw") >= F.col("tw") / 2).groupBy("l_suppkey").agg(F.min("z").alias("mad"))


@plan("WITH m AS (SELECT l_suppkey, median(l_quantity) AS m FROM lineitem GROUP BY l_suppkey) SELECT l.l_suppkey, round(1.4826 * median(abs(l_quantity - m)), 6) AS mad FROM lineitem l JOIN m ON m.l_suppkey = l.l_suppkey GROUP BY l.l_suppkey")
def scaled_mad(spark: SparkSession, sf: str) -> DataFrame:
    return S.scaled_mads(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity").select("l_suppkey", F.round("mad", 6).alias("mad"))


@plan("WITH a AS (SELECT l_suppkey, list_sort(array_agg(l_quantity / 10) FILTER (l_quantity >= 10)) AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY l_suppkey), q AS (SELECT *, v[CAST(floor(len(v) * 0.25) AS BIGINT) + 1] AS q1, v[CAST(floor(len(v) * 0.75) AS BIGINT) + 1] AS q3 FROM a) SELECT l_suppkey, round(coalesce(list_min(list_filter(v, lambda x: x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1))), 2.5), 6) AS width FROM q")
def side_width(spark: SparkSession, sf: str) -> DataFrame:
    """Half width of a way from its probes: those below a metre don't count, nor do outliers; 2.5 where none is left."""
    probes = table(spark, sf, "lineitem").filter("l_linenumber = 1").select("l_suppkey", (F.col("l_quantity") / 10).alias("probe"))
    return S.side_widths(probes, "l_suppkey", "probe", 2.5).select("l_suppkey", F.round("width", 6).alias("width"))


@plan("SELECT user_id, coalesce(list_sort(array_agg(value))[3], -1e9) AS z FROM events WHERE value IS NOT NULL GROUP BY user_id")
def third_lowest(spark: SparkSession, sf: str) -> DataFrame:
    v = S.ranked(table(spark, sf, "events"), "user_id", "value").groupBy("user_id").agg(S.at_place(F.lit(2)).alias("z"))
    return v.select("user_id", F.coalesce("z", F.lit(-1e9)).alias("z"))


@plan("WITH g AS (SELECT l_suppkey, list_sort(array_agg(l_quantity))[3] AS ground FROM lineitem GROUP BY l_suppkey) SELECT l.l_suppkey, CAST(count(*) AS BIGINT) AS before, CAST(count(*) FILTER (l_quantity + l_linenumber >= ground) AS BIGINT) AS after, CAST(count(*) FILTER (NOT l_quantity + l_linenumber >= ground) AS BIGINT) AS removed FROM lineitem l JOIN g ON g.l_suppkey = l.l_suppkey GROUP BY l.l_suppkey")
def ground_filter_counts(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    g = S.ranked(li, "l_suppkey", "l_quantity").groupBy("l_suppkey").agg(S.at_place(F.lit(2)).alias("ground"))
    ok = F.col("l_quantity") + F.col("l_linenumber") >= F.col("ground")
    return li.join(g, "l_suppkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("before"), F.count_if(ok).alias("after"), F.count_if(~ok).alias("removed"))


@plan("SELECT why, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN l_discount = 0 THEN 'degenerate' WHEN l_tax < 0.03 THEN 'normal' WHEN l_quantity <= 2 THEN 'terrain' ELSE 'kept' END AS why FROM lineitem) GROUP BY why")
def candidate_counters(spark: SparkSession, sf: str) -> DataFrame:
    """One label a row, the first reason that holds, counted."""
    why = F.when(F.col("l_discount") == 0, "degenerate").when(F.col("l_tax") < 0.03, "normal").when(F.col("l_quantity") <= 2, "terrain").otherwise("kept")
    return table(spark, sf, "lineitem").groupBy(why.alias("why")).agg(F.count(F.lit(1)).alias("n"))


@plan("SELECT max(z) AS top, min(z) AS bottom, CAST(count(z) AS BIGINT) AS n FROM v_pts", "v_pts")
def model_top_bottom(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).agg(F.max("z").alias("top"), F.min("z").alias("bottom"), F.count("z").alias("n"))


# Slopes by regression on what the other coordinate leaves over: another way to the same plane.
PLANE_SQL = """WITH p AS (SELECT id % 25 AS k, x, y, z / 20 + x * 0.05 AS z FROM v_pts), r AS (SELECT k, regr_slope(y, x) AS yx, regr_slope(x, y) AS xy, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p GROUP BY k),
s AS (SELECT r.k, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, regr_slope(z, (x - mx) - xy * (y - my)) AS a, regr_slope(z, (y - my) - yx * (x - mx)) AS b FROM p JOIN r ON r.k = p.k GROUP BY r.k)
SELECT k, round(a, 6) AS a, round(b, 6) AS b, round(mz - a * mx - b * my, 4) AS c FROM s WHERE sqrt(a * a + b * b) <= tan(radians(25))"""


@plan(PLANE_SQL, "v_pts")
def plane_fit(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).select((F.col("id") % 25).alias("k"), "x", "y", (F.col("z") / 20 + F.col("x") * 0.05).alias("z"))
    fit = p.groupBy("k").agg(S.plane("x", "y", "z").alias("p")).filter("p IS NOT NULL")
    return fit.select("k", F.round("p.a", 6).alias("a"), F.round("p.b", 6).alias("b"), F.round("p.c", 4).alias("c"))


@plan("SELECT l_suppkey, round(avg(CASE WHEN isfinite(l_extendedprice / l_discount) THEN l_extendedprice / l_discount END), 4) AS score FROM lineitem GROUP BY l_suppkey")
def finite_mean(spark: SparkSession, sf: str) -> DataFrame:
    q = F.try_divide("l_extendedprice", "l_discount")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(F.when(~F.isnan(q) & (F.abs(q) < float("inf")), q)), 4).alias("score"))


BAND = "SELECT l_suppkey, l_quantity AS z, sum(l_extendedprice) OVER w AS area, CAST(count(*) OVER w AS BIGINT) AS n, max(l_quantity) OVER w AS z_max FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING)"


@plan(f"SELECT l_suppkey, z, round(area, 2) AS area, n, z_max FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(area, 2) DESC, n DESC, z_max - z, z) AS rn FROM ({BAND})) WHERE rn = 1")
def best_height_band(spark: SparkSession, sf: str) -> DataFrame:
    """Of all two-metre windows upwards the one with most area."""
    # equal heights are one row before the window, so that frames stay short
    v = table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_quantity").cast("double").alias("z")).agg(F.sum("l_extendedprice").alias("a"), F.count(F.lit(1)).alias("k"))
    w = spark.sql("SELECT l_suppkey, z, sum(a) OVER w AS area, sum(k) OVER w AS n, max(z) OVER w AS z_max FROM {v} WINDOW w AS (PARTITION BY l_suppkey ORDER BY z RANGE BETWEEN CURRENT ROW AND 2D FOLLOWING)", v=v)
    best = F.min_by(F.struct("z", F.round("area", 2).alias("area"), "n", "z_max"), F.struct(-F.round("area", 2), -F.col("n"), F.col("z_max") - F.col("z"), F.col("z")))
    return w.groupBy("l_suppkey").agg(best.alias("b")).select("l_suppkey", "b.*")


@plan("SELECT l_suppkey, l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_discount, l_quantity DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def argmax_tie(spark: SparkSession, sf: str) -> DataFrame:
    key = F.struct(-F.col("l_extendedprice"), F.col("l_discount"), -F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber"))
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.min_by(F.struct("l_orderkey", "l_linenumber"), key).alias("m")).select("l_suppkey", "m.*")


@plan("WITH c AS (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) - min(l_quantity) OVER (PARTITION BY l_orderkey) AS span FROM lineitem), f AS (SELECT *, CASE WHEN span >= 8 AND l_quantity <= 5 THEN 1 ELSE 0 END AS low, count(*) OVER (PARTITION BY l_orderkey) AS n, sum(CASE WHEN span >= 8 AND l_quantity <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS lows FROM c) SELECT l_orderkey, arg_max(l_linenumber, l_extendedprice * 10 - l_linenumber) AS main FROM f WHERE low = 0 OR lows = n GROUP BY l_orderkey")
def main_cluster(spark: SparkSession, sf: str) -> DataFrame:
    """Largest cluster; where heights spread widely those near the terrain don't count, unless none is left."""
    w = Window.partitionBy("l_orderkey")
    low = (F.max("l_quantity").over(w) - F.min("l_quantity").over(w) >= 8) & (F.col("l_quantity") <= 5)
    c = table(spark, sf, "lineitem").withColumn("low", low)
    return c.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct(~F.col("low"), F.col("l_extendedprice") * 10 - F.col("l_linenumber"))).alias("main"))


@plan("SELECT p_brand, p_partkey, CAST(rn AS INT) AS rank, CASE rn WHEN 1 THEN 'main' WHEN 2 THEN 'secondary' ELSE 'candidate' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3")
def top3_rank(spark: SparkSession, sf: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    role = F.when(F.col("rank") == 1, "main").when(F.col("rank") == 2, "secondary").otherwise("candidate")
    return table(spark, sf, "part").withColumn("rank", rn).filter("rank <= 3").select("p_brand", "p_partkey", "rank", role.alias("role"))


@plan("SELECT l_partkey, l_suppkey, l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END DESC, l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def dup_edge_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Of edges between the same nodes: step type, then valid samples, then length; the first of equals."""
    kind = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    key = F.struct(-kind, -F.col("l_quantity"), -F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"))
    return table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min_by(F.struct("l_orderkey", "l_linenumber"), key).alias("m")).select("l_partkey", "l_suppkey", "m.*")


def line_order() -> object:
    return Window.partitionBy("user_id").orderBy("pos")


def step_length() -> object:
    px, py = F.lag("x").over(line_order()), F.lag("y").over(line_order())
    return F.coalesce(F.sqrt((F.col("x") - px) * (F.col("x") - px) + (F.col("y") - py) * (F.col("y") - py)), F.lit(0.0))


STEP = "SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS step FROM v_line WINDOW w AS (PARTITION BY user_id ORDER BY pos)"


@plan(f"SELECT user_id, pos, round(sum(step) OVER (PARTITION BY user_id ORDER BY pos), 6) AS len FROM ({STEP})", "v_line")
def cum_length(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).withColumn("step", step_length()).select("user_id", "pos", F.round(F.sum("step").over(line_order()), 6).alias("len"))


@plan("SELECT user_id, pos, CASE WHEN len < 1e-15 THEN 0.0 ELSE round(-dy / len, 6) + 0.0 END AS nx, CASE WHEN len < 1e-15 THEN 1.0 ELSE round(dx / len, 6) + 0.0 END AS ny FROM (SELECT *, sqrt(dx * dx + dy * dy) AS len FROM (SELECT user_id, pos, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM v_line WINDOW w AS (PARTITION BY user_id ORDER BY pos)))", "v_line")
def edge_normals(spark: SparkSession, sf: str) -> DataFrame:
    """Left normal of each vertex from its neighbours, ends from one; (0, 1) where they coincide."""
    w = line_order()
    d = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    v = lines(spark, sf).select("user_id", "pos", d("x").alias("dx"), d("y").alias("dy")).withColumn("len", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    flat = F.col("len") < 1e-15
    return v.select("user_id", "pos", F.when(flat, 0.0).otherwise(F.round(-F.col("dy") / F.col("len"), 6) + 0.0).alias("nx"), F.when(flat, 1.0).otherwise(F.round(F.col("dx") / F.col("len"), 6) + 0.0).alias("ny"))


@plan("WITH t AS (SELECT user_id, pos, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM v_line WHERE z > 0) SELECT user_id, pos FROM t WHERE n >= 2 AND (i - 1) % greatest(1, n // 20) = 0 AND (i - 1) // greatest(1, n // 20) < 20", "v_line")
def stride20(spark: SparkSession, sf: str) -> DataFrame:
    """At most twenty of a line's positions with a height, evenly strided; none where fewer than two have one."""
    w = Window.partitionBy("user_id")
    v = lines(spark, sf).filter("z > 0").withColumns({"i": F.row_number().over(line_order()) - 1, "n": F.count(F.lit(1)).over(w)})
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 20))
    return v.filter((F.col("n") >= 2) & (F.col("i") % step == 0) & (F.floor(F.col("i") / step) < 20)).select("user_id", "pos")


@plan("WITH c AS (SELECT user_id, pos, z, first_value(z) OVER (PARTITION BY user_id ORDER BY pos) AS centre FROM v_line) SELECT user_id, round(min((pos - 1) * 0.3) FILTER (pos > 1 AND (z IS NULL OR z <= 0 OR abs(centre - z) > 2)), 6) AS edge FROM c GROUP BY user_id", "v_line")
def first_discontinuity(spark: SparkSession, sf: str) -> DataFrame:
    """Distance along a probe in steps of 0.3 m to the first sample without height or over 2 m off the centre's; null if there is none."""
    centre = F.first("z").over(line_order())
    bad = F.col("z").isNull() | (F.col("z") <= 0) | (F.abs(F.col("centre") - F.col("z")) > 2)
    v = lines(spark, sf).withColumn("centre", centre)
    return v.groupBy("user_id").agg(F.round(F.min(F.when((F.col("pos") > 1) & bad, (F.col("pos") - 1) * 0.3)), 6).alias("edge"))


@plan("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 300")
def keep_last_300(spark: SparkSession, sf: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf, "events").withColumn("rn", rn).filter("rn <= 300").select("event_id", "user_id")


@plan("SELECT p_partkey, p_size, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) AS place FROM part")
def stable_order(spark: SparkSession, sf: str) -> DataFrame:
    """Members by level, index and id; text compares by bytes."""
    rn = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_retailprice", "p_partkey"))
    return table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", rn.cast("bigint").alias("place"))


@plan("SELECT p_brand, CASE WHEN p_size <= 15 THEN 'adapted' WHEN p_retailprice < 950 THEN 'skipped' ELSE 'attributed' END AS why, CAST(count(*) AS BIGINT) AS n, array_agg(p_partkey ORDER BY p_partkey) AS ids FROM part GROUP BY ALL")
def attribution_counts(spark: SparkSession, sf: str) -> DataFrame:
    why = F.when(F.col("p_size") <= 15, "adapted").when(F.col("p_retailprice") < 950, "skipped").otherwise("attributed")
    return table(spark, sf, "part").groupBy("p_brand", why.alias("why")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("p_partkey")).alias("ids"))


@plan("SELECT p_brand, CAST(min(p_partkey) AS BIGINT) AS first_seen, CAST(count(*) AS BIGINT) AS n, array_agg(p_partkey ORDER BY p_partkey) AS ids FROM part GROUP BY p_brand")
def groups_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("first_seen"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("p_partkey")).alias("ids"))


@plan("SELECT l.l_orderkey, CAST(l.l_linenumber AS INT) AS l_linenumber, o.o_orderstatus FROM lineitem l JOIN (SELECT o_orderkey, o_orderstatus FROM orders) o ON o.o_orderkey = l.l_orderkey")
def composite_key_match(spark: SparkSession, sf: str) -> DataFrame:
    """Aligned features with their originals, and nothing where either is missing."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus")


@plan("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def unresolved_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(u, "o_orderkey", "left_semi")


@plan("SELECT c_custkey, coalesce(o.k, -1) AS last_order, CASE WHEN o.k IS NULL THEN 'unresolved' ELSE 'resolved' END AS state FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey")
def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("k", F.lit(-1).cast("bigint")).alias("last_order"), F.when(F.col("k").isNull(), "unresolved").otherwise("resolved").alias("state"))
