"""Robust statistics of arrays, as column expressions.  Nulls must be gone before; empty arrays give null."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steepest slope of a fitted plane: that of 25 degrees.
MAX_SLOPE = math.tan(math.radians(25.0))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once (a lambda binds it), however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def _upper(s: Column) -> Column:
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def _lower(s: Column) -> Column:
    return F.get(s, F.floor((F.size(s) - 1) / 2).cast("int"))


def upper_median(values: Column) -> Column:
    """The element at half the count: of an even number the upper of the middle two."""
    return bound(F.array_sort(values), _upper)


def lower_median(values: Column) -> Column:
    return bound(F.array_sort(values), _lower)


def mid_median(values: Column) -> Column:
    """Mean of the middle two."""
    return bound(F.array_sort(values), lambda s: (_upper(s) + _lower(s)) / 2)


def kth_lowest(values: Column, k: int) -> Column:
    return F.get(F.array_sort(values), k - 1)


def iqr_min(values: Column) -> Column:
    """Smallest value within 1.5 interquartile ranges of the quartiles, these taken by index."""
    def least(q: Column) -> Column:
        gap = 1.5 * (q["q3"] - q["q1"])
        return F.array_min(F.filter(q["s"], lambda v: v.between(q["q1"] - gap, q["q3"] + gap)))

    at = lambda s, share: F.get(s, F.floor(F.size(s) * share).cast("int"))
    return bound(bound(F.array_sort(values), lambda s: F.struct(s.alias("s"), at(s, 0.25).alias("q1"), at(s, 0.75).alias("q3"))), least)


def scaled_mad(values: Column) -> Column:
    """1.4826 times the median distance from the median."""
    away = bound(F.struct(values.alias("v"), mid_median(values).alias("m")), lambda p: F.transform(p["v"], lambda v: F.abs(v - p["m"])))
    return 1.4826 * mid_median(away)


def plane(x: str, y: str, z: str) -> Column:
    """Aggregate: struct (a, b, c) of the least-squares plane z = a x + b y + c.

    Slopes come from the 2 x 2 system of covariances, the height from the means.
    Null for fewer than three points, (nearly) collinear ones and slopes above MAX_SLOPE.
    """
    vx, vy, vxy = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    gx, gy = F.covar_pop(x, z), F.covar_pop(y, z)
    spread = vx * vy - vxy * vxy
    a, b = F.try_divide(gx * vy - gy * vxy, spread), F.try_divide(gy * vx - gx * vxy, spread)
    c = F.avg(z) - a * F.avg(x) - b * F.avg(y)
    ok = (F.count(z) >= 3) & (spread > 1e-4 * vx * vy) & (a * a + b * b <= MAX_SLOPE * MAX_SLOPE)
    return F.when(ok, F.struct(a.alias("a"), b.alias("b"), c.alias("c")))


def plane_sums(n: Column, m: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """Aggregates for plane_of_sums over rows that each stand for n points at (x, y), m of which have a height, z in all."""
    w = {"n": n, "x": n * x, "y": n * y, "xx": n * x * x, "xy": n * x * y, "yy": n * y * y, "m": m, "mx": m * x, "my": m * y, "z": z, "xz": x * z, "yz": y * z}
    return [F.sum(c).alias(f"_{k}") for k, c in w.items()]


def plane_of_sums() -> Column:
    """plane() of the points that plane_sums() added up; best where x and y are small."""
    s = lambda k: F.col(f"_{k}")
    over = lambda k, n: F.try_divide(s(k), s(n))
    co = lambda k, i, j, n, p, q: over(k, n) - over(i, p) * over(j, q)
    vx, vy, vxy = co("xx", "x", "x", "n", "n", "n"), co("yy", "y", "y", "n", "n", "n"), co("xy", "x", "y", "n", "n", "n")
    gx, gy = co("xz", "mx", "z", "m", "m", "m"), co("yz", "my", "z", "m", "m", "m")
    spread = vx * vy - vxy * vxy
    a, b = F.try_divide(gx * vy - gy * vxy, spread), F.try_divide(gy * vx - gx * vxy, spread)
    c = over("z", "m") - a * over("x", "n") - b * over("y", "n")
    ok = (s("m") >= 3) & (spread > 1e-4 * vx * vy) & (a * a + b * b <= MAX_SLOPE * MAX_SLOPE)
    return F.when(ok, F.struct(a.alias("a"), b.alias("b"), c.alias("c")))


def ranked(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, v, _n, _upto, _all): distinct values with their counts, cumulative in ascending order.

    Equal values are counted before anything is sorted, and what is sorted
    spills; no key's values are gathered in one row.
    """
    w = Window.partitionBy(key)
    counted = df.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.withColumns({"_upto": F.sum("_n").over(w.orderBy("v")), "_all": F.sum("_n").over(w)})


def at_place(place: Column) -> Column:
    """Aggregate over ranked(): the value at this place, counted from 0."""
    return F.min(F.when(F.col("_upto") > place, F.col("v")))


def upper_place() -> Column:
    return F.floor(F.col("_all") / 2)


def lower_place() -> Column:
    return F.floor((F.col("_all") - 1) / 2)


def share_place(share: float) -> Column:
    return F.floor(F.col("_all") * share)


def median_of(df: DataFrame, key: str, value: str, out: str = "m") -> DataFrame:
    """(key, out): mean of the middle two."""
    both = ranked(df, key, value).groupBy(key).agg(at_place(upper_place()).alias("_u"), at_place(lower_place()).alias("_l"))
    return both.select(key, ((F.col("_u") + F.col("_l")) / 2).alias(out))


def scaled_mads(df: DataFrame, key: str, value: str, out: str = "mad") -> DataFrame:
    """(key, out): 1.4826 times the median distance from the median."""
    v = df.select(key, F.col(value).alias("_x")).join(median_of(df, key, value, "_m"), key)
    away = median_of(v.select(key, F.abs(F.col("_x") - F.col("_m")).alias("_d")), key, "_d", "_mad")
    return away.select(key, (1.4826 * F.col("_mad")).alias(out))


def side_widths(df: DataFrame, key: str, value: str, default: float, least: float = 1.0, out: str = "width") -> DataFrame:
    """(key, out): smallest value of at least `least` within 1.5 interquartile ranges of the quartiles, these taken by index; else the default."""
    r = ranked(df.withColumn(value, F.when(F.col(value) >= least, F.col(value))), key, value)
    q = r.groupBy(key).agg(at_place(share_place(0.25)).alias("_q1"), at_place(share_place(0.75)).alias("_q3"))
    gap = 1.5 * (F.col("_q3") - F.col("_q1"))
    kept = r.join(q, key).filter(F.col("v").between(F.col("_q1") - gap, F.col("_q3") + gap)).groupBy(key).agg(F.min("v").alias("_w"))
    return df.select(key).distinct().join(kept, key, "left").select(key, F.coalesce("_w", F.lit(float(default))).alias(out))
