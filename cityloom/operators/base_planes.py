"""Robust planes through points: consensus over a fixed number of draws, for groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityloom.functions import stats as S
from cityloom.session import cut

# Draws, distance of inliers, fewest of them, steepest slope of a plane.
DRAWS, TOLERANCE, LEAST, STEEPEST = 80, 2.0, 3, math.tan(math.radians(25))


def drawn(seed: Column, draw: Column, slot: Column, n: Column) -> Column:
    """A place below n for each slot of each draw: multiplicative hashing, the same wherever it is computed."""
    h = ((seed + draw * 3 + slot + 1) * F.lit(2654435761)) % F.lit(4294967296)
    return F.floor(h * n / F.lit(4294967296.0)).cast("bigint")


def _gap(p: str = "p") -> Column:
    return F.abs(F.col("z") - (F.col(f"{p}.a") * F.col("x") + F.col(f"{p}.b") * F.col("y") + F.col(f"{p}.c")))


def ransac_planes(df: DataFrame, key: str, draws: int = DRAWS, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, a, b, c, inliers, source) of each group of points (key, x, y, z).

    The plane through three drawn points with most points within the tolerance,
    then the least mean distance, then the earlier draw, fitted again to those
    points (source ransac; drawn if that fit fails); planes steeper than 25
    degrees don't count.  Groups without one take their median height, flat.
    Draws depend on the key and the points, which are numbered by place.  Points
    meet the draws of their group as one array; counts are summed before they
    are shuffled.
    """
    w = Window.partitionBy(key).orderBy("x", "y", "z")
    p = cut(df.filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select(key, "x", "y", "z").withColumn("i", F.row_number().over(w) - 1))
    sizes = p.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    slots = sizes.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(2))))
    seed = F.pmod(F.xxhash64(key), F.lit(1_000_003)) if dict(df.dtypes)[key] not in ("int", "bigint") else F.pmod(F.col(key), F.lit(1_000_003))
    picks = slots.withColumn("i", drawn(seed, F.col("d"), F.col("s"), F.col("n"))).join(p, [key, "i"])
    at = lambda c, s: F.max(F.when(F.col("s") == s, F.col(c))).alias(f"{c}{s}")
    three = picks.groupBy(key, "d").agg(*[at(c, s) for c in "xyz" for s in range(3)])
    d = lambda c, s: F.col(f"{c}{s}") - F.col(f"{c}0")
    det = d("x", 1) * d("y", 2) - d("x", 2) * d("y", 1)
    a, b = (d("z", 1) * d("y", 2) - d("z", 2) * d("y", 1)) / det, (d("x", 1) * d("z", 2) - d("x", 2) * d("z", 1)) / det
    planes = three.filter(F.abs(det) >= 1e-9).select(key, "d", a.alias("a"), b.alias("b"), (F.col("z0") - a * F.col("x0") - b * F.col("y0")).alias("c"))
    planes = planes.filter(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")) <= STEEPEST)
    arrays = cut(planes.groupBy(key).agg(F.collect_list(F.struct("d", "a", "b", "c")).alias("planes")))  # at most `draws` each

    met = p.join(arrays, key).select(key, "x", "y", "z", F.explode("planes").alias("p")).withColumn("gap", _gap()).filter(F.col("gap") <= tolerance)
    scores = met.groupBy(key, "p").agg(F.count(F.lit(1)).alias("m"), F.round(F.avg("gap"), 9).alias("mean")).filter(F.col("m") >= LEAST)
    best = cut(scores.groupBy(key).agg(F.max_by(F.struct("p", "m"), F.struct("m", -F.col("mean"), -F.col("p.d"))).alias("b")).select(key, "b.p", "b.m"))
    again = p.join(best, key).filter(_gap() <= tolerance).groupBy(key).agg(S.plane("x", "y", "z").alias("f"))
    told = sizes.join(S.median_of(p.select(key, "z"), key, "z", "flat"), key).join(best, key, "left").join(again, key, "left")
    found = F.col("p").isNotNull()
    value = lambda c, flat: F.coalesce(F.col(f"f.{c}"), F.col(f"p.{c}"), flat).alias(c)
    source = F.when(F.col("f").isNotNull(), "ransac").when(found, "drawn").otherwise("median")
    return told.select(key, value("a", F.lit(0.0)), value("b", F.lit(0.0)), value("c", F.col("flat")), F.coalesce("m", "n").cast("int").alias("inliers"), source.alias("source"))
