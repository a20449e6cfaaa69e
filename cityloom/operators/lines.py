"""Walking along lines: densification, even spacing, cumulative length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_next(df: DataFrame, key: str, pos: str, values: list[str]) -> DataFrame:
    """df with n_<value> of the next position; a line's last position has none."""
    w = Window.partitionBy(key).orderBy(pos)
    return df.withColumns({f"n_{v}": F.lead(v).over(w) for v in values})


def span(df_x: str = "x", df_y: str = "y") -> Column:
    dx, dy = F.col(f"n_{df_x}") - F.col(df_x), F.col(f"n_{df_y}") - F.col(df_y)
    return F.sqrt(dx * dx + dy * dy)


def densified(df: DataFrame, key: str, step: float, pos: str = "pos", values: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(key, pos, i, values): every vertex (i = 0) and points at most `step` apart between it and the next, linear in all values."""
    v = with_next(df.select(key, pos, *values), key, pos, list(values)).withColumn("_n", F.coalesce(F.greatest(F.ceil(span() / step), F.lit(1)), F.lit(1)).cast("int"))
    each = v.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = F.col("i") / F.col("_n")
    return each.select(key, pos, "i", *[F.coalesce(F.col(c) + (F.col(f"n_{c}") - F.col(c)) * t, F.col(c)).alias(c) for c in values])


def walked(df: DataFrame, key: str, step: float, pos: str = "pos") -> DataFrame:
    """(key, pos, i, x, y): each segment's start and evenly spaced points after it, floor(length / step) of them and at least one."""
    v = with_next(df.select(key, pos, "x", "y"), key, pos, ["x", "y"]).filter("n_x IS NOT NULL").withColumn("_l", span())
    v = v.withColumn("_n", F.greatest(F.floor(F.col("_l") / step).cast("int"), F.lit(1)))
    each = v.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = F.col("i") / F.col("_n")
    return each.select(key, pos, "i", (F.col("x") + (F.col("n_x") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("n_y") - F.col("y")) * t).alias("y"))


def even_walk(df: DataFrame, key: str, step: float, pos: str = "pos") -> DataFrame:
    """(key, k, x, y): floor(length / step) points, at least one, spread evenly over the whole line's length.

    Each segment makes the multiples of that even spacing that lie in its stretch
    of the cumulative length, so no join on intervals is needed.
    """
    v = with_next(df.select(key, pos, "x", "y"), key, pos, ["x", "y"]).filter("n_x IS NOT NULL").withColumn("_l", span()).filter("_l > 0")
    w = Window.partitionBy(key).orderBy(pos)
    whole = F.sum("_l").over(Window.partitionBy(key))
    at = v.withColumns({"_end": F.sum("_l").over(w), "_all": whole}).filter("_all >= 0.01").withColumn("_begin", F.col("_end") - F.col("_l"))
    at = at.withColumn("_n", F.greatest(F.floor(F.col("_all") / step), F.lit(1))).withColumn("_s", F.col("_all") / F.col("_n"))
    # a point at the end of a segment is that segment's; the line's start is the first one's
    first = F.when(F.col("_begin") == 0, F.lit(0)).otherwise(F.floor(F.col("_begin") / F.col("_s")) + 1)
    last = F.least(F.floor(F.col("_end") / F.col("_s")), F.col("_n") - 1)
    each = at.filter(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    t = (F.col("k") * F.col("_s") - F.col("_begin")) / F.col("_l")
    return each.select(key, "k", (F.col("x") + (F.col("n_x") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("n_y") - F.col("y")) * t).alias("y"))
