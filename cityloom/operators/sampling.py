"""Samples inside polygons on grids of their own, finer where there are too few; reference heights from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityloom.functions import geometry as G
from cityloom.functions.stats import mid_median
from cityloom.session import cut


def cell_centres(polygons: DataFrame, step: float, key: str = "id", rings: str = "rings") -> DataFrame:
    """(key, step, x, y): centres of cells of the polygon's bounds, from their lower corner, that lie inside or on the boundary."""
    end = lambda k, f: F.expr(f"array_{f}(transform(get({rings}, 0), p -> p.{k}))")
    bounds = polygons.filter(F.size(F.get(rings, 0)) > 0).select(key, rings, *[end(k, f).alias(f"_{k}{i}") for k in "xy" for i, f in enumerate(("min", "max"))])
    places = lambda k: F.explode(F.transform(F.sequence(F.lit(0), F.ceil((F.col(f"_{k}1") - F.col(f"_{k}0")) / step - 0.5).cast("int")), lambda i: F.col(f"_{k}0") + step * (i + 0.5)))
    p = bounds.withColumn("x", places("x")).filter("x <= _x1").withColumn("y", places("y")).filter("y <= _y1")
    return p.filter(G.in_polygon(F.col(rings), F.col("x"), F.col("y"))).select(key, F.lit(step).alias("step"), "x", "y")


def samples_in_polygons(polygons: DataFrame, step: float, least_step: float, least: int, key: str = "id") -> DataFrame:
    """(key, step, x, y): cell centres; a polygon with some, but fewer than `least`, is sampled again with half the step while that gives more.

    A round carries on only the polygons that still have too few.  Polygons
    without any sample have no rows.
    """
    now = cut(cell_centres(polygons, step, key))
    done, open_ = None, polygons
    while True:
        sizes = now.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        few = cut(sizes.filter(F.col("n") < least))
        if step <= least_step or few.isEmpty():
            return now if done is None else done.unionByName(now)
        step = max(least_step, step / 2)
        open_ = open_.join(few.select(key), key, "left_semi")
        finer = cut(cell_centres(open_, step, key))
        more = cut(finer.groupBy(key).agg(F.count(F.lit(1)).alias("m")).join(few, key).filter("m > n").select(key))
        rest = now.join(more, key, "left_anti")
        done = cut(rest if done is None else done.unionByName(rest))
        now = cut(finer.join(more, key, "left_semi"))
        open_ = open_.join(more, key, "left_semi")


def reference_heights(polygons: DataFrame, samples: DataFrame, key: str = "id") -> DataFrame:
    """(key, x, y, z, status): the median of samples (key, x, y, z) and the sample nearest to it.

    Of equally near samples the lower, then the left one is taken, and where no
    height is known the first such sample.  status: ok, sample_failed (no sample
    has a height), missing_sample_points.
    """
    good = F.col("z").isNotNull() & ~F.isnan("z")
    w = Window.partitionBy(key).orderBy("z")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    placed = samples.filter(good).withColumns({"_i": F.row_number().over(w), "_n": n})
    # one or two values in the middle, whatever the number of samples
    middle = placed.filter((F.col("_i") >= F.floor((F.col("_n") + 1) / 2)) & (F.col("_i") <= F.floor(F.col("_n") / 2) + 1))
    medians = middle.groupBy(key).agg(mid_median(F.collect_list("z")).alias("z"))
    off = F.abs(F.col("s.z") - F.col("m.z"))
    at = samples.filter(good).alias("s").join(medians.alias("m"), key).groupBy(key).agg(F.first("m.z").alias("z"), F.min_by(F.struct("s.x", "s.y"), F.struct(off, F.col("s.y"), F.col("s.x"))).alias("p"))
    none = samples.groupBy(key).agg(F.min_by(F.struct("x", "y"), F.struct("y", "x")).alias("f"))
    told = polygons.select(key).join(none, key, "left").join(at, key, "left")
    status = F.when(F.col("z").isNotNull(), "ok").when(F.col("f").isNotNull(), "sample_failed").otherwise("missing_sample_points")
    return told.select(key, F.coalesce("p.x", "f.x").alias("x"), F.coalesce("p.y", "f.y").alias("y"), "z", status.alias("status"))
