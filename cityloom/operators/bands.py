"""Height bands: the window upwards with most area is taken, again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityloom.session import cut


#: Heights this close to a window's end are told apart by their difference from its start.
NEAR = 1e-9


def height_bands(df: DataFrame, key: str, z: str = "z", area: str = "area", width: float = 0.3, least: int = 2) -> DataFrame:
    """(key, band, z_min, z_max, area, n): of the windows of `width` upwards from a height that with most area is taken, then the best of what is left.

    A window holds heights whose difference from its start is at most `width`
    (which must be more than NEAR).  Ties go to more members, then to the smaller span, then the lower one;
    windows with fewer than `least` members don't count, and members of a taken
    window are gone.  A window that beats all that it could share a member with
    is taken in its turn whatever happens elsewhere, so that each round takes all
    such windows of all keys at once, and bands are numbered by their rank in the
    end.  Heights are counted before they are sorted: what a key holds in one
    task is its distinct heights, by a sort that spills.
    """
    k = F.col(key)
    left = df.filter(F.col(z).isNotNull() & ~F.isnan(z)).groupBy(k, F.col(z).cast("double").alias("z")).agg(F.sum(area).cast("double").alias("a"), F.count(F.lit(1)).alias("m"))
    left, done = cut(left), None
    before = Window.partitionBy(key).orderBy("z").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # frames over doubles exist in SQL alone
    over = f"OVER (PARTITION BY `{key}` ORDER BY z RANGE BETWEEN"
    up, near = f"{over} CURRENT ROW AND {width - NEAR!r}D FOLLOWING)", width + 2 * NEAR
    # a height at the window's very end counts by its difference, which rounding may put on either side of the frame's
    edge = F.expr(f"min(struct(z, a, m)) {over} {width - NEAR!r}D FOLLOWING AND {width + NEAR!r}D FOLLOWING)")
    on_edge = F.col("edge.z") - F.col("z") <= width
    with_edge = lambda inner, e: F.coalesce(F.expr(f"{inner} {up}"), F.lit(0)) + F.when(F.col("on_edge"), F.col(f"edge.{e}")).otherwise(0)
    around = f"{over} {near!r}D PRECEDING AND {near!r}D FOLLOWING)"
    while True:
        seen = left.withColumn("edge", edge).withColumn("on_edge", F.coalesce((F.col("edge.z") > F.col("z")) & on_edge, F.lit(False)))
        top = F.when(F.col("on_edge"), F.col("edge.z")).otherwise(F.expr(f"max(z) {up}"))
        seen = seen.withColumns({"area": F.round(with_edge("sum(a)", "a"), 9), "n": with_edge("sum(m)", "m"), "top": top})
        rank = F.when(F.col("n") >= least, F.struct("area", "n", (F.col("z") - F.col("top")).alias("s"), (-F.col("z")).alias("z")))
        ranked = seen.withColumn("rank", rank).withColumn("best", F.expr(f"max(rank) {around}"))
        marked = ranked.withColumn("taken", F.coalesce(F.col("rank") == F.col("best"), F.lit(False)))
        ended = cut(marked.withColumn("end", F.last(F.when(F.col("taken"), F.col("top")), ignorenulls=True).over(before)))
        taken = ended.filter("taken").select(key, F.col("z").alias("z_min"), F.col("top").alias("z_max"), "area", "n")
        if taken.isEmpty():
            break
        done = taken if done is None else done.unionByName(taken)
        left = cut(ended.filter("end IS NULL OR end < z").select(key, "z", "a", "m"))
    done = taken if done is None else done
    place = Window.partitionBy(key).orderBy(F.desc("area"), F.desc("n"), F.col("z_max") - F.col("z_min"), "z_min")
    return done.select(key, F.row_number().over(place).alias("band"), "z_min", "z_max", "area", F.col("n").cast("int").alias("n"))
