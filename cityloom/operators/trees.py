"""Containment trees: parents, levels, ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.session import cut


def smallest_container(pairs: DataFrame, share: float) -> DataFrame:
    """(child, parent) from pairs (child, parent, shared, child_area, parent_area): the smallest larger one that holds `share` of the child."""
    ok = pairs.filter((F.col("parent_area") > F.col("child_area")) & (F.col("shared") / F.col("child_area") >= share))
    return ok.groupBy("child").agg(F.min(F.struct("parent_area", "parent")).alias("m")).select("child", F.col("m.parent").alias("parent"))


def ancestors(parent: DataFrame) -> DataFrame:
    """(id, ancestor, depth) from (id, parent), by doubling: rounds grow with the logarithm of the height."""
    known = cut(parent.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    reach = 1
    while True:
        top = known.filter(F.col("depth") == reach).select(F.col("id").alias("base"), F.col("ancestor").alias("id"))
        up = known.join(top, "id").select(F.col("base").alias("id"), "ancestor", (F.col("depth") + reach).alias("depth"))
        more = cut(up)
        if more.isEmpty():
            return known
        known, reach = cut(known.union(more)), 2 * reach


def levels(nodes: DataFrame, parent: DataFrame) -> DataFrame:
    """(id, level): 0 for roots."""
    depth = ancestors(parent).groupBy("id").agg(F.max("depth").alias("level"))
    return nodes.select("id").join(depth, "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"))
