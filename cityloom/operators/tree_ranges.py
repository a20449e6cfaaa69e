"""Sampling ranges of containment trees: what of its outline each member keeps for itself.

Siblings share the ground, those with the smaller subtree first; each takes what
of its subtree lies within its parent's share and under no earlier sibling.  A
member's range is its own outline within its share, less its children's shares.
Members left without a range go, and the trees are built anew until all have one.

Only overlapping siblings are joined, and trees are worked off level by level,
so no patch is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom import jts
from cityloom.operators.spatial_join import boxes_with_boxes
from cityloom.operators.trees import ancestors, smallest_container
from cityloom.session import cut

CELL = 32.0


def united(rows: DataFrame, key: str, geometry: str, out: str) -> DataFrame:
    """(key, out): union of the geometries of each key, gathered in one row: for a root these are all its descendants."""
    return rows.groupBy(key).agg(jts.overlay("union", jts.collection_text(F.sort_array(F.collect_list(geometry)))).alias(out))


def one_pass(members: DataFrame, pairs: DataFrame, share: float) -> DataFrame:
    """(id, range): null where nothing is left."""
    parent = cut(smallest_container(pairs, share).select(F.col("child").alias("id"), "parent"))
    up = ancestors(parent)
    lines = up.select("id", "ancestor").union(members.select("id", F.col("id").alias("ancestor")))
    subtree = united(lines.join(members.select("id", "g"), "id"), "ancestor", "g", "sub").withColumnRenamed("ancestor", "id")
    level = up.groupBy("id").agg(F.max("depth").alias("level"))
    reach = lines.join(members.select("id", "x0", "y0", "x1", "y1"), "id").groupBy(F.col("ancestor").alias("id")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    nodes = members.select("id", "g").join(subtree, "id").join(reach, "id").join(parent, "id", "left").join(level, "id", "left").withColumns({"level": F.coalesce("level", F.lit(0)), "size": jts.measure("area", F.col("sub"))})
    nodes = cut(nodes)
    a = nodes.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "parent", "size", "x0", "y0", "x1", "y1")])
    b = nodes.select(*[F.col(c).alias(f"b_{c}") for c in ("id", "parent", "size", "x0", "y0", "x1", "y1", "sub")])
    later = F.col("a_parent").eqNullSafe(F.col("b_parent")) & (F.struct("b_size", "b_id") < F.struct("a_size", "a_id"))
    met = boxes_with_boxes(a, b, CELL, ("a_x0", "a_y0", "a_x1", "a_y1"), ("b_x0", "b_y0", "b_x1", "b_y1"), later)
    before = united(met.select(F.col("a_id").alias("id"), "b_sub"), "id", "b_sub", "taken")
    open_ = nodes.join(before, "id", "left").withColumn("free", F.when(F.col("taken").isNull(), F.col("sub")).otherwise(jts.overlay("difference", F.col("sub"), F.col("taken"))))
    open_ = cut(open_.select("id", "parent", "level", "g", "free"))
    deepest = open_.agg(F.max("level")).first()[0] or 0
    share_of = cut(open_.filter("level = 0").select("id", F.col("free").alias("share")))
    front = share_of
    for depth in range(1, deepest + 1):
        mine = open_.filter(F.col("level") == depth).join(front.select(F.col("id").alias("parent"), F.col("share").alias("given")), "parent")
        front = cut(mine.select("id", jts.overlay("intersection", F.col("free"), F.col("given")).alias("share")))
        share_of = cut(share_of.union(front))
    given = united(share_of.join(parent, "id").select(F.col("parent").alias("id"), "share"), "id", "share", "children")
    own = open_.select("id", "g").join(share_of, "id").join(given, "id", "left").withColumn("own", jts.overlay("intersection", F.col("g"), F.col("share")))
    left = F.when(F.col("children").isNull(), F.col("own")).otherwise(jts.overlay("difference", F.col("own"), F.col("children")))
    left = own.select("id", jts.overlay("polygonal", left).alias("range"))
    return left.withColumn("range", F.when(jts.measure("area", F.col("range")) > 0, F.col("range")))


def tree_ranges_of(members: DataFrame, pairs: DataFrame, share: float) -> DataFrame:
    """(id, range) of members (id, x0, y0, x1, y1, g: outline as text); pairs as for smallest_container.  Every member in it has a range."""
    alive = cut(members)
    count = alive.count()
    while True:
        got = cut(one_pass(alive, pairs, share))
        kept = got.filter("range IS NOT NULL")
        left = kept.count()
        if left == count or not left:
            return kept
        ids = kept.select("id")
        alive, count = cut(alive.join(ids, "id", "left_semi")), left
        pairs = cut(pairs.join(ids.withColumnRenamed("id", "child"), "child", "left_semi").join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi"))
