"""Connected components of an edge list, distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """(node, component) of every node in `edges`; a component is named by its smallest node.

    Alternating star contraction: in the large-star step every node hands its
    larger neighbours to the smallest node it knows, in the small-star step it
    does so with its smaller ones.  Edges stay tree-like and never outnumber
    the input; the number of rounds grows with the logarithm of the longest
    path.  Minima are aggregated before they are shuffled; a hub's edges meet
    its minimum in one task, as pairs of numbers.  Each round is written to the
    shared checkpoint folder.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
    current = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        # large-star: neighbours w > u go to the smallest of u and its neighbours
        both = current.union(current.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large)
        # small-star: neighbours below u, and u itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        small = cut(small)
        # settled once every edge leads straight to a node that is the upper end of none
        pending = small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        repeated = 0 if pending else small.groupBy("u").count().filter("count > 1").limit(1).count()
        current = small
        if not pending and not repeated:
            break
    else:
        raise RuntimeError("components didn't settle")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
