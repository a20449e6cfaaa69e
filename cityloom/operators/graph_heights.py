"""Node heights of a graph by sparse least squares, components of any size.

A sample saw height z at the share t of the way along an edge: (1-t) z_a + t z_b
is to equal z.  Each edge's share of the normal equations is summed in Spark; of
several solutions that with the least norm is found, because conjugate gradients
start from zero.  Components up to SMALL_EDGES edges are solved one in a task;
larger ones together, by conjugate gradients whose vectors are columns of a
table with a row a node and whose product is a join with the edges' sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cityloom.operators.components import connected_components
from cityloom.operators.iterative import propagated_median
from cityloom.session import cut

#: A component of so many edges at most is solved in one task.
SMALL_EDGES = 1 << 16
#: Residuals, relative to the right side, at which a solution counts, and rounds before there must be one.
TOLERANCE, MOST_ROUNDS = 1e-11, 2000


def normal_sums(samples: DataFrame) -> DataFrame:
    """Each edge's share of the normal equations: component, a, b, aa, ab, bb, ra, rb."""
    t, z = F.col("t"), F.col("z")
    u = 1 - t
    parts = {"aa": u * u, "ab": u * t, "bb": t * t, "ra": u * z, "rb": t * z}
    return samples.groupBy("component", "a", "b").agg(*[F.sum(e).alias(n) for n, e in parts.items()])


def _in_task(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes = np.unique(np.concatenate([pdf["a"], pdf["b"]]))
    n, ia, ib = len(nodes), np.searchsorted(nodes, pdf["a"]), np.searchsorted(nodes, pdf["b"])
    aa, ab, bb, ra, rb = (pdf[c].to_numpy(float) for c in ("aa", "ab", "bb", "ra", "rb"))
    right = np.bincount(ia, ra, n) + np.bincount(ib, rb, n)
    x, r = np.zeros(n), right
    p, was = r, float(r @ r)
    for _ in range(20 * n + 50):
        if was <= TOLERANCE**2 * float(right @ right):
            break
        q = np.bincount(ia, aa * p[ia] + ab * p[ib], n) + np.bincount(ib, ab * p[ia] + bb * p[ib], n)
        step = was / float(p @ q)
        x, r = x + step * p, r - step * q
        now = float(r @ r)
        p, was = r + (now / was) * p, now
    return pd.DataFrame({"node": nodes, "z": x})


def _across(sums: DataFrame) -> DataFrame:
    """Conjugate gradients over all rows of `sums` at once, one product and one round of sums an iteration."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("aa").alias("d"), F.col("ra").alias("b")), F.struct(F.col("b").alias("node"), F.col("bb").alias("d"), F.col("rb").alias("b"))))
    nodes = sums.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.d").alias("d"), F.sum("e.b").alias("r"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("to"), F.col("b").alias("node")), F.struct(F.col("b").alias("to"), F.col("a").alias("node"))))
    matrix = cut(sums.select(ways.alias("e"), "ab").select("e.to", "e.node", "ab"))

    def with_product(state: DataFrame) -> tuple[DataFrame, float, float]:
        """The state, a projection of what is stored, with w = A r, r.r and w.r."""
        off = matrix.join(state.select("node", "r"), "node").groupBy(F.col("to").alias("node")).agg(F.sum(F.col("ab") * F.col("r")).alias("o"))
        full = state.join(off, "node", "left").withColumn("w", F.col("d") * F.col("r") + F.coalesce("o", F.lit(0.0))).drop("o")
        seen = Observation()
        full = cut(full.observe(seen, F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("w") * F.col("r")).alias("wr")))
        return full, seen.get["rr"] or 0.0, seen.get["wr"] or 0.0

    zero = F.lit(0.0)
    state, rr, wr = with_product(cut(nodes).withColumns({"x": zero, "p": zero, "s": zero}))
    first, was, step = rr, None, 0.0
    for _ in range(MOST_ROUNDS):
        if rr <= TOLERANCE**2 * first:
            return state.select("node", F.col("x").alias("z"))
        turn = rr / was if was else 0.0
        step = rr / (wr - turn * rr / step) if was else rr / wr
        p, s = F.col("r") + turn * F.col("p"), F.col("w") + turn * F.col("s")
        state = state.select("node", "d", (F.col("x") + step * p).alias("x"), (F.col("r") - step * s).alias("r"), p.alias("p"), s.alias("s"))
        was = rr
        state, rr, wr = with_product(state)
    raise RuntimeError("heights didn't settle")


def least_squares(samples: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(node, z) of samples (component, a, b, t, z)."""
    sums = cut(normal_sums(samples))
    sizes = cut(sums.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    kind = samples.schema["a"].dataType.simpleString()
    few = sums.join(sizes.filter(F.col("n") <= small).select("component"), "component")
    out = few.groupBy("component").applyInPandas(_in_task, f"node {kind}, z double")
    if sizes.filter(F.col("n") > small).isEmpty():
        return cut(out)
    return cut(out.union(_across(sums.join(sizes.filter(F.col("n") > small).select("component"), "component"))))


def _residuals(samples: DataFrame, heights: DataFrame) -> DataFrame:
    at = lambda n: heights.select(F.col("node").alias(n), F.col("z").alias(f"z_{n}"))
    seen = samples.join(at("a"), "a").join(at("b"), "b")
    return seen.withColumn("off", F.abs((1 - F.col("t")) * F.col("z_a") + F.col("t") * F.col("z_b") - F.col("z")))


def fitted(edges: DataFrame, samples: DataFrame, *, reject: float = 2.0, steepest: float = 1.0, small: int = SMALL_EDGES) -> tuple[DataFrame, DataFrame]:
    """Heights (component, node, z, level) and edges (component, a, b, state) of a graph.

    edges (a, b, length, exempt), one a pair of nodes; samples (a, b, t, z) along
    them.  Edges of which a first fit rejects every sample are `unreliable` and
    go.  A second fit over what is left finds edges steeper than `steepest` that
    aren't exempt; a component of such edges alone is `dropped`.  The last fit is
    without rejected samples and steep edges; nodes that it leaves open take the
    median of the nearest fitted heights (level: steps to them).  Components
    without samples keep their edges, `unseen`, and get no heights.
    """
    named = connected_components(edges, "a", "b").withColumnRenamed("node", "a")
    e = cut(edges.join(named, "a").select("component", "a", "b", "length", "exempt"))
    s = cut(samples.join(e.select("component", "a", "b"), ["a", "b"]).select("component", "a", "b", "t", "z"))
    seen = s.select("component").distinct()

    first = least_squares(s, small)
    near = _residuals(s, first).filter(F.col("off") <= reject).select("a", "b").distinct()
    alive = cut(e.join(near, ["a", "b"], "left_semi"))
    current = cut(s.join(near, ["a", "b"], "left_semi"))
    second = first if alive.count() == e.join(seen, "component", "left_semi").count() else least_squares(current, small)

    at = lambda n: second.select(F.col("node").alias(n), F.col("z").alias(f"z_{n}"))
    slope = F.abs(F.col("z_a") - F.col("z_b")) / F.col("length")
    steep = ~F.coalesce("exempt", F.lit(False)) & (F.col("length") >= 1e-6) & (slope > steepest)
    judged = alive.join(at("a"), "a").join(at("b"), "b").withColumn("steep", steep)
    whole = judged.groupBy("component").agg(F.min(F.col("steep").cast("int")).alias("all_steep"))
    judged = cut(judged.join(whole, "component").select("component", "a", "b", "steep", (F.col("all_steep") == 1).alias("gone")))

    usable = judged.filter("NOT steep AND NOT gone").select("a", "b")
    last = least_squares(_residuals(current, second).filter(F.col("off") <= reject).join(usable, ["a", "b"], "left_semi"), small)
    # heights equal to a micrometre are one value to the median
    spread = propagated_median(judged.filter("NOT gone"), last.withColumn("z", F.round("z", 6)))
    heights = spread.join(named.withColumnRenamed("a", "node"), "node").select("component", "node", "z", "level")

    state = F.when(F.col("gone"), "dropped").when(F.col("steep"), "steep").when(F.col("steep").isNotNull(), "kept").when(F.col("seen"), "unreliable").otherwise("unseen")
    told = e.join(judged.drop("component"), ["a", "b"], "left").join(seen.withColumn("seen", F.lit(True)), "component", "left")
    return heights, told.select("component", "a", "b", state.alias("state"))
