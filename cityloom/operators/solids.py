"""Solids over closed outlines: walls, top and base as triangles, turned outwards.

Top and base share one triangulation without added points, and walls use the
outline's vertices, so that every edge belongs to two faces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityloom import jts
from cityloom.functions import geometry as G

Surface = Callable[[Column, Column], Column]


def triangles_of(text: Column) -> Column:
    """Array of arrays of three points (x, y), counter-clockwise, from a triangulation's well-known text."""
    rings = F.regexp_extract_all(text, F.lit(r"\(\(([^()]*)\)\)"), F.lit(1))
    number = lambda p, i: F.split_part(F.trim(p), F.lit(" "), F.lit(i)).cast("double")
    points = lambda r: F.transform(F.slice(F.split(r, ","), 1, 3), lambda p: F.struct(number(p, 1).alias("x"), number(p, 2).alias("y")))
    return F.transform(F.transform(rings, points), lambda t: F.when(G.signed_area(t) < 0, F.reverse(t)).otherwise(t))


def faces(df: DataFrame, key: str, ring: str, bottom: Surface, top: Surface) -> DataFrame:
    """(key, kind, a, b, c): faces of the solid between two surfaces over each outline.

    ring: a closed counter-clockwise outline; bottom and top give heights at (x, y).
    """
    at = lambda p, z: F.struct(p["x"].alias("x"), p["y"].alias("y"), z(p["x"], p["y"]).cast("double").alias("z"))
    face = lambda kind, a, b, c: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), c.alias("c"))
    open_ring = F.slice(F.col(ring), 1, F.size(ring) - 1)

    def wall(e: Column) -> Column:
        p, q = F.struct(e["ax"].alias("x"), e["ay"].alias("y")), F.struct(e["bx"].alias("x"), e["by"].alias("y"))
        return F.array(face("wall", at(p, bottom), at(q, bottom), at(q, top)), face("wall", at(p, bottom), at(q, top), at(p, top)))

    cap = triangles_of(jts.overlay("triangulate", jts.polygon_text(F.col(ring))))
    roof = F.transform(cap, lambda t: face("top", *[at(F.get(t, i), top) for i in range(3)]))
    base = F.transform(cap, lambda t: face("base", *[at(F.get(t, i), bottom) for i in (0, 2, 1)]))
    return df.select("*", F.explode(F.concat(F.flatten(F.transform(G.sides(open_ring), wall)), roof, base)).alias("_f")).select(key, "_f.*")


def measured(solid: DataFrame, key: str) -> DataFrame:
    """(key, faces, edges, volume): number of faces, edges that don't belong to two of them, and the volume enclosed if they are turned outwards.

    One pass over the faces; where solid is partitioned by the key already,
    nothing is shuffled and a task holds the edges of its partition.
    """
    pair = lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    cross = (b["y"] * c["z"] - b["z"] * c["y"], b["z"] * c["x"] - b["x"] * c["z"], b["x"] * c["y"] - b["y"] * c["x"])
    v = a["x"] * cross[0] + a["y"] * cross[1] + a["z"] * cross[2]
    sides = solid.select(key, v.alias("_v"), F.posexplode(F.array(pair(a, b), pair(b, c), pair(c, a))).alias("_i", "_e"))
    # a face counts with its first side
    each = sides.groupBy(key, "_e").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_i") == 0).alias("_f"), F.sum(F.when(F.col("_i") == 0, F.col("_v"))).alias("_v"))
    return each.groupBy(key).agg(F.sum("_f").alias("faces"), F.count_if(F.col("_n") != 2).alias("edges"), (F.sum("_v") / 6).alias("volume"))
