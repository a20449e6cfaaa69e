"""Geometry kernels as column expressions.

A ring is array<struct<x double, y double>>, closed or not; a polygon is an
array of rings, the first the shell.  Null geometry gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box as a closed ring, counter-clockwise."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def bounds(ring: Column) -> Column:
    """Struct (x0, y0, x1, y1) around a ring's vertices."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def bounds_meet(a: Column, b: Column) -> Column:
    """Closed boxes touch."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def sides(ring: Column) -> Column:
    """Array of structs (ax, ay, bx, by): consecutive vertices, the last with the first."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.get(ring, (i + 1) % n)["x"].alias("bx"), F.get(ring, (i + 1) % n)["y"].alias("by")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column) -> Column:
    return total(F.transform(sides(ring), lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def polygon_area(polygon: Column) -> Column:
    """Shell less holes, never below 0."""
    holes = total(F.transform(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), ring_area))
    return F.greatest(F.lit(0.0), ring_area(F.get(polygon, 0)) - holes)


def closed_ring(ring: Column) -> Column:
    """Consecutive duplicates removed and the ring closed."""
    once = F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))
    return F.when(F.size(once) == 0, once).otherwise(F.when(F.get(once, 0) == F.element_at(once, -1), once).otherwise(F.concat(once, F.slice(once, 1, 1))))


def is_empty_ring(ring: Column) -> Column:
    """Fewer than four vertices once closed."""
    return F.coalesce(F.size(closed_ring(ring)) < 4, F.lit(True))


def on_side(e: Column, x: Column, y: Column) -> Column:
    cross = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
    return (cross == 0) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Ray crossing parity; the boundary counts as inside."""
    crossed = F.size(F.filter(sides(ring), lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])))
    return F.exists(sides(ring), lambda e: on_side(e, x, y)) | (crossed % 2 == 1)


def in_polygon(polygon: Column, x: Column, y: Column) -> Column:
    """Inside the shell and not strictly inside a hole."""
    holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0)))
    return in_ring(F.get(polygon, 0), x, y) & ~F.exists(holes, lambda h: in_ring(h, x, y) & ~F.exists(sides(h), lambda e: on_side(e, x, y)))


def ring_centroid(ring: Column) -> Column:
    """Area centroid; the vertices' mean where the area vanishes."""
    a = signed_area(ring)
    cross = lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]
    cx = total(F.transform(sides(ring), lambda e: (e["ax"] + e["bx"]) * cross(e))) / (6 * a)
    cy = total(F.transform(sides(ring), lambda e: (e["ay"] + e["by"]) * cross(e))) / (6 * a)
    mean = lambda k: total(F.transform(ring, lambda p: p[k])) / F.size(ring)
    return F.when(F.abs(a) > 1e-12, F.struct(cx.alias("x"), cy.alias("y"))).otherwise(F.struct(mean("x").alias("x"), mean("y").alias("y")))


def overlap_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Area that two boxes (x0, y0, x1, y1) share."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_gap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Distance between two boxes, 0 where they touch."""
    dx = F.greatest(a[0] - b[2], b[0] - a[2], F.lit(0.0))
    dy = F.greatest(a[1] - b[3], b[1] - a[3], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def vertex(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def triangle_normal(a: Column, b: Column, c: Column) -> Column:
    """Cross product of two sides: struct (x, y, z)."""
    ux, uy, uz = b["x"] - a["x"], b["y"] - a["y"], b["z"] - a["z"]
    vx, vy, vz = c["x"] - a["x"], c["y"] - a["y"], c["z"] - a["z"]
    return F.struct((uy * vz - uz * vy).alias("x"), (uz * vx - ux * vz).alias("y"), (ux * vy - uy * vx).alias("z"))


def triangle_metrics(a: Column, b: Column, c: Column) -> Column:
    """normal_z of the unit normal (null if degenerate), projected area, z_min, z_max, z_mean."""
    n = triangle_normal(a, b, c)
    length = F.sqrt(n["x"] * n["x"] + n["y"] * n["y"] + n["z"] * n["z"])
    return F.struct(F.when(length > 1e-12, n["z"] / length).alias("normal_z"), (F.abs(n["z"]) / 2).alias("area"), F.least(a["z"], b["z"], c["z"]).alias("z_min"), F.greatest(a["z"], b["z"], c["z"]).alias("z_max"), ((a["z"] + b["z"] + c["z"]) / 3).alias("z_mean"))


def height_in_triangle(x: Column, y: Column, a: Column, b: Column, c: Column, slack: float = 0.0) -> Column:
    """Height where the vertical line at (x, y) meets the triangle; null outside or if degenerate."""
    det = (b["y"] - c["y"]) * (a["x"] - c["x"]) + (c["x"] - b["x"]) * (a["y"] - c["y"])
    u = ((b["y"] - c["y"]) * (x - c["x"]) + (c["x"] - b["x"]) * (y - c["y"])) / det
    v = ((c["y"] - a["y"]) * (x - c["x"]) + (a["x"] - c["x"]) * (y - c["y"])) / det
    w = 1 - u - v
    return F.when((F.abs(det) >= 1e-15) & (u >= -slack) & (v >= -slack) & (w >= -slack), u * a["z"] + v * b["z"] + w * c["z"])


def plane_section(a: Column, b: Column, c: Column, z: Column) -> Column:
    """Points where a triangle's sides cross the height z: array of 0 or 2 (x, y), sides touched at a vertex counted once."""
    def cross(p: Column, q: Column) -> Column:
        t = (z - p["z"]) / (q["z"] - p["z"])
        return F.when((p["z"] <= z) != (q["z"] <= z), F.struct((p["x"] + (q["x"] - p["x"]) * t).alias("x"), (p["y"] + (q["y"] - p["y"]) * t).alias("y")))

    return F.filter(F.array(cross(a, b), cross(b, c), cross(c, a)), lambda p: p.isNotNull())


def rigid(x: Column, y: Column, cx: Column, cy: Column, dx: Column, dy: Column, degrees: Column) -> Column:
    """Rotation about (cx, cy) and then a shift: struct (x, y)."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.struct((cx + (x - cx) * c - (y - cy) * s + dx).alias("x"), (cy + (x - cx) * s + (y - cy) * c + dy).alias("y"))


def radial_offset(x: Column, y: Column, cx: Column, cy: Column, d: Column) -> Column:
    """A point moved away from (cx, cy) by d."""
    r = F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))
    k = F.when(r > 0, d / r).otherwise(F.lit(0.0))
    return F.struct((x + (x - cx) * k).alias("x"), (y + (y - cy) * k).alias("y"))


def rounded(v: Column, digits: int) -> Column:
    """v to so many digits by the double's own arithmetic, halves away from zero; F.round goes by the decimal text of v, which moves halves that aren't doubles."""
    scale = 10.0**digits
    return F.signum(v) * F.floor(F.abs(v) * scale + 0.5) / scale


def segments_cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Struct (t, u, x, y) where two segments cross; null if they don't or are parallel."""
    rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
    det = rx * sy - ry * sx
    t = ((cx - ax) * sy - (cy - ay) * sx) / det
    u = ((cx - ax) * ry - (cy - ay) * rx) / det
    return F.when((det != 0) & t.between(0, 1) & u.between(0, 1), F.struct(t.alias("t"), u.alias("u"), (ax + rx * t).alias("x"), (ay + ry * t).alias("y")))


def project_on_segment(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Struct (t, d): clamped position along a segment and the distance to it."""
    rx, ry = bx - ax, by - ay
    n = rx * rx + ry * ry
    t = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - ax) * rx + (y - ay) * ry) / n))).otherwise(F.lit(0.0))
    ex, ey = x - (ax + rx * t), y - (ay + ry * t)
    return F.struct(t.alias("t"), F.sqrt(ex * ex + ey * ey).alias("d"))


def hexagon(x: Column, y: Column, radius: float) -> Column:
    """Closed ring of six corners around a point."""
    turn = lambda i: F.radians(i * 60.0)
    return F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.struct((x + radius * F.cos(turn(i % 6))).alias("x"), (y + radius * F.sin(turn(i % 6))).alias("y")))


def finite_vector(v: Column) -> Column:
    """Every element is a finite number."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def bridge_slabs(kind: Column, base: Column, floor: float, interior: float, cover: float) -> Column:
    """Array of structs (low, high): the solids that stand on a walkway's base."""
    slab = lambda a, b: F.struct((base + a).alias("low"), (base + b).alias("high"))
    top = floor + interior + cover
    return F.when(kind == "covered", F.array(slab(0.0, top))).when(kind == "viaduct", F.array(slab(0.0, floor))).otherwise(F.array(slab(0.0, floor), slab(top - cover, top)))
