"""Coordinates, angles, tiles: column expressions and the projection's constants."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public registry parameters of the Hong Kong 1980 grid and its datum shift.
SHIFT = dict(dx=-162.619, dy=-276.959, dz=-161.764, rx=0.067753, ry=-2.24365, rz=-1.15883, ppm=-1.09425)
WGS84, INTERNATIONAL = (6378137.0, 1 / 298.257223563), (6378388.0, 1 / 297.0)
LAT0, LON0 = math.radians(22 + 18 / 60 + 43.68 / 3600), math.radians(114 + 10 / 60 + 42.80 / 3600)
EASTING0, NORTHING0 = 836694.05, 819069.80
MERCATOR_RADIUS = 6378137.0
WALK_RADIUS, ATTACH_RADIUS = 6371000.0, 6371008.8
DEGREE_X, DEGREE_Y = 111320.0, 110540.0


def let(f, **values: Column) -> Column:
    """f of a struct of values, each computed once per row (a lambda binds them).

    Written out, the series below would repeat their inner terms thousands of times.
    """
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f), 0)


def _meridian(phi: Column | float, a: float, f: float):
    """Meridian arc length from the equator."""
    e2 = 2 * f - f * f
    e4, e6 = e2 * e2, e2 * e2 * e2
    c = [1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256, 3 / 8 * (e2 + e4 / 4 + 15 * e6 / 128), 15 / 256 * (e4 + 3 * e6 / 4), 35 * e6 / 3072]
    sin = math.sin if isinstance(phi, float) else F.sin
    return a * (c[0] * phi - c[1] * sin(2 * phi) + c[2] * sin(4 * phi) - c[3] * sin(6 * phi))


def _geocentric(lon: Column, lat: Column, a: float, f: float) -> tuple[Column, Column, Column]:
    e2 = 2 * f - f * f
    nu = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return nu * F.cos(lat) * F.cos(lon), nu * F.cos(lat) * F.sin(lon), nu * (1 - e2) * F.sin(lat)


def _geodetic(x: Column, y: Column, z: Column, a: float, f: float) -> tuple[Column, Column]:
    """Bowring's closed form, exact to well below a millimetre near the ground."""
    e2, b = 2 * f - f * f, a * (1 - f)
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * a, p * b)
    lat = F.atan2(z + e2 / (1 - e2) * b * F.pow(F.sin(t), 3), p - e2 * a * F.pow(F.cos(t), 3))
    return F.atan2(y, x), lat


def _shift(x: Column, y: Column, z: Column, sign: float) -> tuple[Column, Column, Column]:
    """Position-vector transformation from the local datum to WGS84 (sign 1) or its small-angle inverse (-1)."""
    s = SHIFT
    rx, ry, rz = (math.radians(s[k] / 3600) for k in ("rx", "ry", "rz"))
    m = 1 + s["ppm"] * 1e-6
    if sign > 0:
        return s["dx"] + m * (x - rz * y + ry * z), s["dy"] + m * (rz * x + y - rx * z), s["dz"] + m * (-ry * x + rx * y + z)
    u, v, w = (x - s["dx"]) / m, (y - s["dy"]) / m, (z - s["dz"]) / m
    return u + rz * v - ry * w, -rz * u + v + rx * w, ry * u - rx * v + w


def _shifted(lon: Column, lat: Column, a: tuple[float, float], b: tuple[float, float], sign: float) -> Column:
    """Struct (lam, phi) on ellipsoid b of radians on ellipsoid a."""
    def geocentric(p: Column) -> Column:
        x, y, z = _geocentric(p["lon"], p["lat"], *a)
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))

    def shift(p: Column) -> Column:
        x, y, z = _shift(p["x"], p["y"], p["z"], sign)
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))

    def geodetic(p: Column) -> Column:
        lam, phi = _geodetic(p["x"], p["y"], p["z"], *b)
        return F.struct(lam.alias("lam"), phi.alias("phi"))

    at = let(geocentric, lon=lon, lat=lat)
    moved = let(lambda q: shift(q["p"]), p=at)
    return let(lambda q: geodetic(q["p"]), p=moved)


def to_grid(lon: Column, lat: Column) -> Column:
    """WGS84 degrees to grid metres: struct (x easting, y northing)."""
    a, f = INTERNATIONAL
    e2 = 2 * f - f * f
    ep2 = e2 / (1 - e2)

    def terms(q: Column) -> Column:
        phi, lam = q["p"]["phi"], q["p"]["lam"]
        return F.struct(phi.alias("phi"), (a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))).alias("nu"), F.pow(F.tan(phi), 2).alias("t"), (ep2 * F.pow(F.cos(phi), 2)).alias("c"), ((lam - LON0) * F.cos(phi)).alias("A"))

    def series(q: Column) -> Column:
        phi, nu, t, c, A = (q["k"][n] for n in ("phi", "nu", "t", "c", "A"))
        east = EASTING0 + nu * (A + (1 - t + c) * F.pow(A, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(A, 5) / 120)
        north = NORTHING0 + _meridian(phi, a, f) - _meridian(LAT0, a, f) + nu * F.tan(phi) * (A * A / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(A, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(A, 6) / 720)
        return F.struct(east.alias("x"), north.alias("y"))

    return let(series, k=let(terms, p=_shifted(F.radians(lon), F.radians(lat), WGS84, INTERNATIONAL, -1)))


def from_grid(x: Column, y: Column) -> Column:
    """Grid metres to WGS84 degrees: struct (lon, lat)."""
    a, f = INTERNATIONAL
    e2 = 2 * f - f * f
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))

    def foot(q: Column) -> Column:
        mu = q["mu"]
        return F.struct((mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu)).alias("p"), q["x"].alias("x"))

    def terms(q: Column) -> Column:
        p, s2 = q["k"]["p"], 1 - e2 * F.pow(F.sin(q["k"]["p"]), 2)
        return F.struct(p.alias("p"), (a / F.sqrt(s2)).alias("nu"), (a * (1 - e2) / F.pow(s2, 1.5)).alias("rho"), F.pow(F.tan(p), 2).alias("t"), (ep2 * F.pow(F.cos(p), 2)).alias("c"), ((q["k"]["x"] - EASTING0) / (a / F.sqrt(s2))).alias("d"))

    def series(q: Column) -> Column:
        p, nu, rho, t, c, d = (q["k"][n] for n in ("p", "nu", "rho", "t", "c", "d"))
        lat = p - nu * F.tan(p) / rho * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6) / 720)
        lon = LON0 + (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(p)
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    mu = (_meridian(LAT0, a, f) + y - NORTHING0) / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    local = let(series, k=let(terms, k=let(foot, mu=mu, x=x)))
    wgs = let(lambda q: _shifted(q["g"]["lon"], q["g"]["lat"], INTERNATIONAL, WGS84, 1), g=local)
    return let(lambda q: F.struct(F.degrees(q["w"]["lam"]).alias("lon"), F.degrees(q["w"]["phi"]).alias("lat")), w=wgs)


def mercator_scale(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def from_mercator(x: Column, y: Column) -> Column:
    r = MERCATOR_RADIUS
    return F.struct(F.degrees(x / r).alias("lon"), F.degrees(F.atan(F.sinh(y / r))).alias("lat"))


def transformed(m: list[float], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Column-major 4 x 4 matrix times (x, y, z, 1)."""
    return tuple(m[i] * x + m[4 + i] * y + m[8 + i] * z + m[12 + i] for i in range(3))


def normal_angle(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def flow_axes(x: Column, y: Column, direction: Column) -> Column:
    """Struct (along, across): metres in the frame of a wind direction; `along` grows towards that bearing."""
    t = F.radians(normal_angle(direction.cast("double")))
    return F.struct((x * F.sin(t) + y * F.cos(t)).alias("along"), (x * F.cos(t) - y * F.sin(t)).alias("across"))


def from_flow_axes(along: Column, across: Column, direction: Column) -> Column:
    t = F.radians(normal_angle(direction.cast("double")))
    return F.struct((along * F.sin(t) + across * F.cos(t)).alias("x"), (along * F.cos(t) - across * F.sin(t)).alias("y"))


def local_metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """Flat approximation around an origin."""
    return F.struct(((lon - lon0) * DEGREE_X * F.cos(F.radians(lat0))).alias("x"), ((lat - lat0) * DEGREE_Y).alias("y"))


def flat_tile_path(path: Column) -> Column:
    """Upper octants folded onto lower ones, the two root characters kept; a path with other digits as it is."""
    tail = F.substring(path, 3, 1_000_000)
    return F.when(path.rlike("^..[0-7]*$"), F.concat(F.substring(path, 1, 2), F.translate(tail, "4567", "0123"))).otherwise(path)


def tile_box(path: Column) -> Column:
    """Struct (w, s, e, n) of an octant path.

    The first two characters name one of eight quarters of a hemisphere, each
    further digit halves the box: bit 0 east, bit 1 north (bit 2 is height).
    Boxes at a pole keep their whole width.  Null if the path isn't valid.
    """
    a, b = F.substring(path, 1, 1).cast("int"), F.substring(path, 2, 1).cast("int")
    valid = path.rlike("^([01][23]|[23][01])[0-7]*$")
    west = F.lit(-180.0) + 90.0 * (2 * (a % 2) + b % 2)
    south = F.when(a < 2, F.lit(-90.0)).otherwise(F.lit(0.0))
    start = F.struct(west.alias("w"), south.alias("s"), (west + 90.0).alias("e"), (south + 90.0).alias("n"))
    rest = F.split(F.substring(path, 3, 1_000_000), "")

    def halve(b: Column, digit: Column) -> Column:
        d = digit.cast("int")
        mx, my = (b["w"] + b["e"]) / 2, (b["s"] + b["n"]) / 2
        east, north = d.bitwiseAND(1) == 1, d.bitwiseAND(2) == 2
        # the half that touches a pole isn't split in longitude
        whole = (north & (b["n"] == 90.0)) | (~north & (b["s"] == -90.0))
        return F.when(digit == "", b).otherwise(F.struct(F.when(~whole & east, mx).otherwise(b["w"]).alias("w"), F.when(north, my).otherwise(b["s"]).alias("s"), F.when(~whole & ~east, mx).otherwise(b["e"]).alias("e"), F.when(north, b["n"]).otherwise(my).alias("n")))

    return F.when(valid, F.aggregate(rest, start, halve))


def xyz_tile(lon: Column, lat: Column, zoom: int) -> Column:
    """Struct (x, y) of the web-mercator tile around a point."""
    n = float(1 << zoom)
    p = F.radians(lat)
    return F.struct(F.floor((lon + 180) / 360 * n).cast("bigint").alias("x"), F.floor((1 - F.ln(F.tan(p) + 1 / F.cos(p)) / math.pi) / 2 * n).cast("bigint").alias("y"))


def xyz_box(x: Column, y: Column, zoom: int) -> Column:
    """Struct (w, s, e, n) of a web-mercator tile."""
    n = float(1 << zoom)
    lat = lambda k: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * k / n))))
    return F.struct((x / n * 360 - 180).alias("w"), lat(y + 1).alias("s"), ((x + 1) / n * 360 - 180).alias("e"), lat(y).alias("n"))


def tile_coordinate(raw: Column) -> Column:
    """A non-negative whole number, or null."""
    return F.when(raw.rlike("^[0-9]{1,9}$"), raw.cast("bigint"))
