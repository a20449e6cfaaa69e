"""Parsing, fallbacks, keys and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Storey height and default height in metres, colour stops (place, red, green, blue) from slow to fast.
STOREY, DEFAULT_HEIGHT = 3.5, 10.5
RAMP = [(0.0, 0.0, 0.0, 1.0), (0.25, 0.0, 0.5, 1.0), (0.4, 0.0, 1.0, 1.0), (0.5, 1.0, 1.0, 0.0), (0.75, 1.0, 0.5, 0.0), (1.0, 1.0, 0.0, 0.0)]


def positive_number(raw: Column) -> Column:
    """First number in a text if it is above 0, else null."""
    v = F.regexp_extract(raw, r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when(v > 0, v)


def height(raw: Column, storeys: Column) -> Column:
    """Struct (z, source): the tagged height, else storeys, else the default."""
    h, n = positive_number(raw), positive_number(storeys)
    return F.struct(F.coalesce(h, n * STOREY, F.lit(DEFAULT_HEIGHT)).alias("z"), F.when(h.isNotNull(), "osm_height").when(n.isNotNull(), "osm_levels").otherwise("osm_default").alias("source"))


def clamped(raw: Column, low: float, high: float, default: float) -> Column:
    """A number within bounds, the default where the text is none."""
    v = raw.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(float(default))).otherwise(F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), v)))


def truth(raw: Column, default: bool) -> Column:
    word = F.lower(F.trim(raw))
    return F.when(word.isin("true", "1", "yes", "on"), True).when(word.isin("false", "0", "no", "off"), False).otherwise(F.lit(default))


def choice(raw: Column, allowed: list[str], default: str) -> Column:
    return F.when(raw.isin(allowed), raw).otherwise(F.lit(default))


def safe_name(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^a-zA-Z0-9_-]", "_")


def bridge_kind(raw: Column) -> Column:
    return F.when(F.lower(F.trim(raw)) == "covered", "covered").otherwise("uncovered")


def point_key(x: Column, y: Column, digits: int) -> Column:
    """Key of a point at a number of decimals; -0 is 0."""
    f = lambda v: F.format_string(f"%.{digits}f", F.round(v, digits) + 0.0)
    return F.concat_ws(",", f(x), f(y))


def ring_key(ring: Column, digits: int = 8) -> Column:
    return F.to_json(F.transform(ring, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))))


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def speed_colour(v: Column, low: Column, high: Column) -> Column:
    """Struct (r, g, b), each from 0 to 1: linear between the stops of RAMP, the ends clamped."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / F.greatest(high - low, F.lit(1e-6))))

    def channel(k: int) -> Column:
        out = F.lit(RAMP[-1][k])
        for a, b in reversed(list(zip(RAMP, RAMP[1:]))):
            out = F.when(t <= b[0], a[k] + (b[k] - a[k]) * ((t - a[0]) / (b[0] - a[0]))).otherwise(out)
        return out

    return F.struct(channel(1).alias("r"), channel(2).alias("g"), channel(3).alias("b"))


def golden_hue(i: Column) -> Column:
    return F.round(F.pmod(i * 137.508, F.lit(360.0))).cast("int")


def duration(ms: Column) -> Column:
    """Milliseconds below a second, else seconds rounded to tenths (a half goes up)."""
    ms = ms.cast("bigint")
    tenths = F.floor((ms + 50) / 100)
    return F.when(ms < 1000, F.format_string("%d ms", ms)).otherwise(F.format_string("%d.%d s", F.floor(tenths / 10), tenths % 10))


def logged_duration(ms: Column) -> Column:
    """Seconds rounded to hundredths with the milliseconds in brackets."""
    ms = ms.cast("bigint")
    cents = F.floor((ms + 5) / 10)
    return F.format_string("%d.%02ds (%dms)", F.floor(cents / 100), cents % 100, ms)


def database_message(code: Column, message: Column, database: str, schema: str) -> Column:
    """What a PostgreSQL error code means to a caller; other codes give the error's own message."""
    # The texts that clients know.
    known = {
        "3D000": f'Database "{database}" does not exist.',
        "28P01": "PostgreSQL authentication failed. Check POSTGRES_USER and POSTGRES_PASSWORD.",
        "ECONNREFUSED": "Cannot connect to PostgreSQL. Check host/port and service status.",
        "42P01": f'Required OSM tables are missing in schema "{schema}".',
        "42703": f'Required OSM columns are missing in schema "{schema}".',
    }
    out = F.concat(F.lit("OSM query failed: "), F.coalesce(message, F.lit("unknown error")))
    for k, v in known.items():
        out = F.when(code == k, v).otherwise(out)
    return out
