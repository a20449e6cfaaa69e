"""Flow domains and their block meshes, as column expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cityloom.functions import geo

# Cell sizes in metres outside and inside the core, and from the ground upwards.
OUTER, CORE, LOWER, MIDDLE, UPPER = 90.0, 35.0, 25.0, 40.0, 90.0


def within(v: Column, low: Column, high: Column) -> Column:
    """v between two limits; the upper one counts where they cross."""
    return F.least(F.greatest(v, low), high)


def projected(corners: list[tuple[Column, Column]], direction: Column) -> Column:
    """Struct (a0, a1, c0, c1): reach of points along and across a wind direction."""
    f = [geo.flow_axes(x, y, direction) for x, y in corners]
    along, across = [p["along"] for p in f], [p["across"] for p in f]
    return F.struct(F.least(*along).alias("a0"), F.greatest(*along).alias("a1"), F.least(*across).alias("c0"), F.greatest(*across).alias("c1"))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def horizontal_breaks(d0: Column, d1: Column, s0: Column, s1: Column, reach: Column) -> Column:
    """Four places along an axis: domain, core, domain; the core keeps a distance from the structure, and thirds where it doesn't fit."""
    length = d1 - d0
    rim = F.greatest(length * 0.18, F.least(F.lit(220.0), F.greatest(F.lit(120.0), reach * 0.5)))
    wide = F.greatest(length * 0.25, F.least(F.lit(600.0), F.greatest(F.lit(180.0), s1 - s0 + reach)))

    def placed(p: Column) -> Column:
        low = within(s0 - reach, d0 + p["rim"], d1 - p["rim"] - p["wide"])
        high = within(s1 + reach, low + p["wide"], d1 - p["rim"])
        return F.struct(low.alias("low"), high.alias("high"), p["rim"].alias("rim"), p["wide"].alias("wide"))

    def fitted(p: Column) -> Column:
        mid, short = (s0 + s1) / 2, p["high"] - p["low"] < p["wide"]
        low = F.when(short, F.greatest(d0 + p["rim"], mid - p["wide"] / 2)).otherwise(p["low"])
        return F.struct(low.alias("low"), F.when(short, F.least(d1 - p["rim"], mid + p["wide"] / 2)).otherwise(p["high"]).alias("high"))

    def chosen(p: Column) -> Column:
        sound = (p["low"] > d0) & (p["high"] < d1) & (p["high"] > p["low"])
        return F.when(sound, F.array(d0, p["low"], p["high"], d1)).otherwise(F.array(d0, d0 + length / 3, d1 - length / 3, d1))

    return bound(bound(bound(F.struct(rim.alias("rim"), wide.alias("wide")), placed), fitted), chosen)


def vertical_breaks(bottom: Column, top: Column, ground: Column, reach: Column) -> Column:
    """Four heights: a fine layer over the ground, a middle one, the rest."""
    tall = top - bottom
    low = within(ground + F.greatest(reach, F.lit(120.0)), bottom + tall * 0.12, bottom + tall * 0.28)

    def chosen(p: Column) -> Column:
        mid = within(ground + F.greatest(reach * 2.5, F.lit(260.0)), p["low"] + tall * 0.12, bottom + tall * 0.6)
        sound = (p["low"] > bottom) & (mid > p["low"]) & (mid < top)
        return F.when(sound, F.array(bottom, p["low"], mid, top)).otherwise(F.array(bottom, bottom + tall * 0.18, bottom + tall * 0.45, top))

    return bound(F.struct(low.alias("low")), chosen)


def counts(breaks: Column, sizes: tuple[float, float, float]) -> Column:
    """Cells of each of the three spans, at least one."""
    return F.array(*[F.greatest(F.lit(1), F.floor(F.abs(F.get(breaks, i + 1) - F.get(breaks, i)) / size + 0.5)).cast("bigint") for i, size in enumerate(sizes)])
