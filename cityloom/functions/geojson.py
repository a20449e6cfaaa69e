"""GeoJSON polygons from and to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "type string, geometry struct<type:string, coordinates:array<array<array<double>>>>, features array<struct<type:string, geometry:struct<type:string, coordinates:array<array<array<double>>>>>>"


def single_polygon(text: Column) -> Column:
    """Rings of a Feature, or of a collection of one: null unless finite, closed and of at least four positions each."""
    doc = F.from_json(text, SCHEMA)
    shape = F.when(doc["type"] == "Feature", doc["geometry"]).when((doc["type"] == "FeatureCollection") & (F.size(doc["features"]) == 1), F.get(doc["features"], 0)["geometry"])
    rings = F.when(shape["type"] == "Polygon", shape["coordinates"])
    finite = lambda p: (F.size(p) >= 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.forall(rings, lambda r: (F.size(r) >= 4) & F.forall(r, finite) & (F.get(r, 0) == F.element_at(r, -1)))
    return F.when((F.size(rings) > 0) & sound, rings)


def feature(ring: Column, **properties: Column) -> Column:
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties"), shape.alias("geometry")))
