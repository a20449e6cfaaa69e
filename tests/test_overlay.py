"""Overlays whose input is what other overlays leave where borders only touch."""

from pyspark.sql import functions as F

from cityloom import jts

SQUARE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"


def test_a_collection_without_polygons_takes_nothing_away(spark):
    jts.register(spark)
    border = "GEOMETRYCOLLECTION (POINT (0 0), LINESTRING (4 0, 4 4))"
    row = spark.createDataFrame([(SQUARE, border)], "g string, h string")
    g, h = F.col("g"), F.col("h")
    got = row.select(jts.measure("area", jts.overlay("difference", g, h)), jts.measure("area", jts.overlay("intersection", g, h)), jts.measure("area", jts.overlay("difference", h, g)), jts.measure("rest area", g, h)).first()
    assert tuple(got) == (16.0, 0.0, 0.0, 16.0)
