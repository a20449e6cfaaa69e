"""Vector tiles of footprints: clipped to each tile and encoded (IO-16, Q-09)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.plans.registry import boxes, plan
from cityloom.sources.tiles import EXTENT, encoded

ZOOM = 12


def across(lon: Column) -> Column:
    """Tile units from the west end of the map."""
    return (lon + 180) / 360 * float((1 << ZOOM) * EXTENT)


def down(lat: Column) -> Column:
    """Tile units from the north end of the map."""
    p = F.radians(lat)
    return (1 - F.ln(F.tan(p) + 1 / F.cos(p)) / math.pi) / 2 * float((1 << ZOOM) * EXTENT)


PIXELS = "SELECT id, h, (113.8 + x0 / 1000 + 180) / 360 * 16777216 AS x0, (113.8 + x1 / 1000 + 180) / 360 * 16777216 AS x1, (1 - ln(tan(radians(22.1 + y1 / 2000)) + 1 / cos(radians(22.1 + y1 / 2000))) / pi()) / 2 * 16777216 AS y0, (1 - ln(tan(radians(22.1 + y0 / 2000)) + 1 / cos(radians(22.1 + y0 / 2000))) / pi()) / 2 * 16777216 AS y1 FROM v_box"
TILE_SQL = f"""WITH p AS ({PIXELS}), a AS (SELECT *, unnest(range(CAST(floor(x0 / 4096) AS BIGINT), CAST(floor(x1 / 4096) AS BIGINT) + 1)) AS tx FROM p), b AS (SELECT *, unnest(range(CAST(floor(y0 / 4096) AS BIGINT), CAST(floor(y1 / 4096) AS BIGINT) + 1)) AS ty FROM a),
c AS (SELECT tx, ty, id, h, CAST(floor(greatest(x0 - tx * 4096, 0) + 0.5) AS BIGINT) AS x0, CAST(floor(greatest(y0 - ty * 4096, 0) + 0.5) AS BIGINT) AS y0, CAST(floor(least(x1 - tx * 4096, 4096) + 0.5) AS BIGINT) AS x1, CAST(floor(least(y1 - ty * 4096, 4096) + 0.5) AS BIGINT) AS y1 FROM b)
SELECT tx, ty, id, x0, y0, x1, y1, h FROM c WHERE x1 > x0 AND y1 > y0"""


@plan(TILE_SQL, "v_box")
def tile_features(spark: SparkSession, sf: str) -> DataFrame:
    """Footprints cut at tile borders, in whole tile units; what is thinner than one goes."""
    lon, lat = (lambda c: F.lit(113.8) + F.col(c) / 1000), (lambda c: F.lit(22.1) + F.col(c) / 2000)
    p = boxes(spark, sf).select("id", "h", across(lon("x0")).alias("px0"), across(lon("x1")).alias("px1"), down(lat("y1")).alias("py0"), down(lat("y0")).alias("py1"))
    tiles = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / EXTENT), F.floor(F.col(b) / EXTENT)))
    t = p.withColumn("tx", tiles("px0", "px1")).withColumn("ty", tiles("py0", "py1"))
    low = lambda c, k: F.floor(F.greatest(F.col(c) - F.col(k) * EXTENT, F.lit(0.0)) + 0.5)
    high = lambda c, k: F.floor(F.least(F.col(c) - F.col(k) * EXTENT, F.lit(float(EXTENT))) + 0.5)
    c = t.select("tx", "ty", "id", low("px0", "tx").alias("x0"), low("py0", "ty").alias("y0"), high("px1", "tx").alias("x1"), high("py1", "ty").alias("y1"), "h")
    return c.filter("x1 > x0 AND y1 > y0")


@plan(f"SELECT tx, ty, CAST(count(*) AS INT) AS features FROM ({TILE_SQL}) GROUP BY tx, ty", "v_box")
def vector_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The tiles that hold a footprint (their bytes are read back in the tests)."""
    return encoded(tile_features(spark, sf), "osm_building", ["h"]).select("tx", "ty", "features")
