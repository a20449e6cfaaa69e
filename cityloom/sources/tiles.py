"""Vector tiles: features of a tile as the bytes that map clients read (public format, version 2)."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTENT = 4096
# Field numbers and wire types of the format, commands of its geometry.
LAYER, NAME, FEATURE, KEY, VALUE, EXTENT_FIELD, VERSION = 3, 1, 2, 3, 4, 5, 15
ID, TAGS, TYPE, GEOMETRY, TEXT = 1, 2, 3, 4, 1
POLYGON, MOVE, LINE, CLOSE = 3, 1, 2, 7


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def number(field: int, n: int) -> bytes:
    return varint(field << 3) + varint(n)


def block(field: int, data: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(data)) + data


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def polygon(ring: list[tuple[int, int]]) -> bytes:
    """Commands of one closed ring, given without its closing point."""
    at, out = (0, 0), []
    for i, p in enumerate(ring):
        if i < 2:
            out.append(MOVE | 1 << 3 if i == 0 else LINE | (len(ring) - 1) << 3)
        out += [zigzag(p[0] - at[0]), zigzag(p[1] - at[1])]
        at = p
    return b"".join(map(varint, [*out, CLOSE | 1 << 3]))


def layer(name: str, features: Iterable[tuple[int, list[tuple[int, int]], dict[str, str | None]]]) -> bytes:
    """A tile with one layer of polygons (id, ring, properties); null properties are left out."""
    keys: dict[str, int] = {}
    values: dict[str, int] = {}
    body = []
    for fid, ring, properties in features:
        tags = [t for k, v in properties.items() if v is not None for t in (keys.setdefault(k, len(keys)), values.setdefault(v, len(values)))]
        body.append(block(FEATURE, number(ID, fid) + block(TAGS, b"".join(map(varint, tags))) + number(TYPE, POLYGON) + block(GEOMETRY, polygon(ring))))
    head = block(NAME, name.encode())
    rest = b"".join(block(KEY, k.encode()) for k in keys) + b"".join(block(VALUE, block(TEXT, v.encode())) for v in values)
    return block(LAYER, head + b"".join(body) + rest + number(EXTENT_FIELD, EXTENT) + number(VERSION, 2))


def encoded(features: DataFrame, name: str, properties: list[str]) -> DataFrame:
    """(tx, ty, features, tile) from features (tx, ty, id, x0, y0, x1, y1: a box in tile units, properties).

    A tile is made in one group: what one holds is bounded by the zoom that is asked for.
    """
    columns = ["tx", "ty", "id", "x0", "y0", "x1", "y1", *properties]

    def make(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["id"])
        boxes = [(r["id"], [(r["x0"], r["y0"]), (r["x1"], r["y0"]), (r["x1"], r["y1"]), (r["x0"], r["y1"])], {p: r[p] for p in properties}) for r in rows]
        return pa.table({"tx": pa.array([rows[0]["tx"]], pa.int64()), "ty": pa.array([rows[0]["ty"]], pa.int64()), "features": pa.array([len(rows)], pa.int32()), "tile": pa.array([layer(name, boxes)], pa.binary())})

    return features.select(*[F.col(c).cast("string" if c in properties else "bigint").alias(c) for c in columns]).groupBy("tx", "ty").applyInArrow(make, "tx bigint, ty bigint, features int, tile binary")
