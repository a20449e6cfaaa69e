"""Mesh files: OBJ, b3dm/glTF tiles, tables.  A file is one row (tiles are small); rows that can't be read carry their error."""

from __future__ import annotations

import json
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityloom.operators.ordering import numbered
from cityloom.sources.files import filesystem

TRIANGLES = "path string, face long, " + ", ".join(f"{a}{i} double" for i in range(3) for a in "xyz")
READ = TRIANGLES + ", error string"


def parse_obj(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles; polygons become fans, negative numbers count from the last vertex."""
    points: list[tuple[float, float, float]] = []
    faces: list[tuple[int, int, int]] = []
    for line in text.splitlines():
        part = line.split()
        if not part:
            continue
        if part[0] == "v":
            points.append(tuple(map(float, part[1:4])))
        elif part[0] == "f":
            at = [int(p.split("/", 1)[0]) for p in part[1:]]
            at = [i - 1 if i > 0 else len(points) + i for i in at]
            if min(at) < 0 or max(at) >= len(points):
                raise ValueError(f"face names a vertex that isn't there: {line}")
            faces += [(at[0], at[k], at[k + 1]) for k in range(1, len(at) - 1)]
    return np.array(points, float).reshape(-1, 3), np.array(faces, int).reshape(-1, 3)


# glTF component types and element widths.
COMPONENT = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT4": 16}


def parse_tile(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of a b3dm tile or a binary glTF file (uncompressed buffers)."""
    if data[:4] == b"b3dm":
        version, size, *parts = struct.unpack_from("<6I", data, 4)
        if version != 1 or size > len(data):
            raise ValueError("not a whole b3dm tile")
        data = data[28 + sum(parts) : size]
    magic, version, size, json_size, json_kind = struct.unpack_from("<4sIIII", data)
    if magic != b"glTF" or version != 2 or size > len(data):
        raise ValueError("not a whole glTF file")
    doc = json.loads(data[20 : 20 + json_size])
    blob = data[28 + json_size :]

    def accessor(i: int) -> np.ndarray:
        a = doc["accessors"][i]
        view = doc["bufferViews"][a["bufferView"]]
        kind, n = np.dtype(COMPONENT[a["componentType"]]), WIDTH[a["type"]]
        start = view.get("byteOffset", 0) + a.get("byteOffset", 0)
        stride = view.get("byteStride", kind.itemsize * n)
        return np.ndarray((a["count"], n), kind, blob, start, (stride, kind.itemsize)).copy()

    points, faces, base = [], [], 0
    for mesh in doc.get("meshes", []):
        for p in mesh["primitives"]:
            v = accessor(p["attributes"]["POSITION"]).astype(float)
            i = accessor(p["indices"]).ravel().astype(int) if "indices" in p else np.arange(len(v))
            points.append(v)
            faces.append(i[: len(i) // 3 * 3].reshape(-1, 3) + base)
            base += len(v)
    return (np.concatenate(points), np.concatenate(faces)) if points else (np.empty((0, 3)), np.empty((0, 3), int))


def _decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in READ.split(", ")]
    for f in frames:
        for path, content in zip(f["path"], f["content"]):
            try:
                v, t = parse_tile(bytes(content)) if bytes(content[:4]) in (b"b3dm", b"glTF") else parse_obj(bytes(content).decode())
                out = pd.DataFrame(v[t].reshape(-1, 9), columns=names[2:11])
                out.insert(0, "face", range(len(out)))
                out.insert(0, "path", path)
                out["error"] = None
            except (ValueError, KeyError, struct.error, UnicodeDecodeError) as e:
                out = pd.DataFrame([[path, -1, *[None] * 9, str(e) or type(e).__name__]], columns=names)
            yield out[names]


def read_meshes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Triangles of all OBJ, b3dm and glb files below a path; `error` says what is wrong with a file that gives none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(_decode, READ)


def tile_index(spark: SparkSession, path: str, glob: str = "*.b3dm") -> DataFrame:
    """(level, tile, flat, path) of a tile folder <level>/<octants>.b3dm, contents unread."""
    from cityloom.functions.geo import flat_tile_path

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path")
    named = files.select("path", F.regexp_extract("path", r"(\d+)/[^/]+$", 1).cast("int").alias("level"), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("tile"))
    return named.select("level", "tile", flat_tile_path(F.col("tile")).alias("flat"), "path")


def obj_lines(triangles: DataFrame, order: list[str], digits: int = 6) -> DataFrame:
    """(place, line): an OBJ file of the triangles (x0..z2), vertices shared at `digits` decimals, degenerate faces left out."""
    key = lambda i: F.array(*[F.round(f"{a}{i}", digits) + 0.0 for a in "xyz"])
    faces = numbered(triangles.select(*order, *[key(i).alias(f"v{i}") for i in range(3)]), order, "face").select("face", "v0", "v1", "v2")
    faces = faces.filter("v0 <> v1 AND v1 <> v2 AND v0 <> v2")
    corner = faces.select("face", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "v"))
    first = corner.groupBy("v").agg(F.min(F.struct("face", "corner")).alias("seen"))
    vertex = numbered(first.select("v", F.col("seen.face").alias("f"), F.col("seen.corner").alias("c")), ["f", "c"], "number")
    index = corner.join(vertex.select("v", "number"), "v").groupBy("face").agg(F.array_sort(F.collect_list(F.struct("corner", "number"))).alias("n"))
    v = vertex.select(F.struct(F.lit(0).alias("k"), F.col("number").alias("i")).alias("place"), F.format_string(f"v %.{digits}f %.{digits}f %.{digits}f", *[F.get("v", i) for i in range(3)]).alias("line"))
    f = index.select(F.struct(F.lit(1).alias("k"), F.col("face").alias("i")).alias("place"), F.concat(F.lit("f "), F.array_join(F.transform("n", lambda x: x["number"].cast("string")), " ")).alias("line"))
    return v.unionByName(f)


def write_obj(triangles: DataFrame, order: list[str], folder: str, digits: int = 6) -> None:
    """Text parts that, read in order, are one OBJ file: ranges of places, sorted."""
    obj_lines(triangles, order, digits).repartitionByRange("place").sortWithinPartitions("place").select("line").write.text(folder)


def merged(parts: DataFrame, file: str = "path") -> DataFrame:
    """(file, number, base): vertex offset of each file when files are put one after another; parts (path, vertices)."""
    w = Window.orderBy(file)  # a row a file
    return parts.select(file, (F.sum("vertices").over(w) - F.col("vertices")).alias("base"))


def write_ranked(df: DataFrame, group: str, order: list, folder: str, best: int = 3) -> None:
    """The `best` rows of each group, a folder a rank."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    df.withColumn("rank", rank).filter(F.col("rank") <= best).write.partitionBy("rank").parquet(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    """Quoted where needed, quotes doubled."""
    df.write.option("header", True).option("escape", '"').csv(folder)


def geojson_features(df: DataFrame, ring: str, properties: list[str]) -> DataFrame:
    """One GeoJSON polygon feature a row, as text."""
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry"))).alias("value"))


def read_patches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Patch files, one JSON document each, with an explicit schema; broken ones are null rows with their text in _broken."""
    return spark.read.schema(schema + ", _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)


def write_zip(folder: str, target: str) -> int:
    """Zip all files below a folder (any shared store), streamed; the number of files."""
    fs, base = filesystem(folder)
    out_fs, out = filesystem(target)
    import pyarrow.fs as pafs

    n = 0
    with out_fs.open_output_stream(out) as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
        for info in sorted(fs.get_file_info(pafs.FileSelector(base, recursive=True)), key=lambda i: i.path):
            if info.type == pafs.FileType.File and info.path != out:
                with fs.open_input_stream(info.path) as src, z.open(info.path[len(base) :].lstrip("/"), "w") as dst:
                    while chunk := src.read(1 << 20):
                        dst.write(chunk)
                n += 1
    return n


def write_case(template: str, target: str, values: dict[str, str]) -> list[str]:
    """Copy a folder of text files with {{key}} filled in; the placeholders left over."""
    import re

    import pyarrow.fs as pafs

    fs, base = filesystem(template)
    out_fs, out = filesystem(target)
    left: set[str] = set()
    for info in fs.get_file_info(pafs.FileSelector(base, recursive=True)):
        if info.type != pafs.FileType.File:
            continue
        with fs.open_input_stream(info.path) as src:
            text = src.read().decode()
        text = re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: str(values.get(m[1], m[0])), text)
        left |= set(re.findall(r"\{\{\s*(\w+)\s*\}\}", text))
        path = f"{out}/{info.path[len(base):].lstrip('/')}"
        out_fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with out_fs.open_output_stream(path) as dst:
            dst.write(text.encode())
    return sorted(left)
