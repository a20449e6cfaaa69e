"""Kernels against hand-computed values and properties."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from cityloom.functions import geo, geometry as G, stats as S, text


@pytest.fixture(scope="module")
def one(spark):
    frame = spark.range(1)
    return lambda c: frame.select(c.alias("v")).first()["v"]


def ring(*points):
    return F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def vertex(x, y, z):
    return G.vertex(F.lit(x), F.lit(y), F.lit(z))


def test_projection_golden_pair(one):
    g = one(geo.to_grid(F.lit(114.15931392442343), F.lit(22.281991157406488)))
    assert g["x"] == pytest.approx(834458.2785, abs=1e-3) and g["y"] == pytest.approx(815901.6470, abs=1e-3)
    b = one(geo.from_grid(F.lit(g["x"]), F.lit(g["y"])))
    assert b["lon"] == pytest.approx(114.15931392442343, abs=1e-8) and b["lat"] == pytest.approx(22.281991157406488, abs=1e-8)
    assert one(geo.mercator_scale(F.lit(22.281991157406488))) == pytest.approx(0.9253289409123618, abs=1e-15)


def test_area_centroid_and_holes(one):
    square = ring((0, 0), (4, 0), (4, 3), (0, 3))
    assert one(G.ring_area(square)) == 12
    assert one(G.polygon_area(F.array(square, ring((1, 1), (2, 1), (2, 2), (1, 2))))) == 11
    c = one(G.ring_centroid(square))
    assert (c["x"], c["y"]) == (2, 1.5)


def test_point_in_polygon_counts_boundary(one):
    square = ring((0, 0), (4, 0), (4, 3), (0, 3), (0, 0))
    inside = lambda x, y: one(G.in_ring(square, F.lit(float(x)), F.lit(float(y))))
    assert inside(1, 1) and inside(0, 1) and inside(4, 3) and not inside(5, 1) and not inside(-1, 3)
    holed = F.array(square, ring((1, 1), (2, 1), (2, 2), (1, 2)))
    assert not one(G.in_polygon(holed, F.lit(1.5), F.lit(1.5))) and one(G.in_polygon(holed, F.lit(1.0), F.lit(1.5)))


def test_height_and_section(one):
    t = vertex(0, 0, 0), vertex(2, 0, 2), vertex(0, 2, 4)
    assert one(G.height_in_triangle(F.lit(0.5), F.lit(0.5), *t)) == 1.5
    assert one(G.height_in_triangle(F.lit(3.0), F.lit(0.5), *t)) is None
    cut = one(G.plane_section(vertex(0, 0, 0), vertex(2, 0, 2), vertex(0, 2, 2), F.lit(1.0)))
    assert sorted((p["x"], p["y"]) for p in cut) == [(0, 1), (1, 0)]


def test_medians_differ_on_even_counts(one):
    v = F.array(*[F.lit(float(x)) for x in (8, 1, 4, 2)])
    assert one(S.upper_median(v)) == 4 and one(S.mid_median(v)) == 3 and one(S.lower_median(v)) == 2
    assert one(S.kth_lowest(F.array(*map(F.lit, (5, 1, 3, 2))), 3)) == 3 and one(S.kth_lowest(F.array(F.lit(1), F.lit(2)), 3)) is None


def test_numbers_and_heights(one):
    assert [one(text.positive_number(F.lit(x))) for x in ("12.5 m", "-3", "abc", None)] == [12.5, None, None, None]
    h = one(text.height(F.lit(None).cast("string"), F.lit("4")))
    assert (h["z"], h["source"]) == (14.0, "osm_levels")
    assert one(geo.normal_angle(F.lit(-90.0))) == 270


def test_tiles(one):
    b = one(geo.tile_box(F.lit("31")))
    assert (b["w"], b["s"], b["e"], b["n"]) == (90, 0, 180, 90)
    b = one(geo.tile_box(F.lit("310")))
    assert (b["w"], b["s"], b["e"], b["n"]) == (90, 0, 135, 45)
    assert one(geo.flat_tile_path(F.lit("3157"))) == "3113" and one(geo.flat_tile_path(F.lit("31x7"))) == "31x7" and one(geo.tile_box(F.lit("99"))) is None


def test_components_do_not_depend_on_row_order(spark):
    from cityloom.operators.components import connected_components

    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 700)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    for seed in (1, 2):
        random.Random(seed).shuffle(edges)
        got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_height_bands(spark):
    from cityloom.operators.bands import height_bands

    rows = [(1, z, a) for z, a in ((0.0, 3.0), (0.2, 2.0), (0.31, 4.0), (0.5, 4.0))]
    first = height_bands(spark.createDataFrame(rows, "k long, z double, area double"), "k").filter("band = 1").first()
    assert (first["z_min"], first["area"]) == (0.2, 10.0)


def test_ransac(spark):
    from cityloom.operators.base_planes import ransac_planes

    r = random.Random(5)
    p = [(7, x, y, 0.3 * x - 0.25 * y + 3) for x, y in ((r.uniform(0, 50), r.uniform(0, 50)) for _ in range(60))] + [(7, 1.0, 1.0, 90.0)] * 5
    f = ransac_planes(spark.createDataFrame(p, "k long, x double, y double, z double"), "k").first()
    assert (round(f["a"], 6), round(f["b"], 6), round(f["c"], 6), f["inliers"]) == (0.3, -0.25, 3.0, 60)


def test_outlier_fixpoint_leaves_no_outlier(spark):
    from cityloom.operators.iterative import local_medians, without_outliers

    r = random.Random(2)
    p = spark.createDataFrame([(i, r.uniform(0, 100), r.uniform(0, 100), r.uniform(0, 5) + 40 * (i % 17 == 0)) for i in range(600)], "id long, x double, y double, z double")
    kept, rounds = without_outliers(p, 15.0, 6.0)
    assert rounds >= 2 and kept.join(local_medians(kept, 15.0).filter("n >= 3"), "id").filter("z > median + 6").count() == 0
    assert kept.filter("id % 17 = 0").count() <= 2


def test_numbering_is_global(spark):
    from cityloom.operators.ordering import numbered

    got = numbered(spark.range(1000).selectExpr("(id * 37) % 1000 AS k"), ["k"], "n").collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(i, i + 1) for i in range(1000)]


def test_spatial_joins_need_no_nested_loop(spark):
    from cityloom.operators.spatial_join import boxes_with_boxes, points_in_boxes

    r = random.Random(4)
    pts = [(i, r.uniform(-50, 50), r.uniform(-50, 50)) for i in range(300)]
    bxs = [(i, x, y, x + r.uniform(0, 30), y + r.uniform(0, 30)) for i, x, y in pts[:60]]
    p, b = spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(bxs, "bid long, x0 double, y0 double, x1 double, y1 double")
    j = points_in_boxes(p, b, 8.0)
    assert {(a["id"], a["bid"]) for a in j.collect()} == {(i, k) for i, x, y in pts for k, x0, y0, x1, y1 in bxs if x0 <= x <= x1 and y0 <= y <= y1}
    other = b.toDF("cid", "u0", "v0", "u1", "v1")
    k = boxes_with_boxes(b, other, 8.0, ("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1"))
    rows = [(a["bid"], a["cid"]) for a in k.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(m[0], n[0]) for m in bxs for n in bxs if m[1] <= n[3] and n[1] <= m[3] and m[2] <= n[4] and n[2] <= m[4]}
    for d in (j, k):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def glb() -> bytes:
    points = struct.pack("<9f", 0, 0, 0, 1, 0, 0, 0, 1, 2) + struct.pack("<4H", 0, 1, 2, 0)
    doc = json.dumps({"meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}], "accessors": [{"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": 3}, {"bufferView": 1, "componentType": 5123, "type": "SCALAR", "count": 3}], "bufferViews": [{"byteOffset": 0}, {"byteOffset": 36}], "buffers": [{}]}).encode()
    doc += b" " * (-len(doc) % 4)
    body = struct.pack("<II", len(doc), 0x4E4F534A) + doc + struct.pack("<II", len(points), 0x4E4942) + points
    return struct.pack("<4sII", b"glTF", 2, 12 + len(body)) + body


def test_mesh_files(spark, tmp_path):
    from cityloom.sources import meshes as M

    folder = tmp_path / "tiles" / "20"
    folder.mkdir(parents=True)
    (folder / "3101.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2 3 4\nf -4 -3 -2\n")
    (folder / "3142.b3dm").write_bytes(b"b3dm" + struct.pack("<6I", 1, 28 + len(glb()), 0, 0, 0, 0) + glb())
    (folder / "bad.obj").write_text("v 0 0 0\nf 1 2 3\n")
    got = M.read_meshes(spark, f"file://{tmp_path}/tiles")
    assert {r["path"].rsplit("/", 1)[1]: r["n"] for r in got.filter("error IS NULL").groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()} == {"3101.obj": 3, "3142.b3dm": 1}
    assert got.filter("error IS NOT NULL").count() == 1
    index = M.tile_index(spark, f"file://{tmp_path}/tiles").first()
    assert (index["level"], index["tile"], index["flat"]) == (20, "3142", "3102")
    lines = [r["line"] for r in M.obj_lines(got.filter("error IS NULL"), ["path", "face"]).orderBy("place").collect()]
    assert sum(x.startswith("v ") for x in lines) == 5 and sum(x.startswith("f ") for x in lines) == 4
    M.write_obj(got.filter("error IS NULL"), ["path", "face"], str(tmp_path / "obj"))
    assert M.write_zip(str(tmp_path / "obj"), str(tmp_path / "o.zip")) > 0
    (tmp_path / "case").mkdir()
    (tmp_path / "case" / "dict").write_text("n {{n}} m {{m}}")
    assert M.write_case(str(tmp_path / "case"), str(tmp_path / "out"), {"n": "4"}) == ["m"] and (tmp_path / "out" / "dict").read_text() == "n 4 m {{m}}"
