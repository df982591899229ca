import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoframe.functions import crs, geodesy, kernels
from geoframe.functions import geometry as G
from geoframe.functions import sql as geosql
from geoframe.functions.exprparse import parse
from geoframe.operators import classify, overlay, spatial
from geoframe.operators.table import FeatureFrame
from geoframe.types import FID, GEOM


def square(x, y, s):
    return ("Polygon", [[[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]])


# Published distances of Vincenty's method, points as (lat, lon).
DISTANCES = [((0, 0), (0, 0), 0.0), ((0, 0), (0, 1), 111.319491), ((0, 0), (1, 0), 110.574389), ((0, 0), (0.5, 179.5), 19936.288579), ((0, 0), (0.5, 179.7), None), ((42.3541165, -71.0693514), (40.7791472, -73.9680804), 298.396057)]


@pytest.mark.parametrize("a,b,km", DISTANCES)
def test_vincenty(a, b, km):
    got = float(geodesy.inverse(*a, *b))
    assert math.isnan(got) if km is None else abs(got - km) < 2e-6


def test_vincenty_miles_and_back():
    assert abs(float(geodesy.inverse(42.3541165, -71.0693514, 40.7791472, -73.9680804, miles=True)) - 185.414657) < 1e-4
    lon, lat = geodesy.direct(10.0, 50.0, np.array([0, 45, 180, 300]), 250.0)
    assert np.allclose(geodesy.inverse(50.0, 10.0, lat, lon), 250.0, atol=1e-5)


def test_geodesic_area_of_a_cell_and_the_world():
    assert abs(geodesy.ring_km2([0, 1, 1, 0], [0, 0, 1, 1]) - 12308.778) < 0.1
    whole = sum(geodesy.ring_km2([x, x + 90, x + 90, x], [-90, -90, 90, 90]) for x in (-180, -90, 0, 90))
    assert abs(whole - 510065621.7) < 5


def test_class_values():
    assert classify.class_values(5, [0, 100]) == [0, 25, 50, 75, 100]
    assert classify.class_values(5, [[0, 255, 0], [255, 255, 0], [255, 0, 0]]) == [[0, 255, 0], [127.5, 255, 0], [255, 255, 0], [255, 127.5, 0], [255, 0, 0]]


def test_overlay_keeps_areas():
    random.seed(1)
    for _ in range(60):
        p, q = (("Polygon", [[[(random.random() * 10, random.random() * 10) for _ in range(4)]]]) for _ in range(2))
        p, q = (("Polygon", kernels.overlay([s], lambda state: bool(state[0]))) for s in (p, q))
        i, u, d = (kernels.area(kernels.combine(p, q, how)) for how in ("intersection", "union", "difference"))
        assert abs(i + u - kernels.area(p) - kernels.area(q)) < 1e-6 and abs(d + i - kernels.area(p)) < 1e-6


def test_predicates():
    a, b, c, far = square(0, 0, 4), square(1, 1, 2), square(4, 0, 2), square(9, 9, 1)
    p = kernels.PREDICATES
    assert p["contains"](a, b) and p["within"](b, a) and not p["contains"](b, a) and p["covers"](a, a) and p["equals"](a, a)
    assert p["touches"](a, c) and not p["touches"](a, b) and p["disjoint"](a, far) and p["intersects"](a, c)
    line = ("LineString", [[[(-1, 2), (5, 2)]]])
    assert p["crosses"](line, a) and not p["crosses"](("LineString", [[[(1, 2), (2, 2)]]]), a) and p["crosses"](line, ("LineString", [[[(2, 0), (2, 4)]]]))
    hole = kernels.combine(a, b, "difference")
    assert kernels.area(hole) == pytest.approx(12) and not kernels.inside(2, 2, hole)[0] and len(hole[1][0]) == 2
    assert kernels.length(kernels.combine(line, a, "intersection")) == pytest.approx(4) and kernels.length(kernels.combine(line, a, "difference")) == pytest.approx(2)


def test_buffers_and_simplification():
    assert kernels.area(kernels.buffer(square(0, 0, 2), 1, 256)) == pytest.approx(12 + math.pi, abs=1e-2)
    assert kernels.area(kernels.buffer(square(0, 0, 4), -1)) == pytest.approx(4) and kernels.area(kernels.buffer(square(0, 0, 2), 1, 8, "mitre")) == pytest.approx(16)
    line = ("LineString", [[[(0, 0), (10, 0)]]])
    assert kernels.area(kernels.buffer(line, 1, cap="flat")) == pytest.approx(20) and kernels.area(kernels.buffer(line, 1, cap="square")) == pytest.approx(24)
    assert kernels.simplify([(0, 0), (1, 0.01), (2, 0)], 0.1) == [(0, 0), (2, 0)]


@pytest.fixture(scope="module")
def shapes(spark):
    random.seed(3)
    rows, geo = [], []
    for i in range(40):
        x, y, s = random.randint(0, 20), random.randint(0, 20), random.randint(1, 6)
        rows.append([i])
        geo.append('{"type": "Polygon", "coordinates": [[[%d,%d],[%d,%d],[%d,%d],[%d,%d],[%d,%d]]]}' % (x, y, x + s, y, x + s, y + s, x, y + s, x, y))
    return FeatureFrame.from_rows(spark, ["a"], rows, geo, geometry_type="Polygon")


def test_cell_join_is_the_nested_loop(spark, shapes):
    other = shapes.rename_field("a", "b")
    all_ = {r["a"]: kernels.shape(r[GEOM].asDict(True)) for r in shapes.df.collect()}
    for condition in ("intersects", "contains", "touches"):
        got = {(r["a"], r["b"]) for r in spatial.spatial_join(shapes, other, condition).df.select("a", "b").collect()}
        assert got == {(i, j) for i in all_ for j in all_ if kernels.PREDICATES[condition](all_[i], all_[j])}
    near = {(r["a"], r["b"]) for r in spatial.spatial_join(shapes, other, "distance", radius=2.5, geodetic=False).df.select("a", "b").collect()}
    assert near == {(i, j) for i in all_ for j in all_ if kernels.distance(all_[i], all_[j]) <= 2.5}
    first = spatial.spatial_join(shapes, other, "distance", n=2).df.groupBy("a").count().collect()
    assert {r["count"] for r in first} == {2} and len(first) == 40


def test_geometry_expressions(spark):
    g = '{"type": "Polygon", "coordinates": [[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]}'
    texts = [g, '{"type": "MultiPoint", "coordinates": [[1,2],[3,4]]}', '{"type": "LineString", "coordinates": [[0,0],[3,4]]}', '{"type": "Point", "coordinates": [5,6]}', None, "nonsense"]
    f = FeatureFrame.from_rows(spark, ["i"], [[i] for i in range(len(texts))], texts)
    geom = F.col(GEOM)
    r = f.df.select("i", G.area(geom).alias("area"), G.length(geom).alias("length"), G.centroid(geom).alias("c"), G.inside(geom, F.lit(1.5), F.lit(1.5)).alias("hole"), G.inside(geom, F.lit(3.0), F.lit(3.0)).alias("in"), G.to_geojson(geom).alias("t"), G.is_empty(geom).alias("empty")).orderBy("i").collect()
    assert r[0]["area"] == 15 and r[0]["length"] == 20 and r[0]["hole"] is False and r[0]["in"] is True
    assert r[0]["c"]["bbox"]["xmin"] == pytest.approx((2 * 16 - 1.5) / 15)
    assert r[2]["length"] == 5 and r[2]["c"]["bbox"]["ymin"] == 2 and r[3]["length"] == 0 and r[4]["area"] is None and r[4]["empty"] and r[5]["area"] is None
    import json

    assert json.loads(r[1]["t"]) == {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]} and json.loads(r[0]["t"])["coordinates"][1][0] == [1, 1]


def test_overlay_operators(spark, shapes):
    union = kernels.area(kernels.union_all([kernels.shape(r[GEOM].asDict(True)) for r in shapes.df.collect()]))
    one = shapes.compute("k", 1).aggregate(["k"], [("n", None, "count")], geometry=overlay.dissolve).df.select("n", G.area(F.col(GEOM)).alias("a")).first()
    assert one["n"] == 40 and one["a"] == pytest.approx(union)
    tiles = overlay.tiled(shapes, tiles=(3, 3)).select(F.sum(G.area(F.col(GEOM)))).first()[0]
    assert tiles == pytest.approx(shapes.df.select(F.sum(G.area(F.col(GEOM)))).first()[0])
    assert overlay.convex_hull(shapes).df.count() == 40 and overlay.buffer(shapes, 1.0, resolution=8).df.count() == 40
    folded = shapes.compute("k", 1).select("a < 2").aggregate(["k"], [], geometry=overlay.fold("difference")).df
    assert folded.count() == 1
    pts = overlay.to_points(shapes)
    assert overlay.tessellate(pts).df.count() == pts.df.select(f"{GEOM}.parts").distinct().count()
    line = FeatureFrame.from_rows(spark, ["z"], [[1]], ['{"type": "LineString", "coordinates": [[-5,10.5],[40,10.5]]}'], geometry_type="LineString")
    cut = overlay.cut(shapes, line)
    assert cut.df.count() > 40 and cut.df.select(F.sum(G.area(F.col(GEOM)))).first()[0] == pytest.approx(shapes.df.select(F.sum(G.area(F.col(GEOM)))).first()[0], rel=1e-5)
    moved = shapes.new(shapes.df.withColumn(GEOM, G.transform(F.col(GEOM), lambda x, y: x + 0.01, lambda x, y: y)))
    assert overlay.snap(moved, shapes, 0.1).df.exceptAll(shapes.df).count() == 0
    bow = FeatureFrame.from_rows(spark, ["i"], [[1]], ['{"type": "Polygon", "coordinates": [[[0,0],[2,2],[2,0],[0,2],[0,0]]]}'], geometry_type="Polygon")
    assert overlay.clean(bow).df.select(G.area(F.col(GEOM))).first()[0] == pytest.approx(2)


def test_geodetic_functions(spark):
    f = FeatureFrame.from_rows(spark, ["i"], [[1]], ['{"type": "Point", "coordinates": [10, 50]}'], geometry_type="Point")
    ring = overlay.buffer(f, 100.0, geodetic=True, resolution=40).df.select(geodesy.area_km2(F.col(GEOM)).alias("a"), F.size(G.vertices(F.col(GEOM))).alias("n")).first()
    assert ring["n"] == 40 and ring["a"] == pytest.approx(math.pi * 100**2, rel=0.01)
    line = FeatureFrame.from_rows(spark, ["i"], [[1]], ['{"type": "LineString", "coordinates": [[0,0],[1,0],[1,1]]}'])
    assert line.df.select(geodesy.length_km(F.col(GEOM))).collect()[0][0] == pytest.approx(111.319491 + 110.574389, abs=1e-4)
    d = spark.range(1).select(geodesy.distance_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("d"), geodesy.distance_km(F.lit(0.0), F.lit(0.0), F.lit(179.7), F.lit(0.5)).alias("no")).first()
    assert d["d"] == pytest.approx(111.319491) and d["no"] == pytest.approx(19944.127421)


@pytest.mark.parametrize("name", ["EPSG:3857", "EPSG:3395", "EPSG:4087", "sinu", "cea"])
def test_projections_go_there_and_back(spark, name):
    rows = spark.createDataFrame([(10.0, 50.0), (-120.5, -33.25), (0.0, 0.0)], "x double, y double")
    u, v = crs.transformer("EPSG:4326", name)(F.col("x"), F.col("y"))
    back = crs.transformer(name, "EPSG:4326")
    for r in rows.withColumn("u", u).withColumn("v", v).select("x", "y", back(F.col("u"), F.col("v"))[0].alias("p"), back(F.col("u"), F.col("v"))[1].alias("q")).collect():
        assert r["p"] == pytest.approx(r["x"], abs=1e-7) and r["q"] == pytest.approx(r["y"], abs=1e-7)
    with pytest.raises(ValueError, match="unknown projection"):
        crs.name_of("+proj=krovak")


def test_reprojected_bbox(spark):
    x1, y1, x2, y2 = crs.reproject_bbox(spark, (-180, -90, 180, 90), "EPSG:4326", "EPSG:3857")
    assert x2 == pytest.approx(20037508.34, abs=0.1) and y2 > 1.5e7 and x1 == pytest.approx(-x2) and y1 == pytest.approx(-y2)


def test_expressions(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 0.0)], "a double, b double")
    got = [tuple(r) for r in df.select(parse("a / b"), parse("(a > 2) and not b > 1"), parse("abs(-a) ** 2 + (1 if b == 0 else 0)"), parse("a in [1, 5]"), parse("0 < a < 2")).collect()]
    assert got == [(0.5, False, 1.0, True, True), (None, True, 10.0, False, False)]
    for bad in ("__import__('os')", "a.b", "[x for x in a]", "open('x')", "lambda: 1"):
        with pytest.raises(ValueError):
            parse(bad)


def test_sql_functions(spark):
    assert "geo_area" in geosql.register(spark)
    r = spark.sql("SELECT geo_area(geo_box(0, 0, 2, 3)) AS a, geo_intersects(geo_point(1, 1), geo_box(0, 0, 2, 2)) AS i, geo_distance(geo_point(0, 0), geo_point(3, 4)) AS d").first()
    assert (r["a"], r["i"], r["d"]) == (6.0, True, 5.0)


def test_stays_without_geometry(spark, shapes):
    extra = shapes.add_feature({"a": 99})
    assert FeatureFrame(extra.df, "Polygon").quick_disjoint((0, 0, 100, 100)).df.select("a", FID).first()["a"] == 99
    assert spatial.where(extra, shapes, "disjoint").df.count() == 1 and overlay.crop(extra, (0, 0, 50, 50)).df.count() == 40
