import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoframe.functions import geometry as G
from geoframe.operators import classify, raster, rastervec
from geoframe.operators.raster import RasterFrame
from geoframe.operators.table import FeatureFrame, with_fid
from geoframe.sources import raster as rasters
from geoframe.sources import vector
from geoframe.types import FID, GEOM, Grid


@pytest.fixture
def frame(spark):
    return FeatureFrame.from_rows(spark, ["k", "v", "t"], [["a", 1, "x"], ["a", None, "y"], ["b", 5, None], [None, 2, "z"], {"k": "b", "v": 5}], ['{"type": "Point", "coordinates": [1.5, 2]}', None, '{"type": "Point", "coordinates": [3, 4]}', None, '{"type": "Point", "coordinates": [3, 4]}'], geometry_type="Point")


def test_stats_of_missing_values(frame):
    out = {r["k"]: r for r in frame.aggregate(["k"], [("n", "v", "count"), ("s", "v", "sum"), ("f", "t", "first"), ("l", "t", "last"), ("c", "t", ", concat"), ("m", "v", "majority"), ("r", "t", "minority"), ("x", "v", lambda c: F.max(c) - F.min(c))]).df.collect()}
    assert (out["a"]["n"], out["a"]["s"], out["a"]["f"], out["a"]["l"], out["a"]["c"]) == (1, 1.0, "x", "y", "x, y")
    assert (out["b"]["n"], out["b"]["f"], out["b"]["c"], out["b"]["m"], out["b"]["r"], out["b"]["x"]) == (2, None, None, 5, None, 0)
    assert frame.select("v > 100").aggregate(["k"], [("n", "v", "count")]).df.count() == 0


def test_rows_and_fields(frame, spark):
    assert len(frame) == 5 and frame.fields == ["k", "v", "t"] and frame.has_geometry()
    assert frame.field_type("v") == "int" and frame.field_type("t") == "text"
    assert [r["v"] for r in frame.sort("v").df.orderBy(FID).collect()] == [None, 1, 2, 5, 5]
    assert frame.replace(0, {"v": 9}).df.where("v = 9").count() == 1 and frame.feature(2).df.first()["v"] == 5
    assert frame.duplicates(mapping=[("n", None, "count")]).df.where("n = 2").count() == 2
    with pytest.raises(ValueError):
        frame.keep_fields("nope")
    with pytest.raises(ValueError):
        FeatureFrame.from_rows(spark, ["a"], [{"b": 1}])
    with pytest.raises(ValueError):
        FeatureFrame.from_rows(spark, ["a"], [[1, 2]])
    w = frame.moving_window(2, [("v", "v", "sum"), ("c", "t", "|concat")]).df.orderBy(FID).collect()
    assert [r["v"] for r in w] == [1, 1, 5, 7, 7] and [r["c"] for r in w] == ["x", "x|y", "y", "z", "z"]
    ids = sorted(r[FID] for r in with_fid(spark.range(1000).repartition(7), "id").collect())
    assert ids == list(range(1000))


def test_joins_of_null_keys_and_merge(frame):
    other = frame.keep_fields("k", "v").rename_field("v", "w")
    joined = frame.join(other, "k")
    assert joined.df.count() == 2 * 2 + 2 * 2 + 1 and joined.fields == ["k", "v", "t", "w"]
    assert frame.join(other, "k", collapse=True).df.count() == 5
    merged = frame.merge(other).df
    assert merged.count() == 10 and merged.where(f"{FID} >= 5 and t = ''").count() == 5


def test_breaks(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]], "v double")
    v = F.col("v")
    assert classify.equal(df, v, 4) == [1, 25.75, 50.5, 75.25, 100] and classify.equal(df, v, interval=50, anchor=0) == [1, 50, 100]
    assert classify.quantile(df, v, 2) == [1, 6, 100] and classify.headtail(df, v) == [1, 14.5, 100]
    assert classify.natural(df, v, 2) == [1, 9, 100] and classify.pretty(df, v, 5) == [1, 20, 40, 60, 80, 100]
    assert classify.breaks(df, v, "equal", 1, extrabreaks=[50], maxval=9) == [1, 9, 50]
    assert classify.quantile(df.limit(0).unionByName(df.limit(2)), v, 5) == [1, 2, 2]
    with pytest.raises(ValueError):
        classify.log(df.withColumn("v", -v), v)
    with pytest.raises(ValueError):
        classify.equal(df.limit(0), v)
    c = classify.Classifier(df, v, "unique", values=["p", "q"])
    assert [r["class_value"] for r in c.apply().orderBy("v").limit(3).collect()] == ["p", "q", "p"]
    assert classify.Classifier(df, v, "proportional", values=[0, 99]).apply().orderBy("v").collect()[1]["class_value"] == pytest.approx(1)
    assert classify.cutoff(df, v, 50) == 5


def test_natural_breaks_are_the_best(spark):
    rng = np.random.default_rng(0)
    x = np.sort(np.r_[rng.normal(0, 1, 12), rng.normal(10, 1, 12), rng.normal(30, 2, 12)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = classify.natural(df, F.col("v"), 3)
    cost = lambda i, j: sum(((p - p.mean()) ** 2).sum() for p in (x[:i], x[i:j], x[j:]))
    i, j = min(((i, j) for i in range(1, 35) for j in range(i + 1, 36)), key=lambda t: cost(*t))
    assert got == [x[0], x[i - 1], x[j - 1], x[-1]]


def test_vector_files(frame, tmp_path, spark):
    for name in ("a.geojson", "a.shp"):
        path = f"{tmp_path}/{name}"
        vector.write(frame, path)
        back = vector.read(spark, path)
        assert back.geometry_type == "Point" and len(back) == 5
        rows = back.df.orderBy(FID).collect()
        assert [r["k"] for r in rows] == ["a", "a", "b", None, "b"] and [r["v"] for r in rows] == [1, None, 5, 2, 5]
        assert rows[0][GEOM]["parts"][0][0][0]["x"] == 1.5 and rows[1][GEOM] is None
    vector.write(frame, f"{tmp_path}/a.csv")
    back = vector.read(spark, f"{tmp_path}/a.csv", select="v > 1")
    assert sorted(r["v"] for r in back.df.collect()) == [2, 5, 5] and back.fields == ["k", "v", "t"]
    vector.write(frame, f"{tmp_path}/a.parquet")
    assert vector.read(spark, f"{tmp_path}/a.parquet").df.exceptAll(frame.df).count() == 0
    with pytest.raises(ValueError):
        vector.read(spark, "a.zzz")


def test_delimited_text(spark, tmp_path):
    (tmp_path / "b.txt").write_text('about this file\nx;y;n;t\n1,5;2;NULL;"a;b"\n2,5;3;7;c\n9;9;9;d\n')
    f = vector.read_delimited(spark, f"{tmp_path}/b.txt", delimiter=";", skip=1, last=2, xfield="x", yfield="y")
    rows = f.df.orderBy(FID).collect()
    assert [(r["x"], r["y"], r["n"], r["t"]) for r in rows] == [(1.5, 2, None, "a;b"), (2.5, 3, 7, "c")] and rows[0][GEOM]["bbox"]["xmin"] == 1.5
    (tmp_path / "c.csv").write_text("a\tb\n1\tu\nx\tv\n")
    assert vector.read(spark, f"{tmp_path}/c.csv").field_type("a") == "text"
    (tmp_path / "t.gpx").write_text('<gpx><trk><trkseg><trkpt lat="1" lon="2"/><trkpt lat="3" lon="4"></trkpt></trkseg></trk></gpx>')
    assert vector.read(spark, f"{tmp_path}/t.gpx").df.select(G.x(F.col(GEOM)).alias("x")).collect()[1]["x"] == 4


def test_polygons_with_holes_through_a_shapefile(spark, tmp_path):
    g = '{"type": "MultiPolygon", "coordinates": [[[[0,0],[9,0],[9,9],[0,9],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]],[[[20,20],[21,20],[21,21],[20,20]]]]}'
    f = FeatureFrame.from_rows(spark, ["a long field name", "a long field other"], [[1.25, "é"]], [g], geometry_type="Polygon")
    vector.write(f, f"{tmp_path}/p.shp")
    back = vector.read(spark, f"{tmp_path}/p.shp")
    assert back.fields == ["a_long_fie", "a_long_fi1"] and back.df.select(G.area(F.col(GEOM))).first()[0] == pytest.approx(80.5)
    assert back.df.first()["a_long_fie"] == 1.25 and back.df.first()["a_long_fi1"] == "é"


@pytest.fixture
def small(spark):
    return RasterFrame.from_lists(spark, [[[1, 2, 3], [4, -9999, 6]]], Grid(3, 2, (10.0, 0.0, 100.0, 0.0, -10.0, 50.0)))


def values(r):
    return {(x["col"], x["row"]): x["value"] for x in r.df.collect()}


def test_raster_files(small, spark, tmp_path):
    for name in ("a.asc", "a.tif"):
        rasters.write(small, f"{tmp_path}/{name}")
        back = rasters.read(spark, f"{tmp_path}/{name}")
        assert values(back) == values(small) and back.grid.affine == small.grid.affine
    two = small.add_band(small * 2)
    rasters.write(two, f"{tmp_path}/b.tif")
    back = rasters.read(spark, f"{tmp_path}/b.tif")
    assert len(back) == 2 and values(back.band(1)) == values(small * 2)
    for cellid, how in (("colrow", {}), ("xy", {"xfield": "x", "yfield": "y"})):
        rasters.write(small, f"{tmp_path}/{cellid}.txt", cellid=cellid)
        assert values(rasters.read(spark, f"{tmp_path}/{cellid}.txt", small.grid, **how)) == values(small)
    rasters.write_world(small.grid, f"{tmp_path}/w.wld")
    assert rasters.read_world(f"{tmp_path}/w.wld") == small.grid.affine and rasters.read_prj(f"{tmp_path}/no.prj")
    assert glob.glob(f"{tmp_path}/a.asc/*")


def test_grids():
    g = Grid.of_bbox((-180, 90, 180, -90), 720, 360)
    assert g.affine == (0.5, 0.0, -180, 0.0, -0.5, 90) and g.to_cell(-179.9, 89.9) == (0, 0) and g.to_geo(*g.to_cell(3.3, 4.4, True)) == pytest.approx((3.3, 4.4))
    assert Grid.of_bbox((0, 10, 10.4, 0), cellwidth=2, cellheight=2).width == 5 and Grid.of_tie((1, 1), (10, 10), 2, -2, 5, 5).to_geo(1, 1) == (10, 10)
    with pytest.raises(ValueError):
        Grid(1, 1, (0.0,) * 6).to_cell(1, 1)
    with pytest.raises(ValueError):
        Grid.of_bbox((0, 0, 1, 1))


def test_map_algebra(small):
    assert values(small + 1)[1, 1] is None and values(1 / small)[0, 1] == 0.25 and values(2 ** small)[2, 0] == 8 and values(10 - small)[0, 0] == 9
    assert values(small / (small - 1))[0, 0] is None and values(small >= 3)[2, 0] == 1 and values((small > 1) & (small < 5))[0, 1] == 1
    assert values(small.compute("val * 100", "val > 3").convert("int8"))[2, 1] == 255 and values(small.conditional("val > 3"))[1, 1] == 0
    assert values(small.with_mask(small.df.select("col", "row", (F.col("col") == 0).alias("masked"))))[0, 0] is None and small.clear().is_empty()
    assert values(small.set(1, 1, 7.0))[1, 1] == 7 and small.get(115, 45).first()["value"] == 2
    s = small.summarystats().first()
    assert (s["count"], s["sum"], s["median"], s["majority"], s["minority"]) == (5, 16, 3, 1, 1)
    assert values(raster.mathexpr("rast1 + rast2 * 2", [small, small]))[2, 1] == 18 and len(small.mask().where("masked").collect()) == 1


def test_moving_cells(small, spark):
    c = small.crop((111, 49, 125, 41))
    assert c.grid.bbox == (110, 50, 130, 40) and values(c) == {(0, 0): 2, (1, 0): 3}
    with pytest.raises(ValueError):
        small.crop((500, 500, 600, 600))
    assert values(small.roll(1))[0, 0] == 3 and small.tiled(tiles=(2, 2)).select("tile_x", "tile_y").distinct().count() == 4
    with pytest.raises(ValueError):
        small.align(Grid(3, 2))
    with pytest.raises(ValueError):
        raster.sequence([5], [(0, small), (1, small)])
    assert raster.union_grid([small, RasterFrame(small.df, small.grid.with_(affine=(10.0, 0.0, 120.0, 0.0, -10.0, 60.0)))]).bbox == (100, 60, 150, 30)
    flat = RasterFrame.from_lists(spark, [[[5.0] * 6 for _ in range(6)]])
    for method in ("nearest", "bilinear", "bicubic"):
        assert set(round(v, 9) for v in values(flat.resample(Grid(9, 9, (6 / 9, 0, 0, 0, 6 / 9, 0)), method)).values()) == {5.0}
    assert set(round(v, 9) for v in values(flat.gauss(2)).values()) == {5.0}


def test_gauss_by_brute_force(spark):
    rng = np.random.default_rng(0)
    z = rng.integers(0, 9, (5, 7)).astype(float)
    got = values(RasterFrame.from_lists(spark, [z.tolist()]).gauss(1.0))
    k = {(i, j): np.exp(-(i * i + j * j) / 2) for i in range(-3, 4) for j in range(-3, 4)}
    for r in range(5):
        for c in range(7):
            want = sum(w * z[min(4, max(0, r + j)), min(6, max(0, c + i))] for (i, j), w in k.items()) / sum(k.values())
            assert got[c, r] == pytest.approx(want)


def test_morphology(spark):
    z = [[0, 0, 0, 0, 0], [0, 1, 1, 1, 0], [0, 1, 1, 1, 0], [0, 1, 1, 1, 0], [0, 0, 0, 0, 0]]
    r = RasterFrame.from_lists(spark, [z])
    total = lambda p: sum(values(r.morphology("val == 1", p)).values())
    assert (total("erosion"), total("edge"), total("dilation"), total("dilation4"), total("erosion4")) == (1, 8, 25, 21, 1)
    assert total([[0, 0, 0], [0, 1, 1], [0, 1, 1]]) == 1


def test_between_rasters_and_features(spark):
    g = Grid(6, 6)
    rows = ['{"type": "Polygon", "coordinates": [[[0,0],[4,0],[4,2],[0,2],[0,0]]]}', '{"type": "Polygon", "coordinates": [[[2,0],[6,0],[6,6],[2,6],[2,0]]]}']
    f = FeatureFrame.from_rows(spark, ["v"], [[1], [10]], rows, geometry_type="Polygon")
    assert values(rastervec.rasterize(f, g, "v", "sum"))[3, 1] == 11 and values(rastervec.rasterize(f, g, "v", priority=-F.col("v")))[3, 1] == 1
    assert values(rastervec.rasterize(f, g, "v", "sum", partial=F.lit(0.5)))[0, 0] == 0.5 and sum(values(rastervec.rasterize(f, g)).values()) == 28
    with pytest.raises(ValueError):
        rastervec.rasterize(f, g, "v")
    total = sum(v for v in values(rastervec.disperse(f, g, "v")).values() if v)
    assert total == pytest.approx(11)
    back = rastervec.vectorize(rastervec.rasterize(f, g, "v", "max"), merge=True).df.select("value", "n_cells", G.area(F.col(GEOM)).alias("a")).collect()
    assert {(r["value"], r["n_cells"], round(r["a"], 6)) for r in back} == {(1.0, 4, 4.0), (10.0, 24, 24.0)}
    d = values(rastervec.distance(f.select("v == 1"), g))
    assert d[0, 0] == 0 and d[5, 5] == pytest.approx(np.hypot(2, 4))
    line = FeatureFrame.from_rows(spark, ["v"], [[1]], ['{"type": "LineString", "coordinates": [[0.5,0.5],[5.5,0.5]]}'], geometry_type="LineString")
    assert sum(values(rastervec.rasterize(line, g)).values()) == 6


def test_regions_of_any_shape(spark):
    z = [[1, 1, 1, 1, 1], [0, 0, 0, 0, 1], [1, 1, 1, 0, 1], [1, 0, 0, 0, 1], [1, 1, 1, 1, 1]]
    got = {(r["col"], r["row"]): r["region"] for r in rastervec.regions(RasterFrame.from_lists(spark, [z])).collect()}
    assert {got[c, r] for r in range(5) for c in range(5) if z[r][c]} == {0} and {got[c, r] for r in range(5) for c in range(5) if not z[r][c]} == {5}


def test_streams(spark, sf, tmp_path):
    from geoframe import streaming
    from geoframe.plans import fixtures

    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet")
    x, y = (F.col("user_id") * 37 % 360 - 180).cast("double") + 0.5, (F.col("user_id") * 17 % 180 - 90).cast("double") + 0.5
    zones = fixtures.zones(spark, sf)
    for name, made, mode in (("fence", streaming.geofence(stream, x, y, zones), "append"), ("cells", streaming.cell_counts(stream, "ts", x, y, 36.0, "1 day"), "complete")):
        q = made.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("fence").count() == events.count() and spark.table("fence").where("n_name IS NULL").count() == 0
    assert spark.table("cells").agg(F.sum("n")).first()[0] == events.count()
