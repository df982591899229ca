"""Projections against published values and their own inverses, rasters in another projection against a plain loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoframe.functions import crs
from geoframe.operators.raster import RasterFrame
from geoframe.types import Grid

LCC = "+proj=lcc +lat_1=33 +lat_2=45 +lat_0=23 +lon_0=-96"
AEA = "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96"


def there(spark, source, target, points):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "i int, x double, y double")
    u, v = crs.transformer(source, target)(F.col("x"), F.col("y"))
    return [(r.u, r.v) for r in df.select("i", u.alias("u"), v.alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("target, point, want, least", [
    ("EPSG:32633", (15, 0), (500000, 0), 0.001),
    ("EPSG:32633", (15, 52), (500000, 5761038.213), 0.01),
    ("EPSG:32733", (15, 0), (500000, 10000000), 0.001),
    ("EPSG:32617", (-79.387139, 43.642566), (630084.3, 4833438.5), 1.0),  # a tower's published place in zone 17
    ("robin", (0, 90), (0, 1.3523 * crs.R), 0.001),
    ("robin", (180, 0), (0.8487 * crs.R * math.pi, 0), 0.001),
    ("robin", (180, -90), (0.8487 * crs.R * math.pi * 0.5322, -1.3523 * crs.R), 0.001),
])
def test_known_places(spark, target, point, want, least):
    assert there(spark, "EPSG:4326", target, [point])[0] == pytest.approx(want, abs=least)


def test_conics_as_in_snyders_examples(spark):
    """His examples on the Clarke ellipsoid differ from WGS84 by some hundred metres at most."""
    assert there(spark, "EPSG:4326", LCC, [(-75, 35)])[0] == pytest.approx((1894410.9, 1564649.5), abs=300)
    assert there(spark, "EPSG:4326", AEA, [(-75, 35)])[0] == pytest.approx((1885472.7, 1535925.0), abs=300)


@pytest.mark.parametrize("target", ["EPSG:32633", "EPSG:32733", "robin", LCC, AEA, "EPSG:3395", "EPSG:3857", "sinu", "cea", "eqc", "+proj=robin +lon_0=20", "+proj=tmerc +lat_0=10 +lon_0=11 +k=0.9999 +x_0=100 +y_0=-5"])
def test_there_and_back(spark, target):
    centre = {"EPSG:32633": 15, "EPSG:32733": 15, LCC: -96, AEA: -96}.get(target, 11)
    points = [(centre + dx, y) for dx in (-4, -1, 0, 2.5, 4) for y in (-60.3, -10, 0, 0.001, 33, 78)]
    if target in (LCC, AEA):
        points = [(x, y) for x, y in points if y > -11]
    back = there(spark, target, "EPSG:4326", there(spark, "EPSG:4326", target, points))
    assert np.allclose(back, points, atol=2e-8)


def test_unknown_is_refused():
    with pytest.raises(ValueError, match="unknown projection"):
        crs.projection("+proj=vandg")


@pytest.mark.parametrize("method", ["nearest", "bilinear"])
def test_rasters_reproject(spark, method):
    grid = Grid.of_bbox((-180, 90, 180, -90), 36, 18)
    every = RasterFrame.empty(spark, grid)
    value = every.new(every.df.withColumn("value", F.when(F.col("col") != 5, F.col("col") + 100 * F.col("row")).cast("double")))
    out = value.reproject("sinu", method)
    got = {(r["col"], r["row"]): r["value"] for r in out.df.collect()}
    a, _, c, _, e, f = out.grid.affine
    assert out.grid.crs == "sinu" and (out.grid.width, out.grid.height) == (36, 18)
    want = {}
    for col in range(36):
        for row in range(18):
            x, y = a * (col + 0.5) + c, e * (row + 0.5) + f
            lat = math.degrees(y / crs.R)
            lon = math.degrees(x / (crs.R * math.cos(math.radians(lat))))
            u, v = (lon + 180) / 10, (90 - lat) / 10
            if not (0 <= u < 36 and 0 <= v < 18):
                continue
            if method == "nearest":
                want[col, row] = None if int(u) == 5 else int(u) + 100.0 * int(v)
            else:
                total, lacks = 0.0, False
                for i in (0, 1):
                    for j in (0, 1):
                        su, sv = math.floor(u - 0.5) + i, math.floor(v - 0.5) + j
                        w = (1 - abs(u - 0.5 - su)) * (1 - abs(v - 0.5 - sv))
                        su, sv = min(35, max(0, su)), min(17, max(0, sv))
                        lacks |= su == 5 and w != 0
                        total += w * (su + 100 * sv)
                want[col, row] = None if lacks else total
    assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-6) for k in want)
    assert len(got) > 300
