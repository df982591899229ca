"""Coordinate systems by text: well-known text, datums, ellipsoids, against published places."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoframe.functions import crs, datums, wkt
from tests.test_projections import there

GCS = 'GEOGCS["GCS_{0}",DATUM["D_{0}",SPHEROID["{1}",{2},{3}]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
WGS, GRS = GCS.format("WGS_1984", "WGS_1984", 6378137.0, 298.257223563), GCS.format("ETRS_1989", "GRS_1980", 6378137.0, 298.257222101)
CLARKE = GCS.format("North_American_1927", "Clarke_1866", 6378206.4, 294.9786982)
UTM33 = f'PROJCS["WGS_1984_UTM_Zone_33N",{WGS},PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",15.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
TEXAS = f'PROJCS["NAD_1927_StatePlane_Texas_South_Central_FIPS_4204",{CLARKE},PROJECTION["Lambert_Conformal_Conic"],PARAMETER["False_Easting",2000000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-99.0],PARAMETER["Standard_Parallel_1",28.38333333333333],PARAMETER["Standard_Parallel_2",30.28333333333334],PARAMETER["Latitude_Of_Origin",27.83333333333333],UNIT["Foot_US",0.3048006096012192]]'
LAEA = f'PROJCS["ETRS_1989_LAEA",{GRS},PROJECTION["Lambert_Azimuthal_Equal_Area"],PARAMETER["False_Easting",4321000.0],PARAMETER["False_Northing",3210000.0],PARAMETER["Central_Meridian",10.0],PARAMETER["Latitude_Of_Origin",52.0],UNIT["Meter",1.0]]'
WEB = f'PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere",{WGS},PROJECTION["Mercator_Auxiliary_Sphere"],PARAMETER["False_Easting",0.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",0.0],PARAMETER["Standard_Parallel_1",0.0],PARAMETER["Auxiliary_Sphere_Type",0.0],UNIT["Meter",1.0]]'
OGC = 'PROJCS["OSGB 1936 / British National Grid",\n GEOGCS["OSGB 1936",\n  DATUM["OSGB_1936",\n   SPHEROID["Airy 1830",6377563.396,299.3249646,AUTHORITY["EPSG","7001"]],\n   TOWGS84[446.448,-125.157,542.06,0.1502,0.247,0.8421,-20.4894],AUTHORITY["EPSG","6277"]],\n  PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],\n PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",49],PARAMETER["central_meridian",-2],PARAMETER["scale_factor",0.9996012717],PARAMETER["false_easting",400000],PARAMETER["false_northing",-100000],UNIT["metre",1],AXIS["Easting",EAST],AXIS["Northing",NORTH],AUTHORITY["EPSG","27700"]]'
SNYDER = "+proj={} +lat_1={} +lat_2={} +lat_0=23 +lon_0=-96 +datum=NAD27"


@pytest.mark.parametrize(("source", "target", "place", "want", "least"), [
    ("EPSG:4267", TEXAS, (-96, 28.5), (2963503.91, 254759.80), 0.01),  # the worked examples of EPSG's guidance note 7-2
    ("EPSG:4258", LAEA, (5, 50), (3962799.45, 2999718.85), 0.01),
    ("EPSG:4258", "EPSG:3035", (5, 50), (3962799.45, 2999718.85), 0.01),
    ("EPSG:4277", "EPSG:27700", (0.5, 50.5), (577274.99, 69740.50), 0.01),
    ("+proj=longlat +ellps=airy +towgs84=446.448,-125.157,542.06,0.1502,0.247,0.8421,-20.4894", OGC, (0.5, 50.5), (577274.99, 69740.50), 0.01),
    ("EPSG:4326", "+proj=stere +lat_0=90 +k=0.994 +x_0=2000000 +y_0=2000000 +datum=WGS84", (44, 73), (3320416.75, 632668.43), 0.01),
    ("EPSG:4326", "+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=70 +x_0=6000000 +y_0=6000000 +datum=WGS84", (120, -75), (7255380.79, 7053389.56), 0.01),
    ("EPSG:4267", SNYDER.format("lcc", 33, 45), (-75, 35), (1894410.9, 1564649.5), 0.1),  # Snyder's, on the Clarke ellipsoid
    ("EPSG:4267", SNYDER.format("aea", 29.5, 45.5), (-75, 35), (1885472.7, 1535925.0), 0.1),
    ("EPSG:4326", UTM33, (15, 52), (500000, 5761038.213), 0.01),
    ("EPSG:4326", WEB, (180, 0), (math.pi * 6378137, 0), 0.001),
    ("EPSG:4326", "EPSG:3031", (0, -90), (0, 0), 1e-6),
    ("EPSG:4326", "EPSG:3035", (10, 52), (4321000, 3210000), 1e-6),
])
def test_published_places(spark, source, target, place, want, least):
    assert there(spark, source, target, [place])[0] == pytest.approx(want, abs=least)


def _shift_by_hand(lon, lat, a, rf, shift):
    """Geodetic places of another datum on WGS84, in numpy, the way back by iteration."""
    f = 1 / rf
    e2 = f * (2 - f)
    n = a / math.sqrt(1 - e2 * math.sin(lat) ** 2)
    x, y, z = n * math.cos(lat) * math.cos(lon), n * math.cos(lat) * math.sin(lon), n * (1 - e2) * math.sin(lat)
    tx, ty, tz, *turn = (*shift, *(0,) * 7)[:7]
    rx, ry, rz = (math.radians(v / 3600) for v in turn[:3])
    m = 1 + turn[3] * 1e-6
    x, y, z = tx + m * (x - rz * y + ry * z), ty + m * (rz * x + y - rx * z), tz + m * (-ry * x + rx * y + z)
    f = 1 / 298.257223563
    e2, p, phi = f * (2 - f), math.hypot(x, y), math.atan2(z, math.hypot(x, y))
    for _ in range(30):
        n = 6378137 / math.sqrt(1 - e2 * math.sin(phi) ** 2)
        phi = math.atan2(z + e2 * n * math.sin(phi), p)
    return math.degrees(math.atan2(y, x)), math.degrees(phi)


@pytest.mark.parametrize("code", ["EPSG:4267", "EPSG:4277", "EPSG:4230", "EPSG:4314"])
def test_datums_are_shifted_through_the_middle_of_the_earth(spark, code):
    p = crs.projection(code)
    points = [(-100.25, 40.5), (10, 52), (0.1, -33), (179.9, 5), (3, 89)]
    got = there(spark, code, "EPSG:4326", points)
    want = [_shift_by_hand(math.radians(x), math.radians(y), p.a, p.rf, p.shift) for x, y in points]
    assert np.allclose(got, want, rtol=0, atol=1e-10)
    # Heights are not carried along, so that the way back ends off by centimetres where a datum lies far from WGS84.
    off = (np.array(there(spark, "EPSG:4326", code, got)) - points) * [[math.cos(math.radians(y)), 1] for _, y in points]
    assert np.abs(off).max() < 1e-6
    assert max(abs(a - x) for (a, _), (x, _) in zip(got, points, strict=True)) > 1e-4


def test_a_published_shift(spark):
    """A water tower in both systems of Britain's mapping agency, which says its shift is right to some metres."""
    got = there(spark, "EPSG:4277", "EPSG:4326", [(1 + 43 / 60 + 4.5177 / 3600, 52 + 39 / 60 + 27.2531 / 3600)])[0]
    assert got == pytest.approx((1 + 42 / 60 + 57.8663 / 3600, 52 + 39 / 60 + 28.8282 / 3600), abs=8e-5)


@pytest.mark.parametrize("code", ["EPSG:4326", "EPSG:4267", "EPSG:32633", "EPSG:32733", "EPSG:3857", "EPSG:3395", "EPSG:3035", "EPSG:3031", "EPSG:3413", "EPSG:27700", "EPSG:5070", "EPSG:2154", "robin", "sinu", "cea", "eqc", TEXAS, OGC, "+proj=lcc +lat_1=40 +lon_0=3 +k_0=0.99 +datum=NAD27", "+proj=merc +lat_ts=20 +datum=ETRS89", "+proj=stere +lat_0=90 +k_0=0.994 +x_0=2000000"])
def test_written_text_is_read_again(spark, code):
    a, b = crs.projection(code), crs.projection(crs.to_wkt(code))
    assert a.name == b.name and a.datum == b.datum and a.shift == b.shift and all(abs((x or 0) - (y or 0)) < 1e-6 for x, y in zip(a[1:9], b[1:9], strict=True)) and abs(a.unit - b.unit) < 1e-12 and abs(a.a - b.a) < 1e-6
    near = {"EPSG:3031": (20, -75), "EPSG:3413": (-40, 75), TEXAS: (-98, 29), "EPSG:5070": (-98, 29)}.get(code, (14, 50))
    assert there(spark, "EPSG:4326", code, [near])[0] == pytest.approx(there(spark, "EPSG:4326", crs.to_wkt(code), [near])[0], abs=1e-6)
    assert there(spark, code, "EPSG:4326", there(spark, "EPSG:4326", code, [near]))[0] == pytest.approx(near, abs=1e-7)


@pytest.mark.parametrize(("text", "why"), [
    ("+proj=longlat +ellps=intl", "without a datum"), ("+proj=longlat +datum=Tokyo", "unknown datum"), ("+proj=utm +zone=33 +ellps=bessel", "without a datum"), ("+proj=longlat +pm=paris", "unknown words"), ("+proj=longlat +nadgrids=ntv2.gsb", "unknown words"),
    ("+proj=stere +lat_0=50", "not polar"), ("+proj=tmerc +units=furlong", "unknown unit"), (GCS.format("Tokyo", "Bessel_1841", 6377397.155, 299.1528128), "unknown datum"), (WGS.replace('"Greenwich",0.0', '"Paris",2.33'), "prime meridian"),
    (UTM33.replace("Transverse_Mercator", "Bonne"), "unknown projection"), (UTM33[:-1], "does not end"), ("EPSG:99999", "unknown projection"), ("+proj=longlat +towgs84=1,2", "three or seven"),
])
def test_what_is_not_known_is_refused(text, why):
    with pytest.raises(ValueError, match=why):
        crs.projection(text)


def test_texts_are_parsed():
    node = wkt.parse('A["x ""y""",1,-2.5e3,B["c"],AXIS["E",EAST],B["d"]]')
    assert node.values[:3] == ['x "y"', 1.0, -2500.0] and [b.values for b in node.children("B")] == [["c"], ["d"]] and node.child("AXIS").values == ["E", "EAST"]
    assert datums.datum("D_North_American_1983") == "NAD83" and datums.same_ellipsoid(6378137.0, 298.257223563) == datums.ellipsoid("WGS84")


def test_prj_files(spark, tmp_path):
    from geoframe.operators import overlay  # noqa: F401
    from geoframe.sources import raster, vector
    from geoframe.types import GEOM
    from tests.test_spatial_levels import points

    raster.write_prj("EPSG:32633", f"{tmp_path}/a.prj")
    assert raster.read_prj(f"{tmp_path}/a.prj").startswith("PROJCS[") and crs.projection(raster.read_prj(f"{tmp_path}/a.prj")) == crs.projection("EPSG:32633")
    frame = points(spark, [(500000.0, 5761038.213), (600000.0, 5000000.0)]).new(points(spark, [(500000.0, 5761038.213), (600000.0, 5000000.0)]).df, crs="EPSG:32633")
    vector.write(frame, f"{tmp_path}/p.shp")
    back = vector.read(spark, f"{tmp_path}/p.shp")
    out = crs.reproject(back.df, back.crs, "EPSG:4326").select(F.col(f"{GEOM}.bbox.xmin").alias("x"), F.col(f"{GEOM}.bbox.ymin").alias("y")).collect()
    assert min((r.x, r.y) for r in out) == pytest.approx((15, 52), abs=1e-6)
