"""Pictures, packed TIFF, and the smaller operators: groups, nearest to a box, grids from whatever says them, enclosed faces, sizes, stretches, boxes of layers."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoframe.functions import crs, kernels
from geoframe.functions import geometry as G
from geoframe.operators import classify, overlay, raster
from geoframe.operators.raster import RasterFrame
from geoframe.operators.table import FeatureFrame
from geoframe.sources import raster as files
from geoframe.types import FID, GEOM, Grid


def array_of(frame, bands):
    out = np.full((frame.grid.height, frame.grid.width, bands), np.nan)
    for r in frame.df.collect():
        out[r["row"], r["col"], r["band"]] = np.nan if r["value"] is None else r["value"]
    return out


@pytest.mark.parametrize("bands", [1, 2, 3, 4])
def test_png_there_and_back(spark, tmp_path, bands):
    image = np.random.default_rng(bands).integers(0, 256, (9, 13, bands)).astype(np.uint8)
    grid = Grid(13, 9, (0.5, 0.0, -180.0, 0.0, -0.5, 90.0), "int8", None, "+proj=robin")
    path = str(tmp_path / "a.png")
    files.write(files.of_image(spark, image, grid), path)
    back = files.read(spark, path)
    assert back.grid.with_(crs=grid.crs) == grid and crs.projection(back.grid.crs) == crs.projection(grid.crs) and np.array_equal(array_of(back, bands), image)


def png(image, depth, colour, filters, palette=b""):
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    h, w = image.shape[:2]
    raw = image.astype(">u2").tobytes() if depth == 16 else np.packbits(image[:, :, 0].astype(bool), axis=1).tobytes() if depth == 1 else image.astype(np.uint8).tobytes()
    lines = np.frombuffer(raw, np.uint8).reshape(h, -1).astype(int)
    step, above, out = max(1, image.shape[2] * depth // 8), np.zeros(lines.shape[1], int), b""
    for r, line in enumerate(lines):
        left, corner = np.r_[[0] * step, line[:-step]], np.r_[[0] * step, above[:-step]]
        p = left + above - corner
        far = np.abs(np.stack((p - left, p - above, p - corner)))
        paeth = np.choose(far.argmin(0), (left, above, corner))
        how = filters[r % len(filters)]
        out += bytes([how]) + ((line - (0, left, above, (left + above) // 2, paeth)[how]) % 256).astype(np.uint8).tobytes()
        above = line
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_png_filters_depths_and_palettes():
    rng = np.random.default_rng(0)
    for colour, n in ((0, 1), (2, 3), (4, 2), (6, 4)):
        for depth, top in ((8, 256), (16, 65536)):
            image = rng.integers(0, top, (11, 7, n))
            assert np.array_equal(files._png(png(image, depth, colour, range(5))), image)
    bits = rng.integers(0, 2, (5, 13, 1))
    assert np.array_equal(files._png(png(bits, 1, 0, [0, 2])), bits)
    numbers, palette = rng.integers(0, 4, (6, 5, 1)), rng.integers(0, 256, (4, 3)).astype(np.uint8)
    assert np.array_equal(files._png(png(numbers, 8, 3, [0, 1], palette.tobytes())), palette[numbers[:, :, 0]])
    with pytest.raises(ValueError, match="not a PNG"):
        files._png(b"nothing of the kind")


def codes(numbers, size, msb):
    bits = "".join(f"{c:0{size}b}" if msb else f"{c:0{size}b}"[::-1] for c in numbers)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8] if msb else bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


def test_gif_and_lzw():
    data = b"GIF89a" + struct.pack("<HHBBB", 3, 2, 0x80 | 1, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    packed = codes([4, 1, 2, 4, 3, 0, 4, 1, 1, 5], 3, False)
    data += b"\x2c" + struct.pack("<HHHHB", 0, 0, 3, 2, 0) + bytes([2, len(packed)]) + packed + b"\0\x3b"
    want = np.array([[1, 2, 3], [0, 1, 1]])
    colours = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]])
    assert np.array_equal(files._gif(data), colours[want])
    assert files.lzw(codes([256, 7, 258, 258, 8, 257], 9, True)) == bytes([7, 7, 7, 7, 7, 8])
    assert files.packbits(bytes([2, 1, 2, 3, 254, 9, 128, 0, 5])) == bytes([1, 2, 3, 9, 9, 9, 5])


@pytest.mark.parametrize("compression, predictor", [(1, 1), (8, 1), (8, 2), (32946, 2), (32773, 1)])
def test_packed_tiff(spark, tmp_path, compression, predictor):
    values = np.random.default_rng(1).integers(0, 60000, (10, 6)).astype("<u2")
    strips = []
    for top in range(0, 10, 4):
        part = values[top : top + 4]
        part = np.diff(np.c_[np.zeros(len(part), "<u2"), part], axis=1).astype("<u2") if predictor == 2 else part
        raw = part.tobytes()
        strips.append({1: raw, 8: zlib.compress(raw), 32946: zlib.compress(raw), 32773: b"".join(bytes([len(raw[i : i + 100]) - 1]) + raw[i : i + 100] for i in range(0, len(raw), 100))}[compression])
    entries = [(256, 4, 1, 6), (257, 4, 1, 10), (258, 3, 1, 16), (259, 3, 1, compression), (273, 4, 3, None), (277, 3, 1, 1), (278, 4, 1, 4), (279, 4, 3, None), (317, 3, 1, predictor), (339, 3, 1, 1)]
    start, body = 8, b"".join(strips)
    offsets = np.cumsum([start, *map(len, strips)])[:3]
    lists = {273: start + len(body), 279: start + len(body) + 12}
    directory = start + len(body) + 24
    out = b"II*\0" + struct.pack("<I", directory) + body + struct.pack("<3I", *offsets) + struct.pack("<3I", *map(len, strips)) + struct.pack("<H", len(entries))
    for tag, kind, n, v in entries:
        out += struct.pack("<HHI", tag, kind, n) + (struct.pack("<I", lists[tag]) if v is None else struct.pack("<H", v).ljust(4, b"\0") if kind == 3 else struct.pack("<I", v))
    path = tmp_path / "a.tif"
    path.write_bytes(out + b"\0" * 4)
    assert np.array_equal(array_of(files.read(spark, str(path)), 1)[:, :, 0], values)


def table(spark, rows):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(rows)], f"{FID} long, k string")
    return FeatureFrame(df)


def test_groups_are_numbered_in_order(spark):
    out = table(spark, ["b", None, "a", "b", "c", "a"]).group("k").orderBy("group", FID).collect()
    assert [(r["group"], r["key"], r[FID]) for r in out] == [(0, None, 1), (1, "a", 2), (1, "a", 5), (2, "b", 0), (2, "b", 3), (3, "c", 4)]


def test_nearest_to_a_box(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], f"{FID} long, x double")
    frame = FeatureFrame(df.withColumn(GEOM, G.box(F.col("x") * 10, F.lit(0.0), F.col("x") * 10 + 1, F.lit(1.0))), "Polygon")
    near = lambda *a, **k: sorted(r[FID] for r in frame.quick_nearest(*a, **k).df.collect())
    assert near((100, 5, 112, 9), n=2) == [10, 11] and near((112, 9, 100, 5), n=4) == [9, 10, 11, 12]
    assert near(33, 0, 2) == [3, 4] and near((52.0, 0.5)) == [5]


def test_grids_from_whatever_says_them():
    want = Grid(4, 2, (10.0, 0.0, 100.0, 0.0, -10.0, 50.0))
    assert Grid.made(4, 2, affine=(10, 0, 100, 0, -10, 50), cellsize=3, xoffset=0, yoffset=0) == want
    assert Grid.made(4, 2, cellsize=10, xoffset=100, yoffset=50) == want
    assert Grid.made(4, 2, cellsize=10, xoffset=105, yoffset=45, anchor="center") == want
    assert Grid.made(4, 2, xscale=10, yscale=-10, xy_cell=(1, 1), xy_geo=(110, 40)) == want
    assert Grid.made(4, 2, bbox=(100, 50, 140, 30)) == want == Grid.made(bbox=(100, 50, 140, 30), cellsize=10)
    for wrong in ({}, {"cellsize": 10}, {"affine": (1, 0, 0, 0, 1, 0)}):
        with pytest.raises(ValueError, match="needs?"):
            Grid.made(**wrong)


def test_lines_enclose_faces(spark):
    cross = [[(0, 1), (4, 1)], [(1, 0), (1, 4)], [(0, 3), (4, 3)], [(3, 0), (3, 4)], [(10, 10), (11, 11)]]
    parts = kernels.enclosed(("LineString", [[ln] for ln in cross]))
    assert [kernels.area(("Polygon", [p])) for p in parts] == [4.0]
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    nested = kernels.enclosed(("LineString", [[ring(0, 10)], [ring(2, 4)]]))
    assert sorted(kernels.area(("Polygon", [p])) for p in nested) == [4.0, 96.0] and sorted(map(len, nested)) == [1, 2]
    df = spark.createDataFrame([(i, i % 2, [(float(x), float(y)) for x, y in ln]) for i, ln in enumerate([ring(0, 2), ring(0, 4), [(1, -1), (1, 3)], ring(5, 6)])], f"{FID} long, k int, v array<struct<x:double,y:double>>")
    frame = FeatureFrame(df.select(FID, "k", G.line(F.col("v")).alias(GEOM)), "LineString")
    got = sorted((r["k"], round(r["a"], 6)) for r in overlay.enclose(frame, "k").df.select("k", G.area(F.col(GEOM)).alias("a")).collect())
    assert got == [(0, 2.0), (0, 2.0), (1, 1.0), (1, 16.0)]


def test_sizes_stretches_and_boxes(spark):
    df = spark.createDataFrame([(0.0,), (50.0,), (100.0,), (None,)], "v double")
    sizes = [r["size"] for r in classify.area_sizes(df, F.col("v"), 2, 10).collect()]
    assert sizes[3] is None and sizes[:3] == pytest.approx([2, 52**0.5, 10])
    frame = RasterFrame.from_lists(spark, [[[-5.0, 0.0, 10.0]]], Grid(3, 1))
    assert [r["value"] for r in raster.stretch(frame).df.orderBy("col").collect()] == pytest.approx([63.75, 127.5, 255])
    at = lambda x, y, c: FeatureFrame(spark.createDataFrame([(0, x, y)], f"{FID} long, x double, y double").select(FID, G.point(F.col("x"), F.col("y")).alias(GEOM)), "Point", c)
    none = at(0.0, 0.0, "EPSG:4326").select(F.lit(False))
    box = crs.group_bbox([at(10.0, 20.0, "EPSG:4326"), at(0.0, 0.0, "EPSG:3857"), none], "EPSG:3857")
    assert box == pytest.approx((0, 0, 1113194.908, 2273030.927), abs=0.01) and crs.group_bbox([none], "EPSG:3857") is None
