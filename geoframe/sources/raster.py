"""Rasters from and to files: ESRI ASCII grids, cell tables, GeoTIFF, PNG and GIF pictures, world files."""

from __future__ import annotations

import os
import struct as binary
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from geoframe.functions.crs import to_wkt
from geoframe.operators.raster import RasterFrame
from geoframe.operators.table import checkpointed
from geoframe.sources.vector import head
from geoframe.types import WGS84, Grid


def read(spark: SparkSession, path: str, grid: Grid | None = None, **options) -> RasterFrame:
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("asc", "ascii"):
        return read_ascii(spark, path)
    if ending in ("tif", "tiff", "geotiff"):
        return read_geotiff(spark, path, grid)
    if ending in ("png", "gif", "jpg", "jpeg"):
        return read_image(spark, path, grid)
    if ending in ("csv", "txt", "tsv"):
        return read_cells(spark, path, grid, **options)
    if ending == "parquet":
        return RasterFrame(spark.read.parquet(path), grid)
    raise ValueError(f"unknown kind of raster: .{ending}")


def read_ascii(spark: SparkSession, path: str) -> RasterFrame:
    """Header lines of names and numbers, then cells as one stream by row. Lines are numbered by where they stand, in any split of the file."""
    header, lines = {}, 0
    for line in head(spark, path, 4096).splitlines():
        words = line.split()
        if len(words) != 2 or words[0][:1].lower() not in "ncxyd" or words[0].replace(".", "").replace("-", "").isdigit():
            break
        header[words[0].lower()] = float(words[1])
        lines += 1
    w, h, size = int(header["ncols"]), int(header["nrows"]), header.get("cellsize", 1.0)
    nodata = header.get("nodata_value", -9999.0)
    x = header.get("xllcorner", header.get("xllcenter", 0.0) - size / 2)
    y = header.get("yllcorner", header.get("yllcenter", 0.0) - size / 2)
    rows = spark.read.text(path).withColumn("o", F.monotonically_increasing_id())
    parts = rows.select("o", F.filter(F.split("value", r"[ \t\r]+"), lambda v: v != "").alias("v"))
    ranged = checkpointed(parts.repartitionByRange("o").withColumn("p", F.spark_partition_id()))
    local = ranged.withColumn("k", F.size("v"))
    local = local.where((F.col("o") >= lines) | (F.col("o") >= 1 << 33))
    before = Window.partitionBy("p").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    local = local.withColumn("s", F.coalesce(F.sum("k").over(before), F.lit(0)))
    sizes = local.groupBy("p").agg(F.sum("k").alias("all"))
    starts = sizes.select("p", F.coalesce(F.sum("all").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    cells = local.join(F.broadcast(starts), "p").select((F.col("s") + F.col("b")).alias("at"), F.posexplode("v").alias("i", "t"))
    cell = F.col("at") + F.col("i")
    v = F.col("t").cast("double")
    df = cells.select(F.lit(0).alias("band"), (cell % w).cast("int").alias("col"), F.floor(cell / w).cast("int").alias("row"), F.when(v != nodata, v).alias("value"))
    return RasterFrame(df, Grid(w, h, (size, 0.0, x, 0.0, -size, y + h * size), nodata=nodata))


def write_ascii(raster: RasterFrame, path: str, band: int = 0) -> None:
    """One band as one text; its rows are made in parallel and written in order."""
    g = raster.grid
    a, _, c, _, e, f = g.affine
    missing = -9999.0 if g.nodata is None else g.nodata
    header = f"ncols {g.width}\nnrows {g.height}\nxllcorner {c}\nyllcorner {f + e * g.height}\ncellsize {abs(a)}\nnodata_value {missing}"
    v = F.coalesce("value", F.lit(float(missing)))
    lines = raster.band(band).df.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", v.alias("v")))), lambda p: p["v"].cast("string")), " ").alias("value"))
    spark = raster.df.sparkSession
    top = spark.createDataFrame([(-1, header)], "row int, value string")
    lines.select("row", "value").unionByName(top).coalesce(1).sortWithinPartitions("row").select("value").write.mode("overwrite").text(path)


def read_cells(spark: SparkSession, path: str, grid: Grid, xfield: str | None = None, yfield: str | None = None, colfield: str = "col", rowfield: str = "row", valuefield: str = "value", nodataval: float | None = None, delimiter: str = "\t") -> RasterFrame:
    """A table of cells by column and row, or by x and y."""
    df = spark.read.option("header", "true").option("sep", delimiter).csv(path)
    if xfield and yfield:
        a, b, c, d, e, f = grid.inverse
        x, y = F.col(xfield).cast("double"), F.col(yfield).cast("double")
        col, row = F.floor(a * x + b * y + c), F.floor(d * x + e * y + f)
    else:
        col, row = F.col(colfield), F.col(rowfield)
    v = F.regexp_replace(valuefield, ",", ".").try_cast("double")
    missing = grid.nodata if nodataval is None else nodataval
    v = v if missing is None else F.when(v != missing, v)
    return RasterFrame(df.select(F.lit(0).alias("band"), col.cast("int").alias("col"), row.cast("int").alias("row"), v.alias("value")), grid)


def write_cells(raster: RasterFrame, path: str, cellid: str = "colrow", band: int = 0) -> None:
    """Tab separated, cells by column and row or by their corner's x and y."""
    cells = raster.band(band).cells()
    names = ["x", "y"] if cellid == "xy" else ["col", "row"]
    cells.select(*names, "value").write.mode("overwrite").option("header", "true").option("sep", "\t").csv(path)


def read_world(path: str) -> tuple[float, ...]:
    """The affine of a world file, whose six numbers are xscale, yskew, xskew, yscale, xoff, yoff (of the first cell's middle)."""
    with open(path) as f:
        a, d, b, e, c, y = (float(line) for line in f.read().split()[:6])
    return a, b, c, d, e, y


def write_world(grid: Grid, path: str) -> None:
    a, b, c, d, e, f = grid.affine
    with open(path, "w") as out:
        out.write("\n".join(map(str, (a, d, b, e, c, f))) + "\n")


def write_prj(crs: str, path: str) -> None:
    """The coordinate system as well-known text."""
    with open(path, "w") as f:
        f.write(to_wkt(crs))


def read_prj(path: str) -> str:
    try:
        with open(path) as f:
            return f.read() or WGS84
    except FileNotFoundError:
        return WGS84


# TIFF: the fixed numbers of tags and of kinds of values.
_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 11: ("f", 4), 12: ("d", 8), 5: ("II", 8)}
_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "bands", 278: "rows", 279: "lengths", 284: "planar", 317: "predictor", 339: "format", 33550: "scale", 33922: "tie", 34264: "matrix", 42113: "nodata"}


def _tiff_tags(read) -> dict:
    """Tags of a TIFF's first directory; read gives the bytes at a place."""
    first = read(0, 8)
    order = "<" if first[:2] == b"II" else ">"
    (at,) = binary.unpack(order + "I", first[4:8])
    (n,) = binary.unpack(order + "H", read(at, 2))
    listed, tags = read(at + 2, 12 * n), {"order": order}
    for i in range(n):
        tag, kind, count = binary.unpack(order + "HHI", listed[12 * i : 12 * i + 8])
        if tag not in _TAGS or kind not in _SIZES:
            continue
        letter, size = _SIZES[kind]
        raw = listed[12 * i + 8 : 12 * i + 12]
        if size * count > 4:
            raw = read(binary.unpack(order + "I", raw)[0], size * count)
        tags[_TAGS[tag]] = raw[:count].split(b"\0")[0].decode() if letter == "s" else binary.unpack(order + letter * count, raw[: size * count])
    return tags


def _reader(spark: SparkSession, path: str):
    """A function that reads bytes at a place of a file by Spark's own file system, and one that closes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)

    def read(place: int, size: int) -> bytes:
        stream.seek(place)
        return bytes(stream.readNBytes(size))

    return read, stream.close


def lzw(data: bytes, msb: bool = True, least: int = 8) -> bytes:
    """Lempel-Ziv-Welch codes as TIFF (from the highest bit, one code early) and GIF (from the lowest) pack them."""
    clear, out, table = 1 << least, [], []
    size, held, bits, last = least + 1, 0, 0, b""
    for byte in data:
        held, bits = ((held << 8) | byte, bits + 8) if msb else (held | (byte << bits), bits + 8)
        while bits >= size:
            if msb:
                code, held = held >> (bits - size), held & ((1 << (bits - size)) - 1)
            else:
                code, held = held & ((1 << size) - 1), held >> size
            bits -= size
            if code == clear:
                table, size, last = [bytes([i]) for i in range(clear)] + [b"", b""], least + 1, b""
                continue
            if code == clear + 1:
                return b"".join(out)
            if not table:
                table = [bytes([i]) for i in range(clear)] + [b"", b""]
            if code < len(table):
                word = table[code]
            elif code == len(table) and last:
                word = last + last[:1]
            else:
                raise ValueError("broken LZW data")
            out.append(word)
            if last and len(table) < 4096:
                table.append(last + word[:1])
            last = word
            if len(table) >= (1 << size) - msb and size < 12:
                size += 1
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


#: By TIFF's numbers of compressions.
_UNPACK = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: packbits}


def _tiff_grid(tags: dict, world: tuple | None) -> Grid:
    w, h = tags["width"][0], tags["height"][0]
    bits, form = tags.get("bits", (8,))[0], tags.get("format", (1,))[0]
    mode = {(8, 1): "int8", (16, 1): "int16", (16, 2): "int16", (32, 1): "int32", (32, 2): "int32", (32, 3): "float32", (64, 3): "float32"}.get((bits, form), "float32")
    if "matrix" in tags:
        m = tags["matrix"]
        affine = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif "scale" in tags and "tie" in tags:
        (sx, sy), (i, j, _, x, y) = tags["scale"][:2], tags["tie"][:5]
        affine = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        affine = world or (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    nodata = float(tags["nodata"]) if "nodata" in tags else None
    return Grid(w, h, tuple(map(float, affine)), mode, nodata)


def read_geotiff(spark: SparkSession, path: str, grid: Grid | None = None, world: tuple | None = None) -> RasterFrame:
    """Strips, plain or packed by LZW, deflate or PackBits, with or without differences between columns. Only the tags come to the driver; strips are cut out of the
    file by Spark and dealt to the executors."""
    read, close = _reader(spark, path)
    tags = _tiff_tags(read)
    close()
    packed, differs = tags.get("compression", (1,))[0], tags.get("predictor", (1,))[0] == 2
    if packed not in _UNPACK or tags.get("predictor", (1,))[0] not in (1, 2) or "offsets" not in tags:
        raise ValueError(f"a TIFF of compression {packed}, predictor {tags.get('predictor', (1,))[0]}{'' if 'offsets' in tags else ', in tiles'} cannot be read")
    grid = grid or _tiff_grid(tags, world)
    bands, planar = tags.get("bands", (1,))[0], tags.get("planar", (1,))[0]
    bits, form = tags.get("bits", (8,))[0], tags.get("format", (1,))[0]
    kind = np.dtype({(8, 1): "u1", (8, 2): "i1", (16, 1): "u2", (16, 2): "i2", (32, 1): "u4", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8"}[bits, form]).newbyteorder(tags["order"])
    per, across = tags.get("rows", (tags["height"][0],))[0], 1 if planar == 2 else bands
    width, height, nodata, unpack = grid.width, grid.height, grid.nodata, _UNPACK[packed]
    strips = -(-height // per)

    def run(batches):
        for b in batches:
            for s, data in zip(b["strip"], b["data"], strict=True):
                top = (s % strips) * per
                rows = min(per, height - top)
                v = np.frombuffer(unpack(bytes(data)), kind)[: rows * width * across].reshape(rows, width, across)
                v = np.cumsum(v, axis=1, dtype=kind.newbyteorder("=")) if differs else v
                r, c = np.mgrid[0:rows, 0:width]
                for k in range(across):
                    value = pd.Series(v[:, :, k].ravel().astype(float))
                    value = value if nodata is None else value.where(value != nodata)
                    yield pd.DataFrame({"band": np.int32(s // strips if planar == 2 else k), "col": c.ravel().astype(np.int32), "row": (r.ravel() + top).astype(np.int32), "value": value})

    places = list(zip(range(len(tags["offsets"])), tags["offsets"], tags["lengths"], strict=True))
    listed = spark.createDataFrame(places, "strip int, at long, size int")
    whole = spark.read.format("binaryFile").load(path).select("content")
    # One row, the file, beside its strips' places: each is cut out and dealt on by its number.
    cut = whole.withColumn("p", F.explode(F.array(*(F.struct(F.lit(i).alias("strip"), F.lit(o).alias("at"), F.lit(n).alias("size")) for i, o, n in places)))) if len(places) <= 256 else whole.join(F.broadcast(listed)).withColumn("p", F.struct("strip", "at", "size"))
    dealt = cut.select("p.strip", F.expr("substring(content, cast(p.at as int) + 1, p.size)").alias("data")).repartition("strip")
    return RasterFrame(dealt.mapInPandas(run, "band int, col int, row int, value double").withColumn("value", F.when(~F.isnan("value"), F.col("value"))), grid)


# Images: a PNG is decoded here, a GIF's first picture too; others need an imaging library.

def _png(data: bytes) -> np.ndarray:
    """height x width x channels of a PNG that is not interlaced; a palette's numbers become its colours."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, palette = 8, [], None
    while at < len(data):
        size, name = binary.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, colour, _, _, interlaced = binary.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body.append(part)
        at += 12 + size
    if interlaced:
        raise ValueError("interlaced PNG cannot be read")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step, line = max(1, channels * depth // 8), (width * channels * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, line + 1)
    out, above = np.zeros((height, line), np.uint8), np.zeros(line, np.uint8)
    for r in range(height):
        above = out[r] = _unfiltered(int(raw[r, 0]), raw[r, 1:], above, step)
    if depth == 16:
        values = out.view(">u2").astype(np.uint16)
    elif depth == 8:
        values = out
    else:
        values = np.stack([(out >> (8 - depth * (k + 1))) & ((1 << depth) - 1) for k in range(8 // depth)], axis=2).reshape(height, -1)[:, :width]
    values = values.reshape(height, width, channels)
    return palette[values[:, :, 0]] if colour == 3 else values


def _unfiltered(how: int, x: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of bytes whose differences from the left, from above, from their mean or from the nearer of three are undone."""
    if how == 0:
        return x
    if how == 2:
        return x + above
    if how == 1:
        pad = np.concatenate((x, np.zeros(-len(x) % step, np.uint8))).reshape(-1, step)
        return np.cumsum(pad, axis=0, dtype=np.uint8).ravel()[: len(x)]
    out, up = [0] * step + x.tolist(), [0] * step + above.tolist()
    for i in range(step, len(out)):
        a, b, c = out[i - step], up[i], up[i - step]
        if how == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return np.array(out[step:], np.uint8)


def _gif(data: bytes) -> np.ndarray:
    """height x width x 3 of a GIF's first picture."""
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    width, height, flags = binary.unpack("<HHB", data[6:11])
    at, colours = 13, None

    def table(flags: int, at: int):
        n = 2 << (flags & 7)
        return (np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3), at + 3 * n) if flags & 128 else (None, at)

    colours, at = table(flags, at)
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        left, top, w, h, flags = binary.unpack("<HHHHB", data[at + 1 : at + 10])
        own, at = table(flags, at + 10)
        colours, least, at, parts = own if own is not None else colours, data[at], at + 1, []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += data[at] + 1
        lines = np.frombuffer(lzw(b"".join(parts), False, least), np.uint8)[: w * h].reshape(h, w)
        if flags & 64:
            order = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
            lines = lines[np.argsort(order)]
        out = np.zeros((height, width), np.uint8)
        out[top : top + h, left : left + w] = lines
        return colours[out]
    raise ValueError("a GIF without a picture")


def _picture(data: bytes, ending: str) -> np.ndarray:
    if ending == "png":
        return _png(data)
    if ending == "gif":
        return _gif(data)
    try:
        import io

        from PIL import Image
    except ImportError:
        raise ValueError(f".{ending} needs an imaging library, which is not installed") from None
    out = np.asarray(Image.open(io.BytesIO(data)))
    return out if out.ndim == 3 else out[:, :, None]


def of_image(spark: SparkSession, image: np.ndarray, grid: Grid | None = None) -> RasterFrame:
    """A raster with a band for each channel of an image in memory (height x width, or height x width x channels)."""
    image = np.asarray(image)
    image = image if image.ndim == 3 else image[:, :, None]
    h, w, n = image.shape
    grid = grid or Grid(w, h, mode="int8" if image.dtype == np.uint8 else "int32" if image.dtype.kind in "iu" else "float32", nodata=None)
    band, row, col = np.mgrid[0:n, 0:h, 0:w]
    cells = pd.DataFrame({"band": band.ravel().astype(np.int32), "col": col.ravel().astype(np.int32), "row": row.ravel().astype(np.int32), "value": np.moveaxis(image, 2, 0).ravel().astype(float)})
    out = RasterFrame(spark.createDataFrame(cells, "band int, col int, row int, value double"), grid)
    return out.new(out.df.withColumn("value", F.when(~F.isnan("value"), F.col("value"))))


def _beside(path: str, endings: tuple[str, ...]) -> str | None:
    return next((f"{path.rsplit('.', 1)[0]}.{e}" for e in endings if os.path.exists(f"{path.rsplit('.', 1)[0]}.{e}")), None)


def read_image(spark: SparkSession, path: str, grid: Grid | None = None) -> RasterFrame:
    """A picture as a raster of bands, with the world file and the .prj beside it. A picture is one stream, so one task decodes it."""
    ending = path.rsplit(".", 1)[-1].lower()
    read, close = _reader(spark, path)
    head_ = read(0, 1 << 16)
    close()
    if grid is None:
        if ending == "png":
            width, height, depth = binary.unpack(">IIB", head_[16:25])
        elif ending == "gif":
            (width, height), depth = binary.unpack("<HH", head_[6:10]), 8
        else:
            read, close = _reader(spark, path)
            height, width = _picture(read(0, 1 << 30), ending).shape[:2]
            close()
            depth = 8
        world = _beside(path, ("wld", ending[0] + ending[-1] + "w", ending + "w"))
        grid = Grid(width, height, tuple(read_world(world)) if world else (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), "int32" if depth == 16 else "int8", None, read_prj(f"{path.rsplit('.', 1)[0]}.prj"))

    def run(batches):
        for b in batches:
            for data in b["content"]:
                image = _picture(bytes(data), ending)
                r, c = np.mgrid[0 : image.shape[0], 0 : image.shape[1]]
                for k in range(image.shape[2]):
                    yield pd.DataFrame({"band": np.int32(k), "col": c.ravel().astype(np.int32), "row": r.ravel().astype(np.int32), "value": image[:, :, k].ravel().astype(float)})

    return RasterFrame(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "band int, col int, row int, value double"), grid)


def write_png(raster: RasterFrame, path: str) -> None:
    """Bands 0 to 3 at most as grey, grey and alpha, RGB or RGBA of 8 bits (whole values of 0 to 255; nodata is 0), with a world file and a .prj beside. Rows stream through the
    driver in order, as one picture must."""
    g, bands = raster.grid, len(raster)
    colour = {1: 0, 2: 4, 3: 2, 4: 6}.get(bands)
    if colour is None:
        raise ValueError(f"a picture has 1 to 4 bands, not {bands}")

    def chunk(name: bytes, part: bytes) -> bytes:
        return binary.pack(">I", len(part)) + name + part + binary.pack(">I", zlib.crc32(name + part))

    v = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(F.coalesce("value", F.lit(0.0)))))
    lines = raster.df.groupBy("row").agg(F.collect_list(F.struct("col", "band", v.cast("int").alias("v"))).alias("cells")).orderBy("row")
    packer, line = zlib.compressobj(), 0
    with open(path, "wb") as out:
        out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", binary.pack(">IIBBBBB", g.width, g.height, 8, colour, 0, 0, 0)))
        for r in lines.toLocalIterator():
            values = np.zeros((g.width, bands), np.uint8)
            for cell in r["cells"]:
                values[cell["col"], cell["band"]] = cell["v"]
            empty = (b"\0" + bytes(g.width * bands)) * (r["row"] - line)
            if part := packer.compress(empty + b"\0" + values.tobytes()):
                out.write(chunk(b"IDAT", part))
            line = r["row"] + 1
        out.write(chunk(b"IDAT", packer.compress((b"\0" + bytes(g.width * bands)) * (g.height - line)) + packer.flush()) + chunk(b"IEND", b""))
    write_world(g, f"{path.rsplit('.', 1)[0]}.wld")
    write_prj(g.crs, f"{path.rsplit('.', 1)[0]}.prj")


def write_geotiff(raster: RasterFrame, path: str) -> None:
    """32-bit floats, uncompressed, a strip for each row and band, with the affine and nodata. Rows stream through the driver in order, as one file must."""
    g = raster.grid
    missing = -9999.0 if g.nodata is None else g.nodata
    bands = len(raster)
    a, b, c, d, e, f = g.affine
    n = g.height * bands
    matrix = binary.pack("<16d", a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1)
    text = str(missing).encode() + b"\0"
    entries = [(256, 4, 1, g.width), (257, 4, 1, g.height), (258, 3, 1, 32), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, n, None), (277, 3, 1, bands), (278, 4, 1, 1), (279, 4, n, None), (284, 3, 1, 2), (339, 3, 1, 3), (34264, 12, 16, None), (42113, 2, len(text), None)]
    start = 8 + 2 + 12 * len(entries) + 4
    places, at = {}, start
    for tag, size in ((258, 2 * bands), (339, 2 * bands), (273, 4 * n), (279, 4 * n), (34264, 128), (42113, len(text))):
        places[tag], at = at, at + size + size % 2
    blobs = {258: binary.pack(f"<{bands}H", *[32] * bands), 339: binary.pack(f"<{bands}H", *[3] * bands), 273: binary.pack(f"<{n}I", *(at + 4 * g.width * i for i in range(n))), 279: binary.pack(f"<{n}I", *[4 * g.width] * n), 34264: matrix, 42113: text}
    with open(path, "wb") as out:
        out.write(b"II*\0" + binary.pack("<I", 8) + binary.pack("<H", len(entries)))
        for tag, kind, count, value in entries:
            count = bands if tag in (258, 339) else count
            data = blobs.get(tag)
            if data is not None and len(data) > 4:
                out.write(binary.pack("<HHII", tag, kind, count, places[tag]))
            elif data is not None:
                out.write(binary.pack("<HHI", tag, kind, count) + data.ljust(4, b"\0"))
            else:
                out.write(binary.pack("<HHI", tag, kind, count) + (binary.pack("<H", value).ljust(4, b"\0") if kind == 3 else binary.pack("<I", value)))
        out.write(b"\0" * 4)
        for tag, spot in places.items():
            out.seek(spot)
            out.write(blobs[tag])
        out.seek(at + 4 * g.width * n - 1)
        out.write(b"\0")
        v = F.coalesce("value", F.lit(float(missing)))
        lines = raster.df.groupBy("band", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", v.alias("v")))), lambda p: p["v"]).alias("v"))
        for r in lines.toLocalIterator():
            out.seek(at + 4 * g.width * (r["band"] * g.height + r["row"]))
            out.write(np.array(r["v"], "<f4").tobytes())


def write(raster: RasterFrame, path: str, **options) -> None:
    ending = path.rsplit(".", 1)[-1].lower()
    writers = {"asc": write_ascii, "tif": write_geotiff, "tiff": write_geotiff, "png": write_png, "csv": write_cells, "txt": write_cells}
    if ending == "parquet":
        raster.df.write.mode("overwrite").parquet(path)
    elif ending in writers:
        writers[ending](raster, path, **options)
    else:
        raise ValueError(f"unknown kind of raster: .{ending}")
