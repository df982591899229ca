"""Feature tables from and to files: delimited text, GeoJSON, shapefiles, Excel, Stata, Parquet.

Text formats are read and written by Spark itself.  A shapefile is read in record ranges, one task each, by seeking in the file.
"""

from __future__ import annotations

import csv
import decimal
import itertools
import struct as binary
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoframe.functions import geometry as G
from geoframe.functions import kernels
from geoframe.functions.crs import to_wkt
from geoframe.operators.table import FeatureFrame, as_column
from geoframe.types import FID, GEOM, GEOMETRY, WGS84

#: Bytes of a file that its delimiter is guessed from.
SNIFFED = 10 * 1056


def read(spark: SparkSession, path: str, select=None, crs: str | None = None, **options) -> FeatureFrame:
    """A frame from a file by its extension; select is a condition on rows."""
    readers = {"csv": read_delimited, "tsv": read_delimited, "txt": read_delimited, "tab": read_delimited, "dat": read_delimited, "json": read_geojson, "geojson": read_geojson, "shp": read_shapefile, "xls": read_excel, "xlsx": read_excel, "dta": read_stata, "parquet": read_parquet, "gpx": read_gpx}
    ending = path.rsplit(".", 1)[-1].lower()
    if ending not in readers:
        raise ValueError(f"unknown kind of file: .{ending}")
    out = readers[ending](spark, path, **options)
    out = FeatureFrame(out.df, out.geometry_type, crs or out.crs)
    return out.select(as_column(select)) if select is not None else out


def head(spark: SparkSession, path: str, size: int = SNIFFED, encoding: str = "utf-8") -> str:
    """The first bytes of a file, read by Spark's own file system."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(fs_path).isDirectory():
        parts = sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(fs_path))
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path, next(n for n, size in parts if n[0] not in "._" and size))
    stream = fs.open(fs_path)
    try:
        return bytes(stream.readNBytes(size)).decode(encoding, "replace")
    finally:
        stream.close()


def parsed(value: Column) -> Column:
    """A delimited value as text: NULL and '' are missing, a comma may be the decimal point of a number."""
    plain = F.regexp_replace(F.trim(value), ",", ".")
    return F.when((F.upper(F.trim(value)) == "NULL") | (value == ""), None).when(plain.try_cast("double").isNotNull(), plain).otherwise(value)


def typed(df: DataFrame, fields: list[str]) -> DataFrame:
    """Columns of which every value that is there is a number become long (if all are whole and fit one, each as it is written) or double; one pass over the data."""
    aggs = []
    whole = lambda f: F.regexp_replace(F.trim(F.col(f"`{f}`")), r"\.0*$", "").try_cast("long")
    for i, f in enumerate(fields):
        n = F.col(f"`{f}`").try_cast("double")
        fits = whole(f).isNotNull() | ((n == F.floor(n)) & (F.abs(n) < F.lit(2.0**53)))
        aggs += [F.bool_and(F.when(F.col(f"`{f}`").isNotNull(), n.isNotNull())).alias(f"a{i}"), F.bool_and(F.when(n.isNotNull(), F.coalesce(fits, F.lit(False)))).alias(f"b{i}")]
    told = df.agg(*aggs).first() if aggs else None
    for i, f in enumerate(fields):
        if told[f"a{i}"]:
            n = F.col(f"`{f}`").try_cast("double")
            df = df.withColumn(f, F.coalesce(whole(f), F.when(F.abs(n) < F.lit(2.0**53), n).cast("long")) if told[f"b{i}"] else n)
    return df


def _numbered_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """value and n, the number of a line from 0: places inside splits, and splits' sizes added up."""
    lines = spark.read.option("encoding", encoding).text(path).withColumn("m", F.monotonically_increasing_id())
    lines = lines.select("value", F.shiftright("m", 33).alias("split"), F.col("m").bitwiseAND((1 << 33) - 1).alias("place"))
    sizes = lines.groupBy("split").agg(F.count("*").alias("k"))  # a row for each split
    starts = sizes.select("split", F.coalesce(F.sum("k").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return lines.join(F.broadcast(starts), "split").select("value", (F.col("start") + F.col("place")).alias("n"))


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "utf-8", skip: int = 0, last: int | None = None, xfield: str | None = None, yfield: str | None = None, geokey: Callable[[], Column] | None = None, sniffsize: int = 10, multiline: bool = False) -> FeatureFrame:
    """skip: lines before the names; last: the last data row taken (from 1). xfield, yfield: columns of point geometries; geokey: a function that makes the
    geometry column. multiline: quoted values may hold line breaks, and each file is read by one task; not together with skip and last, which count lines."""
    if delimiter is None:
        try:
            delimiter = csv.Sniffer().sniff(head(spark, path, sniffsize * 1056, encoding), ";,\t|").delimiter
        except csv.Error:
            delimiter = ","
    quoting = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    if skip or last is not None:
        if multiline:
            raise ValueError("skip and last count lines, so values cannot go over several")
        lines = _numbered_lines(spark, path, encoding)
        names = lines.where(F.col("n") == skip).first()
        names = next(csv.reader([names["value"]], delimiter=delimiter)) if names else []
        names = [n if n and names.index(n) == i else f"{n or '_c'}{i}" for i, n in enumerate(names)]
        kept = lines.where((F.col("n") > skip) & (F.lit(True) if last is None else F.col("n") <= skip + last) & (F.col("value") != ""))
        schema = ", ".join(f"`{n}` string" for n in names)
        df = kept.select(F.from_csv("value", F.lit(schema), quoting).alias("r"), F.col("n").alias(FID)).select(*(F.col("r").getField(n).alias(n) for n in names), FID)
    else:
        df = spark.read.options(**quoting).option("encoding", encoding).option("multiLine", str(multiline).lower()).option("header", "true").csv(path)
        names = df.columns
        df = df.withColumn(FID, F.monotonically_increasing_id())
    df = typed(df.select(*(parsed(F.col(f"`{f}`")).alias(f) for f in names), FID), names)
    if geokey is not None:
        df = df.withColumn(GEOM, geokey())
    out = FeatureFrame(df)
    return out.point_geometry(xfield, yfield) if xfield and yfield else out


def read_geojson(spark: SparkSession, path: str) -> FeatureFrame:
    """A FeatureCollection (or Feature, or geometry); fields are those that all features have."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"))
    kind = F.get_json_object("t", "$.type")
    as_list = "array<struct<properties:string,geometry:string>>"
    one = F.struct(F.get_json_object("t", "$.properties").alias("properties"), F.get_json_object("t", "$.geometry").alias("geometry"))
    bare = F.struct(F.lit("{}").alias("properties"), F.col("t").alias("geometry"))
    listed = F.when(kind == "FeatureCollection", F.from_json(F.get_json_object("t", "$.features"), as_list)).when(kind == "Feature", F.array(one)).otherwise(F.array(bare))
    # A file is one text, so one task cuts it up; from there on its features are dealt out.
    rows = whole.select(F.posexplode(listed).alias(FID, "f")).repartition(FID).select(F.col(FID).cast("long").alias(FID), F.coalesce(F.col("f.properties"), F.lit("{}")).alias("p"), G.from_geojson(F.col("f.geometry")).alias(GEOM))
    names = rows.select(F.explode(F.json_object_keys("p")).alias("k")).groupBy("k").count()
    total = rows.count()
    common = sorted(r["k"] for r in names.collect() if r["count"] == total)
    values = F.from_json("p", "map<string,string>")
    df = rows.select(*(values[k].alias(k) for k in common), FID, GEOM)
    kinds = [r[0] for r in df.where(F.col(GEOM).isNotNull()).select(f"{GEOM}.type").distinct().collect()]
    if len(kinds) > 1:
        raise TypeError(f"geometries of several types: {sorted(kinds)}")
    return FeatureFrame(typed(df, common), kinds[0] if kinds else None)


def write_geojson(frame: FeatureFrame, path: str, digits: int = 12) -> None:
    """One file that holds a FeatureCollection, numbers rounded, whole numbers written as such. As such a file is one text, one task writes it, streaming."""

    def value(f: str) -> Column:
        kind = frame.df.schema[f].dataType.simpleString()
        c = F.col(f"`{f}`")
        return F.when(c == F.floor(c), F.to_json(F.struct(c.cast("long").alias("v")))).otherwise(F.to_json(F.struct(F.round(c, digits).alias("v")))) if kind in ("double", "float") else F.to_json(F.struct(c.alias("v")))

    pairs = [F.concat(F.lit(f'"{f}": '), F.when(F.col(f"`{f}`").isNull(), "null").otherwise(F.regexp_extract(value(f), r'(?s)^\{"v":(.*)\}$', 1))) for f in frame.fields]
    line = F.concat(F.lit('{"type": "Feature", "properties": {'), F.concat_ws(", ", *pairs), F.lit('}, "geometry": '), F.coalesce(G.to_geojson(F.col(GEOM), digits), F.lit("null")), F.lit("}"))
    rows = frame.df.select(FID, line.alias("line"))
    last = rows.agg(F.max(FID)).first()[0]
    body = rows.select(F.col(FID).alias("o"), F.concat("line", F.when(F.col(FID) == last, "").otherwise(",")).alias("value"))
    spark = frame.df.sparkSession
    ends = spark.createDataFrame([(-(1 << 62), '{"type": "FeatureCollection", "features": ['), ((1 << 62), "]}")], "o long, value string")
    body.unionByName(ends).coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)


def write_delimited(frame: FeatureFrame, path: str, delimiter: str = ";") -> None:
    frame.df.drop(GEOM, FID).write.mode("overwrite").option("header", "true").option("sep", delimiter).csv(path)


def read_parquet(spark: SparkSession, path: str) -> FeatureFrame:
    return FeatureFrame(spark.read.parquet(path))


def write_parquet(frame: FeatureFrame, path: str) -> None:
    """The bbox stays a struct of plain numbers, so a box filter skips row groups."""
    frame.df.write.mode("overwrite").parquet(path)


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0, skip: int = 0, last: int | None = None, xfield: str | None = None, yfield: str | None = None) -> FeatureFrame:
    """One sheet, read on the driver (a sheet is bounded by its format). Needs pandas' Excel engine."""
    frame = pd.read_excel(path, sheet_name=sheet, skiprows=skip, nrows=last)
    return _of_pandas(spark, frame, xfield, yfield)


def read_stata(spark: SparkSession, path: str, labels: bool = False, xfield: str | None = None, yfield: str | None = None) -> FeatureFrame:
    return _of_pandas(spark, pd.read_stata(path, convert_categoricals=labels), xfield, yfield)


def _of_pandas(spark, frame: pd.DataFrame, xfield, yfield) -> FeatureFrame:
    frame = frame.astype(object).where(frame.notna(), None)
    out = FeatureFrame.from_rows(spark, [str(c) for c in frame.columns], frame.values.tolist())
    return out.point_geometry(xfield, yfield) if xfield and yfield else out


def read_gpx(spark: SparkSession, path: str) -> FeatureFrame:
    """Track points of a GPX file in order, as points (x is the longitude)."""
    text = spark.read.text(path, wholetext=True)
    found = text.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<trkpt\b[^>]*>"), F.lit(0))).alias(FID, "t"))
    at = lambda n: F.regexp_extract("t", rf'{n}="([^"]*)"', 1).try_cast("double")
    return FeatureFrame(found.select(F.col(FID).cast("long").alias(FID), G.point(at("lon"), at("lat")).alias(GEOM)), "Point")


# Shapefiles

_SHAPES = {0: None, 1: "Point", 3: "LineString", 5: "Polygon", 8: "Point"}
_CODES = {"Point": 1, "LineString": 3, "Polygon": 5}
#: Records that one task reads.
RECORDS = 50_000


def _shape(data: bytes):
    """Type and parts of a shapefile record's content."""
    (code,) = binary.unpack("<i", data[:4])
    kind = _SHAPES.get(code % 10 if code > 10 else code)
    code = code % 10 if code > 10 else code
    if kind is None:
        return None
    if code == 1:
        return kind, [[[binary.unpack("<2d", data[4:20])]]]
    if code == 8:
        (n,) = binary.unpack("<i", data[36:40])
        v = binary.unpack(f"<{2 * n}d", data[40 : 40 + 16 * n])
        return kind, [[[(v[2 * i], v[2 * i + 1])]] for i in range(n)]
    parts, n = binary.unpack("<2i", data[36:44])
    starts = [*binary.unpack(f"<{parts}i", data[44 : 44 + 4 * parts]), n]
    v = binary.unpack(f"<{2 * n}d", data[44 + 4 * parts : 44 + 4 * parts + 16 * n])
    rings = [[(v[2 * i], v[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
    if kind == "LineString":
        return kind, [[r] for r in rings]
    # In this format exteriors run clockwise; a hole belongs to the exterior that holds it.
    outer = [[r] for r in rings if kernels.ring_area(r) <= 0] or [[r] for r in rings[:1]]
    for r in rings:
        if kernels.ring_area(r) > 0 and [r] not in outer:
            home = next((p for p in outer if kernels.inside(r[0][0], r[0][1], ("Polygon", [[p[0]]]))[0]), outer[0])
            home.append(r)
    return kind, outer


def read_shapefile(spark: SparkSession, path: str, encoding: str = "utf-8") -> FeatureFrame:
    """The .shp with its .shx and .dbf (and .prj), whose paths every executor must see, as record ranges of RECORDS."""
    stem = path.removesuffix(".shp")
    with open(f"{stem}.shx", "rb") as f:
        f.seek(24)
        n = (binary.unpack(">i", f.read(4))[0] * 2 - 100) // 8
    with open(f"{stem}.dbf", "rb") as f:
        start = f.read(32)
        _, header, size = binary.unpack("<IHH", start[4:12])
        fields = []
        while len(d := f.read(32)) == 32 and d[0] != 0x0D:
            fields.append((d[:11].split(b"\0")[0].decode(encoding), chr(d[11]), d[16], d[17]))
    try:
        with open(f"{stem}.prj") as f:
            crs = f.read()
    except FileNotFoundError:
        crs = WGS84
    kinds = {"C": "string", "N": "double", "F": "double", "L": "boolean", "D": "string"}
    # 18 digits always fit a long; wider whole numbers are decimals, so that none is rounded.
    whole = lambda width: "long" if width <= 18 else "decimal(38,0)"
    schema = ", ".join([*(f"`{f}` {whole(w) if k == 'N' and not dec else kinds.get(k, 'string')}" for f, k, w, dec in fields), f"{FID} long", f"{GEOM} {GEOMETRY}"])

    def value(raw: bytes, kind: str, width: int, decimals: int):
        text = raw.decode(encoding, "replace").strip().strip("\0")
        if kind in "NF":
            try:
                if decimals or kind == "F":
                    return float(text)
                number = decimal.Decimal(text)
                return int(number) if width <= 18 else number.quantize(decimal.Decimal(1), decimal.ROUND_DOWN, decimal.Context(38))
            except (ValueError, decimal.InvalidOperation):
                return None
        if kind == "L":
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
        return text or None

    def run(batches):
        with open(f"{stem}.shp", "rb") as shp, open(f"{stem}.shx", "rb") as shx, open(f"{stem}.dbf", "rb") as dbf:
            for b in batches:
                rows = []
                for i in b["id"].tolist():
                    for k in range(i * RECORDS, min(n, (i + 1) * RECORDS)):
                        shx.seek(100 + 8 * k)
                        at, words = binary.unpack(">2i", shx.read(8))
                        shp.seek(at * 2 + 8)
                        s = _shape(shp.read(words * 2))
                        dbf.seek(header + size * k + 1)
                        row = [value(dbf.read(w), kind, w, dec) for _, kind, w, dec in fields]
                        rows.append([*row, k, kernels.struct(*s) if s else None])
                        if len(rows) >= 2000:
                            yield pd.DataFrame(rows, columns=[*(f[0] for f in fields), FID, GEOM]).astype(object)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=[*(f[0] for f in fields), FID, GEOM]).astype(object)

    tasks = max(1, -(-n // RECORDS))
    df = spark.range(0, tasks, 1, tasks).mapInPandas(run, schema)
    with open(f"{stem}.shp", "rb") as f:
        f.seek(32)
        code = binary.unpack("<i", f.read(4))[0]
    return FeatureFrame(df, _SHAPES.get(code % 10 if code > 10 else code), crs)


def write_shapefile(frame: FeatureFrame, path: str) -> None:
    """.shp, .shx, .dbf and .prj on the driver, rows streaming in order: names cut to 10 characters, numbers as N with all digits that
    they need, all else as C. A text of more than the format's 254 bytes is refused, with its field's name."""
    stem, names, used = path.removesuffix(".shp"), {}, set()
    for f in frame.fields:
        short, k = f.replace(" ", "_")[:10], 1
        while short in used:
            short, k = f"{short[: 10 - len(str(k))]}{k}", k + 1
        used.add(short)
        names[f] = short
    kinds = {f: frame.df.schema[f].dataType.simpleString() for f in frame.fields}
    text = lambda f: F.col(f"`{f}`").cast("string")
    is_number = {f: k in ("int", "bigint", "smallint", "tinyint", "double", "float") for f, k in kinds.items()}

    def number(f: str) -> Column:
        """All digits of a double, plainly where a decimal holds it as it is, else with an exponent."""
        c = F.col(f"`{f}`").cast("double")
        plain = c.try_cast("decimal(38,17)")
        text_ = F.regexp_replace(plain.cast("string"), r"\.?0+$", "")
        text_ = F.when(F.instr(plain.cast("string"), ".") > 0, text_).otherwise(plain.cast("string"))
        return F.when(F.isnan(c), None).otherwise(F.when(plain.cast("double") == c, text_).otherwise(c.cast("string")))

    shown = {f: number(f) if kinds[f] in ("double", "float") else text(f) for f in frame.fields}
    places = lambda f: F.max(F.length(F.regexp_extract(shown[f], r"\.([0-9]+)", 1)))
    told = frame.df.agg(*(F.max(F.octet_length(shown[f])).alias(f"w{i}") for i, f in enumerate(frame.fields)), *(places(f).alias(f"p{i}") for i, f in enumerate(frame.fields))).first() if frame.fields else {}
    width = [max(1, told[f"w{i}"] or 1) for i in range(len(frame.fields))]
    # Whole doubles stay doubles when they are read again.
    decimals = [max(1, told[f"p{i}"] or 0) if kinds[f] in ("double", "float") else 0 for i, f in enumerate(frame.fields)]
    if long := [f"{f} ({w} bytes)" for f, w in zip(frame.fields, width, strict=True) if w > 254]:
        raise ValueError(f"a shapefile's values have 254 bytes at most: {', '.join(long)}")
    code = _CODES.get(frame.geometry_type or (frame.df.where(F.col(GEOM).isNotNull()).select(f"{GEOM}.type").first() or ["Point"])[0], 1)
    multi = code == 1 and not frame.df.where(F.col(f"{GEOM}.multi")).isEmpty()
    code = 8 if multi else code
    box, at, n = [float("inf")] * 2 + [float("-inf")] * 2, 50, 0
    with open(f"{stem}.shp", "wb") as shp, open(f"{stem}.shx", "wb") as shx, open(f"{stem}.dbf", "wb") as dbf:
        for f in (shp, shx):
            f.write(b"\0" * 100)
        header = 33 + 32 * len(names)
        dbf.write(b"\0" * header)
        for row in frame.df.select(FID, GEOM, *(shown[f].alias(names[f]) for f in frame.fields)).orderBy(FID).toLocalIterator():
            s = kernels.shape(row[GEOM]) if row[GEOM] else None
            data = _record(s, code)
            if s:
                xs, ys = zip(*[v for p in s[1] for r in p for v in r], strict=True)
                box = [min(box[0], *xs), min(box[1], *ys), max(box[2], *xs), max(box[3], *ys)]
            n += 1
            shp.write(binary.pack(">2i", n, len(data) // 2) + data)
            shx.write(binary.pack(">2i", at, len(data) // 2))
            at += 4 + len(data) // 2
            dbf.write(b" ")
            for f, w in zip(frame.fields, width, strict=True):
                raw = (row[names[f]] or "").encode()
                dbf.write(raw.rjust(w) if is_number[f] else raw.ljust(w))
        dbf.write(b"\x1a")
        box = [0.0] * 4 if n == 0 or box[0] == float("inf") else box
        for f, size in ((shp, at), (shx, 50 + 4 * n)):
            f.seek(0)
            f.write(binary.pack(">7i", 9994, 0, 0, 0, 0, 0, size) + binary.pack("<2i", 1000, code) + binary.pack("<8d", *box, 0, 0, 0, 0))
        dbf.seek(0)
        dbf.write(binary.pack("<4BIHH20x", 3, 100, 1, 1, n, header, 1 + sum(width)))
        for f, w, d in zip(frame.fields, width, decimals, strict=True):
            dbf.write(names[f].encode()[:10].ljust(11, b"\0") + (b"N" if is_number[f] else b"C") + b"\0" * 4 + bytes([w, d]) + b"\0" * 14)
        dbf.write(b"\r")
    with open(f"{stem}.prj", "w") as f:
        f.write(to_wkt(frame.crs))


def _record(s, code: int) -> bytes:
    if s is None:
        return binary.pack("<i", 0)
    if code == 1:
        return binary.pack("<i2d", 1, *s[1][0][0][0])
    points = [v for p in s[1] for r in p for v in r]
    xs, ys = zip(*points, strict=True)
    box = binary.pack("<4d", min(xs), min(ys), max(xs), max(ys))
    if code == 8:
        return binary.pack("<i", 8) + box + binary.pack("<i", len(points)) + b"".join(binary.pack("<2d", *v) for v in points)
    rings = []
    for part in s[1]:
        for i, r in enumerate(part):
            if code == 5:
                r = [*r, r[0]] if r[0] != r[-1] else r
                r = r[::-1] if (kernels.ring_area(r) > 0) == (i == 0) else r
            rings.append(r)
    starts, at = [], 0
    for r in rings:
        starts.append(at)
        at += len(r)
    return binary.pack("<i", code) + box + binary.pack("<2i", len(rings), at) + binary.pack(f"<{len(starts)}i", *starts) + b"".join(binary.pack("<2d", *v) for r in rings for v in r)


def write(frame: FeatureFrame, path: str, **options) -> None:
    """By the path's extension."""
    writers = {"csv": write_delimited, "txt": write_delimited, "geojson": write_geojson, "json": write_geojson, "shp": write_shapefile, "parquet": write_parquet, "xls": write_excel, "xlsx": write_excel}
    ending = path.rsplit(".", 1)[-1].lower()
    if ending not in writers:
        raise ValueError(f"unknown kind of file: .{ending}")
    writers[ending](frame, path, **options)


#: Data rows that a sheet holds below its names.
SHEET_ROWS = 1_048_575


def write_excel(frame: FeatureFrame, path: str) -> None:
    """Sheets named Data, Data2 and so on, as many as the rows need, in the frame's order, streaming through the driver; needs pandas' Excel engine."""
    rows, sheet = frame.df.orderBy(FID).select(*frame.fields).toLocalIterator(), 0
    with pd.ExcelWriter(path) as book:
        while True:
            part = list(itertools.islice(rows, SHEET_ROWS))
            if sheet and not part:
                return
            sheet += 1
            pd.DataFrame(part, columns=frame.fields).to_excel(book, sheet_name=f"Data{sheet if sheet > 1 else ''}", index=False)
