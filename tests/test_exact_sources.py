"""Files keep numbers, texts and rows as they are, or say why not."""

import pytest
from pyspark.sql import functions as F

from geoframe.functions import geometry as G
from geoframe.operators.table import FeatureFrame
from geoframe.sources import vector
from geoframe.types import FID, GEOM


def test_delimited_numbers_are_exact(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_text("id,big,mixed,name,few\n9007199254740993,12345678901234567890,1.5,a,1.0\n9007199254740995,1,2,b,2\n-9223372036854775808,2,3,c,1e3\n")
    out = vector.read(spark, str(path)).df.orderBy("name")
    assert [r.id for r in out.collect()] == [9007199254740993, 9007199254740995, -9223372036854775808]
    assert dict(out.dtypes)["id"] == "bigint" and dict(out.dtypes)["big"] == "double" and dict(out.dtypes)["mixed"] == "double"
    assert [r.few for r in out.collect()] == [1, 2, 1000] and dict(out.dtypes)["few"] == "bigint"


def test_delimited_lines_and_splits(spark, tmp_path):
    path = tmp_path / "many.csv"
    path.write_text("note\nx,y\n" + "".join(f"{i},t{i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = vector.read_delimited(spark, str(path), ",", skip=1, last=4321)
        rows = out.df.orderBy(FID).collect()
        assert [r.x for r in rows] == list(range(4321)) and rows[-1].y == "t4320"
        lines = tmp_path / "plain.csv"
        lines.write_text("x,y\n" + "".join(f"{i},t{i}\n" for i in range(5000)))
        plain = vector.read_delimited(spark, str(lines), ",")
        assert plain.df.rdd.getNumPartitions() > 2 and plain.df.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    quoted = tmp_path / "quoted.csv"
    quoted.write_text('a,b\n1,"two\nlines"\n')
    assert vector.read_delimited(spark, str(quoted), ",", multiline=True).df.first().b == "two\nlines"
    with pytest.raises(ValueError, match="count lines"):
        vector.read_delimited(spark, str(quoted), ",", skip=1, multiline=True)


def frame(spark, rows, schema):
    df = spark.createDataFrame(rows, schema).withColumn(FID, F.monotonically_increasing_id()).withColumn(GEOM, G.point(F.lit(1.0), F.lit(2.0)))
    return FeatureFrame(df.coalesce(1), "Point")


def test_shapefile_keeps_numbers_and_refuses_long_texts(spark, tmp_path):
    values = [0.000000123, 1e-300, 123456789.123456789, -0.5, 3.0, None, 1e25, 1 / 3]
    ids = [9007199254740993, 9007199254740995, -(1 << 63), (1 << 63) - 1, 0, 5, 6, 7]
    path = str(tmp_path / "a.shp")
    vector.write(frame(spark, list(zip(values, ids, strict=True)), "v double, id long"), path)
    back = vector.read(spark, path).df.orderBy(FID).collect()
    assert [r.v for r in back] == values and [int(r.id) for r in back] == ids
    vector.write(frame(spark, [("x" * 254,)], "t string"), path)
    assert vector.read(spark, path).df.first().t == "x" * 254
    with pytest.raises(ValueError, match="t \\(300 bytes\\)"):
        vector.write(frame(spark, [("x" * 300,)], "t string"), path)


def test_excel_takes_more_sheets(spark, tmp_path, monkeypatch):
    written = []

    class Book:
        def __init__(self, path):
            self.path = path

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    monkeypatch.setattr(vector, "SHEET_ROWS", 4)
    monkeypatch.setattr(vector.pd, "ExcelWriter", Book)
    monkeypatch.setattr(vector.pd.DataFrame, "to_excel", lambda df, book, sheet_name, index: written.append((sheet_name, df["v"].tolist())))
    vector.write(frame(spark, [(i,) for i in range(9)], "v long"), str(tmp_path / "a.xlsx"))
    assert written == [("Data", [0, 1, 2, 3]), ("Data2", [4, 5, 6, 7]), ("Data3", [8])]
    written.clear()
    vector.write(frame(spark, [], "v long"), str(tmp_path / "b.xlsx"))
    assert written == [("Data", [])]
