"""Feature and raster frames derived from the test tables, and the same as SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoframe.functions import geometry as G
from geoframe.operators.raster import RasterFrame
from geoframe.operators.table import FeatureFrame
from geoframe.types import FID, GEOM, Grid

#: A raster of lineitem has this many columns and rows.
COLS, ROWS = 48, 24


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str, name: str, key: str) -> FeatureFrame:
    """Points of supplier, customer or part: x, y from the key; __fid is the key."""
    df = table(spark, sf, name)
    k = F.col(key).cast("long")
    x, y = ((k * 37) % 360 - 180).cast("double") + F.lit(0.5), ((k * 17) % 180 - 90).cast("double") + F.lit(0.5)
    return FeatureFrame(df.withColumn(FID, k).withColumn(GEOM, G.point(x, y)), "Point")


def zones(spark: SparkSession, sf: str) -> FeatureFrame:
    """Boxes of 72 x 36 degrees, one for each nation; together they tile the world."""
    df = table(spark, sf, "nation")
    k = F.col("n_nationkey").cast("long")
    x, y = (-180 + 72 * (k % 5)).cast("double"), (-90 + 36 * F.floor(k / 5)).cast("double")
    return FeatureFrame(df.withColumn(FID, k).withColumn(GEOM, G.box(x, y, x + 72, y + 36)), "Polygon")


def suppliers(spark, sf) -> FeatureFrame:
    return points(spark, sf, "supplier", "s_suppkey")


def customers(spark, sf) -> FeatureFrame:
    return points(spark, sf, "customer", "c_custkey")


def parts(spark, sf) -> FeatureFrame:
    return points(spark, sf, "part", "p_partkey")


def embedded(spark, sf) -> FeatureFrame:
    """Irregular points: the first two components of the embeddings."""
    df = table(spark, sf, "embeddings")
    e = F.col("embedding")
    return FeatureFrame(df.select("vec_id", "label", F.col("vec_id").alias(FID), G.point(F.get(e, 0).cast("double"), F.get(e, 1).cast("double")).alias(GEOM)), "Point")


def globe(spark, sf) -> FeatureFrame:
    """Irregular points all over the globe: the directions of the first three components of the embeddings."""
    df = table(spark, sf, "embeddings")
    e = [F.get("embedding", k).cast("double") for k in range(3)]
    x, y = F.degrees(F.atan2(e[1], e[0])), F.degrees(F.atan2(e[2], F.sqrt(e[0] * e[0] + e[1] * e[1])))
    return FeatureFrame(df.select("vec_id", "label", F.col("vec_id").alias(FID), G.point(x, y).alias(GEOM)), "Point")


def stars(spark, sf) -> FeatureFrame:
    """Irregular polygons: eight corners around each of the globe's points, as far away as further components say."""
    df = table(spark, sf, "embeddings").select("vec_id", "embedding")
    at = globe(spark, sf)
    rows = at.df.join(df, "vec_id")
    r = [2 + 10 * F.abs(F.get("embedding", k + 4).cast("double")) for k in range(8)]
    ring = [G.vertex(G.x(F.col(GEOM)) + r[k] * math.cos(k * math.pi / 4), G.y(F.col(GEOM)) + r[k] * math.sin(k * math.pi / 4)) for k in range(8)]
    return at.new(rows.withColumn(GEOM, G.polygon(F.array(*ring, ring[0]))).select(*at.df.columns), geometry_type="Polygon")


def events(spark, sf) -> FeatureFrame:
    df = table(spark, sf, "events")
    return FeatureFrame(df.withColumn(FID, F.col("event_id")))


def orders(spark, sf) -> FeatureFrame:
    df = table(spark, sf, "orders")
    return FeatureFrame(df.withColumn(FID, F.col("o_orderkey")))


def _raster(spark, sf, value) -> RasterFrame:
    df = table(spark, sf, "lineitem")
    cells = df.groupBy((F.col("l_partkey") % COLS).cast("int").alias("col"), (F.col("l_suppkey") % ROWS).cast("int").alias("row")).agg(value.alias("value"))
    return RasterFrame(cells.select(F.lit(0).alias("band"), "col", "row", "value"), Grid(COLS, ROWS))


def quantity(spark, sf) -> RasterFrame:
    return _raster(spark, sf, F.sum("l_quantity"))


def discount(spark, sf) -> RasterFrame:
    return _raster(spark, sf, F.round(F.avg(F.col("l_discount") + 0.0), 6))


def zone_raster(spark, sf) -> RasterFrame:
    """4 x 2 blocks of 12 x 12 cells."""
    every = RasterFrame.empty(spark, Grid(COLS, ROWS)).df
    zone = F.floor(F.col("col") / 12) + 4 * F.floor(F.col("row") / 12)
    return RasterFrame(every.withColumn("value", zone.cast("double")), Grid(COLS, ROWS))


#: The same in SQL, as common table expressions.
SQL = {
    "sup": "sup AS (SELECT *, CAST((s_suppkey*37)%360-180 AS DOUBLE)+CAST(0.5 AS DOUBLE) AS x, CAST((s_suppkey*17)%180-90 AS DOUBLE)+CAST(0.5 AS DOUBLE) AS y FROM supplier)",
    "cus": "cus AS (SELECT *, CAST((c_custkey*37)%360-180 AS DOUBLE)+CAST(0.5 AS DOUBLE) AS x, CAST((c_custkey*17)%180-90 AS DOUBLE)+CAST(0.5 AS DOUBLE) AS y FROM customer)",
    "par": "par AS (SELECT *, CAST((p_partkey*37)%360-180 AS DOUBLE)+CAST(0.5 AS DOUBLE) AS x, CAST((p_partkey*17)%180-90 AS DOUBLE)+CAST(0.5 AS DOUBLE) AS y FROM part)",
    "zon": "zon AS (SELECT *, CAST(-180+72*(n_nationkey%5) AS DOUBLE) AS x1, CAST(-90+36*(n_nationkey//5) AS DOUBLE) AS y1, CAST(-180+72*(n_nationkey%5) AS DOUBLE)+72 AS x2, CAST(-90+36*(n_nationkey//5) AS DOUBLE)+36 AS y2 FROM nation)",
    "emb": "emb AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)",
    "glo": "glo AS (SELECT vec_id, label, degrees(atan2(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE))) AS x, degrees(atan2(CAST(embedding[3] AS DOUBLE), sqrt(pow(CAST(embedding[1] AS DOUBLE), 2) + pow(CAST(embedding[2] AS DOUBLE), 2)))) AS y FROM embeddings)",
    "sta": "corners AS (SELECT vec_id, k, x + r * cos(k * pi() / 4) AS x, y + r * sin(k * pi() / 4) AS y FROM (SELECT vec_id, k, x, y, 2 + 10 * abs(CAST(embedding[k + 5] AS DOUBLE)) AS r FROM glo JOIN embeddings USING (vec_id), range(0, 8) t(k))), "
    "sides AS (SELECT a.vec_id, a.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM corners a JOIN corners b ON a.vec_id = b.vec_id AND b.k = (a.k + 1) % 8), "
    "boxes AS (SELECT vec_id, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM corners GROUP BY 1)",
    "qty": f"qty AS (SELECT CAST(l_partkey%{COLS} AS INTEGER) AS col, CAST(l_suppkey%{ROWS} AS INTEGER) AS row, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)",
    "dis": f"dis AS (SELECT CAST(l_partkey%{COLS} AS INTEGER) AS col, CAST(l_suppkey%{ROWS} AS INTEGER) AS row, round(avg(l_discount+0.0), 6) AS value FROM lineitem GROUP BY 1, 2)",
    "grid": f"grid AS (SELECT CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row FROM range({COLS}) a(c), range({ROWS}) b(r))",
}


def cte(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
