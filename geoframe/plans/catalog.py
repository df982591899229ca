"""Named queries over the test tables, one for each operator, each with its SQL. Doubles are rounded, as sums are taken in another order."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoframe.functions import crs, datums
from geoframe.functions import geometry as G
from geoframe.operators import classify, overlay, query, raster, rastervec, spatial, tessellation
from geoframe.operators.table import FeatureFrame, remove_at_end, shared_dir
from geoframe.plans import fixtures as X
from geoframe.plans.fixtures import cte
from geoframe.sources import raster as raster_files
from geoframe.sources import vector
from geoframe.streaming import geofence, ordered
from geoframe.types import FID, GEOM, Grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    """The function under its own name, with SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def quick6(c: str) -> Column:
    """r6 of a column of numbers by the billion: what is not near the middle of two sixth decimals needs no decimal arithmetic to be rounded the same."""
    t = F.col(c) * 1e6
    low = F.floor(t)
    clear = (F.abs(t) < 2.0**40) & (F.abs(t - low - 0.5) > 1e-3)
    return F.when(clear, (low + (t - low > 0.5).cast("long")) / F.lit(1e6)).otherwise(r6(c))


def _cells(r: raster.RasterFrame, digits: int = 6) -> DataFrame:
    return r.df.select("col", "row", (F.round("value", digits) + F.lit(0.0)).alias("value"))


# Tables

@registered("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def select_filter(s, sf):
    return X.customers(s, sf).select("c_acctbal > 5000 and c_mktsegment == 'BUILDING'").df.select("c_custkey", "c_name", "c_acctbal")


@registered("SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0)")
def exclude_filter(s, sf):
    return X.customers(s, sf).exclude("c_acctbal > 0").df.select("c_custkey")


@registered("SELECT p_partkey, round(p_retailprice * 1.2 + p_size, 6) AS gross FROM part")
def compute_expr(s, sf):
    return X.parts(s, sf).compute("gross", "p_retailprice * 1.2 + p_size").df.select("p_partkey", r6("gross").alias("gross"))


@registered("SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS nation_mean FROM customer")
def compute_by_group(s, sf):
    return X.customers(s, sf).compute("nation_mean", "c_acctbal", by="c_nationkey", stat="mean").df.select("c_custkey", r6("nation_mean").alias("nation_mean"))


@registered("SELECT p_partkey, p_name AS label, CAST(NULL AS VARCHAR) AS note, CAST(p_size AS DOUBLE) AS p_size FROM part")
def fields_edit(s, sf):
    return X.parts(s, sf).keep_fields("p_partkey", "p_name", "p_size").rename_field("p_name", "label").add_field("note", 1).convert_field("p_size", "double").df.select("p_partkey", "label", "note", "p_size")


@registered("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NOWHERE'")
def add_feature(s, sf):
    return FeatureFrame(X.table(s, sf, "region").withColumn(FID, F.col("r_regionkey").cast("long"))).add_feature({"r_regionkey": 99, "r_name": "NOWHERE"}).df.select("r_regionkey", "r_name")


@registered("SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5 FROM events")
def moving_window_mean(s, sf):
    return X.events(s, sf).moving_window(5, [("mean5", "value", "mean")]).df.select("event_id", r6("mean5").alias("mean5"))


@registered("SELECT event_id, round(sum(value) OVER w, 6) AS sum3, max(value) OVER w AS max3, first(event_type) OVER w AS first3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def moving_window_grouped(s, sf):
    return X.events(s, sf).moving_window(3, [("sum3", "value", "sum"), ("max3", "value", "max"), ("first3", "event_type", "first")], groupby="user_id").df.select("event_id", r6("sum3").alias("sum3"), "max3", "first3")


@registered("SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS place, c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def sort_limit(s, sf):
    return X.customers(s, sf).sort("c_acctbal", reverse=True).limit(20).df.select(F.col(FID).alias("place"), "c_custkey")


@registered("SELECT c_mktsegment AS value, count(*) AS frequency, round(100.0 * count(*) / (SELECT count(*) FROM customer), 6) AS percent FROM customer GROUP BY 1")
def tab_frequency(s, sf):
    return X.customers(s, sf).tab("c_mktsegment").select("value", "frequency", r6("percent").alias("percent"))


@registered("SELECT 'c_acctbal' AS field, 'float' AS type, count(c_acctbal) AS valid, count(*) - count(c_acctbal) AS missing FROM customer UNION ALL SELECT 'c_name', 'text', count(c_name), count(*) - count(c_name) FROM customer UNION ALL SELECT 'c_nationkey', 'int', count(c_nationkey), count(*) - count(c_nationkey) FROM customer")
def describe_fields(s, sf):
    return X.customers(s, sf).keep_fields("c_acctbal", "c_name", "c_nationkey").describe().select("field", "type", "valid", "missing")


@registered("SELECT 'c_acctbal' AS field, count(c_acctbal) AS obs, min(c_acctbal) AS min, max(c_acctbal) AS max, round(avg(c_acctbal), 6) AS mean FROM customer UNION ALL SELECT 'c_name', 0, NULL, NULL, NULL")
def field_summary(s, sf):
    return X.customers(s, sf).summarystats("c_acctbal", "c_name").select("field", "obs", "min", "max", r6("mean").alias("mean"))


@registered("SELECT DISTINCT p_brand FROM part")
def field_values(s, sf):
    return X.parts(s, sf).field_values("p_brand")


@registered("SELECT c_nationkey, count(c_acctbal) AS n, round(sum(c_acctbal), 4) AS total, min(c_acctbal) AS least, max(c_acctbal) AS most, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY 1")
def aggregate_stats(s, sf):
    out = X.customers(s, sf).aggregate(["c_nationkey"], [("n", "c_acctbal", "count"), ("total", "c_acctbal", "sum"), ("least", "c_acctbal", "min"), ("most", "c_acctbal", "max"), ("mean", "c_acctbal", "mean")])
    return out.df.select("c_nationkey", "n", F.round("total", 4).alias("total"), "least", "most", r6("mean").alias("mean"))


@registered("SELECT c_nationkey, arg_min(c_name, c_custkey) AS first_name, arg_max(c_name, c_custkey) AS last_name FROM customer GROUP BY 1")
def aggregate_first_last(s, sf):
    return X.customers(s, sf).aggregate(["c_nationkey"], [("first_name", "c_name", "first"), ("last_name", "c_name", "last")]).df.select("c_nationkey", "first_name", "last_name")


@registered("SELECT c_nationkey, arg_min(c_mktsegment, (-n, c_mktsegment)) AS usual FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def aggregate_majority(s, sf):
    return X.customers(s, sf).aggregate(["c_nationkey"], [("usual", "c_mktsegment", "majority")]).df.select("c_nationkey", "usual")


@registered("SELECT c_nationkey, arg_min(c_mktsegment, (n, c_mktsegment)) AS rare FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def aggregate_minority(s, sf):
    return X.customers(s, sf).aggregate(["c_nationkey"], [("rare", "c_mktsegment", "minority")]).df.select("c_nationkey", "rare")


@registered("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def aggregate_concat(s, sf):
    return X.zones(s, sf).aggregate(["n_regionkey"], [("names", "n_name", "|concat")]).df.select("n_regionkey", "names")


@registered("SELECT c_nationkey, round(median(c_acctbal), 6) AS median, round(stddev_pop(c_acctbal), 6) AS stdev FROM customer GROUP BY 1")
def aggregate_spread(s, sf):
    return X.customers(s, sf).aggregate(["c_nationkey"], [("median", "c_acctbal", "median"), ("stdev", "c_acctbal", "stdev")]).df.select("c_nationkey", r6("median").alias("median"), r6("stdev").alias("stdev"))


@registered("SELECT nullif(count(CASE WHEN c_acctbal > 9000 THEN 1 END), 0) AS n, max(CASE WHEN c_acctbal > 9000 THEN c_acctbal END) AS most FROM customer GROUP BY c_custkey % 40")
def query_where_in_group(s, sf):
    return query.query(X.customers(s, sf), [("n", None, "count"), ("most", "c_acctbal", "max")], where="c_acctbal > 9000", groupby=F.col("c_custkey") % 40)


@registered("SELECT c_nationkey AS nation, round(sum(c_acctbal), 4) AS total FROM customer WHERE c_nationkey IN (SELECT DISTINCT c_nationkey FROM customer ORDER BY 1 LIMIT 7) GROUP BY 1")
def query_group_limit(s, sf):
    out = query.query(X.customers(s, sf), [("nation", "c_nationkey", "first"), ("total", "c_acctbal", "sum")], groupby="c_nationkey", limit=7)
    return out.select("nation", F.round("total", 4).alias("total"))


@registered("SELECT c_custkey, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal < 100 ORDER BY c_custkey LIMIT 10")
def query_flat(s, sf):
    return query.query(X.customers(s, sf), [("c_custkey", "c_custkey"), ("twice", "c_acctbal * 2")], where="c_acctbal < 100", limit=10)


@registered("SELECT s_suppkey, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey")
def query_product(s, sf):
    both = query.product([("a", X.suppliers(s, sf)), ("b", X.zones(s, sf))])
    return query.query(both, [("s_suppkey", F.col("s_suppkey")), ("n_name", F.col("n_name"))], where=F.col("s_nationkey") == F.col("n_nationkey"))


@registered("SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey")
def join_left(s, sf):
    return X.customers(s, sf).join(X.zones(s, sf).select("n_regionkey < 3"), ("c_nationkey", F.col("n_nationkey"))).df.select("c_custkey", "n_name")


@registered("SELECT c_custkey, n_name FROM customer JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey")
def join_inner(s, sf):
    return X.customers(s, sf).join(X.zones(s, sf).select("n_regionkey < 3"), ("c_nationkey", F.col("n_nationkey")), keepall=False).df.select("c_custkey", "n_name")


@registered("SELECT n_nationkey, n, first_supplier FROM nation LEFT JOIN (SELECT s_nationkey, count(s_suppkey) AS n, arg_min(s_name, s_suppkey) AS first_supplier FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def join_collapse(s, sf):
    out = X.zones(s, sf).join(X.suppliers(s, sf), ("n_nationkey", F.col("s_nationkey")), collapse=True, mapping=[("n", "s_suppkey", "count"), ("first_supplier", "s_name", "first")])
    return out.df.select("n_nationkey", "n", "first_supplier")


@registered("SELECT k, c_custkey, p_partkey FROM (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS k, c_custkey FROM customer) a JOIN (SELECT nullif(p_partkey, 7) AS j, p_partkey FROM part) b ON a.k IS NOT DISTINCT FROM b.j")
def join_nullsafe(s, sf):
    """The key is unique among parts, null in one of them, so each customer has one part at most."""
    a = X.customers(s, sf).compute("k", F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")))
    b = X.parts(s, sf).compute("k", F.nullif(F.col("p_partkey"), F.lit(7)))
    return a.join(b, "k", keepall=False).df.select("k", "c_custkey", "p_partkey")


@registered("SELECT s_suppkey, s_name, s_acctbal, '' AS n_name FROM supplier UNION ALL SELECT NULL, '', NULL, n_name FROM nation")
def merge_union(s, sf):
    return X.suppliers(s, sf).keep_fields("s_suppkey", "s_name", "s_acctbal").merge(X.zones(s, sf).keep_fields("n_name")).df.select("s_suppkey", "s_name", "s_acctbal", "n_name")


@registered(cte("cus") + "SELECT x, y, count(*) AS n, round(sum(c_acctbal), 4) AS total FROM cus GROUP BY 1, 2")
def duplicates_geom(s, sf):
    out = X.customers(s, sf).duplicates(mapping=[("n", None, "count"), ("total", "c_acctbal", "sum")]).df
    return out.select(G.x(F.col(GEOM)).alias("x"), G.y(F.col(GEOM)).alias("y"), "n", F.round("total", 4).alias("total"))


@registered("SELECT c_mktsegment AS part, count(*) AS n FROM customer GROUP BY 1")
def split_unique(s, sf):
    return X.customers(s, sf).split("c_mktsegment").df.groupBy("part").agg(F.count("*").alias("n"))


@registered("SELECT CASE WHEN c_acctbal >= 0 AND c_acctbal < 2500 THEN 0 WHEN c_acctbal >= 2500 AND c_acctbal < 5000 THEN 1 WHEN c_acctbal >= 5000 AND c_acctbal <= 9000 THEN 2 END AS part, count(*) AS n FROM customer WHERE c_acctbal BETWEEN 0 AND 9000 GROUP BY 1")
def split_breaks(s, sf):
    return X.customers(s, sf).split("c_acctbal", [0, 2500, 5000, 9000]).df.groupBy("part").agg(F.count("*").alias("n"))


@registered("WITH e AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer), c AS (SELECT CAST(least(7, floor((c_acctbal - a) / ((b - a) / 8))) AS INTEGER) AS bin, count(*) AS n FROM customer, e GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, round(a + i * ((b - a) / 8), 6) AS lo, coalesce(n, 0) AS n FROM range(8) t(i) CROSS JOIN e LEFT JOIN c ON c.bin = i")
def histogram_bins(s, sf):
    return X.customers(s, sf).histogram("c_acctbal", 8).select("bin", r6("lo").alias("lo"), "n")


# Boxes

@registered(cte("cus") + "SELECT c_custkey FROM cus WHERE x BETWEEN -50 AND 20 AND y BETWEEN 0 AND 40")
def bbox_overlap(s, sf):
    return X.customers(s, sf).quick_overlap((-50, 0, 20, 40)).df.select("c_custkey")


@registered(cte("cus") + "SELECT c_custkey FROM cus WHERE NOT (x BETWEEN -50 AND 20 AND y BETWEEN 0 AND 40)")
def bbox_disjoint(s, sf):
    return X.customers(s, sf).quick_disjoint((-50, 0, 20, 40)).df.select("c_custkey")


@registered(cte("sup") + "SELECT s_suppkey FROM sup ORDER BY sqrt((x-10)*(x-10)+(y-20)*(y-20)), s_suppkey LIMIT 5")
def bbox_nearest(s, sf):
    return X.suppliers(s, sf).quick_nearest(10, 20, 5).df.select("s_suppkey")


@registered(cte("par") + "SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM par")
def dataset_bbox(s, sf):
    return X.parts(s, sf).bbox()


@registered(cte("par") + "SELECT p_partkey, x, y FROM par WHERE x BETWEEN 0 AND 90 AND y BETWEEN -45 AND 45")
def crop_points(s, sf):
    return overlay.crop(X.parts(s, sf), (0, -45, 90, 45)).df.select("p_partkey", G.x(F.col(GEOM)).alias("x"), G.y(F.col(GEOM)).alias("y"))


@registered(cte("zon") + "SELECT n_nationkey, round((least(x2,50)-greatest(x1,-100))*(least(y2,30)-greatest(y1,-50)),6) AS area FROM zon WHERE x2 > -100 AND x1 < 50 AND y2 > -50 AND y1 < 30")
def crop_polygons(s, sf):
    return overlay.crop(X.zones(s, sf), (-100, -50, 50, 30)).df.select("n_nationkey", r6(G.area(F.col(GEOM))).alias("area"))


@registered(cte("par") + ", e AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM par) SELECT CAST(least(4, floor((x-a)/((b-a)/5))) AS INTEGER) AS tile_x, CAST(least(4, floor((y-c)/((d-c)/5))) AS INTEGER) AS tile_y, count(*) AS n FROM par, e GROUP BY 1, 2")
def tiled_points(s, sf):
    return overlay.tiled(X.parts(s, sf)).groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"))


# Spatial select and joins

@registered(cte("cus", "zon") + "SELECT c_custkey FROM cus WHERE EXISTS (SELECT 1 FROM zon z WHERE n_regionkey = 2 AND x > x1 AND x < x2 AND y > y1 AND y < y2)")
def where_within(s, sf):
    return spatial.where(X.customers(s, sf), X.zones(s, sf).select("n_regionkey == 2"), "within").df.select("c_custkey")


@registered(cte("cus", "zon") + "SELECT c_custkey FROM cus WHERE NOT EXISTS (SELECT 1 FROM zon z WHERE n_regionkey = 2 AND x >= x1 AND x <= x2 AND y >= y1 AND y <= y2)")
def where_disjoint(s, sf):
    return spatial.where(X.customers(s, sf), X.zones(s, sf).select("n_regionkey == 2"), "disjoint").df.select("c_custkey")


@registered(cte("sup") + "SELECT s_suppkey FROM sup WHERE s_acctbal >= 0 AND EXISTS (SELECT 1 FROM sup b WHERE b.s_acctbal < 0 AND sqrt((b.x-sup.x)*(b.x-sup.x)+(b.y-sup.y)*(b.y-sup.y)) <= 25)")
def where_distance(s, sf):
    sup = X.suppliers(s, sf)
    return spatial.where(sup.select("s_acctbal >= 0"), sup.select("s_acctbal < 0"), "distance", 25.0).df.select("s_suppkey")


@registered(cte("sup", "zon") + "SELECT n_name, count(*) AS n, round(sum(s_acctbal), 4) AS total, round(avg(s_acctbal), 6) AS mean FROM sup JOIN zon ON x > x1 AND x < x2 AND y > y1 AND y < y2 GROUP BY 1")
def sjoin_within(s, sf):
    joined = spatial.spatial_join(X.suppliers(s, sf), X.zones(s, sf), "within")
    out = joined.aggregate(["n_name"], [("n", None, "count"), ("total", "s_acctbal", "sum"), ("mean", "s_acctbal", "mean")]).df
    return out.select("n_name", "n", F.round("total", 4).alias("total"), r6("mean").alias("mean"))


@registered(cte("sup", "zon") + "SELECT n_nationkey, s_suppkey FROM zon LEFT JOIN sup ON x > x1 AND x < x2 AND y > y1 AND y < y2")
def sjoin_contains_keepall(s, sf):
    return spatial.spatial_join(X.zones(s, sf), X.suppliers(s, sf), "contains", keepall=True).df.select("n_nationkey", "s_suppkey")


@registered(cte("sup", "zon") + "SELECT s_suppkey, n_nationkey FROM sup, zon z WHERE NOT (x >= x1 AND x <= x2 AND y >= y1 AND y <= y2)")
def sjoin_disjoint(s, sf):
    return spatial.spatial_join(X.suppliers(s, sf), X.zones(s, sf), "disjoint").df.select("s_suppkey", "n_nationkey")


@registered(cte("sup", "par") + "SELECT s_suppkey, p_partkey, round(sqrt((sup.x-par.x)*(sup.x-par.x)+(sup.y-par.y)*(sup.y-par.y)), 6) AS distance FROM sup JOIN par ON sqrt((sup.x-par.x)*(sup.x-par.x)+(sup.y-par.y)*(sup.y-par.y)) <= 6")
def sjoin_distance_radius(s, sf):
    out = spatial.spatial_join(X.suppliers(s, sf), X.parts(s, sf), "distance", radius=6.0, geodetic=False, distance=True)
    return out.df.select("s_suppkey", "p_partkey", quick6("distance").alias("distance"))


_KNN = "row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), b.vec_id)"


@registered(cte("emb") + f"SELECT vec_id, other FROM (SELECT a.vec_id, b.vec_id AS other, {_KNN} AS r FROM emb a, emb b WHERE a.vec_id % 20 = 0) WHERE r <= 3")
def sjoin_knn(s, sf):
    e = X.embedded(s, sf)
    return spatial.spatial_join(e.select("vec_id % 20 == 0"), e.rename_field("vec_id", "other"), "distance", n=3).df.select("vec_id", "other")


@registered(cte("emb") + f"SELECT vec_id, other FROM (SELECT a.vec_id, b.vec_id AS other, {_KNN} AS r FROM emb a, emb b WHERE a.vec_id % 20 = 0 AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 0.02) WHERE r <= 4")
def sjoin_knn_radius(s, sf):
    e = X.embedded(s, sf)
    return spatial.spatial_join(e.select("vec_id % 20 == 0"), e.rename_field("vec_id", "other"), "distance", radius=0.02, n=4, geodetic=False).df.select("vec_id", "other")


@registered(cte("sup", "zon") + "SELECT s_suppkey, n_nationkey FROM sup JOIN zon ON x > x1 AND x < x2 AND y > y1 AND y < y2 AND s_nationkey % 2 = n_nationkey % 2")
def sjoin_subkey(s, sf):
    return spatial.spatial_join(X.suppliers(s, sf), X.zones(s, sf), "within", subkey=lambda a, b: a("s_nationkey") % 2 == b("n_nationkey") % 2).df.select("s_suppkey", "n_nationkey")


@registered(cte("zon") + ", w AS (SELECT n_nationkey AS k, x1+30 AS x1, y1+10 AS y1, x2+30 AS x2, y2+10 AS y2 FROM zon) SELECT n_nationkey, k, round((least(z.x2,w.x2)-greatest(z.x1,w.x1))*(least(z.y2,w.y2)-greatest(z.y1,w.y1)),6) AS area FROM zon z JOIN w ON z.x1 < w.x2 AND w.x1 < z.x2 AND z.y1 < w.y2 AND w.y1 < z.y2")
def sjoin_clip(s, sf):
    z = X.zones(s, sf)
    moved = z.new(z.df.select(F.col("n_nationkey").alias("k"), FID, G.transform(F.col(GEOM), lambda x, y: x + 30, lambda x, y: y + 10).alias(GEOM)))
    return spatial.spatial_join(z, moved, "intersects", clip="intersection").df.select("n_nationkey", "k", r6(G.area(F.col(GEOM))).alias("area"))


@registered(cte("zon") + "SELECT a.n_nationkey, count(*) AS n FROM zon a JOIN zon b ON a.n_nationkey <> b.n_nationkey AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2 GROUP BY 1")
def sjoin_touches(s, sf):
    z = X.zones(s, sf)
    other = z.new(z.df.select(F.col("n_nationkey").alias("k"), FID, GEOM))
    return spatial.spatial_join(z, other, "touches").aggregate(["n_nationkey"], [("n", None, "count")]).df.select("n_nationkey", "n")


@registered(cte("cus", "zon") + "SELECT n_nationkey, nullif(count(c_custkey), 0) AS n, round(sum(c_acctbal), 4) AS total, max(c_acctbal) AS most FROM zon LEFT JOIN cus ON x > x1 AND x < x2 AND y > y1 AND y < y2 GROUP BY 1")
def spatial_stats(s, sf):
    out = spatial.spatial_stats(X.zones(s, sf), X.customers(s, sf), [("n", "c_custkey", "count"), ("total", "c_acctbal", "sum"), ("most", "c_acctbal", "max")])
    return out.select("n_nationkey", "n", F.round("total", 4).alias("total"), "most")


@registered(cte("cus", "zon") + "SELECT n_nationkey, c_mktsegment, count(*) AS n FROM zon JOIN cus ON x > x1 AND x < x2 AND y > y1 AND y < y2 GROUP BY 1, 2")
def spatial_stats_subkey(s, sf):
    out = spatial.spatial_stats(X.zones(s, sf), X.customers(s, sf), [("n", "c_custkey", "count")], subkey="c_mktsegment", keepall=False)
    return out.select("n_nationkey", "c_mktsegment", "n")


@registered(cte("sup", "cus") + "SELECT s_suppkey, c_custkey, round(sqrt((sup.x-cus.x)*(sup.x-cus.x)+(sup.y-cus.y)*(sup.y-cus.y)), 6) AS len FROM sup JOIN cus ON s_nationkey = c_nationkey")
def connect_lines(s, sf):
    out = spatial.connect(X.suppliers(s, sf), X.customers(s, sf), key=("s_nationkey", "c_nationkey"), greatcircle=False)
    return out.df.select("s_suppkey", "c_custkey", G.segment_length(F.col(GEOM)).alias("len")).withColumn("len", quick6("len"))


@registered(cte("sup") + "SELECT s_suppkey, i, round(degrees(atan2(v, u)), 6) + 0.0 AS lon, round(degrees(atan2(w, sqrt(u*u+v*v))), 6) + 0.0 AS lat FROM (SELECT s_suppkey, i, sin((1-f)*d)/sin(d)*cos(radians(y))*cos(radians(x)) + sin(f*d)/sin(d)*cos(radians(50))*cos(radians(10)) AS u, sin((1-f)*d)/sin(d)*cos(radians(y))*sin(radians(x)) + sin(f*d)/sin(d)*cos(radians(50))*sin(radians(10)) AS v, sin((1-f)*d)/sin(d)*sin(radians(y)) + sin(f*d)/sin(d)*sin(radians(50)) AS w FROM (SELECT s_suppkey, x, y, CAST(i AS INTEGER) AS i, i/10.0 AS f, 2*asin(sqrt(pow(sin((radians(50)-radians(y))/2),2)+cos(radians(y))*cos(radians(50))*pow(sin((radians(10)-radians(x))/2),2))) AS d FROM sup, range(11) t(i)))")
def great_circle(s, sf):
    d = X.suppliers(s, sf).df
    path = G.great_circle(G.x(F.col(GEOM)), G.y(F.col(GEOM)), F.lit(10.0), F.lit(50.0), 11)
    return d.select("s_suppkey", F.posexplode(path).alias("i", "v")).select("s_suppkey", "i", r6("v.x").alias("lon"), r6("v.y").alias("lat"))


@registered(cte("sup", "zon") + "SELECT n_nationkey, round(arg_min(least(greatest(x, x1), x2), (d, s_suppkey)), 6) AS x, round(arg_min(least(greatest(y, y1), y2), (d, s_suppkey)), 6) AS y FROM (SELECT *, sqrt(pow(greatest(x1-x, x-x2, 0), 2) + pow(greatest(y1-y, y-y2, 0), 2)) AS d FROM zon, sup) GROUP BY 1")
def closest_point(s, sf):
    out = spatial.closest_point(X.zones(s, sf), X.suppliers(s, sf))
    return out.df.select("n_nationkey", r6(G.x(F.col(GEOM))).alias("x"), r6(G.y(F.col(GEOM))).alias("y"))


# Geometry

@registered(cte("zon") + "SELECT n_nationkey, x1 AS x, y1 AS y FROM zon UNION ALL SELECT n_nationkey, x2, y1 FROM zon UNION ALL SELECT n_nationkey, x2, y2 FROM zon UNION ALL SELECT n_nationkey, x1, y2 FROM zon UNION ALL SELECT n_nationkey, x1, y1 FROM zon")
def vertex_explode(s, sf):
    return overlay.to_points(X.zones(s, sf), "vertex").df.select("n_nationkey", G.x(F.col(GEOM)).alias("x"), G.y(F.col(GEOM)).alias("y"))


@registered(cte("zon") + "SELECT n_nationkey, round((x2-x1)*(y2-y1), 6) AS area, round(2*(x2-x1)+2*(y2-y1), 6) AS outline FROM zon")
def polygon_area(s, sf):
    return X.zones(s, sf).df.select("n_nationkey", r6(G.area(F.col(GEOM))).alias("area"), r6(G.length(F.col(GEOM))).alias("outline"))


@registered("SELECT user_id, count(*) AS n, round(coalesce(sum(step), 0), 4) AS len FROM (SELECT user_id, sqrt(pow(value - lag(value) OVER w, 2) + pow(event_id % 100 - lag(event_id % 100) OVER w, 2)) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY 1")
def line_length(s, sf):
    e = X.events(s, sf)
    pts = FeatureFrame(e.df.withColumn(GEOM, G.point(F.col("value"), F.col("event_id") % 100)), "Point")
    return overlay.to_lines(pts, "user_id").df.select("user_id", F.size(G.vertices(F.col(GEOM))).cast("long").alias("n"), (F.round(G.length(F.col(GEOM)), 4) + 0.0).alias("len"))


@registered(cte("zon") + "SELECT n_nationkey, round((x1+x2)/2, 6) AS x, round((y1+y2)/2, 6) AS y FROM zon")
def centroid(s, sf):
    return overlay.to_points(X.zones(s, sf)).df.select("n_nationkey", r6(G.x(F.col(GEOM))).alias("x"), r6(G.y(F.col(GEOM))).alias("y"))


@registered(cte("zon") + "SELECT n_regionkey, round(sum((x2-x1)*(y2-y1)), 4) AS area FROM zon GROUP BY 1")
def dissolve_union(s, sf):
    out = X.zones(s, sf).aggregate(["n_regionkey"], [], geometry=overlay.dissolve).df
    return out.select("n_regionkey", F.round(G.area(F.col(GEOM)), 4).alias("area"))


@registered(cte("sup") + "SELECT s_suppkey, round(CAST(3.121445152258052 AS DOUBLE) * 25, 4) AS area FROM sup")
def buffer_points(s, sf):
    out = overlay.buffer(X.suppliers(s, sf), 5.0, resolution=32).df
    return out.select("s_suppkey", F.round(G.area(F.col(GEOM)), 4).alias("area"))


@registered(cte("cus") + "SELECT c_custkey, round(6378137.0 * radians(x), 3) + 0.0 AS x, round(6378137.0 * ln(tan(pi()/4 + radians(y)/2)), 3) + 0.0 AS y FROM cus")
def reproject_mercator(s, sf):
    out = crs.reproject(X.customers(s, sf).df, "EPSG:4326", "EPSG:3857")
    return out.select("c_custkey", (F.round(G.x(F.col(GEOM)), 3) + 0.0).alias("x"), (F.round(G.y(F.col(GEOM)), 3) + 0.0).alias("y"))


def _double(x: float) -> str:
    """A number that SQL takes as a double."""
    return repr(x) if "e" in repr(x) else f"{x!r}e0"


def _places(out: DataFrame) -> DataFrame:
    return out.select("c_custkey", (F.round(G.x(F.col(GEOM)), 3) + 0.0).alias("x"), (F.round(G.y(F.col(GEOM)), 3) + 0.0).alias("y"))


def _robinson_sql(table: str, values: tuple) -> str:
    """The cubic through the four entries around a latitude y."""
    sign = 1.0 if values[0] else -1.0
    whole = [sign * values[1], *values, 2 * values[-1] - values[-2]]
    k = "CAST(least(17, floor(abs(y) / 5)) AS INTEGER)"
    t, v = f"(abs(y) / 5 - {k})", [f"CAST([{', '.join(map(repr, whole))}] AS DOUBLE[])[{k} + {i}]" for i in range(1, 5)]
    return f"(-{v[0]}*{t}*({t}-1)*({t}-2)/6 + {v[1]}*({t}+1)*({t}-1)*({t}-2)/2 - {v[2]}*({t}+1)*{t}*({t}-2)/2 + {v[3]}*({t}+1)*{t}*({t}-1)/6)"


@registered(cte("cus") + f"SELECT c_custkey, round({_double(crs.R * crs.ROBINSON_X)} * {_robinson_sql('l', crs.ROBINSON_LENGTH)} * radians(x), 3) + 0.0 AS x, round({_double(crs.R * crs.ROBINSON_Y)} * sign(y) * {_robinson_sql('h', crs.ROBINSON_HEIGHT)}, 3) + 0.0 AS y FROM cus")
def reproject_robinson(s, sf):
    return _places(crs.reproject(X.customers(s, sf).df, "EPSG:4326", "robin"))


_SERIES = ", ".join(f"{_double(a)} AS a{j}" for j, a in enumerate(crs._ALPHA, 1))


def _datum_sql(name: str) -> str:
    """CTEs that end in moved(c_custkey, lon, lat): customers' places in a datum of three numbers, on WGS84."""
    (size, inverse), (tx, ty, tz) = datums.ELLIPSOIDS[datums.DATUMS[name][0]], datums.DATUMS[name][1]
    e2 = datums.Ellipsoid(size, inverse).e2
    w = datums.ellipsoid("WGS84")
    b, second = w.a * (1 - w.f), w.e2 / (1 - w.e2)
    turn = lambda t, n: f"{n} AS (SELECT *, atan2(h + {_double(second * b)} * pow({t} / sqrt(1 + {t} * {t}), 3), p - {_double(w.e2 * w.a)} * pow(1 / sqrt(1 + {t} * {t}), 3)) AS {n}_phi FROM"
    return f"""n AS (SELECT c_custkey, radians(x) AS l, radians(y) AS f, {_double(size)} / sqrt(1 - {_double(e2)} * pow(sin(radians(y)), 2)) AS n FROM cus),
space AS (SELECT c_custkey, n * cos(f) * cos(l) + {_double(tx)} AS x, n * cos(f) * sin(l) + {_double(ty)} AS y, n * {_double(1 - e2)} * sin(f) + {_double(tz)} AS h FROM n),
axis AS (SELECT *, sqrt(x * x + y * y) AS p, h * {_double(w.a)} / (sqrt(x * x + y * y) * {_double(b)}) AS t FROM space),
{turn("t", "one")} axis), flat AS (SELECT * EXCLUDE (t), {_double(1 - w.f)} * tan(one_phi) AS t FROM one),
{turn("t", "two")} flat), moved AS (SELECT c_custkey, degrees(atan2(y, x)) AS lon, degrees(two_phi) AS lat FROM two)"""


@registered(cte("cus") + ", " + _datum_sql("NAD27") + " SELECT c_custkey, round(lon, 7) + 0.0 AS x, round(lat, 7) + 0.0 AS y FROM moved")
def reproject_datum(s, sf):
    """Customers' places as if in NAD27, on WGS84."""
    out = crs.reproject(X.customers(s, sf).df, "EPSG:4267", "EPSG:4326")
    return out.select("c_custkey", F.round(G.x(F.col(GEOM)), 7).alias("x"), F.round(G.y(F.col(GEOM)), 7).alias("y"))


_LAEA = crs.projection("EPSG:3035")
_WHOLE, _SIN, _COS, _BENT = crs._middle(_LAEA)
_E = _double(_LAEA.body.e)


@registered(cte("cus") + f", q AS (SELECT c_custkey, radians(x / 10) AS l, {_double(1 - _LAEA.body.e2)} * (sin(f) / (1 - {_E} * {_E} * sin(f) * sin(f)) + atanh({_E} * sin(f)) / {_E}) / {_double(_WHOLE)} AS b FROM (SELECT c_custkey, x, radians(y) AS f FROM cus)), k AS (SELECT *, {_double(_LAEA.a * math.sqrt(_WHOLE / 2))} * sqrt(2 / (1 + {_double(_SIN)} * b + {_double(_COS)} * sqrt(1 - b * b) * cos(l))) AS r FROM q) SELECT c_custkey, round(4321000 + r * {_double(_BENT)} * sqrt(1 - b * b) * sin(l), 3) + 0.0 AS x, round(3210000 + r / {_double(_BENT)} * ({_double(_COS)} * b - {_double(_SIN)} * sqrt(1 - b * b) * cos(l)), 3) + 0.0 AS y FROM k")
def reproject_wkt(s, sf):
    """Customers, drawn together in longitude around 10 degrees, in the system that a well-known text describes."""
    f = X.customers(s, sf)
    drawn = f.df.withColumn(GEOM, G.transform(F.col(GEOM), lambda x, y: x / 10 + 10, lambda x, y: y))
    return _places(crs.reproject(drawn, "EPSG:4326", crs.to_wkt("EPSG:3035")))


@registered(cte("cus") + f", p AS (SELECT c_custkey, radians(x / 60) AS l, radians(y) AS f, {_SERIES} FROM cus), t AS (SELECT *, sinh(atanh(sin(f)) - {_double(crs.E)} * atanh({_double(crs.E)} * sin(f))) AS t FROM p), u AS (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM t) SELECT c_custkey, round(500000 + 0.9996 * {_double(crs._RECTIFYING)} * (eta + a1*cos(2*xi)*sinh(2*eta) + a2*cos(4*xi)*sinh(4*eta) + a3*cos(6*xi)*sinh(6*eta)), 3) + 0.0 AS x, round(0.9996 * {_double(crs._RECTIFYING)} * (xi + a1*sin(2*xi)*cosh(2*eta) + a2*sin(4*xi)*cosh(4*eta) + a3*sin(6*xi)*cosh(6*eta)), 3) + 0.0 AS y FROM u")
def reproject_utm(s, sf):
    """All customers, drawn together into three degrees on either side of the zone's middle."""
    c = X.customers(s, sf)
    drawn = c.df.withColumn(GEOM, G.transform(F.col(GEOM), lambda x, y: x / 60 + 15, lambda x, y: y))
    return _places(crs.reproject(drawn, "EPSG:4326", "EPSG:32633"))


# Classification

def _broken(s, df: DataFrame, value: Column, algorithm: str, **more) -> DataFrame:
    edges = classify.breaks(df, value, algorithm, **more)
    return s.createDataFrame([(i, float(b)) for i, b in enumerate(edges)], "i int, edge double").select("i", r6("edge").alias("edge"))


@registered("SELECT CAST(i AS INTEGER) AS i, round(CASE WHEN i = 5 THEN b ELSE a + i * (b - a) / 5 END, 6) AS edge FROM range(6) t(i), (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer)")
def breaks_equal(s, sf):
    return _broken(s, X.table(s, sf, "customer"), F.col("c_acctbal"), "equal")


@registered("SELECT CAST(i AS INTEGER) AS i, round(pow(10, a + i * (b - a) / 5) - 1, 6) AS edge FROM range(6) t(i), (SELECT log10(min(p_retailprice) + 1) AS a, log10(max(p_retailprice) + 1) AS b FROM part)")
def breaks_log(s, sf):
    return _broken(s, X.table(s, sf, "part"), F.col("p_retailprice"), "log")


@registered("WITH v AS (SELECT list(c_acctbal ORDER BY c_acctbal) AS v, count(*) AS n FROM customer) SELECT CAST(i AS INTEGER) AS i, round(CASE WHEN i = 5 THEN v[n] ELSE (1 - (i/5.0*n - floor(i/5.0*n))) * v[CAST(floor(i/5.0*n) AS INTEGER) + 1] + (i/5.0*n - floor(i/5.0*n)) * v[CAST(floor(i/5.0*n) AS INTEGER) + 2] END, 6) AS edge FROM range(6) t(i), v")
def breaks_quantile(s, sf):
    return _broken(s, X.table(s, sf, "customer"), F.col("c_acctbal"), "quantile")


#: Round steps that cover (a, b) in about five classes, as multiples i of step.
_ROUND = "w AS (SELECT *, (b - a) / 5 AS wide, pow(10, floor(log10((b - a) / 5))) AS base FROM r), step AS (SELECT *, base * CASE WHEN wide / base <= 1.4 THEN 1 WHEN wide / base <= 2.8 THEN 2 WHEN wide / base <= 7 THEN 5 ELSE 10 END AS step FROM w), inner_ AS (SELECT r.*, i * step AS z FROM step r, range(-60, 61) k(i) WHERE i * step > a AND i * step < b)"
_EDGES = "SELECT CAST(row_number() OVER (ORDER BY edge) - 1 AS INTEGER) AS i, round(edge, 6) + 0.0 AS edge FROM e"


@registered(f"WITH r AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS d, min(c_acctbal) AS lo, max(c_acctbal) AS hi, (min(c_acctbal) - avg(c_acctbal)) / stddev_pop(c_acctbal) AS a, (max(c_acctbal) - avg(c_acctbal)) / stddev_pop(c_acctbal) AS b FROM customer), {_ROUND}, e AS (SELECT lo AS edge FROM r UNION ALL SELECT hi FROM r UNION ALL SELECT z * d + m FROM inner_) {_EDGES}")
def breaks_stdev(s, sf):
    return _broken(s, X.table(s, sf, "customer"), F.col("c_acctbal"), "stdev")


@registered(f"WITH r AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer), {_ROUND}, e AS (SELECT a AS edge FROM r UNION ALL SELECT b FROM r UNION ALL SELECT z FROM inner_) {_EDGES}")
def breaks_pretty(s, sf):
    return _broken(s, X.table(s, sf, "customer"), F.col("c_acctbal"), "pretty")


#: Best division of the first j distinct values into k classes, by trying every start of the last one.
_BEST = ", ".join(f"d{k} AS (SELECT e.j, min(d.best + {{cost}}) AS best, arg_min(b.j, d.best + {{cost}}) AS upto FROM p e JOIN p b ON b.j < e.j JOIN d{k - 1} d ON d.j = b.j GROUP BY e.j)".format(cost="(e.q - b.q - (e.s - b.s) * (e.s - b.s) / (e.w - b.w))") for k in range(2, 6))


@registered(f"WITH v AS (SELECT c_acctbal AS v, count(*) AS n, row_number() OVER (ORDER BY c_acctbal) AS j FROM customer GROUP BY 1), c AS (SELECT v.*, v - (SELECT avg(c_acctbal) FROM customer) AS x FROM v), p AS MATERIALIZED (SELECT j, v, CAST(sum(n) OVER (ORDER BY j) AS DOUBLE) AS w, sum(n * x) OVER (ORDER BY j) AS s, sum(n * x * x) OVER (ORDER BY j) AS q FROM c), d1 AS (SELECT j, q - s * s / w AS best FROM p), {_BEST}, e5 AS (SELECT max(j) AS j FROM p), e4 AS (SELECT upto AS j FROM d5 JOIN e5 USING (j)), e3 AS (SELECT upto AS j FROM d4 JOIN e4 USING (j)), e2 AS (SELECT upto AS j FROM d3 JOIN e3 USING (j)), e1 AS (SELECT upto AS j FROM d2 JOIN e2 USING (j)), e AS (SELECT min(v) AS edge FROM p UNION ALL SELECT v FROM p JOIN (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4 UNION ALL SELECT * FROM e5) USING (j)) {_EDGES}")
def breaks_natural(s, sf):
    return _broken(s, X.table(s, sf, "customer"), F.col("c_acctbal"), "natural")


@registered("WITH RECURSIVE v AS (SELECT l_quantity * l_quantity * l_extendedprice AS v FROM lineitem), h(k, m) AS (SELECT 0, CAST('-infinity' AS DOUBLE) UNION ALL SELECT k + 1, m2 FROM h, LATERAL (SELECT avg(v) AS m2 FROM v WHERE v >= h.m) a, LATERAL (SELECT count(*) FILTER (v >= m2) AS head, count(*) FILTER (v < m2) AS tail FROM v WHERE v >= h.m) b WHERE tail > head), e AS (SELECT min(v) AS edge FROM v UNION ALL SELECT m FROM h WHERE k > 0 UNION ALL SELECT max(v) FROM v) SELECT CAST(row_number() OVER (ORDER BY edge) - 1 AS INTEGER) AS i, round(edge, 2) AS edge FROM e")
def breaks_headtail(s, sf):
    rows = X.table(s, sf, "lineitem")
    out = _broken(s, rows, F.col("l_quantity") * F.col("l_quantity") * F.col("l_extendedprice"), "headtail")
    return out.select("i", (F.round("edge", 2) + 0.0).alias("edge"))


@registered("SELECT CAST(r.i AS INTEGER) AS range_id, count(p_partkey) AS n FROM (VALUES (0, 1, 20), (1, 10, 30), (2, 30, 50), (3, 90, 99)) r(i, a, b) LEFT JOIN part ON p_size BETWEEN a AND b GROUP BY 1")
def membership(s, sf):
    out = classify.membership(X.table(s, sf, "part"), F.col("p_size"), [(1, 20), (10, 30), (30, 50), (90, 99)])
    return out.groupBy("range_id").agg(F.count("p_partkey").alias("n"))


@registered("SELECT c_custkey, round(10 + 90 * (c_acctbal - a) / (b - a), 6) AS rescaled FROM customer, (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer)")
def rescale(s, sf):
    return classify.rescale(X.table(s, sf, "customer"), F.col("c_acctbal"), 10, 100).select("c_custkey", r6("rescaled").alias("rescaled"))


@registered("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 0 WHEN p_size BETWEEN 10 AND 30 THEN 1 WHEN p_size BETWEEN 30 AND 50 THEN 2 END AS class FROM part")
def find_class(s, sf):
    return X.table(s, sf, "part").select("p_partkey", classify.find_class(F.col("p_size"), [1, 10, 30, 50]).alias("class"))


@registered("SELECT p_partkey, CASE WHEN p_size < 10 THEN 0.0 WHEN p_size < 30 THEN 50.0 ELSE 100.0 END::DOUBLE AS class_value FROM part WHERE p_size BETWEEN 1 AND 50")
def classify_values(s, sf):
    c = classify.Classifier(X.table(s, sf, "part"), F.col("p_size"), [1.0, 10.0, 30.0, 50.0], values=[0.0, 100.0])
    return c.apply().select("p_partkey", "class_value").where("class_value IS NOT NULL")


@registered("SELECT min(v) AS cut FROM (SELECT c_acctbal AS v, cume_dist() OVER (ORDER BY c_acctbal) AS share FROM customer) WHERE share >= 0.9")
def cutoff_percentile(s, sf):
    return X.table(s, sf, "customer").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY c_acctbal)").alias("cut"))


# Rasters: local

def _sql_cells(names: tuple, value: str, source: str) -> str:
    return cte(*names) + f"SELECT col, row, round({value}, 6) + 0.0 AS value FROM {source}"


@registered(_sql_cells(("qty", "dis"), "a.value + b.value", "qty a JOIN dis b USING (col, row)"))
def raster_add(s, sf):
    return _cells(X.quantity(s, sf) + X.discount(s, sf))


@registered(cte("qty", "dis") + "SELECT col, row, round(CASE WHEN a.value > 100 THEN a.value END * CASE WHEN b.value > 0.03 THEN b.value END, 6) + 0.0 AS value FROM qty a JOIN dis b USING (col, row)")
def raster_mask_union(s, sf):
    return _cells(X.quantity(s, sf).recode("val <= 100", None) * X.discount(s, sf).recode("val <= 0.03", None))


@registered(_sql_cells(("qty",), "CAST(CASE WHEN value > 1000 THEN 1 ELSE 0 END AS DOUBLE)", "qty"))
def raster_compare(s, sf):
    return _cells(X.quantity(s, sf) > 1000)


@registered(_sql_cells(("qty",), "CASE WHEN value > 1200 THEN value * 3 + 1 ELSE value END", "qty"))
def raster_compute(s, sf):
    return _cells(X.quantity(s, sf).compute("val * 3 + 1", "val > 1200"))


@registered(_sql_cells(("qty",), "CASE WHEN value < 900 THEN -1 ELSE value END", "qty"))
def raster_recode(s, sf):
    return _cells(X.quantity(s, sf).recode("val < 900", -1.0))


@registered(_sql_cells(("qty", "dis"), "(a.value - 5) * b.value", "qty a JOIN dis b USING (col, row)"))
def raster_mathexpr(s, sf):
    return _cells(raster.mathexpr("(rast1 - 5) * rast2", [X.quantity(s, sf), X.discount(s, sf)]))


@registered(cte("qty") + "SELECT count(*) AS count, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM qty")
def raster_stats(s, sf):
    return X.quantity(s, sf).summarystats("count", "sum", "mean", "min", "max").select("count", F.round("sum", 4).alias("sum"), r6("mean").alias("mean"), "min", "max")


@registered(cte("dis") + "SELECT v[CAST(floor(len(v)/2) AS INTEGER) + 1] AS median FROM (SELECT list_sort(list(DISTINCT round(value, 2))) AS v FROM dis)")
def raster_median_distinct(s, sf):
    return X.discount(s, sf).compute(F.round(F.col("value"), 2)).summarystats("median").select("median")


@registered(cte("qty") + "SELECT arg_min(v, (-n, v)) AS majority, arg_min(v, (n, v)) AS minority FROM (SELECT floor(value/100) AS v, count(*) AS n FROM qty GROUP BY 1)")
def raster_majority(s, sf):
    return X.quantity(s, sf).compute(F.floor(F.col("value") / 100)).summarystats("majority", "minority").select("majority", "minority")


# Rasters: moved cells

@registered(cte("qty") + "SELECT col - 5 AS col, row - 3 AS row, round(value, 6) + 0.0 AS value FROM qty WHERE col BETWEEN 5 AND 20 AND row BETWEEN 3 AND 11")
def raster_crop(s, sf):
    return _cells(X.quantity(s, sf).crop((5, 3, 20, 11)))


@registered(cte("qty") + "SELECT (col + 7) % 48 AS col, (row + 22) % 24 AS row, round(value, 6) + 0.0 AS value FROM qty")
def raster_roll(s, sf):
    return _cells(X.quantity(s, sf).roll(7, -2))


@registered(cte("qty") + "SELECT CAST(col // 10 AS INTEGER) AS tile_x, CAST(row // 10 AS INTEGER) AS tile_y, count(*) AS n, round(sum(value), 4) AS total FROM qty GROUP BY 1, 2")
def raster_tile_stats(s, sf):
    return X.quantity(s, sf).tiled((10, 10)).groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@registered(cte("qty") + "SELECT CAST(col // 4 AS INTEGER) AS col, CAST(row // 4 AS INTEGER) AS row, round(sum(value), 6) + 0.0 AS value FROM qty GROUP BY 1, 2")
def upscale_sum(s, sf):
    return _cells(X.quantity(s, sf).upscale(12, 6, "sum"))


def _shifted(s, sf):
    return X.discount(s, sf).new(X.discount(s, sf).df, Grid(X.COLS, X.ROWS, (1.0, 0.0, 10.0, 0.0, 1.0, 5.0)))


_MOSAIC = cte("qty", "dis", "grid") + ", m AS (SELECT col + 10 AS col, row + 5 AS row, value FROM dis WHERE col + 10 < 48 AND row + 5 < 24) SELECT col, row, round({}, 6) + 0.0 AS value FROM qty FULL JOIN m USING (col, row)"


@registered(_MOSAIC.format("coalesce(m.value, qty.value)"))
def mosaic_last(s, sf):
    return _cells(raster.mosaic([X.quantity(s, sf), _shifted(s, sf)]))


@registered(_MOSAIC.format("coalesce(qty.value, m.value)"))
def mosaic_first(s, sf):
    return _cells(raster.mosaic([X.quantity(s, sf), _shifted(s, sf)], "first"))


@registered(cte("dis") + "SELECT col + 10 AS col, row + 5 AS row, round(value, 6) + 0.0 AS value FROM dis WHERE col + 10 < 48 AND row + 5 < 24")
def align_shift(s, sf):
    return _cells(_shifted(s, sf).align(Grid(X.COLS, X.ROWS)))


@registered(cte("qty") + "SELECT CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row, round(value, 6) + 0.0 AS value FROM range(20) a(c), range(10) b(r) JOIN qty ON qty.col = CAST(floor((c + 0.5) * 2.4) AS INTEGER) AND qty.row = CAST(floor((r + 0.5) * 2.4) AS INTEGER)")
def resample_nearest(s, sf):
    return _cells(X.quantity(s, sf).resample(Grid(20, 10, (2.4, 0.0, 0.0, 0.0, 2.4, 0.0))))


@registered(cte("qty", "grid") + ", z AS (SELECT col, row, coalesce(value, 0) AS v FROM grid LEFT JOIN qty USING (col, row)), t AS (SELECT CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row, (c + 0.5) / 2 - 0.5 AS u, (r + 0.5) / 2 - 0.5 AS v FROM range(96) a(c), range(48) b(r)), w AS (SELECT t.col, t.row, least(47, greatest(0, floor(u) + i)) AS sc, least(23, greatest(0, floor(t.v) + j)) AS sr, (1 - abs(u - floor(u) - i)) * (1 - abs(t.v - floor(t.v) - j)) AS k FROM t, range(2) x(i), range(2) y(j)) SELECT w.col, w.row, round(sum(k * z.v), 4) + 0.0 AS value FROM w JOIN z ON z.col = sc AND z.row = sr GROUP BY 1, 2")
def resample_bilinear(s, sf):
    q = X.quantity(s, sf)
    full = raster.mosaic([raster.RasterFrame.empty(s, q.grid, 1, 0.0), q])
    return _cells(full.resample(Grid(96, 48, (0.5, 0.0, 0.0, 0.0, 0.5, 0.0)), "bilinear"), 4)


@registered(cte("qty") + "SELECT CAST(t AS DOUBLE) AS at, col, row, round(CASE WHEN t = 0 THEN value ELSE value + (value * 2 - value) * (t / 10.0) END, 6) + 0.0 AS value FROM qty, (VALUES (0), (3), (7)) v(t)")
def sequence_lerp(s, sf):
    q = X.quantity(s, sf)
    return raster.sequence([0, 3, 7], [(0, q), (10, q * 2)]).select("at", "col", "row", r6("value").alias("value"))


@registered(cte("qty") + "SELECT CAST(col // 12 + 4 * (row // 12) AS DOUBLE) AS zone, round(avg(value), 6) AS value FROM qty GROUP BY 1")
def zonal_mean(s, sf):
    return raster.zonal_statistics(X.zone_raster(s, sf), X.quantity(s, sf)).select("zone", r6("value").alias("value"))


@registered(cte("qty") + "SELECT CAST(col // 12 + 4 * (row // 12) AS DOUBLE) AS zone, round(stddev_pop(value), 6) AS value FROM qty GROUP BY 1")
def zonal_stdev(s, sf):
    return raster.zonal_statistics(X.zone_raster(s, sf), X.quantity(s, sf), "stdev").select("zone", r6("value").alias("value"))


@registered(cte("qty") + "SELECT col, row, round(255 * (value - a) / (b - a), 6) + 0.0 AS value FROM qty, (SELECT min(value) AS a, max(value) AS b FROM qty)")
def raster_normalise(s, sf):
    return _cells(raster.normalise(X.quantity(s, sf)))


# Rasters and features

WORLD = Grid.of_bbox((-180, 90, 180, -90), 36, 18)


def _at(x: str, y: str) -> str:
    return f"CAST(floor(({x} + 180) / 10) AS INTEGER) AS col, CAST(floor((90 - {y}) / 10) AS INTEGER) AS row"


_WORLD = "world AS (SELECT CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row FROM range(36) a(c), range(18) b(r))"


@registered(cte("cus") + f", {_WORLD}, p AS (SELECT {_at('x', 'y')}, c_acctbal FROM cus) SELECT col, row, CAST(nullif(count(c_acctbal), 0) AS DOUBLE) AS value FROM world LEFT JOIN p USING (col, row) GROUP BY 1, 2")
def rasterize_count(s, sf):
    return _cells(rastervec.rasterize(X.customers(s, sf), WORLD, "c_acctbal", "count"))


@registered(cte("sup", "zon") + f", {_WORLD} SELECT col, row, CAST(sum(n_nationkey + 1) AS DOUBLE) AS value FROM world JOIN (SELECT *, x1 + 14 AS a, x2 + 14 AS b, y1 + 14 AS c, y2 + 14 AS d FROM zon UNION ALL SELECT *, x1 AS a, x2 AS b, y1 AS c, y2 AS d FROM zon) z ON -175 + 10 * col > a AND -175 + 10 * col < b AND 85 - 10 * row > c AND 85 - 10 * row < d GROUP BY 1, 2")
def rasterize_sum(s, sf):
    z = X.zones(s, sf)
    moved = z.new(z.df.withColumn(GEOM, G.transform(F.col(GEOM), lambda x, y: x + 14, lambda x, y: y + 14)))
    return _cells(rastervec.rasterize(z.new(z.df.unionByName(moved.df)), WORLD, F.col("n_nationkey") + 1, "sum"))


@registered(cte("zon") + f", {_WORLD} SELECT col, row, CAST(CASE WHEN EXISTS (SELECT 1 FROM zon WHERE n_regionkey = 1 AND -175 + 10 * col > x1 AND -175 + 10 * col < x2 AND 85 - 10 * row > y1 AND 85 - 10 * row < y2) THEN 1 ELSE 0 END AS DOUBLE) AS value FROM world")
def rasterize_presence(s, sf):
    return _cells(rastervec.rasterize(X.zones(s, sf).select("n_regionkey == 1"), WORLD))


@registered(cte("qty") + "SELECT col, row, CAST(col AS DOUBLE) AS x, CAST(row AS DOUBLE) AS y, value, CAST(1 AS DOUBLE) AS area FROM qty")
def vectorize_cells(s, sf):
    out = rastervec.vectorize(X.quantity(s, sf)).df
    return out.select("col", "row", "x", "y", "value", r6(G.area(F.col(GEOM))).alias("area"))


@registered("SELECT CAST(i AS DOUBLE) AS value, CAST(144 AS BIGINT) AS n_cells, CAST(144 AS DOUBLE) AS area FROM range(8) t(i)")
def vectorize_merged(s, sf):
    out = rastervec.vectorize(X.zone_raster(s, sf), merge=True).df
    return out.select("value", "n_cells", r6(G.area(F.col(GEOM))).alias("area"))


@registered(cte("sup") + f", {_WORLD}, k AS (SELECT {_at('x', 'y').replace(' AS col', ' AS pc').replace(' AS row', ' AS pr')}, avg(s_acctbal) AS known FROM sup GROUP BY 1, 2) SELECT col, row, round(coalesce(max(CASE WHEN pc = col AND pr = row THEN known END), sum(CASE WHEN pc <> col OR pr <> row THEN pow((col-pc)*(col-pc)+(row-pr)*(row-pr), -1.5) * known END) / sum(CASE WHEN pc <> col OR pr <> row THEN pow((col-pc)*(col-pc)+(row-pr)*(row-pr), -1.5) END)), 4) + 0.0 AS value FROM world, k GROUP BY 1, 2")
def idw(s, sf):
    return _cells(rastervec.interpolate(X.suppliers(s, sf), WORLD, "s_acctbal"), 4)


_RADIAL = cte("sup") + f", {_WORLD}, m AS (SELECT col, row, {{}} * (1 - sqrt(pow(-180 + 10 * col - x, 2) + pow(90 - 10 * row - y, 2)) / 25) AS part FROM world JOIN sup ON sqrt(pow(-180 + 10 * col - x, 2) + pow(90 - 10 * row - y, 2)) <= 25) SELECT col, row, round(sum(part), 4) + 0.0 AS value FROM world LEFT JOIN m USING (col, row) GROUP BY 1, 2"


@registered(_RADIAL.format("s_acctbal"))
def smooth_radial(s, sf):
    return _cells(rastervec.smooth(X.suppliers(s, sf), WORLD, 25.0, "s_acctbal"), 4)


@registered(_RADIAL.format("1"))
def density(s, sf):
    return _cells(rastervec.density(X.suppliers(s, sf), WORLD, 25.0), 4)


@registered(cte("sup") + f", {_WORLD}, z AS (SELECT col, row, count(s_suppkey) AS v FROM world LEFT JOIN (SELECT s_suppkey, {_at('x', 'y')} FROM sup) USING (col, row) GROUP BY 1, 2), k AS (SELECT i, j, exp(-(i*i+j*j) / 2.0) AS w FROM range(-3, 4) a(i), range(-3, 4) b(j)), n AS (SELECT t.col, t.row, least(35, greatest(0, t.col + i)) AS sc, least(17, greatest(0, t.row + j)) AS sr, w FROM world t, k) SELECT n.col, n.row, round(sum(w * v) / (SELECT sum(w) FROM k), 6) + 0.0 AS value FROM n JOIN z ON z.col = sc AND z.row = sr GROUP BY 1, 2")
def smooth_gauss(s, sf):
    counts = rastervec.rasterize(X.suppliers(s, sf), WORLD, "s_suppkey", "count")
    return _cells(counts.gauss(1.0))


@registered(cte("zon") + f", {_WORLD}, m AS (SELECT n_nationkey, col, row, n_nationkey + 10.0 AS v FROM zon JOIN world ON -175 + 10 * col > x1 AND -175 + 10 * col < x2 AND 85 - 10 * row > y1 AND 85 - 10 * row < y2) SELECT col, row, round(sum(v / n), 6) + 0.0 AS value FROM world LEFT JOIN (SELECT m.*, count(*) OVER (PARTITION BY n_nationkey) AS n FROM m) USING (col, row) GROUP BY 1, 2")
def disperse(s, sf):
    return _cells(rastervec.disperse(X.zones(s, sf), WORLD, F.col("n_nationkey") + 10.0))


@registered(cte("sup") + f", {_WORLD}, o AS (SELECT DISTINCT {_at('x', 'y').replace(' AS col', ' AS pc').replace(' AS row', ' AS pr')} FROM sup) SELECT col, row, round(min(sqrt(pow((col - pc) * 10, 2) + pow((row - pr) * 10, 2))), 6) + 0.0 AS value FROM world, o GROUP BY 1, 2")
def distance_raster(s, sf):
    return _cells(rastervec.distance(X.suppliers(s, sf), WORLD))


@registered(cte("zon") + f", {_WORLD}, z AS (SELECT col, row, EXISTS (SELECT 1 FROM zon WHERE n_regionkey = 2 AND -175 + 10 * col > x1 AND -175 + 10 * col < x2 AND 85 - 10 * row > y1 AND 85 - 10 * row < y2) AS s FROM world) SELECT a.col, a.row, CAST(CASE WHEN a.s AND (SELECT count(*) FROM z b WHERE b.s AND abs(a.col - b.col) <= 1 AND abs(a.row - b.row) <= 1) < 9 THEN 1 ELSE 0 END AS DOUBLE) AS value FROM z a")
def morphology_edge(s, sf):
    on = rastervec.rasterize(X.zones(s, sf).select("n_regionkey == 2"), WORLD)
    return _cells(on.morphology("val == 1", "edge"))


@registered(cte("zon") + f", {_WORLD} SELECT col, row, CASE WHEN EXISTS (SELECT 1 FROM zon WHERE n_regionkey = 2 AND -175 + 10 * col > x1 AND -175 + 10 * col < x2 AND 85 - 10 * row > y1 AND 85 - 10 * row < y2) THEN CAST(col + row AS DOUBLE) END AS value FROM world")
def clip_raster(s, sf):
    every = raster.RasterFrame.empty(s, WORLD)
    numbered = every.new(every.df.withColumn("value", F.col("col") + F.col("row")))
    return _cells(rastervec.clip(numbered, X.zones(s, sf).select("n_regionkey == 2")))


@registered(cte("zon") + f", {_WORLD} SELECT n_nationkey, count(*) AS n, round(avg(col + row), 6) AS mean FROM zon JOIN world ON -175 + 10 * col > x1 AND -175 + 10 * col < x2 AND 85 - 10 * row > y1 AND 85 - 10 * row < y2 GROUP BY 1")
def raster_in_vector(s, sf):
    every = raster.RasterFrame.empty(s, WORLD)
    out = spatial.raster_stats(X.zones(s, sf), every.df.withColumn("value", (F.col("col") + F.col("row")).cast("double")), WORLD, [("n", "value", "count"), ("mean", "value", "mean")])
    return out.select("n_nationkey", "n", r6("mean").alias("mean"))


_MERCATOR_TOP = crs.R * math.log(math.tan(math.pi / 4 + math.radians(81) / 2))


@registered(cte("cus") + f", {_WORLD}, v AS (SELECT {_at('x', 'y')}, count(*) AS n FROM cus GROUP BY 1, 2), g AS (SELECT col, row, degrees(2 * atan(exp(({_double(_MERCATOR_TOP)} - (row + 0.5) * {_double(_MERCATOR_TOP)} / 9) / {_double(crs.R)})) - pi() / 2) AS lat FROM world) SELECT g.col, g.row, CAST(n AS DOUBLE) AS value FROM g JOIN v ON v.col = g.col AND v.row = CAST(floor((90 - lat) / 10) AS INTEGER)")
def raster_reproject(s, sf):
    """Customers counted in the cells of a world raster, which goes from degrees to web Mercator."""
    counts = rastervec.rasterize(X.customers(s, sf), WORLD, "c_custkey", "count")
    return _cells(counts.reproject("EPSG:3857")).where("value IS NOT NULL")


# More of predicates, overlays and conversions

def _lines(s, sf) -> FeatureFrame:
    """A level line of 80 degrees from each supplier eastwards."""
    f = X.suppliers(s, sf)
    x, y = G.x(F.col(GEOM)), G.y(F.col(GEOM))
    return f.new(f.df.withColumn(GEOM, G.line(F.array(G.vertex(x, y), G.vertex(x + 80, y)))), geometry_type="LineString")


@registered(cte("sup", "zon") + "SELECT s_suppkey, n_nationkey FROM sup JOIN zon ON y > y1 AND y < y2 AND x < x2 AND x + 80 > x1")
def sjoin_crosses(s, sf):
    return spatial.spatial_join(_lines(s, sf), X.zones(s, sf), "crosses").df.select("s_suppkey", "n_nationkey")


@registered(cte("sup", "zon") + "SELECT n_nationkey, s_suppkey FROM zon JOIN sup ON x >= x1 AND x <= x2 AND y >= y1 AND y <= y2")
def sjoin_covers(s, sf):
    return spatial.spatial_join(X.zones(s, sf), X.suppliers(s, sf), "covers").df.select("n_nationkey", "s_suppkey")


@registered("SELECT n_nationkey, n_nationkey AS k FROM nation")
def sjoin_equals(s, sf):
    z = X.zones(s, sf)
    return spatial.spatial_join(z, z.new(z.df.select(F.col("n_nationkey").alias("k"), FID, GEOM)), "equals").df.select("n_nationkey", "k")


def _km_sql(pairs: str, where: str = "true") -> str:
    """CTEs that end in km(a, b, km): the ellipsoid's distances, by Vincenty's iteration, of pairs(a, b, x1, y1, x2, y2), which are to be less than half round."""
    f = 1 / 298.257223563
    return f"""pairs AS ({pairs}),
vin(a, b, l, u1, u2, lam, k) AS (SELECT a, b, radians(x2 - x1), atan((1 - {_double(f)}) * tan(radians(y1))), atan((1 - {_double(f)}) * tan(radians(y2))), radians(x2 - x1), 0 FROM pairs
  UNION ALL
  SELECT a, b, l, u1, u2, l + (1 - c) * {_double(f)} * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1))), k + 1
  FROM (SELECT *, {_double(f)} / 16 * c2a * (4 + {_double(f)} * (4 - 3 * c2a)) AS c FROM (SELECT *, CASE WHEN c2a > 0 THEN cs - 2 * sin(u1) * sin(u2) / c2a ELSE 0 END AS c2m FROM (SELECT *, 1 - sa * sa AS c2a FROM (SELECT *, atan2(ss, cs) AS sigma, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0 END AS sa FROM
    (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM vin WHERE k < 20))))) t),
ends AS (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM vin WHERE k = 20),
bent AS (SELECT *, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0 END AS sa FROM ends),
curved AS (SELECT *, (1 - sa * sa) * (pow(6378137.0, 2) - pow(6356752.314245, 2)) / pow(6356752.314245, 2) AS u, CASE WHEN 1 - sa * sa > 0 THEN cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) ELSE 0 END AS c2m FROM bent),
sized AS (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS g, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS h FROM curved),
km AS (SELECT a, b, round(6356752.314245 * g * (atan2(ss, cs) - h * ss * (c2m + h / 4 * (cs * (2 * c2m * c2m - 1) - h / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))) / 1000, 6) AS km FROM sized WHERE {where})"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


#: Whether two points are within some km of each other on a sphere: a little more than needed.
_AROUND = "6400 * 2 * asin(least(1, sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))))"
_GLOBE = X.SQL["glo"]


@registered(_recursive(cte("sup") + ", " + _km_sql(f"SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM sup a JOIN sup b ON {_AROUND} <= 1720") + ", near AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY km, b) AS r FROM km WHERE km <= 1700) SELECT a AS s_suppkey, b AS other, round(km, 3) AS km FROM near WHERE r <= 3"))
def sjoin_km_first(s, sf):
    """At most three suppliers within 1,700 km of each, the nearest by km, all over the globe."""
    a = X.suppliers(s, sf)
    out = spatial.spatial_join(a, a.rename_field("s_suppkey", "other"), "distance", radius=1700.0, n=3, distance=True)
    return out.df.select("s_suppkey", "other", F.round("distance", 3).alias("km"))


@registered(_recursive(f"WITH {_GLOBE}, " + _km_sql("SELECT a.vec_id AS a, b.vec_id AS b, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM glo a JOIN glo b ON " + f"{_AROUND} <= 305") + " SELECT a AS vec_id, b AS other, round(km, 3) AS km FROM km WHERE km <= 300"))
def sjoin_km(s, sf):
    """All pairs of irregular points, whose places are directions of vectors, within 300 km of each other."""
    g = X.globe(s, sf)
    out = spatial.spatial_join(g, g.rename_field("vec_id", "other"), "distance", radius=300.0, distance=True)
    return out.df.select("vec_id", "other", F.round("distance", 3).alias("km"))


@registered(_recursive(f"WITH {_GLOBE}, " + _km_sql("SELECT a.vec_id AS a, b.vec_id AS b, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM glo a JOIN glo b ON a.vec_id % 20 = 0 AND " + f"{_AROUND} <= 15000") + ", near AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY km, b) AS r FROM km) SELECT a AS vec_id, b AS other, round(km, 3) AS km FROM near WHERE r <= 5"))
def sjoin_km_nearest(s, sf):
    """The five nearest by km, without a radius."""
    g = X.globe(s, sf)
    out = spatial.spatial_join(g.select("vec_id % 20 == 0"), g.rename_field("vec_id", "other"), "distance", n=5, geodetic=True, distance=True)
    return out.df.select("vec_id", "other", F.round("distance", 3).alias("km"))


def _turn(a: str, b: str, c: str, d: str, e: str, f: str) -> str:
    return f"(({c} - {a}) * ({f} - {b}) - ({d} - {b}) * ({e} - {a}))"


_IN = "(SELECT count(*) FROM sides s WHERE s.vec_id = {0} AND (s.y1 > v.y) <> (s.y2 > v.y) AND v.x < (s.x2 - s.x1) * (v.y - s.y1) / (s.y2 - s.y1) + s.x1) % 2 = 1"


@registered(cte("glo", "sta") + f""", near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM boxes a JOIN boxes b ON a.x1 <= b.x2 AND a.x2 >= b.x1 AND a.y1 <= b.y2 AND a.y2 >= b.y1),
cross_ AS (SELECT DISTINCT a, b FROM near JOIN sides s ON s.vec_id = a JOIN sides t ON t.vec_id = b
  WHERE {_turn("s.x1", "s.y1", "s.x2", "s.y2", "t.x1", "t.y1")} * {_turn("s.x1", "s.y1", "s.x2", "s.y2", "t.x2", "t.y2")} <= 0
    AND {_turn("t.x1", "t.y1", "t.x2", "t.y2", "s.x1", "s.y1")} * {_turn("t.x1", "t.y1", "t.x2", "t.y2", "s.x2", "s.y2")} <= 0 AND s.x1 + s.x2 + t.x1 + t.x2 IS NOT NULL),
inner_ AS (SELECT a, b FROM near JOIN corners v ON v.vec_id = a AND v.k = 0 WHERE {_IN.format("b")} UNION SELECT a, b FROM near JOIN corners v ON v.vec_id = b AND v.k = 0 WHERE {_IN.format("a")})
SELECT a AS vec_id, b AS other FROM cross_ UNION SELECT a, b FROM inner_""")
def sjoin_stars(s, sf):
    """Irregular polygons that share a point with one another."""
    f = X.stars(s, sf)
    return spatial.spatial_join(f, f.rename_field("vec_id", "other"), "intersects").df.select("vec_id", "other")


@registered(cte("glo", "sta") + """, parts AS (SELECT s.vec_id, abs(sum(s.x1 * s.y2 - s.x2 * s.y1)) / 2 AS area, sum(sqrt(pow(s.x2 - s.x1, 2) + pow(s.y2 - s.y1, 2))) AS len FROM sides s GROUP BY 1)
SELECT vec_id, round(area, 6) AS area, round(len, 6) AS len FROM parts""")
def star_measures(s, sf):
    f = X.stars(s, sf)
    return f.df.select("vec_id", r6(G.area(F.col(GEOM))).alias("area"), r6(G.length(F.col(GEOM))).alias("len"))


@registered(cte("sup") + "SELECT s_suppkey, CAST(2 AS BIGINT) AS parts FROM sup")
def clip_union_points(s, sf):
    """Each supplier and the place 3 degrees north of it, as one geometry."""
    a = X.suppliers(s, sf)
    north = a.new(a.df.select(F.col("s_suppkey").alias("k"), FID, G.transform(F.col(GEOM), lambda x, y: x, lambda x, y: y + 3).alias(GEOM)))
    out = spatial.spatial_join(a, north, "distance", radius=3.5, geodetic=False, clip="union", subkey=lambda l, r: l("s_suppkey") == r("k"))
    return out.df.select("s_suppkey", F.size(f"{GEOM}.parts").cast("long").alias("parts"))


def _moved(z: FeatureFrame, dx: float, dy: float) -> DataFrame:
    return z.df.withColumn(GEOM, G.transform(F.col(GEOM), lambda x, y: x + dx, lambda x, y: y + dy)).withColumn(FID, F.col(FID) + 1000)


def _both(s, sf) -> FeatureFrame:
    z = X.zones(s, sf)
    return z.new(z.df.unionByName(_moved(z, 20, 10)))


@registered(cte("zon") + "SELECT n_nationkey, round((x2-x1-20)*(y2-y1-10), 6) AS area FROM zon")
def fold_intersection(s, sf):
    out = _both(s, sf).aggregate(["n_nationkey"], [], geometry=overlay.fold("intersection")).df
    return out.select("n_nationkey", r6(G.area(F.col(GEOM))).alias("area"))


@registered(cte("zon") + "SELECT n_nationkey, round((x2-x1)*(y2-y1) - (x2-x1-20)*(y2-y1-10), 6) AS area FROM zon")
def fold_difference(s, sf):
    out = _both(s, sf).aggregate(["n_nationkey"], [], geometry=overlay.fold("difference")).df
    return out.select("n_nationkey", r6(G.area(F.col(GEOM))).alias("area"))


@registered(cte("sup") + "SELECT s_suppkey, round(80 * 4 + CAST(3.121445152258052 AS DOUBLE) * 4, 4) AS area FROM sup")
def buffer_lines(s, sf):
    out = overlay.buffer(_lines(s, sf), 2.0, resolution=32).df
    return out.select("s_suppkey", F.round(G.area(F.col(GEOM)), 4).alias("area"))


@registered(cte("zon") + "SELECT n_nationkey, round((x2-x1)*(y2-y1) + 2*3*((x2-x1)+(y2-y1)) + CAST(3.121445152258052 AS DOUBLE) * 9, 4) AS area FROM zon")
def buffer_polygons(s, sf):
    out = overlay.buffer(X.zones(s, sf), 3.0, resolution=32).df
    return out.select("n_nationkey", F.round(G.area(F.col(GEOM)), 4).alias("area"))


def _shaped(s, sf, ring) -> FeatureFrame:
    """Zones of another outline, made of their boxes' sides."""
    z = X.zones(s, sf)
    b = F.col(f"{GEOM}.bbox")
    v = ring(b["xmin"], b["ymin"], b["xmax"], b["ymax"])
    return z.new(z.df.withColumn(GEOM, G.polygon(F.array(*(G.vertex(x, y) for x, y in [*v, v[0]])))))


def _corner(s, sf) -> FeatureFrame:
    return _shaped(s, sf, lambda a, b, c, d: [(a, b), (c, b), (c, b + 10), (a + 20, b + 10), (a + 20, d), (a, d)])


@registered(cte("zon") + "SELECT n_nationkey, round((x2-x1)*(y2-y1) - (x2-x1-20)*(y2-y1-10)/2, 6) AS area FROM zon")
def convex_hull(s, sf):
    return overlay.convex_hull(_corner(s, sf)).df.select("n_nationkey", r6(G.area(F.col(GEOM))).alias("area"))


@registered(cte("zon") + "SELECT n_nationkey, round((x2-x1)*(y2-y1), 6) AS area, CAST(5 AS BIGINT) AS vertices FROM zon")
def clean_simplified(s, sf):
    """Vertices half-way along the sides say nothing."""
    frame = _shaped(s, sf, lambda a, b, c, d: [(a, b), ((a + c) / 2, b), (c, b), (c, (b + d) / 2), (c, d), ((a + c) / 2, d), (a, d), (a, (b + d) / 2)])
    out = overlay.clean(frame, 0.01).df
    return out.select("n_nationkey", r6(G.area(F.col(GEOM))).alias("area"), F.size(G.vertices(F.col(GEOM))).cast("long").alias("vertices"))


@registered(cte("sup", "zon") + ", v AS (SELECT DISTINCT * FROM (SELECT x1 AS tx, y1 AS ty FROM zon UNION ALL SELECT x1, y2 FROM zon UNION ALL SELECT x2, y1 FROM zon UNION ALL SELECT x2, y2 FROM zon)), n AS (SELECT s_suppkey, arg_min(tx, (sqrt(pow(x-tx, 2) + pow(y-ty, 2)), tx, ty)) AS tx, arg_min(ty, (sqrt(pow(x-tx, 2) + pow(y-ty, 2)), tx, ty)) AS ty FROM sup JOIN v ON sqrt(pow(x-tx, 2) + pow(y-ty, 2)) <= 12 GROUP BY 1) SELECT s_suppkey, coalesce(tx, x) AS x, coalesce(ty, y) AS y FROM sup LEFT JOIN n USING (s_suppkey)")
def snap_points(s, sf):
    return overlay.snap(X.suppliers(s, sf), X.zones(s, sf), 12.0).df.select("s_suppkey", G.x(F.col(GEOM)).alias("x"), G.y(F.col(GEOM)).alias("y"))


@registered(cte("sup") + ", m AS (SELECT s_suppkey, x, unnest([x, x + 80, -180.0, -108.0, -36.0, 36.0, 108.0, 180.0]) AS e FROM sup), k AS (SELECT DISTINCT s_suppkey, e FROM m WHERE e >= x AND e <= x + 80) SELECT s_suppkey, CAST(count(*) - 1 AS BIGINT) AS pieces, CAST(max(e) - min(e) AS DOUBLE) AS len FROM k GROUP BY 1")
def cut_lines(s, sf):
    """Level lines cut along the meridians between the zones."""
    edges = s.createDataFrame([(i, float(x)) for i, x in enumerate((-180, -108, -36, 36, 108, 180))], f"{FID} long, x double")
    cutter = FeatureFrame(edges.select(FID, G.line(F.array(G.vertex(F.col("x"), F.lit(-95.0)), G.vertex(F.col("x"), F.lit(95.0)))).alias(GEOM)), "LineString")
    out = overlay.cut(_lines(s, sf), cutter).df
    return out.groupBy("s_suppkey").agg(F.count("*").alias("pieces"), r6(F.sum(G.length(F.col(GEOM)))).alias("len"))


#: Share of a diamond's area below a share t of its height.
_BELOW = "CASE WHEN t < 0.5 THEN 2 * t * t ELSE 1 - 2 * (1 - t) * (1 - t) END"


@registered(cte("sup", "zon") + f", t AS (SELECT DISTINCT n_nationkey, (x2-x1)*(y2-y1)/2 AS a, unnest([0.0, 1.0, (y-y1)/(y2-y1)]) AS t FROM zon LEFT JOIN sup ON y > y1 AND y < y2), p AS (SELECT n_nationkey, a * (b - lag(b) OVER (PARTITION BY n_nationkey ORDER BY b)) AS area FROM (SELECT n_nationkey, a, {_BELOW} AS b FROM t WHERE t IS NOT NULL)) SELECT n_nationkey, count(*) AS pieces, round(sum(area), 6) + 0.0 AS area, round(max(area), 6) + 0.0 AS largest FROM p WHERE area IS NOT NULL GROUP BY 1")
def cut_polygons(s, sf):
    """Diamonds cut along the parallels of all suppliers."""
    frame = _shaped(s, sf, lambda a, b, c, d: [((a + c) / 2, b), (c, (b + d) / 2), ((a + c) / 2, d), (a, (b + d) / 2)])
    along = X.suppliers(s, sf)
    y = G.y(F.col(GEOM))
    lines = along.new(along.df.withColumn(GEOM, G.line(F.array(G.vertex(F.lit(-181.0), y), G.vertex(F.lit(181.0), y)))), geometry_type="LineString")
    area = G.area(F.col(GEOM))
    return overlay.cut(frame, lines).df.groupBy("n_nationkey").agg(F.count("*").alias("pieces"), r6(F.sum(area)).alias("area"), r6(F.max(area)).alias("largest"))


@registered(cte("qty") + ", c AS (SELECT col, row, col // 12 AS bx, row // 12 AS by FROM qty WHERE floor(value) % 3 <> 0) SELECT CAST(a.bx AS INTEGER) AS bx, CAST(a.by AS INTEGER) AS by, CAST(count(*) AS DOUBLE) AS area, CAST(sum(4 - (SELECT count(*) FROM c b WHERE b.bx = a.bx AND b.by = a.by AND abs(a.col - b.col) + abs(a.row - b.row) = 1)) AS DOUBLE) AS outline FROM c a GROUP BY 1, 2")
def dissolve_cells(s, sf):
    """Cells of a raster as squares, united by blocks in a tree: area and outline of what is left."""
    q = X.quantity(s, sf)
    rows = q.df.where("value IS NOT NULL AND floor(value) % 3 <> 0").select(F.floor(F.col("col") / 12).cast("int").alias("bx"), F.floor(F.col("row") / 12).cast("int").alias("by"), G.box(F.col("col"), F.col("row"), F.col("col") + 1, F.col("row") + 1).alias(GEOM))
    out = overlay.dissolve(rows, ["bx", "by"], most=64)
    return out.select("bx", "by", r6(G.area(F.col(GEOM))).alias("area"), r6(G.length(F.col(GEOM))).alias("outline"))


@registered(cte("zon") + "SELECT n_nationkey, CAST(4 AS BIGINT) AS triangles, round((x2-x1)*(y2-y1), 6) AS area FROM zon")
def delaunay(s, sf):
    """A zone's corners and its middle."""
    z = X.zones(s, sf)
    corners, middles = overlay.to_points(z, "vertex").df, overlay.to_points(z).df
    pts = corners.unionByName(middles).withColumn(FID, F.monotonically_increasing_id())
    out = tessellation.tessellate(FeatureFrame(pts, "Point"), "delaunay", "n_nationkey").df
    return out.groupBy("n_nationkey").agg(F.count("*").alias("triangles"), r6(F.sum(G.area(F.col(GEOM)))).alias("area"))


@registered(cte("emb") + "SELECT a.vec_id, round(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS nearest FROM (SELECT min(vec_id) AS vec_id, x, y FROM emb GROUP BY x, y) a JOIN emb b ON a.x <> b.x OR a.y <> b.y GROUP BY 1")
def delaunay_nearest(s, sf):
    """The shortest side at each point of a diagram of all: it goes to the nearest other point."""
    out = tessellation.tessellate(X.embedded(s, sf), "delaunay").df
    v = lambda i: F.col(f"{GEOM}.parts")[0][0][i % 3]
    end = F.explode(F.array(*(F.struct(v(i)["x"].alias("x"), v(i)["y"].alias("y"), F.least(*(F.hypot(v(i)["x"] - v(i + k)["x"], v(i)["y"] - v(i + k)["y"]) for k in (1, 2))).alias("d")) for i in range(3))))
    least = out.select(end.alias("e")).groupBy(F.col("e.x").alias("x"), F.col("e.y").alias("y")).agg(F.min("e.d").alias("d"))
    points = X.embedded(s, sf).df.select("vec_id", G.x(F.col(GEOM)).alias("x"), G.y(F.col(GEOM)).alias("y"))
    return points.groupBy("x", "y").agg(F.min("vec_id").alias("vec_id")).join(least, ["x", "y"]).select("vec_id", r6("d").alias("nearest"))


@registered(cte("emb") + ", oth AS (SELECT e.vec_id, CAST(embedding[3] AS DOUBLE) AS x, CAST(embedding[4] AS DOUBLE) AS y FROM embeddings e), box AS (SELECT min(x) - (max(x) - min(x)) AS x1, max(x) + (max(x) - min(x)) AS x2, min(y) - (max(y) - min(y)) AS y1, max(y) + (max(y) - min(y)) AS y2 FROM emb) SELECT oth.vec_id, arg_min(emb.vec_id, pow(emb.x - oth.x, 2) + pow(emb.y - oth.y, 2)) AS cell FROM oth JOIN box ON oth.x > x1 AND oth.x < x2 AND oth.y > y1 AND oth.y < y2 CROSS JOIN emb GROUP BY 1")
def voronoi_owner(s, sf):
    """Whose cell each of other irregular points is in: the nearest one's."""
    cells = tessellation.tessellate(X.embedded(s, sf), "voronoi").df.withColumn("cell", F.col(FID))
    e = F.col("embedding")
    others = X.table(s, sf, "embeddings").select("vec_id", F.col("vec_id").alias(FID), G.point(F.get(e, 2).cast("double"), F.get(e, 3).cast("double")).alias(GEOM))
    return spatial.spatial_join(FeatureFrame(others, "Point"), FeatureFrame(cells, "Polygon"), "within").df.select("vec_id", "cell")


@registered("WITH cus AS (SELECT DISTINCT c_nationkey, CAST((c_custkey*37)%360-180 AS DOUBLE)+0.5e0 AS x, CAST((c_custkey*17)%180-90 AS DOUBLE)+0.5e0 AS y FROM customer) SELECT c_nationkey, count(*) AS cells, round(9 * (CASE WHEN max(x) > min(x) THEN max(x) - min(x) ELSE 1 END) * (CASE WHEN max(y) > min(y) THEN max(y) - min(y) ELSE 1 END), 4) AS area FROM cus GROUP BY 1 HAVING count(*) > 1 AND max(x) > min(x) AND max(y) > min(y)")
def voronoi_lattice(s, sf):
    """Cells of each nation's customers, on a lattice, fill the frame."""
    out = tessellation.tessellate(X.customers(s, sf), "voronoi", "c_nationkey").df
    flat = X.customers(s, sf).df.groupBy("c_nationkey").agg(*(F.max(c(F.col(GEOM))) > F.min(c(F.col(GEOM))) for c in (G.x, G.y))).toDF("c_nationkey", "wide", "high").where("wide AND high")
    return out.join(flat, "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("cells"), (F.round(F.sum(G.area(F.col(GEOM))), 4) + 0.0).alias("area"))


@registered(cte("zon") + "SELECT n_nationkey, CAST(4 AS BIGINT) AS corners, round((x2-x1)*(y2-y1), 6) AS area FROM zon")
def simplify_shared(s, sf):
    """Zones whose borders wave by less than the tolerance, between corners that all have: their boxes are left, without gaps or overlaps."""
    z = X.zones(s, sf)
    b = F.col(f"{GEOM}.bbox")
    step = F.sequence(F.lit(0), F.lit(35))
    wave = lambda k, at: F.when((k % 36) == 0, 0.0).otherwise(F.sin(k * 2.0 + at))
    across = lambda y: F.transform(step, lambda k: G.vertex(b["xmin"] + k * 2, F.col(f"{GEOM}.bbox.{y}") + wave(k, F.col(f"{GEOM}.bbox.{y}"))))
    along = lambda x: F.transform(step, lambda k: G.vertex(F.col(f"{GEOM}.bbox.{x}") + wave(k, F.col(f"{GEOM}.bbox.{x}")), b["ymin"] + k))
    corner = F.array(G.vertex(b["xmax"], b["ymax"]))
    top = F.slice(F.reverse(F.concat(across("ymax"), corner)), 1, 36)
    left = F.slice(F.reverse(F.concat(along("xmin"), F.array(G.vertex(b["xmin"], b["ymax"])))), 1, 36)
    ring = F.concat(across("ymin"), along("xmax"), top, left)
    waved = z.new(z.df.withColumn(GEOM, G.polygon(F.concat(ring, F.slice(ring, 1, 1)))))
    out = overlay.clean(waved, 3.0, preserve_topology=True).df
    return out.select("n_nationkey", (F.size(G.vertices(F.col(GEOM))) - 1).cast("long").alias("corners"), r6(G.area(F.col(GEOM))).alias("area"))


@registered(cte("zon") + "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS faces, round(sum((x2-x1)*(y2-y1)), 6) AS area FROM zon GROUP BY 1")
def enclose_zones(s, sf):
    """The outlines of a region's zones, as lines, enclose the zones again."""
    out = overlay.enclose(overlay.to_lines(X.zones(s, sf)), "n_regionkey").df
    return out.groupBy("n_regionkey").agg(F.count("*").alias("faces"), r6(F.sum(G.area(F.col(GEOM)))).alias("area"))


@registered("SELECT CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS \"group\", c_mktsegment AS key, c_custkey FROM customer")
def group_numbers(s, sf):
    return X.customers(s, sf).group("c_mktsegment").select("group", "key", "c_custkey")


@registered(cte("zon") + "SELECT n_nationkey FROM zon ORDER BY sqrt(pow(greatest(x1 - 30, 20 - x2, 0), 2) + pow(greatest(y1 - 40, 10 - y2, 0), 2)), n_nationkey LIMIT 7")
def quick_nearest_box(s, sf):
    return X.zones(s, sf).quick_nearest((20, 10, 30, 40), n=7).df.select("n_nationkey")


@registered("SELECT c_custkey, round(sqrt(4 + (c_acctbal - a) / (b - a) * 96), 6) AS size FROM customer, (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer)")
def area_sizes(s, sf):
    return classify.area_sizes(X.table(s, sf, "customer"), F.col("c_acctbal"), 2, 10).select("c_custkey", r6("size").alias("size"))


@registered("WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i, c_acctbal FROM customer) SELECT c_custkey, round(sum(c_acctbal) OVER (ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS total FROM r")
def moving_window_all(s, sf):
    out = X.customers(s, sf).moving_window(5, [("total", "c_acctbal", "sum")])
    return out.df.select("c_custkey", F.round("total", 4).alias("total"))


# More of rasters

_TWO = cte("qty", "dis") + "SELECT col, row, round({}, 6) + 0.0 AS value FROM qty JOIN (SELECT col, row, value AS w FROM dis) USING (col, row)"


@registered(_TWO.format("value - w * 100"))
def raster_minus(s, sf):
    return _cells(X.quantity(s, sf) - X.discount(s, sf) * 100)


@registered(_TWO.format("value * w"))
def raster_times(s, sf):
    return _cells(X.quantity(s, sf) * X.discount(s, sf))


@registered(_TWO.format("1000 / value"))
def raster_reflected(s, sf):
    return _cells((1000 / X.quantity(s, sf)) + X.discount(s, sf) * 0)


@registered(_TWO.format("pow(w, 2)"))
def raster_power(s, sf):
    return _cells(X.discount(s, sf) ** 2)


@registered(_TWO.format("CASE WHEN value > 40 AND w > 0.05 THEN 1e0 ELSE 0e0 END"))
def raster_logic(s, sf):
    return _cells((X.quantity(s, sf) > 40) & (X.discount(s, sf) > 0.05))


@registered(cte("qty") + "SELECT col, row, CAST(CASE WHEN value > 50 THEN 1 ELSE 0 END AS DOUBLE) AS value FROM qty")
def raster_conditional(s, sf):
    return _cells(X.quantity(s, sf).conditional("val > 50"))


@registered(cte("qty") + ", e AS (SELECT min(value) AS a, max(value) AS b FROM qty), n AS (SELECT CAST(least(9, floor((value - a) / ((b - a) / 10))) AS INTEGER) AS bin, count(*) AS n FROM qty, e GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, round(a + i * (b - a) / 10, 6) AS lo, CAST(coalesce(n, 0) AS BIGINT) AS n FROM range(10) t(i) CROSS JOIN e LEFT JOIN n ON n.bin = i")
def raster_histogram(s, sf):
    return X.quantity(s, sf).histogram().select("bin", r6("lo").alias("lo"), "n")


@registered(cte("qty") + "SELECT a.col, a.row, CAST(count(*) AS BIGINT) AS n, round(sum(b.value), 4) AS total FROM qty b JOIN (SELECT col, row FROM qty) a ON abs(a.col - b.col) <= 1 AND abs(a.row - b.row) <= 1 AND (a.col <> b.col OR a.row <> b.row) GROUP BY 1, 2")
def raster_neighbours(s, sf):
    q = X.quantity(s, sf)
    seen = q.neighbours().join(q.df.select("band", "col", "row"), ["band", "col", "row"], "left_semi")
    return seen.groupBy("col", "row").agg(F.count("*").alias("n"), F.round(F.sum("n_value"), 4).alias("total"))


@registered(cte("qty") + "SELECT col, row, round(127.5 + 127.5 * (value - 30) / f, 6) + 0.0 AS value FROM qty, (SELECT max(abs(value - 30)) AS f FROM qty)")
def raster_stretch(s, sf):
    return _cells(raster.stretch(X.quantity(s, sf), 30.0))


def _weight(d: str) -> str:
    return f"(CASE WHEN abs({d}) <= 1 THEN 1.5 * pow(abs({d}), 3) - 2.5 * pow(abs({d}), 2) + 1 WHEN abs({d}) < 2 THEN -0.5 * pow(abs({d}), 3) + 2.5 * pow(abs({d}), 2) - 4 * abs({d}) + 2 ELSE 0 END)"


@registered(cte("qty", "grid") + f", z AS (SELECT col, row, coalesce(value, 0) AS v FROM grid LEFT JOIN qty USING (col, row)), t AS (SELECT CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row, (c + 0.5) / 3e0 - 0.5 AS u, (r + 0.5) / 3e0 - 0.5 AS v FROM range(144) a(c), range(72) b(r)), w AS (SELECT t.col, t.row, least(47, greatest(0, floor(u) + i)) AS sc, least(23, greatest(0, floor(t.v) + j)) AS sr, {_weight('(u - floor(u) - i)')} * {_weight('(t.v - floor(t.v) - j)')} AS k FROM t, range(-1, 3) x(i), range(-1, 3) y(j)) SELECT w.col, w.row, round(sum(k * z.v), 4) + 0.0 AS value FROM w JOIN z ON z.col = sc AND z.row = sr GROUP BY 1, 2")
def resample_bicubic(s, sf):
    q = X.quantity(s, sf)
    full = raster.mosaic([raster.RasterFrame.empty(s, q.grid, 1, 0.0), q])
    return _cells(full.resample(Grid(144, 72, (1 / 3, 0.0, 0.0, 0.0, 1 / 3, 0.0)), "bicubic"), 4)


@registered(cte("qty") + "SELECT col, row, round(CASE WHEN b > value THEN b ELSE value END, 6) + 0.0 AS value FROM (SELECT col, row, value, value * 0.5 + 20 AS b FROM qty)")
def mosaic_most(s, sf):
    q = X.quantity(s, sf)
    return _cells(raster.mosaic([q, q * 0.5 + 20], "max"))


# Files and streams: written, read back, and looked at

def _folder(s) -> str:
    """A place in the shared folder for a query's files, which go when the process ends."""
    path = f"{shared_dir(s)}/files-{uuid.uuid4().hex}"
    for ending in ("", ".csv", ".geojson", ".parquet", ".asc"):
        remove_at_end(s, path + ending)
    return path


@registered("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def source_csv(s, sf):
    path = f"{_folder(s)}.csv"
    vector.write(X.customers(s, sf).keep_fields("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return vector.read(s, path).df.select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


@registered(cte("cus") + "SELECT c_custkey, c_mktsegment, x, y FROM cus")
def source_geojson(s, sf):
    path = f"{_folder(s)}.geojson"
    vector.write(X.customers(s, sf).keep_fields("c_custkey", "c_mktsegment"), path)
    return vector.read(s, path).df.select("c_custkey", "c_mktsegment", G.x(F.col(GEOM)).alias("x"), G.y(F.col(GEOM)).alias("y"))


@registered(cte("cus") + "SELECT c_custkey, x, y FROM cus WHERE x >= 0 AND x <= 50")
def source_parquet(s, sf):
    """The bbox filter reaches the scan."""
    path = f"{_folder(s)}.parquet"
    vector.write(X.customers(s, sf).keep_fields("c_custkey"), path)
    back = FeatureFrame(vector.read(s, path).df, "Point").quick_overlap((0, -90, 50, 90))
    return back.df.select("c_custkey", G.x(F.col(GEOM)).alias("x"), G.y(F.col(GEOM)).alias("y"))


@registered(cte("qty") + "SELECT col, row, round(value, 6) + 0.0 AS value FROM qty")
def source_ascii(s, sf):
    path = f"{_folder(s)}.asc"
    q = X.quantity(s, sf)
    full = raster.mosaic([raster.RasterFrame.empty(s, q.grid), q])
    raster_files.write(full.new(full.df, q.grid.with_(affine=(1.0, 0.0, 0.0, 0.0, -1.0, float(q.grid.height)))), path)
    return _cells(raster_files.read(s, path)).where("value IS NOT NULL")


@registered(cte("zon") + ", e AS (SELECT user_id, ts, n_name AS zone FROM events LEFT JOIN zon ON CAST(event_id * 37 % 360 AS DOUBLE) - 179.5 > x1 AND CAST(event_id * 37 % 360 AS DOUBLE) - 179.5 < x2 AND CAST(event_id * 17 % 180 AS DOUBLE) - 89.5 > y1 AND CAST(event_id * 17 % 180 AS DOUBLE) - 89.5 < y2), l AS (SELECT *, lag(zone) OVER (PARTITION BY user_id ORDER BY ts, zone) AS last FROM e WHERE ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)) SELECT user_id, move, zone, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, 'enter' AS move, zone FROM l WHERE zone IS DISTINCT FROM last UNION ALL SELECT user_id, 'leave' AS move, last AS zone FROM l WHERE zone IS DISTINCT FROM last) WHERE zone IS NOT NULL GROUP BY 1, 2, 3")
def stream_moves(s, sf):
    """All events as a stream: which zones users enter and leave, by when and where their events are; up to the last watermark."""
    schema = X.table(s, sf, "events").schema
    events = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    at = lambda k, n: (F.col("event_id") * k % n).cast("double") - (n / 2 - 0.5)
    met = ordered.moves(geofence(events, at(37, 360), at(17, 180), X.zones(s, sf)), "user_id", "ts", "n_name")
    path = _folder(s)
    met.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(met.schema).parquet(path).groupBy("user_id", "move", "zone").agg(F.count("*").alias("n"))


@registered(cte("zon") + "SELECT n_name, event_type, CAST(count(*) AS BIGINT) AS n FROM events JOIN zon ON CAST(user_id * 37 % 360 AS DOUBLE) - 179.5 > x1 AND CAST(user_id * 37 % 360 AS DOUBLE) - 179.5 < x2 AND CAST(user_id * 17 % 180 AS DOUBLE) - 89.5 > y1 AND CAST(user_id * 17 % 180 AS DOUBLE) - 89.5 < y2 GROUP BY 1, 2")
def stream_geofence(s, sf):
    """All events as a stream against the zones, by where their users are."""
    schema = X.table(s, sf, "events").schema
    events = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    at = lambda k, n: (F.col("user_id") * k % n).cast("double") - (n / 2 - 0.5)
    path = _folder(s)
    met = geofence(events, at(37, 360), at(17, 180), X.zones(s, sf)).select("n_name", "event_type")
    met.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(met.schema).parquet(path).groupBy("n_name", "event_type").agg(F.count("*").alias("n"))
