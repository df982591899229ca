"""Queries whose work has to be dealt out, and must not grow with repeated places."""

import pytest
from pyspark.sql import functions as F

from geoframe.functions import geometry as G
from geoframe.operators import overlay, spatial
from geoframe.operators.table import FeatureFrame
from geoframe.types import FID, GEOM


def points(spark, rows, name="k"):
    """Points (id, key, x, y) of one file split."""
    df = spark.createDataFrame(rows, f"{FID} long, {name} long, x double, y double").coalesce(1)
    return FeatureFrame(df.select(FID, name, G.point(F.col("x"), F.col("y")).alias(GEOM)), "Point")


def test_a_key_of_many_pairs_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CONNECTED", 100)
    a = points(spark, [(i, i % 2, float(i), 0.0) for i in range(40)])
    b = points(spark, [(i, i % 2, 0.0, float(i)) for i in range(60)], "m")
    out = spatial.connect(a, b, key=("k", "m"), greatcircle=False).df
    got = sorted((r.k, r.m, r.len) for r in out.select("k", "m", G.length(F.col(GEOM)).alias("len")).collect())
    want = sorted((i % 2, j % 2, (i * i + j * j) ** 0.5) for i in range(40) for j in range(60) if i % 2 == j % 2)
    assert got == [(k, m, pytest.approx(d)) for k, m, d in want]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        held = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(held) > 2 and max(held) < 600


def test_an_edge_cuts_once(spark, monkeypatch):
    """A thousand times the same three blades, drawn either way, come to a polygon as three."""
    square = FeatureFrame(spark.range(1).select(F.col("id").alias(FID), G.box(*(F.lit(v) for v in (0.0, 0.0, 4.0, 4.0))).alias(GEOM)), "Polygon")
    y = F.col("id") % 3 + 1
    ends = [G.vertex(F.lit(x), y) for x in (-1.0, 5.0)]
    lines = FeatureFrame(spark.range(1000).select(F.col("id").alias(FID), F.when(F.col("id") % 2 == 0, G.line(F.array(*ends))).otherwise(G.line(F.array(*ends[::-1]))).alias(GEOM)), "LineString")
    out = overlay.cut(square, lines).df
    assert [r[0] for r in out.select(G.area(F.col(GEOM))).collect()] == [pytest.approx(4.0)] * 4
    met = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a#" in met


def test_repeated_places_are_paired_once(spark, monkeypatch):
    met = []
    old = spatial.candidates
    monkeypatch.setattr(spatial, "candidates", lambda a, b, *more: met.append((a.count(), b.count())) or old(a, b, *more))
    monkeypatch.setattr(spatial, "CONNECTED", 50)
    a = points(spark, [(i, i, float(i % 5), 0.0) for i in range(100)] + [(100, 100, None, 0.0)])
    b = points(spark, [(i, i, float(i % 7), 1.0) for i in range(140)], "m")
    out = spatial.spatial_join(a, b, "distance", radius=1.5, geodetic=False, distance=True).df
    got = sorted((r.k, r.m, r.distance) for r in out.collect())
    want = sorted((i, j, d) for i in range(100) for j in range(140) if (d := ((i % 5 - j % 7) ** 2 + 1) ** 0.5) <= 1.5)
    assert got == [(i, j, pytest.approx(d)) for i, j, d in want]
    assert met == [(5, 7)]


def test_numbers_by_the_billion_are_rounded_as_others(spark):
    from geoframe.plans import catalog

    values = [0.0, -0.0, 1.0000005, 2.5e-7, 5e-7, -5e-7, 123.4567895, 1e13 + 0.3, float("inf"), None, *(k * 1e-7 + k * k for k in range(2000)), *(-(k**0.5) for k in range(2000))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(catalog.quick6("v").alias("a"), catalog.r6("v").alias("b"))
    assert not rows.where("NOT a <=> b").count()


def test_a_strip_with_two_caps_is_the_union(spark):
    import math

    from geoframe.functions import kernels

    for k in range(40):
        x, y, turn, far = k % 7 - 3.0, k % 5 * 1.5, k * 0.37, 2.0 + k % 3
        line = ("LineString", [[[(x, y), (x + far * math.cos(turn), y + far * math.sin(turn))]]])
        made = kernels.buffer(line, 2.0, 32)
        kind, parts = kernels.buffer(("LineString", [[[*line[1][0][0], line[1][0][0][1]]]]), 2.0, 32)
        assert (kind, len(parts), len(made[1])) == ("Polygon", 1, 1)
        assert kernels.area(made) == pytest.approx(kernels.area((kind, parts)), abs=1e-9)
        assert kernels.area(kernels.combine(made, (kind, parts), "difference") or ("Polygon", [])) == pytest.approx(0, abs=1e-7)


def test_buffers_are_dealt_out(spark):
    lines = FeatureFrame(spark.range(50).coalesce(1).select(F.col("id").alias(FID), G.line(F.array(G.vertex(F.lit(0), F.lit(0)), G.vertex(F.lit(9), F.col("id")))).alias(GEOM)), "LineString")
    assert overlay.buffer(lines, 1.0).df.rdd.getNumPartitions() > 1


def test_nearest_by_km_does_not_grow_with_repeated_places(spark, monkeypatch):
    from geoframe.operators import geodesic

    met = []
    old = geodesic._near
    monkeypatch.setattr(geodesic, "_near", lambda a, b, *more: met.append((a.count(), b.count())) or old(a, b, *more))
    a = points(spark, [(i, i, float(i % 5), 50.0) for i in range(100)])
    out = geodesic.nearest(a, a, 3)
    got = sorted((r[f"l_{FID}"], r[f"r_{FID}"], r["distance"]) for r in out.collect())
    assert got == [(i, i % 5 + 5 * k, 0.0) for i in range(100) for k in range(3)]
    assert met[0] == (5, 15)


def test_boxes_are_told_by_their_bbox(spark):
    """Points on an edge, too, which the distance from it leaves out by rounding; and a box takes no lambda to be told."""
    ends = [(0.1, 0.1), (0.7, 0.1), (0.7, 0.9), (0.1, 0.9)]
    square = lambda corners: F.array(*(G.vertex(F.lit(x), F.lit(y)) for x, y in corners))
    on = [(0.7, 0.1 + 0.8 * k / 97) for k in range(97)]
    df = spark.createDataFrame([*on, (0.4, 0.5), (0.1, 0.9), (0.8, 0.5), (float("nan"), 0.5)], "x double, y double")
    for corners in (ends, ends[::-1], [*ends, ends[0]], [*ends[2:], *ends[:2]]):
        shape = G.polygon(square(corners))
        told = df.select(G.is_box(shape).alias("box"), G.intersects_point(shape, F.col("x"), F.col("y")).alias("i"), G.contains_point(shape, F.col("x"), F.col("y")).alias("c"), G.touches_point(shape, F.col("x"), F.col("y")).alias("t"))
        assert [tuple(r) for r in told.collect()] == [(True, True, False, True)] * 97 + [(True, True, True, False), (True, True, False, True), (True, False, False, False), (True, False, False, False)]
    others = [[(0, 0), (2, 0), (2, 2), (1, 3)], [(0, 0), (2, 0), (0, 2), (2, 2)], [(0, 0), (2, 0), (2, 2), (1, 1), (0, 2)], [(0, 1), (1, 0), (2, 1), (1, 2)], [(0, 0), (1, 0), (2, 0)]]
    assert not spark.range(1).select(F.array(*(F.coalesce(G.is_box(G.polygon(square(c))), F.lit(False)) for c in others)).alias("b")).where(F.exists("b", lambda b: b)).count()


def test_rows_of_a_geofence_are_dealt_out(spark):
    from geoframe.streaming import geofence

    zone = FeatureFrame(spark.range(1).select(F.col("id").alias(FID), F.lit("z").alias("name"), G.box(*(F.lit(v) for v in (0.0, 0.0, 40.0, 4.0))).alias(GEOM)), "Polygon")
    rows = spark.range(100).coalesce(1)
    met = geofence(rows, F.col("id") + 0.5, F.lit(1.0), zone)
    assert met.rdd.getNumPartitions() > 1
    assert sorted(r["id"] for r in met.collect()) == list(range(40))


def sent(spark, df):
    """Rows that df's run writes for shuffles, nothing being broadcast."""
    store, bus = spark._jsc.sc().statusStore(), spark._jsc.sc().listenerBus()

    def stages():
        bus.waitUntilEmpty()
        told = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(told)}

    before = stages()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df.write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return sum(n for k, n in stages().items() if k not in before)


def test_copies_for_shares_do_not_grow_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CONNECTED", 10)
    rows = {}
    for k in (1, 3):
        a = points(spark, [(i, 0, float(i), 0.0) for i in range(100 * k)])
        b = points(spark, [(i, 0, 0.0, float(i)) for i in range(300 * k)], "m")
        out = spatial.connect(a, b, key=("k", "m"), greatcircle=False).df.select(FID, G.length(F.col(GEOM)).alias("len"))
        rows[k] = sent(spark, out)
        want = [sum((i * i + j * j) ** 0.5 for i in range(100 * k) for j in range(300 * k)), 30000 * k * k, 100 * k]
        assert list(out.agg(F.sum("len"), F.count("*"), F.count_distinct(FID)).first()) == [pytest.approx(v) for v in want]
    # Nine times the pairs; a key's 32 shares for each core are at most a grid that copies each row to so many.
    assert rows[3] < 4 * rows[1] and rows[3] < 40000


def test_a_share_holds_few_rows_of_the_right_side(spark, monkeypatch):
    monkeypatch.setattr(spatial, "HELD", 50, raising=False)
    a = points(spark, [(0, 0, 0.0, 0.0), (1, 1, 0.0, 0.0)])
    b = points(spark, [(i, int(i > 590), 0.0, float(i)) for i in range(600)], "m")
    out = spatial.connect(a, b, key=("k", "m"), greatcircle=False).df.select(F.spark_partition_id().alias("p"), FID, G.length(F.col(GEOM)).alias("len"))
    got = out.collect()
    assert sorted((r[FID], r["len"]) for r in got) == sorted((int(i > 590), float(i)) for i in range(600))
    assert len({r["p"] for r in got if r[FID] == 0}) > 4


def test_lengths_of_segments_take_no_arrays(spark):
    ends = [G.vertex(F.col(x), F.col(y)) for x, y in (("x", "y"), ("u", "v"))]
    rows = [(0.0, 0.0, 3.0, 4.0), (1.0, 1.0, 1.0, 1.0), (None, 0.0, 3.0, 4.0), (0.0, 0.0, 3.0, None), (None, None, None, None)]
    lines = spark.createDataFrame(rows, "x double, y double, u double, v double").select(G.segment(*ends).alias(GEOM), G.line(F.array(*ends)).alias("whole"))
    lengths = lines.select(G.segment_length(F.col(GEOM)).alias("len"), G.length(F.col(GEOM)).alias("told"), G.length(F.col("whole")).alias("whole"))
    assert [tuple(r) for r in lengths.collect()] == [(v, v, v) for v in (5.0, 0.0, None, None, None)]
    assert "array(" not in lengths.select("len")._jdf.queryExecution().optimizedPlan().toString()
    # Where coordinates cannot be null, Catalyst tells that there are two vertices.
    sure = spark.range(3).selectExpr("id * 1.0D AS x", "id * 2.0D AS y", "id + 3.0D AS u", "id * 2.0D AS v").select(G.segment(*ends).alias(GEOM)).select(G.length(F.col(GEOM)).alias("len"))
    assert "array(" not in sure._jdf.queryExecution().optimizedPlan().toString()
    assert [r["len"] for r in sure.collect()] == [3.0, 3.0, 3.0]
