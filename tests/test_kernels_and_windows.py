"""Unions of points and lines, regions, distances and interpolation of rasters, and moving windows over blocks, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoframe.functions import geometry as G
from geoframe.functions import kernels, stats
from geoframe.operators import rastervec, spatial
from geoframe.operators.components import components
from geoframe.operators.raster import RasterFrame
from geoframe.operators.table import FeatureFrame
from geoframe.types import FID, GEOM, Grid


def pts(*xy):
    return "Point", [[[p]] for p in xy]


def test_union_keeps_all_parts():
    assert kernels.combine(pts((0, 0)), pts((5, 5)), "union") == pts((0, 0), (5, 5))
    assert kernels.combine(pts((0, 0), (5, 5)), pts((5, 5)), "union") == pts((0, 0), (5, 5))
    a, b = ("LineString", [[[(0, 0), (2, 0)]]]), ("LineString", [[[(1, 0), (1, 5)]]])
    assert kernels.length(kernels.combine(a, b, "union")) == 7
    assert kernels.length(kernels.combine(a, ("LineString", [[[(1, 0), (4, 0)]]]), "union")) == 4
    assert kernels.length(kernels.combine(a, ("LineString", [[[(1, 0), (4, 0)]]]), "symdifference")) == 3
    square = ("Polygon", [[[(0, 0), (4, 0), (4, 4), (0, 4)]]])
    assert kernels.combine(square, pts((1, 1)), "union") == square == kernels.combine(pts((1, 1)), square, "union")
    with pytest.raises(ValueError, match="not one geometry"):
        kernels.combine(square, pts((9, 9)), "union")
    assert kernels.combine(pts((0, 0), (1, 1)), pts((1, 1), (2, 2)), "symdifference") == pts((0, 0), (2, 2))
    for how, want in (("union", square), ("symdifference", square), ("intersection", None), ("difference", None)):
        assert kernels.combine(None, square, how) == want


def test_join_clips_points_by_union(spark):
    def at(name, x, y):
        return FeatureFrame(spark.createDataFrame([(1,)], f"{name} long").select(name, F.lit(1).cast("long").alias(FID), G.point(F.lit(x), F.lit(y)).alias(GEOM)), "Point")

    out = spatial.spatial_join(at("a", 0.0, 0.0), at("b", 5.0, 5.0), "distance", radius=9.0, geodetic=False, clip="union").df
    assert out.select(F.size(f"{GEOM}.parts")).first()[0] == 2


def raster_of(spark, a):
    h, w = a.shape
    rows = [(0, c, r, None if math.isnan(a[r, c]) else float(a[r, c])) for r in range(h) for c in range(w)]
    return RasterFrame(spark.createDataFrame(rows, "band int, col int, row int, value double"), Grid(w, h))


def test_regions_wind(spark):
    """A spiral, a comb and random noise against a flood fill."""
    a = np.random.default_rng(0).integers(0, 2, (21, 23)).astype(float)
    a[:, :11] = 5
    for k in range(1, 21, 4):
        a[k, 0:10], a[k + 2, 1:11] = 6, 6
    a[3, 15] = np.nan
    want, seen = {}, set()
    for r in range(21):
        for c in range(23):
            if (r, c) in seen or math.isnan(a[r, c]):
                continue
            todo, found = [(r, c)], []
            seen.add((r, c))
            while todo:
                y, x = todo.pop()
                found.append((y, x))
                for u, v in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= u < 21 and 0 <= v < 23 and (u, v) not in seen and a[u, v] == a[r, c]:
                        seen.add((u, v))
                        todo.append((u, v))
            low = min(y * 23 + x for y, x in found)
            want |= dict.fromkeys(found, low)
    got = {(x.row, x.col): x.region for x in rastervec.regions(raster_of(spark, a)).collect()}
    assert got == want


def points(spark, rows):
    df = spark.createDataFrame([(i, float(x), float(y), float(v)) for i, (x, y, v) in enumerate(rows)], "k long, x double, y double, v double")
    return FeatureFrame(df.select("k", "v", F.col("k").alias(FID), G.point(F.col("x"), F.col("y")).alias(GEOM)), "Point")


def test_distance_by_sweep_and_interpolation_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    grid = Grid(31, 17, (2.0, 0.0, 0.0, 0.0, 3.0, 0.0))
    spots = [(rng.uniform(0, 62), rng.uniform(0, 51), k) for k in range(9)]
    frame, cells = points(spark, spots), {}
    for x, y, v in spots:
        cells.setdefault((int(x // 2), int(y // 3)), []).append(v)
    got = {(r["col"], r["row"]): r["value"] for r in rastervec.distance(frame, grid).df.collect()}
    assert len(got) == 31 * 17 and all(abs(d - min(math.hypot(2 * (c - a), 3 * (r - b)) for a, b in cells)) < 1e-9 for (c, r), d in got.items())
    monkeypatch.setattr(rastervec, "POINT_BLOCK", 2)
    monkeypatch.setattr(rastervec, "CELL_PART", 100)
    got = {(r["col"], r["row"]): r["value"] for r in rastervec.interpolate(frame, grid, "v").df.collect()}
    for (c, r), v in got.items():
        known = {k: sum(x) / len(x) for k, x in cells.items()}
        w = {k: ((c - k[0]) ** 2 + (r - k[1]) ** 2) ** -1.5 for k in known if k != (c, r)}
        assert abs(v - known.get((c, r), sum(w[k] * known[k] for k in w) / sum(w.values()))) < 1e-9
    assert rastervec.distance(frame.select("k < 0"), grid).df.where("value IS NOT NULL").count() == 0


@pytest.mark.parametrize("n", [1, 3, 40])
def test_moving_window_over_blocks(spark, monkeypatch, n):
    monkeypatch.setattr(FeatureFrame, "WINDOW_BLOCK", 7)
    values = np.random.default_rng(4).integers(0, 50, 60).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"{FID} long, v long").repartition(5)
    out = FeatureFrame(df).moving_window(n, [("total", "v", "sum"), ("most", "v", "max"), ("v", "v", "first")]).df
    got = {r[FID]: (r["total"], r["most"], r["v"]) for r in out.collect()}
    assert len(got) == 60 == out.count()
    for i in range(60):
        part = values[max(0, i - n + 1) : i + 1]
        assert got[i] == (sum(part), max(part), part[0])


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr("geoframe.operators.components.ONE_TASK", most)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000), (7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 5000: 5000, 5001: 5000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_kept_tables_are_removed(spark):
    from geoframe.operators import table

    before = set(table._kept)
    one, two = (table.checkpointed(spark.range(5).withColumnRenamed("id", "an id, (odd)")) for _ in range(2))
    assert len(set(table._kept) - before) == 2 and one.columns == ["an id, (odd)"] and one.count() == 5
    table.remove_kept(one)
    assert len(set(table._kept) - before) == 1 and two.count() == 5
    table.remove_kept(two)
    assert set(table._kept) == before


def test_no_local_folder_on_a_cluster():
    from geoframe.operators import table

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        table.shared_dir(Session)
    Session.sparkContext.getCheckpointDir = staticmethod(lambda: "hdfs://x/y/")
    assert table.shared_dir(Session) == "hdfs://x/y"


def test_grids_go_there_and_back():
    rng = np.random.default_rng(6)
    for _ in range(50):
        grid = Grid(7, 5, tuple(rng.normal(0, 10, 6).tolist()))
        col, row = rng.uniform(-20, 20, 2).tolist()
        assert grid.to_cell(*grid.to_geo(col, row), fraction=True) == pytest.approx((col, row), abs=1e-8)
    with pytest.raises(ValueError, match="no inverse"):
        _ = Grid(2, 2, (1.0, 2.0, 0.0, 2.0, 4.0, 0.0)).inverse


def test_ranked_statistics_hold_no_group(spark):
    """The rarest value and the middle of the distinct ones, by groups that nulls may name, with a hot group."""
    rng = np.random.default_rng(12)
    rows = [(k, float(v)) for k, v in zip(rng.choice([0, 0, 0, 1, 2], 4000).tolist(), rng.integers(0, 900, 4000).tolist(), strict=True)]
    rows = [(None if k == 2 else k, v) for k, v in rows] + [(7, None), (8, 5.0), (8, 5.0), (8, 4.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    out = stats.grouped(df, ["k"], [F.count("*").alias("n")], [("rare", F.col("v"), "minority"), ("middle", F.col("v"), "distinct_median")])
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    want = {}
    for k, vs in by.items():
        some = [v for v in vs if v is not None]
        distinct = sorted(set(some))
        want[k] = (len(vs), min(distinct, key=lambda v: (some.count(v), v), default=None), distinct[len(distinct) // 2] if distinct else None)
    assert {r.k: (r.n, r.rare, r.middle) for r in out.collect()} == want
    one = stats.grouped(df, [], [F.count("*").alias("n")], [("middle", F.col("v"), "distinct_median")]).first()
    every = sorted({v for _, v in rows if v is not None})
    assert one.n == len(rows) and one.middle == every[len(every) // 2]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
