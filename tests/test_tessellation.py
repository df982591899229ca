"""Diagrams over partitions: empty circles, Euler's formula, areas, nearest points; the same whatever the tiles."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoframe.functions import diagrams, kernels
from geoframe.functions import geometry as G
from geoframe.operators import tessellation
from geoframe.operators.table import FeatureFrame
from geoframe.types import FID, GEOM


def frame_of(spark, xy, key=None):
    df = pd.DataFrame({"x": [float(q[0]) for q in xy], "y": [float(q[1]) for q in xy], FID: range(len(xy)), **({"k": key} if key is not None else {})})
    schema = f"x double, y double, {FID} long" + (", k string" if key is not None else "")
    return FeatureFrame(spark.createDataFrame(df, schema).withColumn(GEOM, G.point(F.col("x"), F.col("y"))), "Point")


def triangles_of(frame, key=None):
    rows = tessellation.tessellate(frame, "delaunay", key).df.orderBy(FID).collect()
    return [[(v.x, v.y) for v in r[GEOM].parts[0][0]] for r in rows]


def check(xy, triangles):
    """No point inside of a circle, and as much area as the hull has."""
    xy = np.array(sorted({tuple(map(float, q)) for q in xy}))
    hull = kernels.convex_hull([tuple(q) for q in xy])
    assert sum(abs(kernels.ring_area(t)) for t in triangles) == pytest.approx(abs(kernels.ring_area(hull)), rel=1e-9)
    for t in triangles:
        (ax, ay), (bx, by), (cx, cy) = t[:3]
        d = 2 * ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
        b, c = (bx - ax) ** 2 + (by - ay) ** 2, (cx - ax) ** 2 + (cy - ay) ** 2
        u, v = ((cy - ay) * b - (by - ay) * c) / d, ((bx - ax) * c - (cx - ax) * b) / d
        away = np.hypot(xy[:, 0] - ax - u, xy[:, 1] - ay - v)
        assert away.min() > math.hypot(u, v) * (1 - 1e-5)
    return xy


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(tessellation, "SHARE", 8)
    monkeypatch.setattr(tessellation, "FULL", 64)


def scattered(n, seed=1):
    return np.random.default_rng(seed).random((n, 2)) * [300, 80] + [5_000_000, -200]


def clustered():
    r = np.random.default_rng(2)
    return np.concatenate([r.normal(c, s, (200, 2)) for c, s in (((0, 0), 1e-3), ((50, 10), 5), ((-900, 40), 0.1))])


@pytest.mark.parametrize("points", [scattered(700), clustered()], ids=["scattered", "clustered"])
def test_triangles_have_empty_circles_over_many_tiles(spark, small_tiles, points):
    made = triangles_of(frame_of(spark, points))
    xy = check(points, made)
    hull = len(kernels.convex_hull([tuple(q) for q in xy])) - 1
    assert len(made) == 2 * len(xy) - 2 - hull


def test_one_tile_and_many_give_the_same(spark, monkeypatch):
    points = scattered(600, 5)
    one = triangles_of(frame_of(spark, points))
    monkeypatch.setattr(tessellation, "SHARE", 4)
    monkeypatch.setattr(tessellation, "FULL", 16)
    assert sorted(map(sorted, one)) == sorted(map(sorted, triangles_of(frame_of(spark, points))))


@pytest.mark.parametrize("points", [[(i, j) for i in range(23) for j in range(17)], [(math.cos(k / 20 * math.pi), math.sin(k / 20 * math.pi)) for k in range(40)]], ids=["lattice", "circle"])
def test_points_that_share_circles(spark, small_tiles, points):
    made = triangles_of(frame_of(spark, points))
    check(points, made)
    assert len(made) == (2 * 22 * 16 if len(points) > 40 else 38)


def test_cells_hold_what_is_nearest(spark, small_tiles):
    points = scattered(500, 7)
    out = tessellation.tessellate(frame_of(spark, points), "voronoi").df.collect()
    assert sorted(r[FID] for r in out) == list(range(500))
    w, h = np.ptp(points, axis=0)
    assert sum(abs(kernels.ring_area([(v.x, v.y) for v in r[GEOM].parts[0][0]])) for r in out) == pytest.approx(9 * w * h, rel=1e-9)
    for r in out:
        ring = np.array([(v.x, v.y) for v in r[GEOM].parts[0][0]])
        away = np.hypot(*(ring[:, None] - points[None]).transpose(2, 0, 1))
        assert (away[:, r[FID]] <= away.min(1) + 1e-6).all()


def test_keys_repeated_null_and_few_points(spark):
    xy = [(0, 0), (1, 0), (0, 1), (0, 0), (3, 3), (0, 0), (1, 1), (2, 2), (float("nan"), 0), (5, 5), (6, 5), (5, 6), (6, 6)]
    key = ["a", "a", "a", "a", "one", "line", "line", "line", "line", None, None, None, None]
    frame = frame_of(spark, xy, key)
    frame = frame.new(frame.df.unionByName(frame.df.limit(1).withColumn(GEOM, F.when(F.lit(False), F.col(GEOM))).withColumn(FID, F.lit(99).cast("long"))))
    counts = {r["k"]: r["count"] for r in tessellation.tessellate(frame, "delaunay", "k").df.groupBy("k").count().collect()}
    assert counts == {"a": 1, None: 2}
    cells = {(r["k"], r[FID]): abs(kernels.ring_area([(v.x, v.y) for v in r[GEOM].parts[0][0]])) for r in tessellation.tessellate(frame, "voronoi", "k").df.collect()}
    assert {k: round(sum(v for (a, _), v in cells.items() if a == k), 9) for k in ("a", "one", "line", None)} == {"a": 9, "one": 4, "line": 36, None: 9}
    assert len(cells) == 3 + 1 + 3 + 4
    assert tessellation.tessellate(frame.new(frame.df.limit(0)), "voronoi").df.count() == 0
    with pytest.raises(ValueError):
        tessellation.tessellate(frame, "other")


def test_known_neighbours_count_like_points():
    points = scattered(80, 9)
    lo, size = points.min(0), np.ptp(points, axis=0).max()
    at = (points - lo) / size
    box = (-1, -1, 2, 2)
    whole = diagrams.voronoi(at, box, [np.zeros((0, 2))] * 80)
    mine = {int(c) for c in whole.owner[0, : whole.count[0]] if c >= 0}
    alone = diagrams.voronoi(at[:1], box, [at[sorted(mine)]])
    a, b = (np.array(sorted(map(tuple, c.xy[0, : c.count[0]]))) for c in (whole, alone))
    assert np.allclose(a, b)
