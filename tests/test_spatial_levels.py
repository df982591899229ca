"""Grid levels, rings of nearest features and distances in km against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoframe.functions import geometry as G
from geoframe.operators import spatial
from geoframe.operators.table import FeatureFrame
from geoframe.types import FID, GEOM


def boxes(spark, rows):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "k long, x1 double, y1 double, x2 double, y2 double")
    return FeatureFrame(df.select("k", F.col("k").alias(FID), G.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))).alias(GEOM)), "Polygon")


def points(spark, rows, name="k"):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], f"{name} long, x double, y double")
    return FeatureFrame(df.select(name, F.col(name).alias(FID), G.point(F.col("x"), F.col("y")).alias(GEOM)), "Point")


def test_boxes_of_all_sizes_meet_once(spark):
    rng = np.random.default_rng(0)
    at, side = rng.uniform(-180, 180, (400, 2)), 10 ** rng.uniform(-3, 2, (400, 2))
    a, b = np.c_[at, at + side][:200], np.c_[at, at + side][200:]
    b[0] = (-1000, -1000, 1000, 1000)
    got = spatial.candidates(boxes(spark, a).df, boxes(spark, b).df).select("l_k", "r_k").collect()
    want = {(i, j) for i in range(200) for j in range(200) if a[i][0] <= b[j][2] and a[i][2] >= b[j][0] and a[i][1] <= b[j][3] and a[i][3] >= b[j][1]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    near = spatial.candidates(boxes(spark, a).df, boxes(spark, b).df, 3.0).select("l_k", "r_k").collect()
    wide = {(i, j) for i in range(200) for j in range(200) if a[i][0] - 3 <= b[j][2] and a[i][2] + 3 >= b[j][0] and a[i][1] - 3 <= b[j][3] and a[i][3] + 3 >= b[j][1]}
    assert len(near) == len(wide) and {tuple(r) for r in near} == wide


def test_one_world_sized_feature_costs_the_small_ones_nothing(spark):
    rng = np.random.default_rng(1)
    at = rng.uniform(-180, 180, (5000, 2))
    small = np.c_[at, at + 0.1]
    plain, world = boxes(spark, small), boxes(spark, [*small, (-180, -180, 180, 180)])
    one, two = spatial.Levels(plain.df, plain.df), spatial.Levels(plain.df, world.df)
    assert one.base == two.base and len(two.right) == 2

    def listed(frame, levels):
        return spatial._cells(frame.df, GEOM, levels.base, levels.left, 0.0).count()

    assert listed(world, two) - listed(plain, one) < 40
    assert spatial._cells(plain.df, GEOM, two.base, two.right).count() < 2.2 * listed(plain, one)


def test_empty_sides(spark):
    some, no = boxes(spark, [(0, 0, 1, 1)]), boxes(spark, [(0, 0, 1, 1)]).select("k < 0")
    assert spatial.candidates(some.df, no.df).count() == 0 and spatial.candidates(no.df, some.df).count() == 0
    assert spatial.pairs_of(some, no, "distance", n=2).count() == 0 and spatial.pairs_of(no, some, "distance", n=2).count() == 0


@pytest.mark.parametrize("n", [1, 4])
def test_nearest_with_far_and_unequal_features(spark, n):
    rng = np.random.default_rng(2)
    a = np.concatenate((rng.normal(0, 1, (60, 2)), [(500.0, 500.0), (-80.0, 3.0)]))
    b = np.concatenate((rng.normal(0, 0.01, (80, 2)), rng.uniform(-50, 50, (20, 2))))
    got = {}
    for r in spatial.spatial_join(points(spark, a), points(spark, b, "o"), "distance", n=n).df.collect():
        got.setdefault(r.k, set()).add(r.o)
    for i, p in enumerate(a):
        d = np.sqrt(((b - p) ** 2).sum(1))
        assert got[i] == set(np.lexsort((np.arange(len(b)), d))[:n].tolist())


def test_a_radius_in_km_holds_with_n_too(spark):
    a, b = points(spark, [(0, 0)]), points(spark, [(0.5, 0), (0, 0.53), (40, 0), (0, 0.6), (0.1, 0.1)], "o")
    all_of_them = {r.o for r in spatial.spatial_join(a, b, "distance", radius=60).df.collect()}
    assert all_of_them == {0, 1, 4}
    assert {r.o for r in spatial.spatial_join(a, b, "distance", radius=60, n=5).df.collect()} == all_of_them
    assert [r.o for r in spatial.spatial_join(a, b, "distance", radius=60, n=1).df.collect()] == [4]
    unknown = FeatureFrame(a.df)
    assert {r.o for r in spatial.spatial_join(unknown, b, "distance", radius=60).df.collect()} == all_of_them
