"""Joins by km against brute force on the ellipsoid: across the 180th meridian, at the poles, of points, lines and polygons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoframe.functions import geodesy, kernels
from geoframe.functions import geometry as G
from geoframe.operators import geodesic, spatial
from geoframe.operators.table import FeatureFrame
from geoframe.types import FID, GEOM
from tests.test_spatial_levels import points


def joined(a, b, **how):
    out = spatial.spatial_join(a, b, "distance", distance=True, **how).df
    return {(r.k, r.o): r.distance for r in out.collect()}


def shaped(spark, kind, rings, name="k"):
    """Lines or polygons of lists of (lon, lat)."""
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r]) for i, r in enumerate(rings)], f"{name} long, v array<struct<x:double,y:double>>")
    make = G.line if kind == "LineString" else G.polygon
    return FeatureFrame(df.select(name, F.col(name).alias(FID), make(F.col("v")).alias(GEOM)), kind)


def test_radius_across_the_date_line_and_the_poles(spark):
    assert joined(points(spark, [(179.9, 0), (0, 89.9), (10, -89.9)]), points(spark, [(-179.9, 0), (180, 89.9), (-170, -89.95)], "o"), radius=200.0).keys() == {(0, 0), (1, 1), (2, 2)}
    assert joined(points(spark, [(0, 89.9)]), points(spark, [(180, 89.9), (90, 89.0)], "o"), radius=60.0).keys() == {(0, 0)}
    assert joined(points(spark, [(0, 89.9)]), points(spark, [(180, 89.9)], "o"), radius=10.0) == {}
    # At latitude 60 a degree east is nearer than one north.
    near = points(spark, [(1.5, 60), (0, 61)], "o")
    got = joined(points(spark, [(0, 60)]), near, radius=300.0, n=1)
    assert got.keys() == {(0, 0)} and abs(got[0, 0] - 83.6) < 0.5


@pytest.mark.parametrize("km", [0.5, 700.0, 9000.0])
def test_radius_is_brute_force(spark, km):
    rng = np.random.default_rng(3)
    a = np.c_[rng.uniform(-180, 180, 120), np.degrees(np.arcsin(rng.uniform(-1, 1, 120)))]
    b = np.concatenate((a[:20] + rng.normal(0, 0.003, (20, 2)), np.c_[rng.uniform(-180, 180, 120), np.degrees(np.arcsin(rng.uniform(-1, 1, 120)))], [(180, 5), (-180, 5), (3, 90), (99, 90)]))
    d = geodesy.apart_km(a[:, None, 1], a[:, None, 0], b[None, :, 1], b[None, :, 0])
    want = {(int(i), int(j)): d[i, j] for i, j in zip(*np.nonzero(d <= km), strict=True)}
    got = joined(points(spark, a), points(spark, b, "o"), radius=km)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want) and len(want) > 5


@pytest.mark.parametrize("km", [None, 1500.0])
def test_nearest_is_brute_force(spark, km):
    rng = np.random.default_rng(4)
    a = np.concatenate((np.c_[rng.uniform(-180, 180, 60), np.degrees(np.arcsin(rng.uniform(-1, 1, 60)))], [(0, 90), (180, 0), (-179.99, 0.1)]))
    # Most partners in one town, some far away: antipodes, too.
    b = np.concatenate((rng.normal((179.99, 0.0), 0.02, (150, 2)), np.c_[rng.uniform(-180, 180, 25), rng.uniform(-90, 90, 25)], [(-0.2, -90), (0.1, 0.05)]))
    d = geodesy.apart_km(a[:, None, 1], a[:, None, 0], b[None, :, 1], b[None, :, 0])
    want = {(i, int(j)) for i in range(len(a)) for j in np.lexsort((np.arange(len(b)), d[i]))[:3] if km is None or d[i, j] <= km}
    assert joined(points(spark, a), points(spark, b, "o"), n=3, radius=km, geodetic=True).keys() == want


def test_nearly_antipodal_points():
    lat1, lat2 = np.array([0.0, 0.0, 30.0, 90.0, -12.5]), np.array([0.0, 0.5, -30.0, -90.0, 12.4])
    lon1, lon2 = np.zeros(5), np.array([180.0, 179.7, 180.0, 7.0, 179.9])
    got = geodesy.apart_km(lat1, lon1, lat2, lon2)
    # Published: half a meridian is 20003.931459 km long; (0, 0) to (0.5, 179.7) is 19944.127421 km, to (0.5, 179.5) 19936.288579 km.
    assert np.allclose(got[[0, 2, 3]], 20003.931459, atol=2e-3) and abs(got[1] - 19944.127421) < 1e-4 and abs(geodesy.apart_km(0.0, 0.0, 0.5, 179.5)[0] - 19936.288579) < 1e-5 and np.isfinite(got).all()


def _dense(ring, closed, step=0.1):
    """Places along a line, straight in longitude and latitude, every tenth of a degree."""
    r = np.array([*ring, ring[0]] if closed and tuple(ring[0]) != tuple(ring[-1]) else ring, float)
    return np.concatenate([p + np.linspace(0, 1, 2 + int(np.abs(q - p).max() / step))[:, None] * (q - p) for p, q in zip(r, r[1:], strict=False)])


def test_lines_and_polygons_of_any_size(spark):
    rng = np.random.default_rng(5)
    lines = [[(170, 10), (179, 12)], [(-20, 88), (100, 88.5)], [(0, 0), (0.01, 0.01)], [(-60, -40), (60, -45)]]
    stars = []
    for x, y in ((-178, 11), (10, 5), (40, 60), (0, -80)):
        turn = np.sort(rng.uniform(0, 2 * np.pi, 12))
        r = rng.uniform(0.5, 4, 12)
        ring = np.c_[x + r * np.cos(turn) * (1 if y > -80 else 8), y + r * np.sin(turn)]
        stars.append([*map(tuple, ring), tuple(ring[0])])
    spots = np.concatenate((rng.uniform((-180, -85), (180, 85), (40, 2)), [(-178.0, 11.0), (180.0, 12.0), (0.0, 89.5), (-179.9, 12.1)]))
    a, b = shaped(spark, "LineString", lines), shaped(spark, "Polygon", stars, "o")
    km = 5000.0

    def brute(p, q, closed_p, closed_q):
        u, v = _dense(p, closed_p), _dense(q, closed_q)
        if closed_q and kernels.inside(u[:, 0], u[:, 1], ("Polygon", [[q]])).any():
            return 0.0
        s, t = geodesic._space(*u.T) / 1000, geodesic._space(*v.T) / 1000
        i, j = np.unravel_index((((s[:, :, None] - t[:, None, :]) ** 2).sum(0)).argmin(), (len(u), len(v)))
        return float(geodesy.apart_km(u[i, 1], u[i, 0], v[j, 1], v[j, 0])[0])

    got = joined(a, b, radius=km)
    want = {(i, j): d for i, p in enumerate(lines) for j, q in enumerate(stars) if (d := brute(p, q, False, True)) <= km}
    assert got.keys() == want.keys() and all(got[k] <= want[k] + 1e-6 and got[k] > want[k] - 6 for k in want) and len(want) >= 4
    to_spots = joined(b.rename_field("o", "k"), points(spark, spots, "o"), radius=km)
    want = {(i, j): d for i, q in enumerate(stars) for j, p in enumerate(spots) if (d := 0.0 if kernels.inside(p[:1], p[1:], ("Polygon", [[q]]))[0] else brute(q, [p, p], True, False)) <= km}
    assert to_spots.keys() == want.keys() and all(-6 < to_spots[k] - want[k] <= 1e-6 for k in want) and 0.0 in to_spots.values()
    # The nearest star of each spot, polygons on the right.
    first = joined(points(spark, spots), b, n=1, geodetic=True)
    every = np.array([[0.0 if kernels.inside(p[:1], p[1:], ("Polygon", [[q]]))[0] else brute(q, [p, p], True, False) for q in stars] for p in spots])
    assert {k for k, _ in first} == set(range(len(spots))) and all(every[i, j] < every[i].min() + 6 for i, j in first)


def test_pieces_are_as_exact_as_points():
    """Where the nearest place of a line is known: due north of a parallel's middle, at a meridian's end."""
    one = lambda *v: float(geodesic.pieces_km(*([x] for x in v))[0])
    foot = geodesy.apart_km(1.0, 0.0, 0.0, 0.0)[0]
    assert abs(one(0, 1, 0, 1, -0.4, 0, 0.4, 0) - foot) < 1e-5
    assert abs(one(-0.4, 0, 0.4, 0, 0.1, 1, 0.1, 1) - foot) < 1e-5
    assert abs(one(5, 2, 5, 2.5, 5, 3, 5, 3.5) - geodesy.apart_km(2.5, 5.0, 3.0, 5.0)[0]) < 1e-5


def test_empty_sides_and_nulls(spark):
    a, no = points(spark, [(0, 0), (1, 1)]), points(spark, [(0, 0)], "o").select("o > 5")
    assert joined(a, no, radius=10.0) == joined(a.select("k > 5"), points(spark, [(0, 0)], "o"), radius=10.0) == joined(a, no, n=2, geodetic=True) == {}
    lost = a.new(a.df.withColumn(GEOM, F.when(F.col("k") == 0, F.col(GEOM))))
    assert joined(lost, points(spark, [(0, 0)], "o"), n=2, geodetic=True).keys() == {(0, 0)}
    kept = spatial.spatial_join(a, no, "distance", radius=10.0, keepall=True).df
    assert kept.count() == 2
