"""Simplification that keeps shared borders: no gaps, no overlaps, nothing crossed, nothing flat."""

import json
import math

import numpy as np
import pytest

from geoframe.functions import kernels
from geoframe.operators import overlay
from geoframe.operators.table import FeatureFrame
from geoframe.types import FID, GEOM


def simplified(spark, polygons, tolerance, kind="Polygon"):
    geo = [json.dumps({"type": kind, "coordinates": p}) if p else None for p in polygons]
    frame = FeatureFrame.from_rows(spark, ["n"], [[k] for k in range(len(polygons))], geo, geometry_type=kind)
    rows = overlay.clean(frame, tolerance, preserve_topology=True).df.orderBy("n").collect()
    return [kernels.shape(r[GEOM].asDict(True)) if r[GEOM] else None for r in rows]


def wavy(a, b, n, r):
    t = np.linspace(0, 1, n)[1:-1]
    return [list(a), *[[a[0] + (b[0] - a[0]) * s + r.normal(0, 0.05), a[1] + (b[1] - a[1]) * s + r.normal(0, 0.05)] for s in t]]


def grid(n, points, seed):
    """Squares with irregular borders that neighbours share."""
    r = np.random.default_rng(seed)
    side = {}
    for i in range(n + 1):
        for j in range(n + 1):
            side[i, j, "x"], side[i, j, "y"] = wavy((i, j), (i + 1, j), points, r), wavy((i, j), (i, j + 1), points, r)
    back = lambda s, end: [end, *s[:0:-1]]
    out = []
    for i in range(n):
        for j in range(n):
            ring = [*side[i, j, "x"], *side[i + 1, j, "y"], *back(side[i, j + 1, "x"], [i + 1, j + 1]), *back(side[i, j, "y"], [i, j + 1])]
            out.append([[*ring, ring[0]]])
    return out


def test_neighbours_share_borders_afterwards(spark):
    made = simplified(spark, grid(3, 12, 4), 0.2)
    assert sum(len(s[1][0][0]) for s in made) < 9 * 45 / 2
    inner, outer = {}, 0
    for s in made:
        ring = s[1][0][0]
        for a, b in zip(ring[:-1], ring[1:], strict=True):
            e = tuple(sorted((tuple(a), tuple(b))))
            inner[e] = inner.get(e, 0) + 1
    assert set(inner.values()) == {1, 2}
    union = kernels.union_all(made)
    assert sum(kernels.area(s) for s in made) == pytest.approx(kernels.area(union), rel=1e-9) and len(union[1]) == 1 and len(union[1][0]) == 1
    outer = sum(1 for v in inner.values() if v == 1)
    assert outer < 12 * 12


def test_islands_stay_on_their_side_and_rings_do_not_fall_flat(spark):
    bump = [[0, 0], [4, 0], [4, 4], [2, 5], [0, 4], [0, 0]]
    island = [[1.9, 4.5], [2.1, 4.5], [2, 4.6], [1.9, 4.5]]
    circle = [[9 + math.cos(k * math.pi / 20), math.sin(k * math.pi / 20)] for k in range(40)]
    made = simplified(spark, [[bump, island[::-1]], [island], [[*circle, circle[0]]], None], 2.0)
    assert made[3] is None and all(kernels.area(s) > 0 for s in made[:3])
    assert [2, 5] in [list(v) for v in made[0][1][0][0]] and kernels.area(made[1]) == pytest.approx(0.01)
    assert kernels.area(kernels.combine(made[0], made[1], "intersection") or ("Polygon", [])) == pytest.approx(0, abs=1e-12)


def test_two_arcs_between_the_same_nodes_lines_and_empty_frames(spark):
    lens = [[0, 0], [1, -0.1], [2, 0], [1, 0.1], [0, 0]]
    left, right = [[0, 0], [-1, 1], [-1, -1], [0, 0]], [[2, 0], [3, -1], [3, 1], [2, 0]]
    made = simplified(spark, [[lens], [left], [right]], 5.0)
    assert kernels.area(made[0]) == pytest.approx(0.2)
    lines = simplified(spark, [[[0, 0], [1, 0.1], [2, 0]], [[2, 0], [3, 0.1], [4, 0]]], 1.0, "LineString")
    assert [[list(v) for v in s[1][0][0]] for s in lines] == [[[0, 0], [2, 0]], [[2, 0], [4, 0]]]
    frame = FeatureFrame.from_rows(spark, ["n"], [[1]], [json.dumps({"type": "Polygon", "coordinates": [lens]})], geometry_type="Polygon")
    assert overlay.clean(frame.new(frame.df.limit(0)), 1.0, preserve_topology=True).df.count() == 0
    assert FID in frame.df.columns
