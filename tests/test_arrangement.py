"""Polygons cut by a planar arrangement: areas add up, whatever the place and the size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoframe.functions import arrangement, kernels
from geoframe.functions import geometry as G
from geoframe.operators import overlay
from geoframe.types import GEOM
from tests.test_geodesic_joins import shaped


def star(rng, x, y, r, n=14):
    turn = np.sort(rng.uniform(0, 2 * math.pi, n))
    d = rng.uniform(0.4, 1, n) * r
    ring = np.c_[x + d * np.cos(turn), y + d * np.sin(turn)].tolist()
    return [tuple(v) for v in (*ring, ring[0])]


def edges(*lines):
    return np.array([(*p, *q) for ln in lines for p, q in zip(ln, ln[1:], strict=False)], float).reshape(-1, 4)


def area(part):
    return kernels.area(("Polygon", [part]))


def test_boxes_of_edges_meet_as_in_all_pairs():
    rng = np.random.default_rng(0)
    for n, m, size in ((1, 1, 1), (50, 40, 0.1), (300, 200, 0.5), (200, 300, 0.001)):
        e, f = (np.repeat(rng.uniform(0, 1, (k, 2)), 2, 0).reshape(k, 4) + np.c_[np.zeros((k, 2)), rng.normal(0, size, (k, 2))] for k in (n, m))
        own_e, own_f = rng.integers(0, 3, n), rng.integers(0, 3, m)
        low = lambda s: np.minimum(s[:, :2], s[:, 2:])
        high = lambda s: np.maximum(s[:, :2], s[:, 2:])
        near = (low(e)[:, None] <= high(f)[None]).all(2) & (high(e)[:, None] >= low(f)[None]).all(2)
        assert set(zip(*map(np.ndarray.tolist, arrangement.box_pairs(e, f)), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))
        i, j = arrangement.box_pairs(e, f, own_e, own_f)
        assert len(i) == len(set(zip(i.tolist(), j.tolist(), strict=True))) == (near & (own_e[:, None] == own_f[None])).sum()


@pytest.mark.parametrize(("x", "y", "r"), [(0, 0, 1), (5_000_000, 5_000_000, 7), (-3e7, 1e6, 1e6), (0.1, 0.2, 1e-6), (1e3, -1e3, 1e-3)])
def test_areas_of_pieces_add_up(x, y, r):
    rng = np.random.default_rng(1)
    for k in range(40):
        ring = star(rng, x, y, r)
        blades = [[(x + r * a, y + r * b) for a, b in rng.uniform(-1.2, 1.2, (rng.integers(2, 6), 2))] for _ in range(4)]
        if k % 4 == 0:  # along an edge and through vertices
            blades += [[ring[0], ring[4]], [ring[2], ring[3], ring[7]], [ring[5], ring[6]]]
        parts = arrangement.split_polygon(edges(ring), edges(*blades))
        whole = abs(kernels.ring_area(ring))
        assert abs(sum(map(area, parts)) - whole) <= 1e-9 * whole and min(map(area, parts)) > 0
        # A place in the polygon that is on no edge lies in just one piece.
        at = np.array([x, y]) + rng.uniform(-r, r, (50, 2))
        inside = kernels.inside(at[:, 0], at[:, 1], ("Polygon", [[ring]]))
        held = sum(kernels.inside(at[:, 0], at[:, 1], ("Polygon", [p])).astype(int) for p in parts)
        assert (held == inside).all()


def test_holes_bridges_loose_ends_and_rings():
    box, hole = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
    outline = edges(box, hole)
    cut = lambda *blades: sorted(round(area(p), 9) for p in arrangement.split_polygon(outline, edges(*blades)))
    assert cut([(-1, 5), (2, 5)]) == [96]  # a loose end
    assert cut([(-1, 5), (5, 5)]) == [96]  # from the outside to the hole: nothing is parted
    assert cut([(-1, 5), (11, 5)]) == [48, 48]
    assert cut([(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]) == [4, 92]  # a ring inside
    assert cut([(3, 3), (7, 3), (7, 7), (3, 7), (3, 3)]) == [12, 84]  # one around the hole
    assert cut([(0, 0), (10, 0)]) == [96] and cut([(20, 20), (30, 30)]) == [96]
    assert cut([(-1, 2), (11, 2)], [(-1, 2), (11, 2)]) == [20, 76]  # twice the same
    parts = arrangement.split_polygon(outline, edges([(3, 3), (7, 3), (7, 7), (3, 7), (3, 3)]))
    assert sorted(map(len, parts)) == [2, 2]
    two = edges([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], [(5, 0), (6, 0), (6, 1), (5, 1), (5, 0)])
    assert sorted(round(area(p), 9) for p in arrangement.split_polygon(two, edges([(0.25, -1), (0.25, 2)]))) == [0.25, 0.75, 1]


def test_cut_of_frames_far_from_the_origin(spark):
    m = 5_000_000
    boxes = shaped(spark, "Polygon", [[(m, m), (m + 10, m), (m + 10, m + 10), (m, m + 10), (m, m)], [(0, 0), (1, 0), (0, 1), (0, 0)], [(m + 100, m), (m + 101, m), (m + 101, m + 1), (m + 100, m)]])
    blades = shaped(spark, "LineString", [[(m - 1, m + 2.5), (m + 11, m + 2.5)], [(m + 5, m - 1), (m + 5, m + 11)], [(0.25, -1), (0.25, 2)]])
    out = overlay.cut(boxes, blades).df.select("k", G.area(F.col(GEOM)).alias("a")).collect()
    by = {k: sorted(r.a for r in out if r.k == k) for k in (0, 1, 2)}
    assert np.allclose(by[0], [12.5, 12.5, 37.5, 37.5], atol=1e-7) and np.allclose(by[1], [0.21875, 0.28125]) and np.allclose(by[2], [0.5])


def test_unions_cover_what_their_shapes_cover():
    rng = np.random.default_rng(3)
    for k in range(30):
        n, off = int(rng.integers(2, 12)), rng.choice((0.0, 1e6))
        shapes = [("Polygon", [[star(rng, *(off + rng.uniform(0, 4, 2)), rng.uniform(0.3, 2), 9)]]) for _ in range(n)]
        shapes += [("Polygon", [[[(off + a, off + b), (off + a + 1, off + b), (off + a + 1, off + b + 1), (off + a, off + b + 1), (off + a, off + b)][:: int(rng.choice((1, -1)))]]]) for a, b in rng.integers(0, 4, (n, 2)).tolist()]
        kind, parts = kernels.union_all(shapes)
        at = off + rng.uniform(-2, 6, (400, 2))
        inside = lambda s: kernels.inside(at[:, 0], at[:, 1], s)
        assert (inside((kind, parts)) == np.any([inside(s) for s in shapes], 0)).all()
        assert all(abs(kernels.ring_area(p[0])) > sum(abs(kernels.ring_area(h)) for h in p[1:]) for p in parts)


def test_a_union_of_tiles_is_their_outline():
    tiles = [("Polygon", [[[(a, b), (a + 1, b), (a + 1, b + 1), (a, b + 1), (a, b)]]]) for a in range(30) for b in range(20) if not (10 <= a < 12 and 5 <= b < 9)]
    kind, parts = kernels.union_all(tiles)
    assert len(parts) == 1 and len(parts[0]) == 2 and area(parts[0]) == 30 * 20 - 8 and [len(r) for r in parts[0]] == [5, 5]
    two = kernels.union_all([("Polygon", [[[(0, 0), (1, 0), (1, 1), (0, 0)]]]), ("Polygon", [[[(5, 5), (6, 5), (6, 6), (5, 5)]]])])
    assert len(two[1]) == 2


def test_dissolve_is_a_tree(spark, monkeypatch):
    """4,000 squares of one group, some in heaps, no more than 50 in a task."""
    held = []
    rows = spark.range(4000).select(F.when(F.col("id") < 3990, 1).alias("g"), G.box(F.col("id") % 80, F.floor(F.col("id") / 80), F.col("id") % 80 + 1, F.floor(F.col("id") / 80) + 1).alias(GEOM))
    heap = spark.range(300).select(F.lit(1).alias("g"), G.box(F.col("id") / 1000, F.lit(0), F.col("id") / 1000 + 1, F.lit(1)).alias(GEOM))
    grouped = overlay._grouped

    def watched(frame, keys, unite):
        held.append(frame.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return grouped(frame, keys, unite)

    monkeypatch.setattr(overlay, "_grouped", watched)
    out = {r.g: (r.a, r.n) for r in overlay.dissolve(rows.unionByName(heap), ["g"], most=50).select("g", G.area(F.col(GEOM)).alias("a"), F.size(G.vertices(F.col(GEOM))).alias("n")).collect()}
    assert out == {1: (3990.0, 7), None: (10.0, 5)} and len(held) > 2 and max(held) <= 75
    assert overlay.dissolve(rows.limit(0), ["g"]).count() == 0
