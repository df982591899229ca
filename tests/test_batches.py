"""Predicates and distances of whole batches against the kernels of single pairs."""

import time

import numpy as np
import pyarrow as pa
import pytest

from geoframe.functions import arrowshapes, batches, kernels
from tests.test_arrangement import star


def column(shapes):
    return arrowshapes.geometries(shapes)


def many(rng, n):
    """Stars, some with holes or several parts, lines, boxes on a lattice (which touch, overlap and agree), points, nulls."""
    out = []
    for _ in range(n):
        x, y = rng.uniform(0, 6, 2)
        kind = rng.integers(0, 10)
        if kind < 3:
            out.append(("Polygon", [[star(rng, x, y, rng.uniform(0.2, 3), 9)]]))
        elif kind == 3:
            hole = [(x - 0.3, y - 0.3), (x + 0.3, y - 0.3), (x, y + 0.3), (x - 0.3, y - 0.3)]
            out.append(("Polygon", [[[(x - 1, y - 1), (x + 1, y - 1), (x + 1, y + 1), (x - 1, y + 1), (x - 1, y - 1)], hole]]))
        elif kind == 4:
            out.append(("Polygon", [[star(rng, x, y, 0.8, 7)], [star(rng, x + 3, y, 0.8, 7)]]))
        elif kind == 5:
            out.append(("LineString", [[[tuple(v) for v in rng.uniform(0, 6, (rng.integers(2, 5), 2)).tolist()]]]))
        elif kind in (6, 7):
            a, b = rng.integers(0, 5, 2).tolist()
            w, h = rng.integers(1, 3, 2).tolist()
            out.append(("Polygon", [[[(a, b), (a + w, b), (a + w, b + h), (a, b + h)][:: int(rng.choice((1, -1)))]]]))
        elif kind == 8:
            a, b, c, d = rng.integers(0, 6, 4).tolist()
            out.append(("LineString", [[[(a, b), (c + 0.5, d)]]]))
        else:
            out.append(None if rng.random() < 0.3 else ("Point", [[[(x, y)]]]))
    return out


@pytest.mark.parametrize("chunk", [batches.EDGES, 40])
def test_predicates_are_those_of_single_pairs(chunk, monkeypatch):
    monkeypatch.setattr(batches, "EDGES", chunk)
    monkeypatch.setattr(batches, "PRODUCTS", chunk * 3)
    rng = np.random.default_rng(7)
    a, b = many(rng, 700), many(rng, 700)
    b[:40] = a[:40]
    for name, test in kernels.PREDICATES.items():
        got = batches.predicate(name, column(a), column(b)).to_pylist()
        assert got == [None if s is None or t is None else bool(test(s, t)) for s, t in zip(a, b, strict=True)], name
        assert set(got) == {None, True, False}
    got = batches.distance(column(a), column(b)).to_pylist()
    want = [None if s is None or t is None else kernels.distance(s, t) for s, t in zip(a, b, strict=True)]
    assert all((g is None) == (w is None) and (g is None or abs(g - w) < 1e-12) for g, w in zip(got, want, strict=True))


def test_slices_and_empty_batches():
    rng = np.random.default_rng(8)
    a, b = many(rng, 60), many(rng, 60)
    whole = batches.predicate("intersects", column(a), column(b)).to_pylist()
    assert batches.predicate("intersects", column(a).slice(13, 30), column(b).slice(13, 30)).to_pylist() == whole[13:43]
    assert len(batches.predicate("within", column([]), column([]))) == 0 and len(batches.distance(column([]), column([]))) == 0
    assert isinstance(batches.predicate("covers", column([None]), column([None])), pa.Array)


def test_batches_are_ten_times_as_fast():
    rng = np.random.default_rng(9)
    a = [("Polygon", [[star(rng, *rng.uniform(0, 100, 2), rng.uniform(0.5, 3), 24)]]) for _ in range(3000)]
    b = [("Polygon", [[star(rng, *(np.array(s[1][0][0][0]) + rng.normal(0, 2, 2)), rng.uniform(0.5, 3), 24)]]) for s in a]
    left, right = column(a), column(b)
    began = time.perf_counter()
    got = batches.predicate("intersects", left, right).to_pylist()
    batched = time.perf_counter() - began
    began = time.perf_counter()
    few = [kernels.intersects(kernels.shape(left[i].as_py()), kernels.shape(right[i].as_py())) for i in range(0, 3000, 10)]
    single = (time.perf_counter() - began) * 10
    assert got[::10] == few and batched * 10 < single, (batched, single)


def test_a_common_corner_needs_no_kernel(monkeypatch):
    """Shapes that equal each other or share a corner meet for certain: each pair by itself cost a thousand times as much."""
    rng = np.random.default_rng(11)
    a = [("Polygon", [[star(rng, *rng.uniform(0, 100, 2), rng.uniform(0.5, 3), 8)]]) for _ in range(200)]
    b = [("Polygon", [[[s[1][0][0][0], (-50.0, -50.0), (-60.0, 0.0), s[1][0][0][0]]]]) for s in a]
    monkeypatch.setitem(kernels.PREDICATES, "intersects", None)
    monkeypatch.setitem(kernels.PREDICATES, "disjoint", None)
    for left, right in ((a, a), (a, b), (b, a)):
        assert batches.predicate("intersects", column(left), column(right)).to_pylist() == [True] * 200
        assert batches.predicate("disjoint", column(left), column(right)).to_pylist() == [False] * 200


def test_packed_shapes_are_those_of_structs(monkeypatch):
    rng = np.random.default_rng(12)
    a, b = many(rng, 300), many(rng, 300)
    b[:20] = a[:20]
    for name in kernels.PREDICATES:
        want = batches.predicate(name, column(a), column(b)).to_pylist()
        left, right = batches.pack(column(a)), batches.pack(column(b))
        assert batches.predicate(name, left, right).to_pylist() == want, name
        assert batches.predicate(name, left.slice(13, 90), right.slice(13, 90)).to_pylist() == want[13:103]
        assert batches.predicate(name, batches.pack(column(a).slice(13, 90)), right.slice(13, 90)).to_pylist() == want[13:103]
        monkeypatch.setattr(batches, "FEW", 0)
        assert batches.predicate(name, left, right).to_pylist() == want
        monkeypatch.undo()
    assert [batches.shape(left, i) for i in range(300)] == [s and kernels.shape(kernels.struct(*s)) for s in a]
    assert len(batches.predicate("intersects", batches.pack(column([])), batches.pack(column([])))) == 0
    assert batches.predicate("within", batches.pack(column([None])), batches.pack(column([None]))).to_pylist() == [None]
