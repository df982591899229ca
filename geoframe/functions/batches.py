"""Predicates and distances of whole Arrow batches of geometry pairs, on the batches' own buffers.

Edges of all pairs lie in columns with their pair's number.  Those that may meet are found by one grid for each pair, and each pair is
told by what its edges do: some cross, beyond any doubt of rounding; none come near each other, so that one shape lies in
the other or apart, which one corner of each ring tells; or they touch, or come as near as rounding errors.  Only the last kind goes to
the kernels of single pairs, and so do shapes of several parts where more than a common point is asked for, and points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from geoframe.functions import kernels
from geoframe.functions.arrangement import box_pairs

#: Edges nearer than this, in units of the largest coordinate (or 1), may touch. Edges of a chunk of pairs, and products of one.
NEAR, EDGES, PRODUCTS = 2e-9, 100_000, 1 << 21
#: Pairs of no more products of edges than this need no grid.
FEW = 1024
POINT, LINE, POLYGON = 0, 1, 2


def _offsets(lists: pa.ListArray) -> np.ndarray:
    """Also of no lists at all, which may come without any offset."""
    out = np.asarray(lists.offsets, np.int64)
    return out if len(out) else np.zeros(1, np.int64)


def _rings(column: pa.StructArray) -> tuple[np.ndarray, ...]:
    """Of structs: kind, parts and rings of each, and of all rings their part and size, and x and y of all corners."""
    kinds = column.field("type").fill_null("").to_pylist()
    kind = np.array([{"Point": POINT, "LineString": LINE, "Polygon": POLYGON}.get(k, -1) for k in kinds], np.int64)
    parts = column.field("parts")
    by_part = _offsets(parts)
    rings = parts.values
    by_ring = _offsets(rings)[by_part[0] : by_part[-1] + 1]
    by_part = by_part - by_part[0]
    corners = rings.values
    offsets = _offsets(corners)[by_ring[0] : by_ring[-1] + 1]
    points = corners.values
    x = np.asarray(points.field("x"), float)[offsets[0] : offsets[-1]]
    y = np.asarray(points.field("y"), float)[offsets[0] : offsets[-1]]
    part = np.repeat(np.arange(by_part[-1]) - np.repeat(by_part[:-1], np.diff(by_part)), np.diff(by_ring))
    return kind, np.diff(by_part), np.diff(by_ring[by_part]), part, np.diff(offsets), x, y


def _within_row(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of counts."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def pack(column: pa.StructArray) -> pa.Array:
    """Geometries as numbers in a row: kind, parts, rings, then part and size of each ring, then x and y of each corner. Where a shape is in many
    pairs, this is copied at once, and nested arrays value by value."""
    valid = np.asarray(column.is_valid())
    kind, parts, rings, part, sizes, x, y = _rings(column)
    corners = np.bincount(np.repeat(np.arange(len(kind)), rings), sizes, len(kind)).astype(np.int64)
    length = np.where(valid, 3 + 2 * rings + 2 * corners, 0)
    first = np.cumsum(length) - length
    live = np.flatnonzero(valid)
    out = np.zeros(length.sum())
    for k, v in enumerate((kind, parts, rings)):
        out[first[live] + k] = v[live]
    # A null row has neither rings nor corners.
    at = np.repeat(first + 3, rings) + 2 * _within_row(rings)
    out[at], out[at + 1] = part, sizes
    at = np.repeat(first + 3 + 2 * rings, corners) + 2 * _within_row(corners)
    out[at], out[at + 1] = x, y
    mask = pa.array(valid, pa.bool_()).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(kind), [mask, pa.py_buffer(np.r_[0, np.cumsum(length * 8)].astype(np.int32)), pa.py_buffer(out)])


def _unpacked(column: pa.BinaryArray) -> tuple[np.ndarray, ...]:
    """_rings() of packed geometries."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if column.type == pa.binary() else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    values = np.frombuffer(data[int(offsets[0]) : int(offsets[-1])] if data else b"", float)
    first, length = (offsets[:-1] - offsets[0]) // 8, np.diff(offsets) // 8
    some = length > 0
    kind, parts, rings = np.full(len(first), -1), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    for k, v in enumerate((kind, parts, rings)):
        v[some] = values[first[some] + k]
    at = np.repeat(first + 3, rings) + 2 * _within_row(rings)
    part, sizes = values[at].astype(np.int64), values[at + 1].astype(np.int64)
    corners = np.where(some, (length - 3 - 2 * rings) // 2, 0)
    at = np.repeat(first + 3 + 2 * rings, corners) + 2 * _within_row(corners)
    return kind, parts, rings, part, sizes, values[at], values[at + 1]


def shape(column: pa.Array, i: int) -> tuple[str, list] | None:
    """The shape for kernels of one row of structs or packed geometries."""
    if not pa.types.is_binary(column.type):
        return kernels.shape(column[i].as_py())
    if not column[i].is_valid:
        return None
    kind, parts, _, part, sizes, x, y = _unpacked(column.slice(i, 1))
    out: list = [[] for _ in range(int(parts[0]))]
    for k, size, start in zip(part.tolist(), sizes.tolist(), (np.cumsum(sizes) - sizes).tolist(), strict=True):
        out[k].append(list(zip(x[start : start + size].tolist(), y[start : start + size].tolist(), strict=True)))
    return {POINT: "Point", LINE: "LineString", POLYGON: "Polygon"}[int(kind[0])], out


class Shapes:
    """A column of geometries: kind and parts of each, its rings' first corners, and its edges."""

    def __init__(self, column: pa.Array) -> None:
        n = len(column)
        self.valid = np.asarray(column.is_valid())
        self.kind, self.parts, rings, _, sizes, x, y = _unpacked(column) if pa.types.is_binary(column.type) else _rings(column)
        owner = np.repeat(np.arange(n), rings)
        offsets = np.r_[0, np.cumsum(sizes)]
        some = sizes > 0
        owner, starts, sizes = owner[some], offsets[:-1][some], sizes[some]
        ends = starts + sizes - 1
        ring = np.repeat(np.arange(len(sizes)), sizes)
        inner = np.flatnonzero(ring[1:] == ring[:-1])
        # Rings that do not end where they begin are closed; a lone corner is an edge to itself.
        open_ = np.flatnonzero((self.kind[owner] == POLYGON) & ((x[starts] != x[ends]) | (y[starts] != y[ends])) | (sizes == 1))
        a, b = np.concatenate((inner, ends[open_])), np.concatenate((inner + 1, starts[open_]))
        self.edges = np.c_[x[a], y[a], x[b], y[b]]
        self.edge_of = np.concatenate((owner[ring[inner]], owner[open_]))
        order = np.argsort(self.edge_of, kind="stable")
        self.edges, self.edge_of = self.edges[order], self.edge_of[order]
        self.corner, self.corner_of = np.c_[x[starts], y[starts]], owner
        self.counts = np.bincount(self.edge_of, minlength=n)
        self.rings = np.bincount(self.corner_of, minlength=n)


def _chunks(a: Shapes, b: Shapes) -> Iterator[slice]:
    """Consecutive pairs of no more than EDGES edges (or one)."""
    total, start = np.cumsum(a.counts + b.counts), 0
    while start < len(total):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + EDGES, "right")))
        yield slice(start, end)
        start = end


def _between(owner: np.ndarray, rows: slice) -> slice:
    return slice(int(np.searchsorted(owner, rows.start)), int(np.searchsorted(owner, rows.stop)))


def _scale(a: Shapes, b: Shapes) -> np.ndarray:
    out = np.ones(len(a.kind))
    for s in (a, b):
        np.maximum.at(out, s.edge_of, np.abs(s.edges).max(1, initial=0.0))
    return out


def _distances(px, py, e: np.ndarray) -> np.ndarray:
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    d2 = dx * dx + dy * dy
    t = np.clip(((px - e[:, 0]) * dx + (py - e[:, 1]) * dy) / np.where(d2 > 0, d2, 1), 0, 1)
    return np.hypot(px - e[:, 0] - t * dx, py - e[:, 1] - t * dy)


def _near(e: np.ndarray, f: np.ndarray, oe: np.ndarray, of: np.ndarray, n: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """box_pairs() of n owners with few edges, all in order of their owners: those edges that reach where both sides are, all with all."""
    sides = []
    for s, o in ((e, oe), (f, of)):
        box = [np.minimum(s[:, 0], s[:, 2]) - slack, np.minimum(s[:, 1], s[:, 3]) - slack, np.maximum(s[:, 0], s[:, 2]) + slack, np.maximum(s[:, 1], s[:, 3]) + slack]
        new = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        reach = np.full((4, n), np.nan)
        for k, v in enumerate(box):
            reach[k, o[new]] = (np.minimum if k < 2 else np.maximum).reduceat(v, new)
        sides.append((box, o, reach))
    low, high = (np.maximum(sides[0][2][:2], sides[1][2][:2]), np.minimum(sides[0][2][2:], sides[1][2][2:]))
    kept = [np.flatnonzero((b[2] >= low[0][o]) & (b[3] >= low[1][o]) & (b[0] <= high[0][o]) & (b[1] <= high[1][o])) for b, o, _ in sides]
    counts = [np.bincount(o[k], minlength=n) for k, (_, o, _) in zip(kept, sides, strict=True)]
    i, j, _ = _all_with_all(np.cumsum(counts[0]) - counts[0], counts[0], np.cumsum(counts[1]) - counts[1], counts[1])
    i, j = kept[0][i], kept[1][j]
    (b, c) = (sides[0][0], sides[1][0])
    near = (b[0][i] <= c[2][j]) & (b[2][i] >= c[0][j]) & (b[1][i] <= c[3][j]) & (b[3][i] >= c[1][j])
    return i[near], j[near]


def meetings(a: Shapes, b: Shapes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair: whether edges cross beyond doubt, whether some may touch, and whether some end at the very same place."""
    n = len(a.kind)
    crossing, touching, common = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    near = NEAR * _scale(a, b)
    for rows in _chunks(a, b):
        ra, rb = _between(a.edge_of, rows), _between(b.edge_of, rows)
        e, f, oe, of = a.edges[ra], b.edges[rb], a.edge_of[ra], b.edge_of[rb]
        slack = float(near[rows].max(initial=0.0))
        few = len(e) and len(f) and (a.counts[rows] * b.counts[rows]).max() <= FEW
        i, j = _near(e, f, oe - rows.start, of - rows.start, rows.stop - rows.start, slack) if few else box_pairs(e, f, oe - rows.start, of - rows.start, slack=slack)
        e, f, o = e[i], f[j], oe[i]
        eps = near[o]
        ax, ay, bx, by = e.T
        cx, cy, dx, dy = f.T
        with np.errstate(all="ignore"):
            le, lf = np.hypot(bx - ax, by - ay), np.hypot(dx - cx, dy - cy)
            c, d = (((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / le for x, y in ((cx, cy), (dx, dy)))
            p, q = (((dx - cx) * (y - cy) - (dy - cy) * (x - cx)) / lf for x, y in ((ax, ay), (bx, by)))
            through = (np.minimum(c, d) < -eps) & (np.maximum(c, d) > eps) & (np.minimum(p, q) < -eps) & (np.maximum(p, q) > eps)
        crossing[o[through]] = True
        rest = ~through
        e, f, o, eps = e[rest], f[rest], o[rest], eps[rest]
        closest = np.minimum.reduce([_distances(e[:, 0], e[:, 1], f), _distances(e[:, 2], e[:, 3], f), _distances(f[:, 0], f[:, 1], e), _distances(f[:, 2], f[:, 3], e)])
        close = closest <= eps
        touching[o[close]] = True
        e, f, o = e[close], f[close], o[close]
        ends = np.logical_or.reduce([(e[:, i] == f[:, j]) & (e[:, i + 1] == f[:, j + 1]) for i in (0, 2) for j in (0, 2)])
        common[o[ends]] = True
    return crossing, touching, common


def _products(rows: np.ndarray, n: np.ndarray, m: np.ndarray) -> Iterator[np.ndarray]:
    """rows in runs whose n * m add up to no more than PRODUCTS (or one)."""
    total, start = np.cumsum(n[rows] * m[rows]), 0
    while start < len(rows):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + PRODUCTS, "right")))
        yield rows[start:end]
        start = end


def _all_with_all(first_a: np.ndarray, n: np.ndarray, first_b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each k the places first_a[k] + (0 .. n[k]) with first_b[k] + (0 .. m[k]), and k."""
    each = n * m
    k = np.repeat(np.arange(len(n)), each)
    nth = np.arange(len(k)) - np.repeat(np.cumsum(each) - each, each)
    width = np.maximum(m[k], 1)
    return first_a[k] + nth // width, first_b[k] + nth % width, k


def corners_inside(a: Shapes, b: Shapes, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of the rows: whether any, and whether all, of a's rings begin inside the polygon of b (even-odd)."""
    any_, all_ = np.zeros(len(a.kind), bool), np.zeros(len(a.kind), bool)
    rows = rows[b.kind[rows] == POLYGON]
    first_corner, first_edge = np.cumsum(a.rings) - a.rings, np.cumsum(b.counts) - b.counts
    for part in _products(rows, a.rings, b.counts):
        c, e, k = _all_with_all(first_corner[part], a.rings[part], first_edge[part], b.counts[part])
        x, y = a.corner[c].T
        x1, y1, x2, y2 = b.edges[e].T
        over = (y1 > y) != (y2 > y)
        hit = over & (x < (x2 - x1) * (y - y1) / np.where(y2 == y1, 1, y2 - y1) + x1)
        # A corner's edges follow one another.
        new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
        odd = np.add.reduceat(hit.astype(np.int64), new) % 2 if len(c) else np.zeros(0, np.int64)
        count = np.bincount(k[new], odd, len(part))
        any_[part], all_[part] = count > 0, (count == a.rings[part]) & (count > 0)
    return any_, all_


def predicate(name: str, left: pa.Array, right: pa.Array) -> pa.Array:
    """What kernels.PREDICATES[name] says of each pair; null where a geometry is."""
    a, b = Shapes(left), Shapes(right)
    n = len(a.kind)
    valid = a.valid & b.valid
    known = valid & (a.kind > POINT) & (b.kind > POINT) & (a.counts > 0) & (b.counts > 0)
    if name not in ("intersects", "disjoint"):
        known &= (a.parts == 1) & (b.parts == 1)
    crossing, touching, common = meetings(a, b)
    lines = (a.kind == LINE) & (b.kind == LINE)
    # Crossing lines may run along each other, too; whatever crosses or touches shares a point.
    crossed = crossing & ~(lines & touching) if name not in ("intersects", "disjoint") else crossing | common
    clear = known & ~crossing & ~touching
    rows = np.flatnonzero(clear)
    a_in, a_all = corners_inside(a, b, rows)
    b_in, b_all = corners_inside(b, a, rows)
    shared = a_in | b_in
    within, contains = a_all & ~b_in, b_all & ~a_in
    apart = {"intersects": shared, "disjoint": ~shared, "within": within, "contains": contains, "covers": contains, "touches": np.zeros(n, bool), "equals": np.zeros(n, bool), "crosses": np.zeros(n, bool)}[name]
    met = {"intersects": np.ones(n, bool), "disjoint": np.zeros(n, bool), "crosses": (a.kind == LINE) | (b.kind == LINE)}.get(name, np.zeros(n, bool))
    out = np.where(crossed, met, apart)
    for i in np.flatnonzero(valid & ~(known & (crossed | clear))).tolist():
        out[i] = kernels.PREDICATES[name](shape(left, i), shape(right, i))
    return pa.array(out, pa.bool_(), mask=~valid)


def distance(left: pa.Array, right: pa.Array) -> pa.Array:
    """Planar distances of pairs, 0 where they share a point."""
    a, b = Shapes(left), Shapes(right)
    valid = a.valid & b.valid
    out = np.zeros(len(a.kind))
    apart = np.flatnonzero(valid & ~np.asarray(predicate("intersects", left, right).fill_null(True)))
    first_a, first_b = np.cumsum(a.counts) - a.counts, np.cumsum(b.counts) - b.counts
    for part in _products(apart, a.counts, b.counts):
        i, j, k = _all_with_all(first_a[part], a.counts[part], first_b[part], b.counts[part])
        e, f = a.edges[i], b.edges[j]
        closest = np.minimum.reduce([_distances(e[:, 0], e[:, 1], f), _distances(e[:, 2], e[:, 3], f), _distances(f[:, 0], f[:, 1], e), _distances(f[:, 2], f[:, 3], e)])
        out[part] = np.minimum.reduceat(closest, np.flatnonzero(np.r_[True, k[1:] != k[:-1]]))
    return pa.array(out, pa.float64(), mask=~valid)
