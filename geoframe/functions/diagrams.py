"""Voronoi cells of many points at once: each is a convex ring in coordinates relative to its point, cut by bisectors.

A cell is right once no known point lies in the circle around any of its vertices that goes through its own point; that is tested for all
cells in batches, and what lies deepest in a circle cuts next.
"""

from __future__ import annotations

import numpy as np

#: Neighbours that cut a cell before any circle is tested; numbers that one batch of tests holds at most.
FIRST, BATCH = 8, 2_000_000
ROUNDING = 1e-15


class Cells:
    """Rings of n cells: xy (n, width, 2) relative to the points; of the edge that starts at a vertex its owner (-1 for the frame's) and its line
    (a, b, c: where ax + by = c); and how many vertices count. Vertices are where two lines meet, whatever was there before they were cut."""

    def __init__(self, points: np.ndarray, frame: tuple[float, float, float, float]) -> None:
        x1, y1, x2, y2 = frame
        n = len(points)
        self.points = points
        self.xy = np.zeros((n, 16, 2))
        self.xy[:, :4] = np.array([[x1, y1], [x2, y1], [x2, y2], [x1, y2]]) - points[:, None]
        self.owner = np.full((n, 16), -1, np.int64)
        self.line = np.zeros((n, 16, 3))
        for k, axis in enumerate((1, 0, 1, 0)):
            self.line[:, k, axis], self.line[:, k, 2] = 1, self.xy[:, k, axis]
        self.count = np.full(n, 4)

    def cut(self, rows: np.ndarray, other: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Cut the cells of rows by the bisectors to others (relative to the points); which of them lost anything."""
        xy, count = self.xy[rows], self.count[rows]
        valid = np.arange(xy.shape[1]) < count[:, None]
        square = (other**2).sum(1)
        beyond = np.einsum("nwk,nk->nw", xy, other) - square[:, None] / 2
        out = valid & (beyond > ROUNDING * np.sqrt(square)[:, None] * np.sqrt((xy**2).sum(2)))
        met = out.any(1) & (valid & ~out).any(1)
        if not met.any():
            return met
        rows, owner, xy, count, beyond, out, valid = rows[met], owner[met], xy[met], count[met], beyond[met], out[met], valid[met]
        n, width = out.shape
        before = (np.arange(width) - 1) % count[:, None]
        # The vertices that stay are one run of the ring: it starts after one that goes.
        start = (valid & ~out & np.take_along_axis(out, before, 1)).argmax(1)
        stay = (valid & ~out).sum(1)
        if stay.max() + 2 > width:
            self.xy, self.line = (np.concatenate((a, np.zeros_like(a)), 1) for a in (self.xy, self.line))
            self.owner = np.concatenate((self.owner, np.full_like(self.owner, -1)), 1)
            width *= 2
        # Places wrap at the count, so they are inside of what was read above.
        at = (start[:, None] + np.arange(width)) % count[:, None]
        each = np.arange(n)
        ring, edges = np.take_along_axis(xy, at[..., None], 1), np.take_along_axis(self.owner[rows], at, 1)
        lines, signed = np.take_along_axis(self.line[rows], at[..., None], 1), np.take_along_axis(beyond, at, 1)
        bisector = np.column_stack((other[met], square[met] / 2))

        def crossing(a, b):
            p, q = lines[each, a], bisector
            det = p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                meet = np.stack((p[:, 2] * q[:, 1] - p[:, 1] * q[:, 2], p[:, 0] * q[:, 2] - p[:, 2] * q[:, 0]), 1) / det[:, None]
                share = signed[each, a] / (signed[each, a] - signed[each, b])
            between = ring[each, a] + np.nan_to_num(np.clip(share, 0, 1))[:, None] * (ring[each, b] - ring[each, a])
            return np.where(np.isfinite(meet).all(1)[:, None], meet, between)

        first, last = crossing(stay - 1, stay), crossing(count - 1, np.zeros(n, np.int64))
        closing, line = edges[each, count - 1], lines[each, count - 1]
        ring[each, stay], ring[each, stay + 1] = first, last
        edges[each, stay], edges[each, stay + 1] = owner, closing
        lines[each, stay], lines[each, stay + 1] = bisector, line
        self.xy[rows], self.owner[rows], self.line[rows], self.count[rows] = ring, edges, lines, stay + 2
        return met

    def outside(self, rect: tuple[float, float, float, float]) -> np.ndarray:
        """Which cells' circles all keep clear of a rectangle."""
        x1, y1, x2, y2 = rect
        centre = self.xy + self.points[:, None]
        near = np.stack((np.clip(centre[..., 0], x1, x2), np.clip(centre[..., 1], y1, y2)), 2) - self.points[:, None]
        clear = (near**2).sum(2) / 2 - (near * self.xy).sum(2) > 1e-12 * (1 + np.sqrt((self.xy**2).sum(2)))
        return (clear | (np.arange(clear.shape[1]) >= self.count[:, None])).all(1)


def voronoi(points: np.ndarray, frame: tuple[float, float, float, float], known: list[np.ndarray]) -> Cells:
    """Cells of points among each other and, of each, among points that it is known to border on (an array of places, whose owners are
    numbered on from len(points))."""
    n = len(points)
    cells = Cells(points, frame)
    sizes = np.array([len(k) for k in known], np.int64)
    starts = n + np.concatenate(([0], np.cumsum(sizes)[:-1])) if n else sizes
    for j in range(sizes.max(initial=0)):
        rows = np.flatnonzero(sizes > j)
        cells.cut(rows, np.array([known[i][j] for i in rows]) - points[rows], starts[rows] + j)
    first = min(FIRST, n - 1)
    for rows in np.array_split(np.arange(n), max(1, n * n // BATCH)):
        if first < 1 or not len(rows):
            break
        d = ((points[rows, None] - points[None]) ** 2).sum(2)
        order = np.argpartition(d, first, 1)[:, : first + 1]
        order = np.take_along_axis(order, np.take_along_axis(d, order, 1).argsort(1), 1)
        for j in range(first + 1):
            other = order[:, j]
            some = other != rows
            cells.cut(rows[some], points[other[some]] - points[rows[some]], other[some])
    open_ = np.arange(n)
    while len(open_) and n > 1:
        changed = np.zeros(n, bool)
        width = int(cells.count.max())
        for rows in np.array_split(open_, max(1, len(open_) * n * width // BATCH)):
            to = points[None] - points[rows, None]
            square = (to**2).sum(2)
            # How deep each point lies in the circle around each vertex.
            deep = np.matmul(cells.xy[rows, :width], to.transpose(0, 2, 1)) - square[:, None] / 2
            # Itself, and what its edges are from already.
            deep[np.arange(len(rows)), :, rows] = -np.inf
            has, edge = np.nonzero((cells.owner[rows] >= 0) & (cells.owner[rows] < n) & (np.arange(cells.owner.shape[1]) < cells.count[rows][:, None]))
            deep[has, :, cells.owner[rows][has, edge]] = -np.inf
            deepest = deep.argmax(2)
            most = np.take_along_axis(deep, deepest[..., None], 2)[..., 0]
            vertices = np.arange(width) < cells.count[rows][:, None]
            for j in range(width):
                other = deepest[:, j]
                some = vertices[:, j] & (most[:, j] > 0)
                if some.any():
                    lost = cells.cut(rows[some], points[other[some]] - points[rows[some]], other[some])
                    changed[rows[some][lost]] = True
        open_ = np.flatnonzero(changed)
    return cells
