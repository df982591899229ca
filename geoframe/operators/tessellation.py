"""Delaunay triangles and Voronoi cells of points, over partitions.

Points meet in square tiles. A cell that is made of its tile's points is final once the circles around its vertices, through its own point,
stay inside the tile as far as there are points at all; its borders are then told to those neighbours in the tile that are not final yet. What is
left goes on to the tiles that lie across the borders of the last, and then to wider ones. A point needs no halo: whatever may still border on it is
either left like itself or has told it so. The last tile of a key takes the rest, mostly points near the hull.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.functions import diagrams
from geoframe.functions import geometry as G
from geoframe.operators.table import FeatureFrame, checkpointed, ranked, remove_kept
from geoframe.types import FID, GEOM

#: Points of a tile at first, on average and at most; how many levels of halving there are; each later tile is so many levels wider.
SHARE, FULL, LEVELS, WIDER = 256, 2048, 40, 2
#: For triangles: how far away the frame is, and how far points are shifted so that no four are on a circle; in sizes of the bbox.
FAR, SHIFT = 1e6, 1e-10
PLACE = "struct<id:bigint,x:double,y:double>"
_BOX = ("__x0", "__y0", "__w", "__h")


def _shifted(ids: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Places moved by up to SHIFT, by a hash of the id."""
    h = ids.astype(np.uint64)[:, None] * np.uint64(2) + np.arange(2, dtype=np.uint64)
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(by))) * np.uint64(times)
    return xy + SHIFT * ((h >> np.uint64(11)).astype(float) / 2.0**53 - 0.5)


def _tile(how: str, margin: float, p: pd.DataFrame) -> tuple[np.ndarray, list, list]:
    """Of a tile's points: which are final, what each knows, and what is made of those that are final (a ring, or two further corners for
    each triangle whose least id it has)."""
    x0, y0, w, h = (float(p[c].iloc[0]) for c in _BOX)
    size = max(w, h) or 1.0
    ids, own = p[FID].to_numpy(np.int64), p[["__x", "__y"]].to_numpy(float)
    told = [list(k) if k is not None else [] for k in p["__known"]]
    far = [q for k in told for q in k]
    all_ids = np.concatenate((ids, np.array([q["id"] for q in far], np.int64)))
    all_xy = np.concatenate((own, np.array([[q["x"], q["y"]] for q in far], float).reshape(-1, 2)))
    at = (all_xy - [x0, y0]) / size
    if how == "delaunay":
        at = _shifted(all_ids, at)
        frame = (-FAR, -FAR, FAR, FAR)
    else:
        wide = [(v or 1.0) * margin / size for v in (w, h)]
        frame = (-wide[0], -wide[1], w / size + wide[0], h / size + wide[1])
    n = len(ids)
    ends = np.cumsum([n] + [len(k) for k in told])
    cells = diagrams.voronoi(at[:n], frame, [at[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
    level, shift, cx, cy = int(p["__level"].iloc[0]), float(p["__off"].iloc[0]), float(p["__cx"].iloc[0]), float(p["__cy"].iloc[0])
    done = np.ones(n, bool)
    if level:
        side = 0.5**level
        # Shifted places may lie a little outside of their tile, and of the bbox.
        tx1, ty1, tx2, ty2 = (cx - shift) * side + SHIFT, (cy - shift) * side + SHIFT, (cx + 1 - shift) * side - SHIFT, (cy + 1 - shift) * side - SHIFT
        lo, bx, by = -SHIFT, w / size + SHIFT, h / size + SHIFT
        for beside, rect in ((tx1 > SHIFT, (lo, lo, tx1, by)), (tx2 < w / size - SHIFT, (tx2, lo, bx, by)), (ty1 > SHIFT, (lo, lo, bx, ty1)), (ty2 < h / size - SHIFT, (lo, ty2, bx, by))):
            if beside:
                done &= cells.outside(rect)
    made: list = [None] * n
    for i in np.flatnonzero(done):
        k = cells.count[i]
        owner = cells.owner[i, :k]
        if how == "voronoi":
            ring = own[i] + cells.xy[i, :k] * size
            keep = (np.abs(cells.xy[i, :k] - np.roll(cells.xy[i, :k], 1, 0)) > 1e-14).any(1)
            made[i] = [{"id": 0, "x": x, "y": y} for x, y in ring[keep].tolist()]
        else:
            a, b = np.roll(owner, 1), owner
            some = (a >= 0) & (b >= 0) & (all_ids[a] > ids[i]) & (all_ids[b] > ids[i])
            made[i] = [{"id": int(all_ids[c]), "x": float(all_xy[c, 0]), "y": float(all_xy[c, 1])} for pair in zip(a[some], b[some], strict=True) for c in pair]
        if not done.all():
            for c in owner[(owner >= 0) & (owner < n)]:
                if not done[c]:
                    told[c].append({"id": int(ids[i]), "x": float(own[i, 0]), "y": float(own[i, 1])})
    return done, told, made


def _pass(rows: DataFrame, keys: list[str], how: str, margin: float, half: bool) -> DataFrame:
    """rows with __made where they are final, and with more in __known where they are not."""
    off = F.when((F.col("__level") > 0) & F.lit(half), 0.5).otherwise(0.0)
    size = F.greatest("__w", "__h")
    cell = lambda c, lo: F.floor((F.col(c) - F.col(lo)) / F.when(size > 0, size).otherwise(1.0) * F.pow(F.lit(2.0), "__level") + off).cast("long")
    # The far edges of the bbox belong to the last tiles.
    last = lambda c: F.least(c, (F.pow(F.lit(2.0), "__level") - 1 + F.ceil(off)).cast("long"))
    placed = rows.withColumn("__off", off).withColumn("__cx", last(cell("__x", "__x0"))).withColumn("__cy", last(cell("__y", "__y0")))
    names = placed.columns

    def run(p: pd.DataFrame) -> pd.DataFrame:
        done, told, made = _tile(how, margin, p)
        return p.assign(__known=told, __made=made, __done=done)[[*names, "__made", "__done"]]

    schema = placed.withColumn("__made", F.lit(None).cast(f"array<{PLACE}>")).withColumn("__done", F.lit(True)).schema
    return placed.groupBy(*keys, "__level", "__cx", "__cy").applyInPandas(run, schema).drop("__off", "__cx", "__cy")


def _levels(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the level of each key's first tiles: few points on average, and no tile with too many as long as smaller ones help."""
    size = F.when(F.greatest("__w", "__h") > 0, F.greatest("__w", "__h")).otherwise(1.0)
    start = F.greatest(F.lit(0), F.ceil(F.log2(F.col("__n") / SHARE) / 2)).cast("int")
    rows = rows.withColumn("__level", start)
    more = None
    while True:
        scale = F.pow(F.lit(2.0), "__level") / size
        tile = [F.floor((F.col(c) - F.col(lo)) * scale).alias(f"__t{c}") for c, lo in (("__x", "__x0"), ("__y", "__y0"))]
        full = rows.groupBy(*keys, "__level", *tile).count().groupBy(*keys, "__level").agg(F.max("count").alias("__most"))
        full = full.where((F.col("__most") > FULL) & (F.col("__level") < LEVELS))
        if not keys:
            if full.isEmpty():
                return rows
            rows = rows.withColumn("__level", F.col("__level") + WIDER)
            continue
        if rows.where(F.col("__n") > FULL).isEmpty():
            return rows
        if more is not None:
            remove_kept(more)
        more = checkpointed(full.select(*(F.col(k).alias(f"__of{k}") for k in keys), F.lit(WIDER).alias("__deeper")))
        if more.isEmpty():
            return rows
        rows = rows.join(more, [F.col(k).eqNullSafe(F.col(f"__of{k}")) for k in keys], "left").withColumn("__level", F.col("__level") + F.coalesce("__deeper", F.lit(0)))
        rows = checkpointed(rows.drop("__deeper", *(f"__of{k}" for k in keys)))


def _boxed(points: DataFrame, keys: list[str]) -> DataFrame:
    """points with the bbox and number of their key's."""
    told = points.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__x").alias("__x0"), F.min("__y").alias("__y0"), (F.max("__x") - F.min("__x")).alias("__w"), (F.max("__y") - F.min("__y")).alias("__h"))
    if keys:
        told = told.select(*(F.col(k).alias(f"__of{k}") for k in keys), "__n", *_BOX)
        return points.join(told, [F.col(k).eqNullSafe(F.col(f"__of{k}")) for k in keys]).drop(*(f"__of{k}" for k in keys))
    one = told.first()
    return points.select("*", *(F.lit(one[c]).alias(c) for c in ("__n", *_BOX)))


def tessellate(frame: FeatureFrame, how: str = "voronoi", key: str | None = None, margin: float = 1.0) -> FeatureFrame:
    """delaunay: triangles of the points of each key (of the whole frame without one), numbered from 0, least ids first. voronoi: of each distinct
    point the part of the bbox, widened by its size times margin on each side, that is nearest to it, under the point's id.

    Of points at one place the least id counts. Null geometries and coordinates that are not finite take no part; one or two points, or points in
    a line, have no triangles, one point has the whole frame as its cell; an empty frame gives an empty one. Where four points are on a circle any of
    the right diagrams may come, the same one each time. Triangles are right to SHIFT of the bbox's size: clusters tighter than that are not told apart, and triangles
    flatter than it at the hull go. Tasks hold a tile each. How many points are left for the last tile goes by how many have circles as wide as the data: about
    the square root of all for points that fill an area, all of them for points that lie on one circle."""
    if how not in ("voronoi", "delaunay"):
        raise ValueError(f"unknown diagram: {how}")
    keys = [key] if key else []
    x, y = G.x(F.col(GEOM)), G.y(F.col(GEOM))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    points = frame.df.where(F.col(GEOM).isNotNull()).select(*keys, F.col(FID).cast("long").alias(FID), (x + 0.0).alias("__x"), (y + 0.0).alias("__y")).where(finite(F.col("__x")) & finite(F.col("__y")))
    points = checkpointed(points.groupBy(*keys, "__x", "__y").agg(F.min(FID).alias(FID)))
    known = F.array().cast(f"array<{PLACE}>")
    rows = _levels(_boxed(points, keys), keys).withColumn("__known", known)
    final, half = [], False
    while True:
        out = checkpointed(_pass(rows, keys, how, margin, half))
        final.append(out.where("__done"))
        left = out.where("NOT __done")
        n = left.count()
        if not n:
            break
        rows = left.drop("__made", "__done")
        if n <= FULL:
            # One tile of a key can take all that it has left.
            rows = rows.withColumn("__level", F.lit(0))
        elif half:
            rows = rows.withColumn("__level", F.greatest(F.lit(0), F.col("__level") - WIDER))
        half = not half
    made = reduce(DataFrame.unionByName, (f.select(*keys, FID, "__x", "__y", "__made") for f in final))
    if how == "voronoi":
        return frame.new(_rings(made, keys), geometry_type="Polygon")
    return frame.new(_triangles(made, keys), geometry_type="Polygon")


def _rings(made: DataFrame, keys: list[str]) -> DataFrame:
    vertex = F.transform("__made", lambda v: G.vertex(v["x"], v["y"]))
    return made.where(F.size("__made") > 2).select(*keys, FID, G.polygon(F.concat(vertex, F.slice(vertex, 1, 1))).alias(GEOM))


def _triangles(made: DataFrame, keys: list[str]) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(0), (F.size("__made") / 2).cast("int") - 1), lambda i: F.struct(F.get("__made", 2 * i).alias("a"), F.get("__made", 2 * i + 1).alias("b")))
    each = made.where(F.size("__made") > 1).select(*keys, FID, "__x", "__y", F.explode(pairs).alias("t"))
    at = lambda p: (F.col(f"t.{p}.x") - F.col("__x"), F.col(f"t.{p}.y") - F.col("__y"))
    (ax, ay), (bx, by) = at("a"), at("b")
    longest = F.greatest(F.hypot(ax, ay), F.hypot(bx, by), F.hypot(ax - bx, ay - by))
    each = each.where(F.abs(ax * by - ay * bx) > 4 * SHIFT * longest * longest)
    corner: list[Column] = [G.vertex(F.col("__x"), F.col("__y")), *(G.vertex(F.col(f"t.{p}.x"), F.col(f"t.{p}.y")) for p in "ab")]
    shaped = each.select(*keys, F.col(FID).alias("__a"), F.col("t.a.id").alias("__b"), F.col("t.b.id").alias("__c"), G.polygon(F.array(*corner, corner[0])).alias(GEOM))
    return ranked(shaped, F.col("__a"), F.col("__b"), F.col("__c")).drop("__a", "__b", "__c")
