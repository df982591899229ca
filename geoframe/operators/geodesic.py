"""Distance and nearest joins in km on the WGS84 ellipsoid, which hold everywhere: across the 180th meridian, at the poles, for points, lines and polygons.

A straight line through the earth is never longer than the way on its surface.  So what lies within a radius in km lies within it in
space, too, where there is neither a seam nor a pole: candidates are an equi-join on cells of a grid over earth-centred coordinates.  Lines and
outlines (straight in longitude and latitude between their vertices) are cut into pieces of some km, each a ball around its middle; a right piece is listed under the
cell of its middle alone, so that a pair of pieces meets once, a left one under all cells in reach that the earth's surface passes.  Balls near enough
are measured on the ellipsoid, and that is the test and the order.  Features that share a point have the distance 0.

Defined results: null geometries have no partners; ties go to the smaller right id; repeated places are partners of their own; a side without features
gives no pairs.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoframe.functions import geodesy
from geoframe.functions import geometry as G
from geoframe.operators.table import FeatureFrame, checkpointed
from geoframe.types import FID, GEOM

#: No two places are farther apart than this; pieces of lines are at least and at most so long; a degree of a great circle is at most so long. All in km.
HALF_ROUND, SHORT_PIECE, LONG_PIECE, DEGREE = 20_016.0, 5.0, 100.0, 111.7
#: Steps of the golden section that finds the nearest place of a piece.
STEPS = 36


def _in_space(lon: Column, lat: Column) -> Column:
    """Earth-centred coordinates in km, as a struct (x, y, z)."""
    e2 = geodesy.FLAT * (2 - geodesy.FLAT)
    phi, lam = F.radians(lat), F.radians(lon)

    def placed(v: Column) -> Column:
        n = geodesy.A / 1000 / F.sqrt(1 - e2 * v["s"] * v["s"])
        return F.struct((n * v["c"] * F.cos(v["l"])).alias("x"), (n * v["c"] * F.sin(v["l"])).alias("y"), (n * (1 - e2) * v["s"]).alias("z"))

    return G.let(F.struct(F.sin(phi).alias("s"), F.cos(phi).alias("c"), lam.alias("l")), placed)


def _pieces(df: DataFrame, step: float) -> DataFrame:
    """__fid, x1, y1, x2, y2 (the piece's ends in degrees), p, r (middle and radius of its ball in space, km)."""
    e = F.explode(G._edges(F.col(GEOM)))
    rows = df.where(F.col(GEOM).isNotNull()).select(FID, e.alias("e")).select(FID, F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    widest = F.when(F.signum("ay") * F.signum("by") <= 0, 1.0).otherwise(F.cos(F.radians(F.least(F.abs("ay"), F.abs("by")))))
    wide, high = (F.col("bx") - F.col("ax")) * widest, F.col("by") - F.col("ay")
    rows = rows.withColumn("km", DEGREE * F.sqrt(wide * wide + high * high)).withColumn("m", F.greatest(F.lit(1), F.ceil(F.col("km") / step).cast("int")))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    at = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * t
    t1, t2 = F.col("k") / F.col("m"), (F.col("k") + 1) / F.col("m")
    end = F.col("k") + 1 == F.col("m")
    rows = rows.select(FID, at("ax", "bx", t1).alias("x1"), at("ay", "by", t1).alias("y1"), F.when(end, F.col("bx")).otherwise(at("ax", "bx", t2)).alias("x2"), F.when(end, F.col("by")).otherwise(at("ay", "by", t2)).alias("y2"), (F.col("km") / F.col("m") / 2).alias("r"))
    return rows.select(FID, "x1", "y1", "x2", "y2", _in_space((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2).alias("p"), "r")


def _near(left: DataFrame, right: DataFrame, km: float, step: float) -> DataFrame:
    """Pairs of pieces (l_*, r_*) whose balls come within km of one another, each once. step: no ball has a diameter above it."""
    reach = max(km + step, 1e-6)
    size = max(reach, 1e-3)
    cell = lambda c: F.floor(c / size).cast("long")
    # Only cells that the surface passes hold anything.
    closest = lambda c: F.greatest(F.lit(0.0), c * size, -(c + 1) * size)
    farthest = lambda c: F.greatest(F.abs(c * size), F.abs((c + 1) * size))
    square = lambda of, v: of(v["x"]) * of(v["x"]) + of(v["y"]) * of(v["y"]) + of(v["z"]) * of(v["z"])
    passed = lambda v: (square(closest, v) <= (geodesy.A / 1000 + 1e-3) ** 2) & (square(farthest, v) >= (geodesy.B / 1000 - 1e-3) ** 2)
    along = lambda c: F.sequence(cell(F.col("l_p")[c] - reach), cell(F.col("l_p")[c] + reach))
    # Functions of arrays, and one row generator: three of them would make more code than a method may have.
    box = F.flatten(F.transform(along("x"), lambda x: F.flatten(F.transform(along("y"), lambda y: F.transform(along("z"), lambda z: F.struct(x.alias("x"), y.alias("y"), z.alias("z")))))))
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns)).withColumn("__cell", F.explode(F.filter(box, passed)))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withColumn("__cell", F.struct(*(cell(F.col("r_p")[c]).alias(c) for c in "xyz")))
    gap = lambda c: F.col("l_p")[c] - F.col("r_p")[c]
    apart = gap("x") * gap("x") + gap("y") * gap("y") + gap("z") * gap("z")
    most = F.col("l_r") + F.col("r_r") + km
    return a.join(b, "__cell").where(apart <= most * most * (1 + 1e-12) + 1e-12)


def _space(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    e2 = geodesy.FLAT * (2 - geodesy.FLAT)
    phi, lam = np.radians(lat), np.radians(lon)
    n = geodesy.A / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    return np.stack((n * np.cos(phi) * np.cos(lam), n * np.cos(phi) * np.sin(lam), n * (1 - e2) * np.sin(phi)))


def _foot(px, py, x1, y1, x2, y2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of short pieces, the place nearest to a point (as the crow digs), by golden section, and the square of that distance."""
    p, golden = _space(px, py), (math.sqrt(5) - 1) / 2

    def off(t: np.ndarray) -> np.ndarray:
        return ((_space(x1 + t * (x2 - x1), y1 + t * (y2 - y1)) - p) ** 2).sum(0)

    lo, hi = np.zeros(len(px)), np.ones(len(px))
    a, b = hi - golden, lo + golden
    fa, fb = off(a), off(b)
    for _ in range(STEPS):
        left = fa <= fb
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
        new = np.where(left, hi - golden * (hi - lo), lo + golden * (hi - lo))
        fn = off(new)
        a, b, fa, fb = np.where(left, new, b), np.where(left, a, new), np.where(left, fn, fb), np.where(left, fa, fn)
    t = np.stack((lo, hi, (lo + hi) / 2, np.zeros_like(lo), np.ones_like(lo)))
    f = np.stack([off(k) for k in t])
    k = f.argmin(0)[None]
    t = np.take_along_axis(t, k, 0)[0]
    return x1 + t * (x2 - x1), y1 + t * (y2 - y1), np.take_along_axis(f, k, 0)[0]


def pieces_km(x1, y1, x2, y2, u1, v1, u2, v2) -> np.ndarray:
    """Distances of short pieces that do not cross: an end of one or the other is nearest."""
    x1, y1, x2, y2, u1, v1, u2, v2 = (np.asarray(c, float) for c in (x1, y1, x2, y2, u1, v1, u2, v2))
    point_l, point_r = bool(((x1 == x2) & (y1 == y2)).all()), bool(((u1 == u2) & (v1 == v2)).all())
    if point_l and point_r:
        return geodesy.apart_km(y1, x1, v1, u1)
    tried = [] if point_r else [(x, y, *_foot(x, y, u1, v1, u2, v2)) for x, y in ((x1, y1), (x2, y2))[: 1 if point_l else 2]]
    if not point_l:
        for x, y in ((u1, v1), (u2, v2))[: 1 if point_r else 2]:
            fx, fy, f = _foot(x, y, x1, y1, x2, y2)
            tried.append((fx, fy, x, y, f))
    best = np.stack([t[4] for t in tried]).argmin(0)[None]
    ends = [np.take_along_axis(np.stack([t[k] for t in tried]), best, 0)[0] for k in range(4)]
    return geodesy.apart_km(ends[1], ends[0], ends[3], ends[2])


@F.pandas_udf(T.DoubleType())
def _pieces_km(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series, u1: pd.Series, v1: pd.Series, u2: pd.Series, v2: pd.Series) -> pd.Series:
    return pd.Series(pieces_km(x1, y1, x2, y2, u1, v1, u2, v2))


def _one_piece(frame: FeatureFrame) -> bool:
    """Whether each feature is a single point."""
    return frame.geometry_type == "Point" and not frame.df.where(F.col(f"{GEOM}.multi")).limit(1).count()


def _measured(left: DataFrame, right: DataFrame, km: float, step: float, single: bool, met: DataFrame | None) -> DataFrame:
    """l___fid, r___fid, distance of features within km. met: pairs that share a point."""
    ends = [F.col(f"{s}_{c}") for s in "lr" for c in ("x1", "y1", "x2", "y2")]
    ids = [f"l_{FID}", f"r_{FID}"]
    out = _near(left, right, km, step).select(*ids, _pieces_km(*ends).alias("distance")).where(F.col("distance") <= km)
    if not single:
        if met is not None:
            out = out.unionByName(met.select(*ids, F.lit(0.0).alias("distance")))
        out = out.groupBy(*ids).agg(F.min("distance").alias("distance"))
    return out


def _with_rows(pairs: DataFrame, left: FeatureFrame, right: FeatureFrame) -> DataFrame:
    for side, frame in (("l", left), ("r", right)):
        pairs = pairs.join(frame.df.select(*(F.col(f"`{c}`").alias(f"{side}_{c}") for c in frame.df.columns)), f"{side}_{FID}")
    return pairs


def _first(pairs: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(f"l_{FID}").orderBy("distance", f"r_{FID}"))
    return pairs.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def _touching(left: FeatureFrame, right: FeatureFrame) -> DataFrame | None:
    from geoframe.operators.spatial import pairs_of

    if left.geometry_type == right.geometry_type == "Point":
        return None
    return pairs_of(left, right, "intersects").select(f"l_{FID}", f"r_{FID}")


def pairs_within(left: FeatureFrame, right: FeatureFrame, km: float) -> DataFrame:
    """l_* and r_* columns and the distance in km of all pairs within km of one another."""
    step = min(LONG_PIECE, max(SHORT_PIECE, km))
    single = _one_piece(left) and _one_piece(right)
    sides = [_points(f.df) if single else _pieces(f.df, step) for f in (left, right)]
    return _with_rows(_measured(*sides, km, 0.0 if single else step, single, _touching(left, right)), left, right)


def _points(df: DataFrame) -> DataFrame:
    """_pieces() of single points."""
    x, y = G.x(F.col(GEOM)), G.y(F.col(GEOM))
    return df.where(F.col(GEOM).isNotNull()).select(FID, x.alias("x1"), y.alias("y1"), x.alias("x2"), y.alias("y2"), _in_space(x, y).alias("p"), F.lit(0.0).alias("r"))


def _start(right: DataFrame, n: int, total: int) -> float:
    """A radius that holds n features around most of them: what n take up if they lie evenly, less where cells of that size, as most of the features see
    them, hold more."""
    even = min(HALF_ROUND, max(1e-3, math.sqrt(n * 4 * 6371.0**2 / total)))
    cells = right.groupBy(*(F.floor(F.col("p")[c] / even) for c in "xyz")).agg(F.count("*").alias("n"))
    met = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 1.0
    return even * min(1.0, max(1e-3, 1.5 * math.sqrt(n / met)))


def nearest(left: FeatureFrame, right: FeatureFrame, n: int, km: float | None = None) -> DataFrame:
    """l_* and r_* columns and the distance in km of the n right features nearest to each left one (of those within km). Radii grow fourfold
    until each left feature has n within; what is settled leaves the loop, and each radius' pairs are kept, so that none is measured again."""
    single = _one_piece(left) and _one_piece(right)
    if single:
        return _with_rows(_nearest_places(left, right, n, km), left, right)
    return _with_rows(_rings(left, right, n, km, False), left, right)


def _nearest_places(left: FeatureFrame, right: FeatureFrame, n: int, km: float | None) -> DataFrame:
    """_rings() of points: places that repeat are searched for once, and of those found the n smallest ids are enough."""
    place = lambda f: f.df.where(F.col(GEOM).isNotNull()).select(FID, G.x(F.col(GEOM)).alias("__x"), G.y(F.col(GEOM)).alias("__y"))
    rank = F.row_number().over(Window.partitionBy("__x", "__y").orderBy(FID))
    few = place(right).withColumn("__rank", rank).where(F.col("__rank") <= n)
    own = checkpointed(place(left))
    spots = own.groupBy("__x", "__y").agg(F.min(FID).alias("__spot"))
    a, b = (frame.new(checkpointed(rows.select(F.col(of).alias(FID), G.point(F.col("__x"), F.col("__y")).alias(GEOM)))) for frame, rows, of in ((left, spots, "__spot"), (right, few, FID)))
    found = _rings(a, b, n, km, True).withColumnRenamed(f"l_{FID}", "__spot")
    mine = own.join(spots, ["__x", "__y"]).select("__spot", F.col(FID).alias(f"l_{FID}"))
    return found.join(mine, "__spot").drop("__spot")


def _rings(left: FeatureFrame, right: FeatureFrame, n: int, km: float | None, single: bool) -> DataFrame:
    """l___fid, r___fid and the distance of the nearest, without rows."""
    total = right.df.where(F.col(GEOM).isNotNull()).count()
    most = HALF_ROUND if km is None else km
    made = _points if single else lambda df: _pieces(df, LONG_PIECE)
    pieces = made(right.df)
    reach = min(most, _start(pieces, n, total)) if total else most
    open_, met, found = left.df, _touching(left, right), []
    if met is not None:
        met = checkpointed(met)
    while True:
        last = reach >= most
        own = left.new(open_)
        touching = None if met is None else met.join(open_.select(F.col(FID).alias(f"l_{FID}")), f"l_{FID}", "left_semi")
        near = _measured(made(own.df), pieces, reach, 0.0 if single else LONG_PIECE, single, touching)
        per = F.count("*").over(Window.partitionBy(f"l_{FID}"))
        near = checkpointed(_first(near, n).withColumn("__k", per))
        enough = near if last else near.where(F.col("__k") >= min(n, total))
        found.append(enough.drop("__k"))
        if last:
            break
        settled = enough.select(F.col(f"l_{FID}").alias(FID)).distinct()
        open_ = checkpointed(open_.where(F.col(GEOM).isNotNull()).join(settled, FID, "left_anti").select(*left.df.columns))
        if not open_.limit(1).count():
            break
        reach = min(most, 4 * reach)
    return reduce(DataFrame.unionByName, found)
