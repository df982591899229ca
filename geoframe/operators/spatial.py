"""Spatial select, joins and statistics.

A spatial join is an equi-join on grid cells of several levels. A feature's home level has cells of about its own size, so it lies in four of them at most; it
is listed there, and under those higher levels that features of the other side have as their home. A pair meets at the higher one of its two home levels, in the cell of the larger of
its two lower left bbox corners, and nowhere else, so one very large feature costs the small ones nothing. Then comes the exact test: an expression where one side
is known to be points, a kernel else.  Catalyst picks the join: broadcast if a side is known to be small, sort-merge with skew handling if not.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoframe.functions import batches, kernels, stats
from geoframe.functions import geometry as G
from geoframe.functions.arrowshapes import of_shapes
from geoframe.operators import geodesic
from geoframe.operators.table import FeatureFrame, spread
from geoframe.types import FID, GEOM

#: A level's cells are 2 ** LEVEL_STEP times as wide as those of the one before; no more than 2 ** FINEST cells lie along the extent of all features.
LEVEL_STEP, FINEST = 2, 30


def _side(geom: str, extra: float) -> Column:
    b = F.col(f"{geom}.bbox")
    return F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]) + 2 * extra


def _raw_level(side: Column) -> Column:
    return F.when(side > 0, F.ceil(F.log2(side) / LEVEL_STEP).cast("int"))


class Levels:
    """The home levels of the features of two frames. Those below `base` are put there: it follows the median feature, or without any
    extent the points' spacing. None stands for points that are not there yet, as in a stream."""

    def __init__(self, left: DataFrame | None, right: DataFrame, extra: float = 0.0):
        b = F.col(f"{GEOM}.bbox")
        # One job for both sides, and one row for each: the levels are few, as each is a factor of 4.
        sides = [df.where(F.col(GEOM).isNotNull()).select(F.lit(k).alias("of"), _side(GEOM, more).alias("side"), *(b[c].alias(c) for c in ("xmin", "xmax", "ymin", "ymax"))) for k, (df, more) in enumerate(((left, extra), (right, 0.0))) if df is not None]
        side = F.col("side")
        rows = reduce(DataFrame.unionAll, sides).groupBy("of").agg(F.collect_set(_raw_level(side)).alias("levels"), F.percentile_approx(F.when(side > 0, side), 0.5).alias("median"), F.min("xmin").alias("x1"), F.max("xmax").alias("x2"), F.min("ymin").alias("y1"), F.max("ymax").alias("y2"), F.count("*").alias("n")).collect()
        told = [next((r for r in rows if r["of"] == k), {"levels": [], "n": 0}) for k in (0, 1)]
        some = [t for t in told if t["n"]]
        extent = max([max(t["x2"] for t in some) - min(t["x1"] for t in some), max(t["y2"] for t in some) - min(t["y1"] for t in some)], default=0.0) if some else 0.0
        far = max([abs(t[c]) for t in some for c in ("x1", "x2", "y1", "y2")], default=1.0) or 1.0
        medians = [t["median"] for t in some if t["median"]]
        size = min(medians) if medians else extent / max([1.0, *(t["n"] ** 0.5 for t in some)])
        size = max(size, far * 2.0**-FINEST, 1e-300)
        self.base = math.ceil(math.log2(size) / LEVEL_STEP)
        self.left, self.right = (sorted({max(k, self.base) for k in t["levels"]} | {self.base}) for t in told)


def _size(level: Column) -> Column:
    return F.pow(F.lit(2.0), level * LEVEL_STEP)


def _cells(df: DataFrame, geom: str, base: int, others: list[int], extra: float = 0.0) -> DataFrame:
    """df with a row for each cell (__lv, __cx, __cy) that a feature is listed under, and whether it is at home there."""
    b = F.col(f"{geom}.bbox")
    home = F.greatest(F.coalesce(_raw_level(_side(geom, extra)), F.lit(base)), F.lit(base))
    rows = df.where(F.col(geom).isNotNull()).withColumn("__home", home)
    above = F.filter(F.array(*map(F.lit, others)), lambda k: k > F.col("__home"))
    listed = F.when(F.col("__home") >= others[0], F.concat(F.array(F.col("__home")), above)).otherwise(above)
    rows = rows.withColumn("__lv", F.explode(listed)).withColumn("__home", F.col("__home") == F.col("__lv"))
    size = _size(F.col("__lv"))
    along = lambda lo, hi: F.sequence(F.floor((b[lo] - extra) / size).cast("long"), F.floor((b[hi] + extra) / size).cast("long"))
    return rows.withColumn("__cx", F.explode(along("xmin", "xmax"))).withColumn("__cy", F.explode(along("ymin", "ymax")))


def candidates(left: DataFrame, right: DataFrame, extra: float = 0.0, levels: Levels | None = None) -> DataFrame:
    """Pairs (left columns l_*, right columns r_*) whose bboxes, the left ones widened by extra, overlap; each pair once."""
    levels = levels or Levels(left, right, extra)
    a = _cells(left, GEOM, levels.base, levels.right, extra).select("__lv", "__cx", "__cy", F.col("__home").alias("__lhome"), *(F.col(f"`{c}`").alias(f"l_{c}") for c in left.columns))
    b = _cells(right, GEOM, levels.base, levels.left).select("__lv", "__cx", "__cy", F.col("__home").alias("__rhome"), *(F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns))
    lb, rb, size = F.col(f"l_{GEOM}.bbox"), F.col(f"r_{GEOM}.bbox"), _size(F.col("__lv"))
    own = (F.col("__cx") == F.floor(F.greatest(lb["xmin"] - extra, rb["xmin"]) / size)) & (F.col("__cy") == F.floor(F.greatest(lb["ymin"] - extra, rb["ymin"]) / size))
    near = (lb["xmin"] - extra <= rb["xmax"]) & (lb["xmax"] + extra >= rb["xmin"]) & (lb["ymin"] - extra <= rb["ymax"]) & (lb["ymax"] + extra >= rb["ymin"])
    met = a.join(b, ["__lv", "__cx", "__cy"]).where((F.col("__lhome") | F.col("__rhome")) & own & near)
    return met.drop("__lv", "__cx", "__cy", "__lhome", "__rhome")


def _kernel(condition: str):
    def told(a: pa.Array, b: pa.Array) -> pa.Array:
        return batches.predicate(condition, a, b)

    return F.arrow_udf(told, T.BooleanType())


def _packed(a: pa.Array) -> pa.Array:
    return batches.pack(a)


# Not to be run again for each pair.
_pack = F.arrow_udf(_packed, T.BinaryType()).asNondeterministic()


def met(left: DataFrame, right: DataFrame, condition: str, atype: str | None = None, btype: str | None = None) -> DataFrame:
    """Candidates that meet the condition. What is not points is packed once for each feature on its way to the kernel."""
    if "Point" in (atype, btype):
        return candidates(left, right).where(predicate(condition, F.col(f"l_{GEOM}"), F.col(f"r_{GEOM}"), atype, btype))
    pairs = candidates(*(df.where(F.col(GEOM).isNotNull()).withColumn("__packed", _pack(F.col(GEOM))) for df in (left, right)))
    return pairs.where(_kernel(condition)(F.col("l___packed"), F.col("r___packed"))).drop("l___packed", "r___packed")


@F.arrow_udf(T.DoubleType())
def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return batches.distance(a, b)


def predicate(condition: str, a: Column, b: Column, atype: str | None = None, btype: str | None = None) -> Column:
    """intersects, within, contains, covers, touches, crosses, equals or disjoint. With a known point side it is an expression."""
    if condition == "disjoint":
        return ~predicate("intersects", a, b, atype, btype)
    if atype == "Point" and btype == "Point":
        same = (G.x(a) == G.x(b)) & (G.y(a) == G.y(b))
        return F.lit(False) if condition in ("crosses", "touches") else same
    if btype == "Point":
        x, y = G.x(b), G.y(b)
        tests = {"intersects": G.intersects_point, "covers": G.intersects_point, "contains": G.contains_point, "touches": G.touches_point}
        return tests[condition](a, x, y) if condition in tests else F.lit(False)
    if atype == "Point":
        flipped = {"within": "contains", "contains": "within", "covers": "within"}.get(condition, condition)
        return predicate(flipped, b, a, btype, atype)
    return _kernel(condition)(a, b)


def planar_distance(a: Column, b: Column, atype: str | None = None, btype: str | None = None) -> Column:
    if atype == "Point" and btype == "Point":
        dx, dy = G.x(a) - G.x(b), G.y(a) - G.y(b)
        return F.sqrt(dx * dx + dy * dy)
    if btype == "Point":
        return G.distance_to_point(a, G.x(b), G.y(b))
    if atype == "Point":
        return G.distance_to_point(b, G.x(a), G.y(a))
    return _distance(a, b)


def _clip(how, a: Column, b: Column, btype: str | None):
    if not isinstance(how, str):
        return how(a, b) if callable(how) else a
    if how not in ("intersection", "union", "difference"):
        raise ValueError(f"unknown clip: {how}")

    return of_shapes(lambda s, t: kernels.combine(s, t, how), "gg", "geometry")(a, b)


def where(left: FeatureFrame, right: FeatureFrame, condition: str, radius: float | None = None) -> FeatureFrame:
    """Left features that meet the condition with any right feature (for disjoint: with none), once each, geometry unchanged."""
    if condition == "distance":
        pairs = candidates(left.df.select(FID, GEOM), right.df.select(GEOM), radius)
        test = planar_distance(F.col(f"l_{GEOM}"), F.col(f"r_{GEOM}"), left.geometry_type, right.geometry_type) <= radius
    else:
        pairs = met(left.df.select(FID, GEOM), right.df.select(GEOM), "intersects" if condition == "disjoint" else condition, left.geometry_type, right.geometry_type)
        test = F.lit(True)
    hit = pairs.where(test).select(F.col(f"l_{FID}").alias(FID))
    return left.new(left.df.join(hit, FID, "left_anti" if condition == "disjoint" else "left_semi").select(*left.df.columns))


def _own_right(left: FeatureFrame, right: FeatureFrame) -> list[str]:
    return [f for f in right.fields if f not in left.fields]


def pairs_of(left: FeatureFrame, right: FeatureFrame, condition: str, radius: float | None = None, n: int | None = None, geodetic: bool = False) -> DataFrame:
    """l_* and r_* columns of the pairs that meet the condition; for distance joins with the column distance."""
    lg, rg = F.col(f"l_{GEOM}"), F.col(f"r_{GEOM}")
    if condition == "disjoint":
        hit = pairs_of(left, right, "intersects").select(f"l_{FID}", f"r_{FID}")
        every = left.df.where(F.col(GEOM).isNotNull()).select(*(F.col(f"`{c}`").alias(f"l_{c}") for c in left.df.columns)).join(right.df.where(F.col(GEOM).isNotNull()).select(*(F.col(f"`{c}`").alias(f"r_{c}") for c in right.df.columns)))
        return every.join(hit, [f"l_{FID}", f"r_{FID}"], "left_anti")
    if condition != "distance":
        return met(left.df, right.df, condition, left.geometry_type, right.geometry_type)
    if radius is None and n is None:
        raise ValueError("a distance join needs a radius, or n, or both")
    if geodetic:
        return geodesic.pairs_within(left, right, radius) if n is None else geodesic.nearest(left, right, n, radius)
    if radius is None:
        return _nearest(left, right, n)
    if n is None and left.geometry_type == right.geometry_type == "Point" and _places_repeat(left.df, right.df):
        return _by_places(left.df, right.df, radius)
    out = candidates(left.df, right.df, radius)
    out = out.withColumn("distance", planar_distance(lg, rg, left.geometry_type, right.geometry_type)).where(F.col("distance") <= radius)
    return out if n is None else _first(out, n)


def _places_repeat(left: DataFrame, right: DataFrame) -> bool:
    """Whether there are far more pairs of points than of different places."""
    told = [df.where(F.col(GEOM).isNotNull()).agg(F.count("*").alias("n"), F.approx_count_distinct(F.struct(G.x(F.col(GEOM)), G.y(F.col(GEOM)))).alias("d")) for df in (left, right)]
    m, n = told[0].unionAll(told[1]).collect()
    return m["n"] * n["n"] > 4 * max(m["d"], 1) * max(n["d"], 1)


def _by_places(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """pairs_of() points within a radius: places are paired and measured once, then their points are listed."""
    place = lambda df, names: df.where(F.col(GEOM).isNotNull()).withColumns(dict(zip(names, (G.x(F.col(GEOM)), G.y(F.col(GEOM))), strict=True)))
    a, b = (place(df.select(*(F.col(f"`{c}`").alias(f"{s}_{c}") for c in df.columns), GEOM), names).drop(GEOM) for df, s, names in ((left, "l", ("__x", "__y")), (right, "r", ("__u", "__v"))))
    spots = [f.select(*(F.col(c) for c in names)).distinct().select(G.point(F.col(names[0]), F.col(names[1])).alias(GEOM)) for f, names in ((a, ("__x", "__y")), (b, ("__u", "__v")))]
    lg, rg = F.col(f"l_{GEOM}"), F.col(f"r_{GEOM}")
    met = candidates(*spots, radius).withColumn("distance", planar_distance(lg, rg, "Point", "Point")).where(F.col("distance") <= radius)
    met = met.select(G.x(lg).alias("__px"), G.y(lg).alias("__py"), G.x(rg).alias("__qx"), G.y(rg).alias("__qy"), "distance")
    listed = a.join(met, (F.col("__x") == F.col("__px")) & (F.col("__y") == F.col("__py")))
    return dealt_join(listed, b, ["__qx", "__qy"], ["__u", "__v"], [f"l_{FID}"], [f"r_{FID}"]).drop("__x", "__y", "__px", "__py", "__qx", "__qy", "__u", "__v")


#: Pairs that one share of a key holds, about; more, where all keys together would make more than SHARES shares for each core.
CONNECTED = 1 << 22
SHARES = 32
#: Rows of the right side that one share holds at most, about: they are in memory while the left side's stream by.
HELD = 1 << 17


def dealt_join(a: DataFrame, b: DataFrame, left: list[str], right: list[str], aid: list[str], bid: list[str]) -> DataFrame:
    """Equi-join for keys that many rows of both sides have; aid and bid tell rows apart. The pairs of a key are a grid of shares: rows of a are dealt to its
    rows and copied along them, those of b to its columns. The grid is as wide and high as makes the fewest copies, and has no more shares than keep all cores
    busy (or than HELD asks for), so that copies grow with the rows and not with their pairs."""
    keys = [f"__k{i}" for i in range(len(left))]
    cores = a.sparkSession.sparkContext.defaultParallelism
    count = lambda df, by, n: df.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True))).agg(F.count("*").cast("double").alias(n))
    m, n, pairs = F.col("__m"), F.col("__n"), F.col("__m") * F.col("__n")
    counts = count(a, left, "__m").join(count(b, right, "__n"), keys)
    wanted = counts.where((pairs > CONNECTED) | (n > HELD)).join(F.broadcast(counts.agg(F.sum(pairs).alias("__all"))))
    wanted = wanted.withColumn("__shares", F.ceil(pairs / F.greatest(F.lit(CONNECTED), F.col("__all") / (SHARES * cores))))
    wide = F.greatest(F.least(F.round(F.sqrt(F.col("__shares") * n / m)), F.col("__shares")), F.ceil(n / HELD), F.lit(1))
    grid = wanted.withColumn("__wide", wide.cast("int")).withColumn("__high", F.ceil(F.col("__shares") / F.col("__wide")).cast("int"))
    # At most SHARES keys for each core have more than one share by their pairs, and few can have more than HELD rows.
    grid = F.broadcast(grid.select(*keys, "__wide", "__high").where("__wide > 1 OR __high > 1"))
    of = lambda df, by: df.join(grid, [F.col(c) == F.col(k) for c, k in zip(by, keys, strict=True)], "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("__wide", "__high")})
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = of(a, left).withColumn("__at", each("__wide")).withColumn("__share", (F.pmod(F.xxhash64(*aid), F.col("__high")) * F.col("__wide") + F.col("__at")).cast("int"))
    b = of(b, right).withColumn("__at", each("__high")).withColumn("__of", (F.col("__at") * F.col("__wide") + F.pmod(F.xxhash64(*bid), F.col("__wide"))).cast("int"))
    a, b = (df.drop(*keys, "__wide", "__high", "__at") for df in (a, b))
    if not {df.schema[c].dataType.typeName() for df, by in ((a, left), (b, right)) for c in by} & {"float", "double"}:
        # A number of partitions of its own: Spark would put few rows into few tasks, however many pairs they make. By floating numbers it would shuffle once more.
        a, b = (df.repartition(8 * cores, *(F.col(c) for c in by)) for df, by in ((a, [*left, "__share"]), (b, [*right, "__of"])))
    # Merged, as copies are more than Spark's estimate for a broadcast knows of.
    return a.hint("merge").join(b, [*(F.col(c) == F.col(d) for c, d in zip(left, right, strict=True)), F.col("__share") == F.col("__of")]).drop("__share", "__of")


def _first(pairs: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(f"l_{FID}").orderBy("distance", f"r_{FID}"))
    return pairs.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def _nearest(left: FeatureFrame, right: FeatureFrame, n: int) -> DataFrame:
    """The n nearest right features of each left one, ties to the smaller right id. Rings of cells grow fourfold until each left feature has n
    within a distance that the ring surely covers; what is settled leaves the loop, and each ring is kept, so that none is run again."""
    from geoframe.operators.table import checkpointed

    shapes = right.df.where(F.col(GEOM).isNotNull())
    b = F.col(f"{GEOM}.bbox")
    whole = [F.min(b["xmin"]), F.max(b["xmax"]), F.min(b["ymin"]), F.max(b["ymax"]), F.count("*")]
    x1, x2, y1, y2, total = shapes.agg(*whole).first()
    open_ = left.df.where(F.col(GEOM).isNotNull())
    u1, u2, v1, v2, waiting = open_.agg(*whole).first()
    if not total or not waiting:
        return candidates(left.df.limit(0), right.df.limit(0)).withColumn("distance", F.lit(0.0))
    # What n of the right features take up on average; less, where cells of that size, as most of the features see them, hold more.
    reach = max(x2 - x1, y2 - y1, 1e-9) * (max(n, 1) / total) ** 0.5
    cells = shapes.groupBy(F.floor(b["xmin"] / reach), F.floor(b["ymin"] / reach)).agg(F.count("*").alias("n"))
    met = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
    reach *= min(1.0, max(1e-3, 1.5 * (max(n, 1) / met) ** 0.5))
    extent = max(max(x2, u2) - min(x1, u1), max(y2, v2) - min(y1, v1), reach)
    found = []
    while True:
        last = reach >= 2 * extent
        met = candidates(open_, shapes, reach)
        met = met.withColumn("distance", planar_distance(F.col(f"l_{GEOM}"), F.col(f"r_{GEOM}"), left.geometry_type, right.geometry_type))
        met = met if last else met.where(F.col("distance") <= reach)
        per = F.count("*").over(Window.partitionBy(f"l_{FID}"))
        met = checkpointed(_first(met, n).withColumn("__k", per))
        enough = met if last else met.where(F.col("__k") >= min(n, total))
        found.append(enough.drop("__k"))
        settled = enough.select(F.col(f"l_{FID}").alias(FID)).distinct()
        if last or settled.count() >= waiting:
            return reduce(DataFrame.unionByName, found)
        open_ = checkpointed(open_.join(settled, FID, "left_anti").select(*left.df.columns))
        waiting = open_.count()
        reach *= 4


def spatial_join(left: FeatureFrame, right: FeatureFrame, condition: str, subkey=None, keepall: bool = False, clip=None, radius: float | None = None, n: int | None = None, geodetic: bool | None = None, distance: bool = False) -> FeatureFrame:
    """Pairs of features: the left one's fields, the right one's that the left has not, the left geometry (or what clip makes of both).
    radius: in km on the ellipsoid between any features (n of them at most, the nearest first, if n is given), or with geodetic=False in units of the coordinates; n
    alone: by units of the coordinates, or with geodetic=True by km. subkey: a function of (left, right), which give columns by name, to a further test. keepall: left features without a partner once, with nulls."""
    in_km = condition == "distance" and (radius is not None if geodetic is None else geodetic)
    pairs = pairs_of(left, right, condition, radius, n, in_km)
    if subkey is not None:
        pairs = pairs.where(subkey(lambda f: F.col(f"l_{f}"), lambda f: F.col(f"r_{f}")))
    geom = F.col(f"l_{GEOM}") if clip is None else _clip(clip, F.col(f"l_{GEOM}"), F.col(f"r_{GEOM}"), right.geometry_type)
    own = _own_right(left, right)
    more = [F.col("distance")] if distance and condition == "distance" else []
    out = pairs.select(*(F.col(f"l_{f}").alias(f) for f in left.fields), *(F.col(f"r_{f}").alias(f) for f in own), *more, F.col(f"l_{FID}").alias(FID), F.col(f"r_{FID}").alias("__rfid"), geom.alias(GEOM))
    if clip is not None:
        out = out.where(F.col(GEOM).isNotNull())
    if keepall:
        alone = left.df.join(pairs.select(F.col(f"l_{FID}").alias(FID)), FID, "left_anti")
        out = out.unionByName(alone.select(*left.fields, FID, GEOM), allowMissingColumns=True)
    return left.new(out)


def spatial_stats(left: FeatureFrame, right: FeatureFrame, mapping: Sequence[tuple], subkey: str | None = None, keepall: bool = True, key=None) -> DataFrame:
    """A row for each left feature (and value of the right field subkey) with statistics of the right features that it intersects;
    polygons that only touch do not count. keepall: features without any give nulls."""
    pairs = pairs_of(left, right, "intersects")
    if left.geometry_type == "Polygon" and right.geometry_type in ("Polygon", None):
        pairs = pairs.where(~predicate("touches", F.col(f"l_{GEOM}"), F.col(f"r_{GEOM}"), left.geometry_type, right.geometry_type))
    if key is not None:
        pairs = pairs.where(key(lambda f: F.col(f"l_{f}"), lambda f: F.col(f"r_{f}")))
    rows = pairs.select(F.col(f"l_{FID}").alias(FID), *(F.col(f"r_{f}").alias(f"r_{f}") for f in right.fields), F.col(f"r_{FID}").alias("__rfid"))
    renamed = [(n, F.col(f"r_{v}") if isinstance(v, str) else v, s) for n, v, s in mapping]
    by = [FID] + ([f"r_{subkey}"] if subkey else [])
    out = stats.aggregated(rows, by, renamed, "__rfid")
    if subkey:
        out = out.withColumnRenamed(f"r_{subkey}", subkey)
    return left.df.drop(GEOM).join(out, FID, "left" if keepall else "inner")


def raster_stats(left: FeatureFrame, cells: DataFrame, grid, mapping: Sequence[tuple], keepall: bool = True) -> DataFrame:
    """A row for each left polygon (and band) with statistics of the raster cells whose middles it holds."""
    a, b, c, d, e, f = grid.affine
    x, y = a * (F.col("col") + 0.5) + b * (F.col("row") + 0.5) + c, d * (F.col("col") + 0.5) + e * (F.col("row") + 0.5) + f
    points = FeatureFrame(cells.select("band", "value", G.point(x, y).alias(GEOM), (F.col("row").cast("long") * grid.width + F.col("col")).alias(FID)), "Point")
    return spatial_stats(left, points, mapping, subkey="band", keepall=keepall)


def connect(starts: FeatureFrame, ends: FeatureFrame, key=None, greatcircle: bool = True, segments: int = 100) -> FeatureFrame:
    """Lines from each start to each end with the same key (a name, a pair of names; None: all pairs), parts of multi geometries apart."""
    parts = lambda f: f.df.withColumn("__p", F.explode(F.col(f"{GEOM}.parts"))).withColumn("__v", F.get(F.get(F.col("__p"), 0), 0)).where("__v IS NOT NULL").withColumns({"__x": F.col("__v.x"), "__y": F.col("__v.y")}).drop("__p", "__v", GEOM)
    a, b = parts(starts), parts(ends)
    lkey, rkey = key if isinstance(key, tuple) else (key, key)
    own = [f for f in ends.fields if f not in starts.fields]
    right = b.select(*own, F.col("__x").alias("__u"), F.col("__y").alias("__w"), *([F.col(rkey).alias("__rk"), F.col(FID).alias("__of_end")] if rkey else []))
    out = dealt_join(a, right, [lkey], ["__rk"], [FID, "__x", "__y"], ["__of_end", "__u", "__w"]) if lkey else spread(a).join(spread(right))
    v, w = G.vertex(F.col("__x"), F.col("__y")), G.vertex(F.col("__u"), F.col("__w"))
    path = G.line(G.great_circle(v["x"], v["y"], w["x"], w["y"], segments)) if greatcircle else G.segment(v, w)
    return starts.new(out.withColumn(GEOM, path).select(*starts.fields, *own, FID, GEOM), geometry_type="LineString")


def closest_point(left: FeatureFrame, right: FeatureFrame) -> FeatureFrame:
    """The point of each left feature that is nearest to the nearest right feature; exact against right points, by kernel edges else."""
    pairs = _nearest(left, right, 1)
    rg, lg = F.col(f"r_{GEOM}"), F.col(f"l_{GEOM}")
    spot = G.nearest_on(lg, G.x(rg), G.y(rg)) if right.geometry_type == "Point" else _closest(lg, rg)
    return left.new(pairs.select(*(F.col(f"l_{f}").alias(f) for f in left.fields), F.col(f"l_{FID}").alias(FID), spot.alias(GEOM)), geometry_type="Point")


def _closest_xy(s, t) -> dict:
    e, f = kernels.edges(s), kernels.edges(t)
    met = kernels.crossings(e, f)
    if met:
        return {"x": met[0][4], "y": met[0][5]}
    best = (float("inf"), (0.0, 0.0))
    for u, v, w, z in e.tolist():
        for p, q in f.reshape(-1, 2).tolist():
            d2 = (w - u) ** 2 + (z - v) ** 2
            k = min(1, max(0, ((p - u) * (w - u) + (q - v) * (z - v)) / d2)) if d2 else 0
            spot = (u + k * (w - u), v + k * (z - v))
            best = min(best, ((spot[0] - p) ** 2 + (spot[1] - q) ** 2, spot))
        d = kernels.point_distance(u, v, f)[0].min()
        best = min(best, (float(d * d), (u, v)))
    return {"x": best[1][0], "y": best[1][1]}


def _closest(a: Column, b: Column) -> Column:
    return of_shapes(lambda s, t: ("Point", [[[tuple(_closest_xy(s, t).values())]]]), "gg", "geometry")(a, b)
