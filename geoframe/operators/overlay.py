"""Operators that make new geometries: clip and crop, tiles, buffers, dissolve, simplify, snap, cut, hulls, faces that lines enclose.

Kernels run through Arrow, feature by feature; unions are made in levels, so that no group's geometries all come to one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoframe.functions import arrangement, arrowshapes, geodesy, kernels
from geoframe.functions import crs as systems
from geoframe.functions import geometry as G
from geoframe.functions.arrowshapes import of_shapes
from geoframe.operators.table import FeatureFrame, checkpointed, spread
from geoframe.types import FID, GEOM, GEOMETRY


def kernel(function: Callable) -> Callable[..., Column]:
    """A column function of a geometry from one of shapes; further arguments are fixed values."""
    return lambda geom, *args: of_shapes(lambda s: function(s, *args), "g", "geometry")(geom)


def combine(a: Column, b: Column, how: str) -> Column:
    """intersection, union, difference or symdifference of two geometry columns; null if either is."""
    return of_shapes(lambda s, t: kernels.combine(s, t, how), "gg", "geometry")(a, b)


def crop(frame: FeatureFrame, bbox: tuple[float, float, float, float]) -> FeatureFrame:
    """What is inside a box; features outside go before any kernel runs, those fully inside and points never see one."""
    x1, y1, x2, y2 = min(bbox[0], bbox[2]), min(bbox[1], bbox[3]), max(bbox[0], bbox[2]), max(bbox[1], bbox[3])
    near = frame.df.where(G.overlaps_bbox(F.col(GEOM), x1, y1, x2, y2))
    if frame.geometry_type == "Point":
        return frame.new(near)
    b = F.col(f"{GEOM}.bbox")
    whole = (b["xmin"] >= x1) & (b["xmax"] <= x2) & (b["ymin"] >= y1) & (b["ymax"] <= y2)
    cut = near.where(~whole).withColumn(GEOM, kernel(kernels.clip_box)(F.col(GEOM), float(x1), float(y1), float(x2), float(y2))).where(F.col(GEOM).isNotNull())
    return frame.new(near.where(whole).unionByName(cut))


def tiled(frame: FeatureFrame, tilesize: tuple[float, float] | None = None, tiles: tuple[int, int] = (5, 5)) -> DataFrame:
    """Features once for each tile (tile_x, tile_y) of the frame's bbox that they reach into, cut to it. Tiles are half-open, those
    at the far edges closed; just tiles[0] x tiles[1] of them."""
    e = frame.bbox().first()
    if e["xmin"] is None:
        return frame.df.withColumn("tile_x", F.lit(0)).withColumn("tile_y", F.lit(0)).limit(0)
    w, h = tilesize or ((e["xmax"] - e["xmin"]) / tiles[0] or 1.0, (e["ymax"] - e["ymin"]) / tiles[1] or 1.0)
    nx, ny = (max(1, -int(-(e["xmax"] - e["xmin"]) // w)), max(1, -int(-(e["ymax"] - e["ymin"]) // h))) if tilesize else tiles
    b = F.col(f"{GEOM}.bbox")
    at = lambda v, lo, size, n: F.least(F.lit(n - 1), F.floor((v - lo) / size)).cast("int")
    out = frame.df.where(F.col(GEOM).isNotNull())
    out = out.withColumn("tile_x", F.explode(F.sequence(at(b["xmin"], e["xmin"], w, nx), at(b["xmax"], e["xmin"], w, nx))))
    out = out.withColumn("tile_y", F.explode(F.sequence(at(b["ymin"], e["ymin"], h, ny), at(b["ymax"], e["ymin"], h, ny))))
    if frame.geometry_type == "Point":
        return out
    x1, y1 = e["xmin"] + F.col("tile_x") * w, e["ymin"] + F.col("tile_y") * h
    return out.withColumn(GEOM, combine(F.col(GEOM), G.box(x1, y1, x1 + w, y1 + h), "intersection")).where(F.col(GEOM).isNotNull())


def buffer(frame: FeatureFrame, distance, geodetic: bool = False, resolution: int = 32, join: str = "round", cap: str = "round", mitre_limit: float = 5.0) -> FeatureFrame:
    """Polygons around the features; distance is a number or a Column. A mitre that reaches farther than mitre_limit times the distance is bevelled. Points (and all geodetic buffers, which are for points) are rings by
    formula, lines and polygons unions of strips and discs."""
    d = distance if isinstance(distance, Column) else F.lit(float(distance))
    rows = frame.df.where(F.col(GEOM).isNotNull())
    if geodetic:
        made = geodesy.buffer_km(F.col(GEOM), d, resolution)
    elif frame.geometry_type == "Point":
        turn = lambda i: 6.283185307179586 * i / resolution
        ring = F.transform(F.sequence(F.lit(0), F.lit(resolution)), lambda i: G.vertex(G.x(F.col(GEOM)) + d * F.cos(turn(i % resolution)), G.y(F.col(GEOM)) + d * F.sin(turn(i % resolution))))
        made = G.polygon(ring)
    else:
        rows = spread(rows)
        made = of_shapes(lambda s, r: kernels.buffer(s, r, resolution, join, cap, mitre_limit), "gv", "geometry")(F.col(GEOM), d.cast("double"))
    return frame.new(rows.withColumn(GEOM, made).where(F.col(GEOM).isNotNull()), geometry_type="Polygon")


#: Shapes that one task unites at most, and how much wider the cells of each pass are.
UNITED, WIDER = 2048, 4


def dissolve(rows: DataFrame, keys: Sequence[str], most: int = UNITED) -> DataFrame:
    """The union of each group's geometries, as a tree: what lies in one cell is united, then what lies in one of the cells around, and so on; borders that
    neighbours share cancel at once, so that what goes up is outlines. No task unites more than `most` shapes: fuller cells are dealt
    out until they are not. Points and lines are united in two levels."""
    rows = rows.where(F.col(GEOM).isNotNull()).select(*keys, GEOM)
    b = F.col(f"{GEOM}.bbox")
    side = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])
    told = rows.agg(F.count("*").alias("n"), F.percentile_approx(side, 0.5).alias("side"), F.min(b["xmin"]).alias("x1"), F.max(b["xmax"]).alias("x2"), F.min(b["ymin"]).alias("y1"), F.max(b["ymax"]).alias("y2"), F.bool_and(F.col(f"{GEOM}.type") == "Polygon").alias("polygons")).first()
    if not told["polygons"]:
        size = F.greatest(4 * (told["side"] or 0) + F.lit(0.0), F.lit(1e-9))
        cell = F.concat_ws(":", F.floor(b["xmin"] / size).cast("string"), F.floor(b["ymin"] / size).cast("string"))
        return _grouped(_grouped(rows.withColumn("__cell", cell), [*keys, "__cell"], kernels.union_all), keys, kernels.union_all)
    if told["n"] <= most:
        return _grouped(rows, keys, kernels.union_all)
    extent = max(told["x2"] - told["x1"], told["y2"] - told["y1"], 1e-300)
    size = max(8 * told["side"], extent / 2**20)
    # Repeated shapes go first: they are united with themselves.
    rows = rows.withColumn("__same", F.col(f"{GEOM}.parts")).groupBy(*keys, "__same").agg(F.first(GEOM).alias(GEOM)).drop("__same")
    while True:
        last = size > 4 * extent
        at = [F.lit(0).cast("long") if last else F.floor(((b[f"{k}min"] + b[f"{k}max"]) / 2 - told[f"{k}1"]) / size).cast("long") for k in "xy"]
        rows = checkpointed(rows.withColumn("__cx", at[0]).withColumn("__cy", at[1]))
        cell = [*keys, "__cx", "__cy"]
        counts = rows.groupBy(*cell).agg(F.count("*").alias("__n")).select(*(F.col(c).alias(f"__of{c}") for c in cell), F.ceil(F.col("__n") / most).cast("int").alias("__shares"))
        fullest = counts.agg(F.max("__shares")).first()[0]
        dealt = rows.withColumn("__own", F.lit(0))
        if fullest > 1:
            dealt = rows.join(counts, [F.col(c).eqNullSafe(F.col(f"__of{c}")) for c in cell])
            dealt = dealt.withColumn("__own", F.pmod(F.xxhash64(f"{GEOM}.parts"), F.col("__shares")).cast("int")).select(*cell, GEOM, "__own")
        rows = _grouped(dealt, [*cell, "__own"], kernels.union_all).select(*keys, GEOM)
        if last and fullest == 1:
            return rows
        size = size * WIDER if fullest == 1 else size


def _grouped(rows: DataFrame, keys: Sequence[str], unite: Callable[[list], tuple | None]) -> DataFrame:
    """keys and geom: one shape of each group's, in the frame's order if it has one."""
    keys = list(keys)
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), f"{GEOM} {GEOMETRY}"])

    def run(t: pa.Table) -> pa.Table:
        if FID in t.column_names:
            t = t.sort_by(FID)
        t = t.combine_chunks()
        shapes = [s for c in t.column(GEOM).chunks for s in arrowshapes.shapes(c) if s is not None]
        return pa.table([*(t.column(k).slice(0, 1) for k in keys), arrowshapes.geometries([unite(shapes)])], names=[*keys, GEOM])

    return rows.groupBy(*keys).applyInArrow(run, schema)


def fold(how: str) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """For aggregate(geometry=...): intersection of a group's geometries, or difference (the first less all others), in the frame's order."""

    def one(shapes: list):
        out = shapes[0] if shapes else None
        for s in shapes[1:]:
            out = kernels.combine(out, s, how) if out else None
        return out

    return lambda rows, keys: _grouped(rows.select(*keys, FID, GEOM), keys, one)


def _cleaned(s, tolerance: float):
    kind, parts = s
    if kind == "Polygon":
        # Even-odd overlay of the shape with itself makes crossing rings simple.
        parts = kernels.overlay([s], lambda state: bool(state[0]))
    out = []
    for part in parts:
        rings = []
        for i, r in enumerate(part):
            q = kernels.simplify(r, tolerance) if tolerance else r
            if kind == "Polygon" and (len(q) < 4 or abs(kernels.ring_area(q)) == 0):
                if i == 0:
                    rings = []
                    break
                continue
            rings.append(q)
        if rings:
            out.append(rings)
    return (kind, out) if out else None


def clean(frame: FeatureFrame, tolerance: float = 0.0, preserve_topology: bool = False) -> FeatureFrame:
    """Valid, simplified geometries; features that have nothing left go. preserve_topology simplifies all features together (see coverage.simplify),
    so that shared borders stay shared; what is valid stays so, and nothing goes."""
    if preserve_topology:
        from geoframe.operators import coverage

        return coverage.simplify(frame, tolerance)
    out = frame.df.where(F.col(GEOM).isNotNull())
    if frame.geometry_type != "Point":
        out = out.withColumn(GEOM, kernel(_cleaned)(F.col(GEOM), float(tolerance)))
    return frame.new(out.where(F.col(GEOM).isNotNull()))


def to_points(frame: FeatureFrame, how: str = "centroid") -> FeatureFrame:
    """centroid: one of each feature (nulls stay); multicentroid: one of each part; vertex: every vertex, holes' too."""
    if how == "centroid":
        out = frame.df.withColumn(GEOM, G.centroid(F.col(GEOM)))
    elif how == "multicentroid":
        part = frame.df.where(F.col(GEOM).isNotNull()).withColumn("__p", F.explode(F.col(f"{GEOM}.parts")))
        out = part.withColumn(GEOM, G.centroid(G.geometry(F.col(f"{GEOM}.type"), F.array(F.col("__p")), F.lit(False)))).drop("__p")
    elif how == "vertex":
        out = frame.df.where(F.col(GEOM).isNotNull()).withColumn("__v", F.explode(G.vertices(F.col(GEOM)))).withColumn(GEOM, G.point(F.col("__v.x"), F.col("__v.y"))).drop("__v")
    else:
        raise ValueError(f"unknown conversion: {how}")
    return frame.new(out, geometry_type="Point")


def to_lines(frame: FeatureFrame, key: str | None = None) -> FeatureFrame:
    """Polygons' exteriors as lines; points, in order, as one line (for each key)."""
    if frame.geometry_type == "Polygon":
        return frame.new(frame.df.withColumn(GEOM, G.geometry("LineString", F.transform(F.col(f"{GEOM}.parts"), lambda p: F.array(F.get(p, 0))), F.col(f"{GEOM}.multi"))), geometry_type="LineString")
    keys = [key] if key else []
    vertex = F.struct(F.col(FID).alias("o"), G.x(F.col(GEOM)).alias("x"), G.y(F.col(GEOM)).alias("y"))
    rows = frame.df.where(F.col(GEOM).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(vertex)).alias("__v"), F.min(FID).alias(FID))
    return frame.new(rows.withColumn(GEOM, G.line(F.transform("__v", lambda v: G.vertex(v["x"], v["y"])))).drop("__v"), geometry_type="LineString")


def snap(frame: FeatureFrame, other: FeatureFrame, tolerance: float) -> FeatureFrame:
    """Vertices moved onto the nearest vertex of the other frame that is within the tolerance."""
    spread = lambda f: f.df.where(F.col(GEOM).isNotNull()).select(FID, F.posexplode(F.col(f"{GEOM}.parts")).alias("__i", "__part")).select(FID, "__i", F.posexplode("__part").alias("__j", "__ring")).select(FID, "__i", "__j", F.posexplode("__ring").alias("__k", "__v"))
    size = max(tolerance, 1e-12)
    cell = lambda c: F.floor(c / size).cast("long")
    mine = spread(frame)
    near = F.sequence(F.lit(-1), F.lit(1))
    around = mine.withColumn("__dx", F.explode(near)).withColumn("__dy", F.explode(near)).withColumn("__cx", cell(F.col("__v.x")) + F.col("__dx")).withColumn("__cy", cell(F.col("__v.y")) + F.col("__dy"))
    targets = spread(other).select(F.col("__v.x").alias("tx"), F.col("__v.y").alias("ty")).distinct().withColumn("__cx", cell(F.col("tx"))).withColumn("__cy", cell(F.col("ty")))
    d = F.sqrt((F.col("__v.x") - F.col("tx")) ** 2 + (F.col("__v.y") - F.col("ty")) ** 2)
    place = [FID, "__i", "__j", "__k"]
    moved = around.join(targets, ["__cx", "__cy"]).where(d <= tolerance).groupBy(*place).agg(F.min(F.struct(d.alias("d"), "tx", "ty")).alias("t"))
    new = mine.join(moved, place, "left").select(*place, F.coalesce("t.tx", "__v.x").alias("x"), F.coalesce("t.ty", "__v.y").alias("y"))
    rings = new.groupBy(FID, "__i", "__j").agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "x", "y"))), lambda v: G.vertex(v["x"], v["y"])).alias("r"))
    parts = rings.groupBy(FID, "__i").agg(F.transform(F.array_sort(F.collect_list(F.struct("__j", "r"))), lambda v: v["r"]).alias("p"))
    whole = parts.groupBy(FID).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "p"))), lambda v: v["p"]).alias("__parts"))
    out = frame.df.join(whole, FID, "left").withColumn(GEOM, G.geometry(F.col(f"{GEOM}.type"), F.col("__parts"), F.col(f"{GEOM}.multi")))
    return frame.new(out.select(*frame.df.columns))


def cut(frame: FeatureFrame, cutter: FeatureFrame) -> FeatureFrame:
    """Lines split where the cutter's lines meet them; polygons split along them, a row for each piece. Points raise. Of a cutter only
    those edges come to a feature whose boxes overlap its own."""
    if frame.geometry_type == "Point":
        raise ValueError("points cannot be cut")
    from geoframe.operators.spatial import candidates

    edge = F.explode(G._edges(F.col(GEOM)))
    blades = cutter.df.where(F.col(GEOM).isNotNull()).select(edge.alias("e"))
    # An edge cuts once, however often and whichever way it is drawn.
    blades = blades.select(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).distinct().select(G.segment(F.col("a"), F.col("b")).alias(GEOM))
    ends = [F.col(f"r_{GEOM}.parts")[0][0][k][c] for k in (0, 1) for c in "xy"]
    met = candidates(frame.df.select(FID, GEOM), blades).select(F.col(f"l_{FID}").alias(FID), F.array(*ends).alias("e"))
    rows = frame.df.join(met.groupBy(FID).agg(F.collect_list("e").alias("__cut")), FID, "left")
    schema = rows.drop("__cut").schema

    def run(batches):
        for b in batches:
            knives = b.column(b.num_columns - 1)
            at, made = [], []
            for i, s in enumerate(arrowshapes.shapes(b.column(b.schema.get_field_index(GEOM)))):
                knife = np.array(knives[i].as_py() or [], float).reshape(-1, 4)
                for piece in _pieces(s, knife) if s else [None]:
                    at.append(i)
                    made.append(piece)
            rows = b.select(schema.names).take(pa.array(at, pa.int64()))
            columns = [arrowshapes.geometries(made) if n == GEOM else rows.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return frame.new(spread(rows).mapInArrow(run, schema))


def _pieces(s, knives: np.ndarray) -> list:
    if not len(knives):
        return [s]
    if s[0] == "Polygon":
        return [("Polygon", [part]) for part in arrangement.split_polygon(kernels.edges(s), knives)]
    lines = ("LineString", [[[tuple(k[:2]), tuple(k[2:])]] for k in knives.tolist()])
    out = []
    for part in s[1]:
        e, _ = kernels.pieces(("LineString", [part]), lines)
        spots = {(round(c[4], 9), round(c[5], 9)) for c in kernels.crossings(kernels.edges(("LineString", [part])), knives)}
        run = [tuple(e[0, :2])]
        for x0, y0, x1, y1 in e.tolist():
            if (round(x0, 9), round(y0, 9)) in spots and len(run) > 1:
                out.append(("LineString", [[run]]))
                run = [(x0, y0)]
            run.append((x1, y1))
        out.append(("LineString", [[run]]))
    return out


def reproject(frame: FeatureFrame, tocrs: str) -> FeatureFrame:
    """The frame in another coordinate system; vertices that have no place there go."""
    return frame.new(systems.reproject(frame.df, frame.crs, tocrs), crs=tocrs)


def convex_hull(frame: FeatureFrame) -> FeatureFrame:
    """Hulls that are polygons; features whose hull is a point or line go."""

    def hull(s):
        ring = kernels.convex_hull([v for p in s[1] for r in p for v in r])
        return ("Polygon", [[ring]]) if len(ring) > 3 else None

    out = frame.df.withColumn(GEOM, kernel(hull)(F.col(GEOM)))
    return frame.new(out.where(F.col(GEOM).isNotNull()), geometry_type="Polygon")


def enclose(frame: FeatureFrame, key: str | None = None) -> FeatureFrame:
    """The polygons that the lines (or outlines) of each key enclose together, numbered from 0 in each (of the whole frame without one: faces can be made of
    any lines, so one task makes them; give a key that bounds the lines)."""
    keys = [key] if key else []
    rows = frame.df.where(F.col(GEOM).isNotNull()).select(*keys, GEOM).withColumn("__all", F.lit(1))
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), f"{FID} long, {GEOM} {GEOMETRY}"])

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        rings = [r for c in t.column(GEOM).chunks for s in arrowshapes.shapes(c) if s[0] != "Point" for p in s[1] for r in (p if s[0] == "LineString" else [[*q, q[0]] if q[0] != q[-1] else q for q in p])]
        made = [("Polygon", [p]) for p in kernels.enclosed(("LineString", [[r] for r in rings]))] if rings else []
        made.sort(key=lambda s: (min(s[1][0][0]), kernels.area(s)))
        same = [t.column(k).take(pa.array([0] * len(made), pa.int64())) for k in keys]
        return pa.table([*same, pa.array(range(len(made)), pa.int64()), arrowshapes.geometries(made)], names=[*keys, FID, GEOM])

    return frame.new(rows.groupBy(*(keys or ["__all"])).applyInArrow(run, schema), geometry_type="Polygon")


def label_points(frame: FeatureFrame, view: tuple[float, float, float, float]) -> FeatureFrame:
    """The centroid of what is in view of each feature."""
    return to_points(crop(frame, view))


def first_of_each(frame: FeatureFrame, key: str) -> DataFrame:
    """The first feature of each key, in the frame's order."""
    w = Window.partitionBy(key).orderBy(FID)
    return frame.df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
