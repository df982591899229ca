"""Geometry as Catalyst expressions: constructors, measures, predicates of points, paths. No Python runs on the executors.

Every function takes and returns columns of the geometry struct (geoframe.types.GEOMETRY); a null geometry gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoframe.types import GEOMETRY

EARTH_KM = 6371.0


def let(value: Column, body) -> Column:
    """body of value, evaluated once: inside a lambda an expression would be evaluated for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def bbox_struct(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in ((xmin, "xmin"), (ymin, "ymin"), (xmax, "xmax"), (ymax, "ymax"))))


def point(x: Column, y: Column) -> Column:
    """Null where either coordinate is null or not a number."""
    x, y = x.cast("double"), y.cast("double")
    shape = F.struct(F.lit("Point").alias("type"), F.lit(False).alias("multi"), F.array(F.array(F.array(vertex(x, y)))).alias("parts"), bbox_struct(x, y, x, y).alias("bbox"))
    return F.when(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y), shape.cast(GEOMETRY))


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A rectangle, its ring closed and counter-clockwise."""
    x1, y1, x2, y2 = (c.cast("double") for c in (x1, y1, x2, y2))
    ring = F.array(vertex(x1, y1), vertex(x2, y1), vertex(x2, y2), vertex(x1, y2), vertex(x1, y1))
    return F.struct(F.lit("Polygon").alias("type"), F.lit(False).alias("multi"), F.array(F.array(ring)).alias("parts"), bbox_struct(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)).alias("bbox")).cast(GEOMETRY)


def geometry(kind: Column | str, parts: Column, multi: Column | None = None) -> Column:
    """A geometry from part -> ring -> vertex, its bbox from the exterior rings; null without vertices."""
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def whole(p: Column) -> Column:
        outer = F.flatten(F.transform(p, lambda part: F.get(part, 0)))
        # Both go into the inner lambda by its own value: Spark does not hand a Python function an argument in which one lambda uses the variable of another.
        return let(F.struct(p.alias("p"), outer.alias("v")), lambda z: F.when(F.size(z["v"]) > 0, F.struct(
            kind.alias("type"), (F.size(z["p"]) > 1 if multi is None else multi).alias("multi"), z["p"].alias("parts"),
            bbox_struct(F.array_min(F.transform(z["v"], lambda q: q["x"])), F.array_min(F.transform(z["v"], lambda q: q["y"])), F.array_max(F.transform(z["v"], lambda q: q["x"])), F.array_max(F.transform(z["v"], lambda q: q["y"]))).alias("bbox"),
        )))

    return let(parts, whole).cast(GEOMETRY)


def line(vertices: Column) -> Column:
    return geometry("LineString", F.array(F.array(vertices)), F.lit(False))


def segment(a: Column, b: Column) -> Column:
    """line() of two vertices, without functions of arrays, so that rows by the billion are compiled code."""
    bounds = bbox_struct(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]))
    return F.struct(F.lit("LineString").alias("type"), F.lit(False).alias("multi"), F.array(F.array(F.array(a, b))).alias("parts"), bounds.alias("bbox"))


def polygon(ring: Column) -> Column:
    return geometry("Polygon", F.array(F.array(ring)), F.lit(False))


def vertices(geom: Column) -> Column:
    """All vertices, holes included."""
    return F.flatten(F.flatten(geom["parts"]))


def x(geom: Column) -> Column:
    return F.get(F.get(F.get(geom["parts"], 0), 0), 0)["x"]


def y(geom: Column) -> Column:
    return F.get(F.get(F.get(geom["parts"], 0), 0), 0)["y"]


def is_empty(geom: Column) -> Column:
    return F.coalesce(F.size(vertices(geom)) == 0, F.lit(True))


def _along(ring: Column, step) -> Column:
    """The sum of step(previous, next) over the edges of a ring or line."""
    start = F.struct(F.get(ring, 0).alias("p"), F.lit(0.0).alias("s"))
    return F.when(F.size(ring) > 1, F.aggregate(F.slice(ring, 2, F.size(ring)), start, lambda t, v: F.struct(v.alias("p"), (t["s"] + step(t["p"], v)).alias("s")), lambda t: t["s"])).otherwise(F.lit(0.0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def length(geom: Column) -> Column:
    """Planar length of all rings; 0 for points."""
    # Two vertices are the most frequent line, and need no functions of arrays. Catalyst sees through the lookups in a segment() of the same plan, as long as
    # no more than one expression takes a whole array or vertex.
    part = F.get(geom["parts"], 0)
    ring = F.get(part, 0)
    single = F.get(geom["parts"], 1).isNull() & F.get(part, 1).isNull() & F.get(ring, 2).isNull() & F.get(ring, 1)["x"].isNotNull()
    return F.when(single, segment_length(geom)).otherwise(_whole_length(geom))


def segment_length(geom: Column) -> Column:
    """length() of what is known to be a segment(): of the same plan, it is compiled code over the coordinates, and no geometry is made."""
    ring = F.get(F.get(geom["parts"], 0), 0)
    dx, dy = F.get(ring, 1)["x"] - F.get(ring, 0)["x"], F.get(ring, 1)["y"] - F.get(ring, 0)["y"]
    return F.sqrt(dx * dx + dy * dy)


def _whole_length(geom: Column) -> Column:
    return _sum(F.transform(F.flatten(geom["parts"]), lambda r: _along(r, lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])))))


def _ring_area(ring: Column) -> Column:
    # Seen from its first vertex, so that a ring far from the origin loses no digits.
    o = F.get(ring, 0)
    near = F.transform(ring, lambda v: vertex(v["x"] - o["x"], v["y"] - o["y"]))
    return let(near, lambda r: F.abs(_along(F.concat(r, F.array(F.get(r, 0))), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2)


def area(geom: Column) -> Column:
    """Planar area: exterior rings less holes; 0 unless a polygon."""
    parts = _sum(F.transform(geom["parts"], lambda p: _sum(F.transform(p, lambda r, i: F.when(i == 0, _ring_area(r)).otherwise(-_ring_area(r))))))
    return F.when(geom["type"] == "Polygon", parts).when(geom.isNotNull(), F.lit(0.0))


def centroid(geom: Column) -> Column:
    """Area-weighted for polygons (the ring of the vertices' mean if there is no area), length-weighted for lines, the mean for points."""

    def moments(r: Column) -> Column:
        closed = F.concat(r, F.array(F.get(r, 0)))
        cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct(_along(closed, cross).alias("a"), _along(closed, lambda p, q: (p["x"] + q["x"]) * cross(p, q)).alias("x"), _along(closed, lambda p, q: (p["y"] + q["y"]) * cross(p, q)).alias("y"))

    def signed(m: Column, i: Column) -> Column:
        # Holes count against the exterior whichever way their rings run.
        s = F.when(m["a"] < 0, -1.0).otherwise(1.0) * F.when(i == 0, 1.0).otherwise(-1.0)
        return F.struct((s * m["a"]).alias("a"), (s * m["x"]).alias("x"), (s * m["y"]).alias("y"))

    total = lambda ms, k: _sum(F.transform(ms, lambda m: m[k]))
    rings = F.flatten(F.transform(geom["parts"], lambda p: F.transform(p, lambda r, i: signed(moments(r), i))))
    mean = let(vertices(geom), lambda v: point(_sum(F.transform(v, lambda q: q["x"])) / F.size(v), _sum(F.transform(v, lambda q: q["y"])) / F.size(v)))
    by_area = let(rings, lambda ms: F.when(total(ms, "a") != 0, point(total(ms, "x") / (3 * total(ms, "a")), total(ms, "y") / (3 * total(ms, "a")))))
    step = lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))
    lines = F.transform(F.flatten(geom["parts"]), lambda r: F.struct(_along(r, step).alias("a"), _along(r, lambda p, q: step(p, q) * (p["x"] + q["x"]) / 2).alias("x"), _along(r, lambda p, q: step(p, q) * (p["y"] + q["y"]) / 2).alias("y")))
    by_length = let(lines, lambda ms: F.when(total(ms, "a") != 0, point(total(ms, "x") / total(ms, "a"), total(ms, "y") / total(ms, "a"))))
    return F.when(geom["type"] == "Polygon", F.coalesce(by_area, mean)).when(geom["type"] == "LineString", F.coalesce(by_length, mean)).when(geom.isNotNull(), mean)


def overlaps_bbox(geom: Column, xmin, ymin, xmax, ymax) -> Column:
    """Plain comparisons on the stored bbox, which reach a Parquet scan."""
    b = geom["bbox"]
    return (b["xmin"] <= xmax) & (b["xmax"] >= xmin) & (b["ymin"] <= ymax) & (b["ymax"] >= ymin)


def bboxes_overlap(a: Column, b: Column) -> Column:
    return overlaps_bbox(a, b["bbox"]["xmin"], b["bbox"]["ymin"], b["bbox"]["xmax"], b["bbox"]["ymax"])


def bbox_distance(geom: Column, px, py) -> Column:
    b = geom["bbox"]
    dx = F.greatest(b["xmin"] - px, px - b["xmax"], F.lit(0.0))
    dy = F.greatest(b["ymin"] - py, py - b["ymax"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def _edges(geom: Column) -> Column:
    """Edges of all rings as (a, b); a lone vertex is an edge to itself; polygon rings are closed."""

    def of(r: Column) -> Column:
        shut = F.when((geom["type"] == "Polygon") & (F.get(r, 0) != F.element_at(r, -1)), F.concat(r, F.array(F.get(r, 0)))).otherwise(r)
        return let(shut, lambda v: F.when(F.size(v) == 1, F.array(F.struct(F.get(v, 0).alias("a"), F.get(v, 0).alias("b")))).otherwise(F.transform(F.arrays_zip(F.slice(v, F.lit(1), F.size(v) - 1).alias("a"), F.slice(v, F.lit(2), F.size(v) - 1).alias("b")), lambda z: F.struct(z["a"].alias("a"), z["b"].alias("b")))))

    return F.flatten(F.transform(F.flatten(geom["parts"]), of))


def segment_distance(px: Column, py: Column, a: Column, b: Column) -> Column:
    """Planar distance of a point from the segment between two vertices."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(F.when(dx * dx + dy * dy > 0, ((px - a["x"]) * dx + (py - a["y"]) * dy) / (dx * dx + dy * dy)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = px - (a["x"] + t * dx), py - (a["y"] + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def inside(geom: Column, px: Column, py: Column) -> Column:
    """Whether the point is in a polygon's interior by the even-odd rule (so holes are outside); points on an edge are not told apart."""

    def crossings(r: Column) -> Column:
        closed = F.concat(r, F.array(F.get(r, 0)))
        cross = lambda p, q: F.when(((p["y"] > py) != (q["y"] > py)) & (px < (q["x"] - p["x"]) * (py - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]), 1.0).otherwise(0.0)
        return _along(closed, cross)

    return F.exists(geom["parts"], lambda p: _sum(F.transform(p, crossings)) % 2 == 1) & (geom["type"] == "Polygon")


def outline_distance(geom: Column, px: Column, py: Column) -> Column:
    """Distance of a point from the nearest edge or vertex."""
    return F.array_min(F.transform(_edges(geom), lambda e: segment_distance(px, py, e["a"], e["b"])))


def distance_to_point(geom: Column, px: Column, py: Column) -> Column:
    """0 inside a polygon, else the distance from its outline."""
    return F.when(F.coalesce(inside(geom, px, py), F.lit(False)), F.lit(0.0)).otherwise(outline_distance(geom, px, py))


def is_box(geom: Column) -> Column:
    """Whether a geometry is one upright rectangle, so that its bbox is all of it; null or false else. Without lambdas, so it is compiled."""
    ring = F.get(F.get(geom["parts"], 0), 0)
    c = [F.get(ring, k) for k in range(5)]
    same = lambda p, q, *axes: reduce(Column.__and__, [c[p][a] == c[q][a] for a in axes])
    turned = (same(0, 1, "y") & same(1, 2, "x") & same(2, 3, "y") & same(3, 0, "x")) | (same(0, 1, "x") & same(1, 2, "y") & same(2, 3, "x") & same(3, 0, "y"))
    wide = (c[0]["x"] != c[2]["x"]) & (c[0]["y"] != c[2]["y"])
    return (geom["type"] == "Polygon") & (F.size(geom["parts"]) == 1) & (F.size(F.get(geom["parts"], 0)) == 1) & ((F.size(ring) == 4) | (F.size(ring) == 5) & same(4, 0, "x", "y")) & wide & turned


def _in_bbox(geom: Column, px: Column, py: Column) -> Column:
    b = geom["bbox"]
    return (px >= b["xmin"]) & (px <= b["xmax"]) & (py >= b["ymin"]) & (py <= b["ymax"])


def _within_bbox(geom: Column, px: Column, py: Column) -> Column:
    b = geom["bbox"]
    return (px > b["xmin"]) & (px < b["xmax"]) & (py > b["ymin"]) & (py < b["ymax"])


def intersects_point(geom: Column, px: Column, py: Column) -> Column:
    """Whether a geometry and a point share a point: inside, or on the outline."""
    return F.when(is_box(geom), _in_bbox(geom, px, py)).otherwise(inside(geom, px, py) | (outline_distance(geom, px, py) == 0))


def contains_point(geom: Column, px: Column, py: Column) -> Column:
    """Whether the point is in a polygon's interior."""
    return F.when(is_box(geom), _within_bbox(geom, px, py)).otherwise(inside(geom, px, py) & (outline_distance(geom, px, py) > 0))


def touches_point(geom: Column, px: Column, py: Column) -> Column:
    edge = _in_bbox(geom, px, py) & ~_within_bbox(geom, px, py)
    return F.when(is_box(geom), edge).otherwise((geom["type"] == "Polygon") & (outline_distance(geom, px, py) == 0))


def nearest_on(geom: Column, px: Column, py: Column) -> Column:
    """The point of a geometry's outline (of the polygon itself, if it holds the point) nearest to a point."""

    def spot(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.coalesce(F.when(dx * dx + dy * dy > 0, ((px - a["x"]) * dx + (py - a["y"]) * dy) / (dx * dx + dy * dy)), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        sx, sy = a["x"] + t * dx, a["y"] + t * dy
        return F.struct(((px - sx) * (px - sx) + (py - sy) * (py - sy)).alias("d"), sx.alias("x"), sy.alias("y"))

    best = let(F.array_min(F.transform(_edges(geom), spot)), lambda s: point(s["x"], s["y"]))
    return F.when(F.coalesce(inside(geom, px, py), F.lit(False)), point(px, py)).otherwise(best)


def transform(geom: Column, fx, fy) -> Column:
    """Every vertex through fx(x, y), fy(x, y); vertices that become null, infinite or not a number go, and what is empty then is null."""
    fine = lambda v: v["x"].isNotNull() & v["y"].isNotNull() & ~F.isnan(v["x"]) & ~F.isnan(v["y"]) & (F.abs(v["x"]) < F.lit(float("inf"))) & (F.abs(v["y"]) < F.lit(float("inf")))
    rings = F.transform(geom["parts"], lambda p: F.filter(F.transform(p, lambda r: F.filter(F.transform(r, lambda v: vertex(fx(v["x"], v["y"]), fy(v["x"], v["y"]))), fine)), lambda r: F.size(r) > 0))
    return geometry(geom["type"], F.filter(rings, lambda p: F.size(p) > 0), geom["multi"])


def great_circle(x1: Column, y1: Column, x2: Column, y2: Column, segments: int = 100) -> Column:
    """Vertices, `segments` of them ends included, of the great circle between two lon/lat points; the two ends if they coincide."""
    r = F.radians
    a = F.sin((r(y2) - r(y1)) / 2)
    b = F.sin((r(x2) - r(x1)) / 2)
    d = 2 * F.asin(F.sqrt(a * a + F.cos(r(y1)) * F.cos(r(y2)) * b * b))
    ends = F.array(vertex(x1, y1), vertex(x2, y2))

    def path(d: Column) -> Column:
        def at(i: Column) -> Column:
            f = i / F.lit(float(segments - 1))
            p, q = F.sin((1 - f) * d) / F.sin(d), F.sin(f * d) / F.sin(d)
            u = p * F.cos(r(y1)) * F.cos(r(x1)) + q * F.cos(r(y2)) * F.cos(r(x2))
            v = p * F.cos(r(y1)) * F.sin(r(x1)) + q * F.cos(r(y2)) * F.sin(r(x2))
            w = p * F.sin(r(y1)) + q * F.sin(r(y2))
            return F.when(i == 0, vertex(x1, y1)).when(i == segments - 1, vertex(x2, y2)).otherwise(vertex(F.degrees(F.atan2(v, u)), F.degrees(F.atan2(w, F.sqrt(u * u + v * v)))))

        return F.when(F.sin(d) == 0, ends).otherwise(F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), at))

    return let(d, path)


def to_geojson(geom: Column, digits: int = 12) -> Column:
    """A GeoJSON geometry as text, coordinates rounded."""
    pair = lambda v: F.array(F.round(v["x"], digits), F.round(v["y"], digits))
    kind = F.when(geom["multi"], F.concat(F.lit("Multi"), geom["type"])).otherwise(geom["type"])
    rings = F.transform(geom["parts"], lambda p: F.transform(p, lambda r: F.transform(r, pair)))
    lines, points = F.transform(rings, lambda p: F.get(p, 0)), F.transform(rings, lambda p: F.get(F.get(p, 0), 0))
    one = lambda c: F.to_json(F.struct(kind.alias("type"), c.alias("coordinates")))
    t, m = geom["type"], geom["multi"]
    return (
        F.when((t == "Point") & m, one(points)).when(t == "Point", one(F.get(points, 0))).when((t == "LineString") & m, one(lines))
        .when(t == "LineString", one(F.get(lines, 0))).when(m, one(rings)).otherwise(one(F.get(rings, 0)))
    )


def from_geojson(text: Column) -> Column:
    """The geometry that a GeoJSON text describes; null if it is no Point, LineString, Polygon or Multi of them."""
    kind = F.get_json_object(text, "$.type")
    coords = F.get_json_object(text, "$.coordinates")
    v = lambda c: vertex(F.get(c, 0), F.get(c, 1))
    ring = lambda r: F.transform(r, v)
    p1, p2, p3, p4 = (F.from_json(coords, "array<" * n + "double" + ">" * n) for n in (1, 2, 3, 4))
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(v(p1))))).when(kind == "MultiPoint", F.transform(p2, lambda c: F.array(F.array(v(c)))))
        .when(kind == "LineString", F.array(F.array(ring(p2)))).when(kind == "MultiLineString", F.transform(p3, lambda c: F.array(ring(c))))
        .when(kind == "Polygon", F.array(F.transform(p3, ring))).when(kind == "MultiPolygon", F.transform(p4, lambda p: F.transform(p, ring)))
    )
    return F.when(parts.isNotNull(), geometry(F.regexp_replace(kind, "^Multi", ""), parts, kind.startswith("Multi")))
