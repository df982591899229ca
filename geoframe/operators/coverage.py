"""Simplification of polygons and lines together, so that neighbours keep the borders they share.

Outlines are split into arcs at the vertices where borders part or lines end; each arc is one row, simplified once, and goes back to all that share it. A run of
vertices is only left out if no other vertex lies between it and the chord that stands for it: as nothing crosses a run, nothing can then cross a chord
or change its side.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.functions import geometry as G
from geoframe.functions import kernels
from geoframe.operators.spatial import candidates
from geoframe.operators.table import FeatureFrame, checkpointed
from geoframe.types import FID, GEOM

_XY = "array<struct<x:double,y:double>>"
_PLACE = [FID, "__i", "__j"]


def _rings(frame: FeatureFrame) -> DataFrame:
    """A row for each ring or line: its vertices in order, the last of a closed ring left out, none twice in a row."""
    parts = frame.df.where(F.col(GEOM).isNotNull()).select(FID, (F.col(f"{GEOM}.type") == "Polygon").alias("__shut"), F.posexplode(F.col(f"{GEOM}.parts")).alias("__i", "__part"))
    rings = parts.select(FID, "__i", "__shut", F.posexplode("__part").alias("__j", "__v"))
    once = F.filter("__v", lambda v, k: (k == 0) | (v != F.get("__v", k - 1)))
    rings = rings.withColumn("__v", once)
    open_ = F.when(F.col("__shut") & (F.size("__v") > 1) & (F.get("__v", 0) == F.element_at("__v", -1)), F.slice("__v", F.lit(1), F.greatest(F.size("__v") - 1, F.lit(1)))).otherwise(F.col("__v"))
    return rings.withColumn("__v", open_)


def _nodes(rings: DataFrame) -> DataFrame:
    """Vertices x, y where other than two different edges meet, or a line ends."""
    n = F.size("__v")
    following = lambda k: F.when(k + 1 < n, F.get("__v", k + 1)).when(F.col("__shut"), F.get("__v", 0))
    edge = F.filter(F.transform("__v", lambda v, k: F.struct(v.alias("a"), following(k).alias("b"))), lambda e: e["b"].isNotNull())
    edges = rings.select(F.explode(edge).alias("e")).select(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).distinct()
    met = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v.x", "v.y").count().where("count <> 2").select("x", "y")
    ends = rings.where("NOT __shut").select(F.explode(F.array(F.get("__v", 0), F.element_at("__v", -1))).alias("v")).select("v.x", "v.y")
    return met.unionByName(ends).distinct()


def _arcs_of(ring: list[tuple[float, float]], nodes: list[bool], shut: bool) -> Iterator[list]:
    """A ring's (or line's) arcs in order, each with both of its ends; a ring without nodes starts at its least vertex."""
    if shut:
        start = nodes.index(True) if any(nodes) else ring.index(min(ring))
        ring, nodes = [*ring[start:], *ring[: start + 1]], [*nodes[start:], *nodes[: start + 1]]
    arc = ring[:1]
    for k in range(1, len(ring)):
        arc.append(ring[k])
        if nodes[k] or k == len(ring) - 1:
            yield arc
            arc = ring[k : k + 1]


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        rows = []
        for fid, i, j, shut, vs in zip(p[FID], p["__i"], p["__j"], p["__shut"], p["__vs"], strict=True):
            ring = [(v["x"], v["y"]) for v in vs]
            for o, arc in enumerate(_arcs_of(ring, [bool(v["node"]) for v in vs], shut)):
                back = arc[::-1] < arc
                line = arc[::-1] if back else arc
                key = hashlib.md5(struct.pack(f"<{2 * len(line)}d", *(c + 0.0 for v in line for c in v))).hexdigest()
                rows.append([fid, i, j, o, back, key, [{"x": x, "y": y} for x, y in line]])
        yield pd.DataFrame(rows, columns=[*_PLACE, "__o", "__back", "__key", "__line"])


def _breaks(line: list[tuple[float, float]], tolerance: float, bent: bool) -> list[int]:
    """Places of the vertices that stay. A closed arc keeps three corners; one that must be bent the vertex farthest from the chord of its ends."""
    xy = np.array(line)
    must = {0, len(line) - 1}
    if len(line) > 2 and (bent or line[0] == line[-1]):
        if line[0] == line[-1]:
            far = int(np.hypot(*(xy - xy[0]).T).argmax())
            must.add(far)
            along = xy[far] - xy[0]
        else:
            along = xy[-1] - xy[0]
        off = np.abs(along[0] * (xy[:, 1] - xy[0, 1]) - along[1] * (xy[:, 0] - xy[0, 0]))
        must.add(int(off.argmax()))
    stay, fixed = {0}, sorted(must)
    for a, b in zip(fixed[:-1], fixed[1:], strict=True):
        k = a
        for v in kernels.simplify(line[a : b + 1], tolerance)[1:-1]:
            k = line.index(tuple(v), k + 1)
            stay.add(k)
        stay.add(b)
    return sorted(stay)


def _runs(arcs: DataFrame, tolerance: float) -> DataFrame:
    """Arcs as runs of vertices (key, order, vertices), of which the ends stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for key, bent, vs in zip(p["__key"], p["__bent"], p["__line"], strict=True):
                line = [(v["x"], v["y"]) for v in vs]
                at = _breaks(line, tolerance, bent)
                rows += [[key, o, [{"x": x, "y": y} for x, y in line[a : b + 1]]] for o, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
            yield pd.DataFrame(rows, columns=["__key", "__o", "__run"])

    return arcs.mapInPandas(run, f"__key string, __o int, __run {_XY}")


def _refused(runs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Runs (key, order) with another vertex between them and their chords, or on one."""
    pockets = runs.where(F.size("__run") > 2).withColumn(GEOM, G.polygon(F.concat("__run", F.slice("__run", 1, 1))))
    met = candidates(vertices.select(G.point(F.col("x"), F.col("y")).alias(GEOM)), pockets)
    at, pocket = F.col(f"l_{GEOM}"), F.col(f"r_{GEOM}")
    x, y = G.x(at), G.y(at)
    b = pocket["bbox"]
    near = G.outline_distance(pocket, x, y) <= 1e-12 * F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])
    own = F.exists(F.col("r___run"), lambda v: (v["x"] == x) & (v["y"] == y))
    return met.where(~own & (G.inside(pocket, x, y) | near)).select(F.col("r___key").alias("__key"), F.col("r___o").alias("__o")).distinct()


def _ordered(order: str, value: Column) -> Column:
    """A group's values in their order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s["v"])


def simplify(frame: FeatureFrame, tolerance: float) -> FeatureFrame:
    """The features with fewer vertices, none left out that is farther than the tolerance from what stands for it; borders that were the same
    stay the same, nothing that did not meet before crosses or overlaps, no ring falls flat and no feature goes.

    Shared borders have to have the same vertices on both sides (snap first), and features may meet at vertices only, not cross. Points and null geometries
    stay as they are; repeated features stay repeated; an empty frame stays empty. All vertices of a ring come together in a task, never those of
    more than one feature."""
    if frame.geometry_type == "Point":
        return frame
    rings = checkpointed(_rings(frame))
    spread = rings.select(*_PLACE, "__shut", F.posexplode("__v").alias("__k", "v")).select(*_PLACE, "__shut", "__k", "v.x", "v.y")
    told = spread.join(_nodes(rings).withColumn("__node", F.lit(True)), ["x", "y"], "left")
    vertex = F.struct("x", "y", F.coalesce("__node", F.lit(False)).alias("node"))
    whole = told.groupBy(*_PLACE, "__shut").agg(_ordered("__k", vertex).alias("__vs"))
    schema = f"{FID} long, __i int, __j int, __o int, __back boolean, __key string, __line {_XY}"
    placed = checkpointed(whole.mapInPandas(_split, schema))
    arcs = placed.groupBy("__key").agg(F.first("__line").alias("__line"))
    ends = [F.get("__line", 0).alias("__u"), F.element_at("__line", -1).alias("__w")]
    twins = arcs.groupBy(*ends).agg((F.count("*") > 1).alias("__bent"))
    runs = checkpointed(_runs(arcs.select("*", *ends).join(twins, ["__u", "__w"]).select("__key", "__bent", "__line"), float(tolerance)))
    refused = _refused(runs, spread.select("x", "y").distinct()).withColumn("__whole", F.lit(True))
    kept = runs.join(refused, ["__key", "__o"], "left")
    stays = F.when(F.col("__whole"), F.col("__run")).otherwise(F.array(F.get("__run", 0), F.element_at("__run", -1)))
    lines = kept.groupBy("__key").agg(F.flatten(_ordered("__o", stays)).alias("__new"))
    back = placed.drop("__line").join(lines, "__key")
    ring = F.flatten(_ordered("__o", F.when(F.col("__back"), F.reverse("__new")).otherwise(F.col("__new"))))
    # Runs and arcs repeat each other's ends.
    made = back.groupBy(*_PLACE).agg(ring.alias("__r")).withColumn("__r", F.filter("__r", lambda v, k: (k == 0) | (v != F.get("__r", k - 1))))
    made = made.withColumn("__r", F.transform("__r", lambda v: G.vertex(v["x"], v["y"])))
    parts = made.groupBy(FID, "__i").agg(_ordered("__j", F.col("__r")).alias("__p"))
    shapes = parts.groupBy(FID).agg(_ordered("__i", F.col("__p")).alias("__parts"))
    out = frame.df.join(shapes, FID, "left").withColumn(GEOM, F.when(F.col("__parts").isNotNull(), G.geometry(F.col(f"{GEOM}.type"), F.col("__parts"), F.col(f"{GEOM}.multi"))).otherwise(F.col(GEOM)))
    return frame.new(out.select(*frame.df.columns))
