"""Streams against features: a geofence, and counts by grid cell and window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.functions import geometry as G
from geoframe.operators.spatial import Levels, candidates, predicate
from geoframe.operators.table import FeatureFrame, spread
from geoframe.types import FID, GEOM


def geofence(stream: DataFrame, x: Column, y: Column, zones: FeatureFrame) -> DataFrame:
    """Rows of a stream with the fields of the zones that they are in: a stream-static equi-join on grid cells, so no state is kept. A file is often one split, so rows are dealt out."""
    points = spread(stream).withColumn(FID, F.lit(0).cast("long")).withColumn(GEOM, G.point(x, y))
    pairs = candidates(points, zones.df, levels=Levels(None, zones.df))
    pairs = pairs.where(predicate("intersects", F.col(f"l_{GEOM}"), F.col(f"r_{GEOM}"), "Point", zones.geometry_type))
    own = [f for f in zones.fields if f not in stream.columns]
    return pairs.select(*(F.col(f"l_{c}").alias(c) for c in stream.columns), *(F.col(f"r_{f}").alias(f) for f in own))


def cell_counts(stream: DataFrame, time: str, x: Column, y: Column, size: float, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """How many rows fall into each grid cell and time window; state older than the watermark goes."""
    spans = F.window(time, window, slide) if slide else F.window(time, window)
    marked = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return marked.groupBy(spans.alias("window"), F.floor(x / size).alias("cell_x"), F.floor(y / size).alias("cell_y")).agg(F.count("*").alias("n"))
