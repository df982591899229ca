"""Between rasters and features: rasterize, vectorize, interpolate, smooth, density, disperse, distance.

Features are listed under the cells of their bboxes, cells are tested at their middles, and a grouping by cell makes the values; nothing goes
over features one by one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoframe.functions import geometry as G
from geoframe.functions import stats
from geoframe.operators.components import components
from geoframe.operators.raster import CELL, RasterFrame
from geoframe.operators.table import FeatureFrame, checkpointed
from geoframe.types import FID, GEOM, Grid


def _corner(grid: Grid, col: Column, row: Column, at: float = 0.0) -> tuple[Column, Column]:
    a, b, c, d, e, f = grid.affine
    return a * (col + at) + b * (row + at) + c, d * (col + at) + e * (row + at) + f


def _place(grid: Grid, x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = grid.inverse
    return a * x + b * y + c, d * x + e * y + f


def covered(frame: FeatureFrame, grid: Grid) -> DataFrame:
    """Features' columns with every cell (col, row) that they cover: a point's cell, cells whose middle a polygon holds, cells that a line passes."""
    rows = frame.df.where(F.col(GEOM).isNotNull())
    col, row = F.col("col"), F.col("row")
    if frame.geometry_type == "Point":
        u, v = _place(grid, G.x(F.col(GEOM)), G.y(F.col(GEOM)))
        out = rows.withColumn("col", F.floor(u).cast("int")).withColumn("row", F.floor(v).cast("int"))
        return out.where((col >= 0) & (row >= 0) & (col < grid.width) & (row < grid.height))
    b = F.col(f"{GEOM}.bbox")
    corners = [_place(grid, b[x], b[y]) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
    lo = lambda k, n: F.greatest(F.lit(0), F.floor(F.least(*(c[k] for c in corners))).cast("int"))
    hi = lambda k, n: F.least(F.lit(n - 1), F.floor(F.greatest(*(c[k] for c in corners))).cast("int"))
    out = rows.where((lo(0, grid.width) <= hi(0, grid.width)) & (lo(1, grid.height) <= hi(1, grid.height)))
    out = out.withColumn("col", F.explode(F.sequence(lo(0, grid.width), hi(0, grid.width)))).withColumn("row", F.explode(F.sequence(lo(1, grid.height), hi(1, grid.height))))
    x, y = _corner(grid, col, row, 0.5)
    if frame.geometry_type == "LineString":
        size = max(abs(grid.affine[0]), abs(grid.affine[4]))
        return out.where(G.outline_distance(F.col(GEOM), x, y) <= size / 2)
    return out.where(G.inside(F.col(GEOM), x, y))


def rasterize(frame: FeatureFrame, grid: Grid, value: str | Column | None = None, stat: str | Callable | None = None, priority: Column | None = None, partial: Column | None = None) -> RasterFrame:
    """Without a value 1 where there is a feature, else 0. With one, a statistic of the values of the features in a cell; priority picks
    the feature for which it is largest; partial weighs each value in a cell before the statistic (it may use col and row)."""
    met = covered(frame, grid)
    every = RasterFrame.empty(frame.df.sparkSession, grid).df.select("band", "col", "row")
    if value is None:
        on = met.select("col", "row").distinct().withColumn("value", F.lit(1.0))
        return RasterFrame(every.join(on, ["col", "row"], "left").withColumn("value", F.coalesce("value", F.lit(0.0))), grid.with_(mode="int8"))
    if stat is None and priority is None:
        raise ValueError("a value needs a statistic or a priority")
    v = stats.value_of(value)
    v = v * partial if partial is not None else v
    if priority is not None:
        cells = met.groupBy("col", "row").agg(F.max_by(v, F.struct(priority, F.col(FID))).alias("value"))
    else:
        cells = stats.aggregated(met, ["col", "row"], [("value_", v, stat)]).withColumnRenamed("value_", "value")
    cells = cells.withColumn("value", F.col("value").cast("double"))
    return RasterFrame(every.join(cells, ["col", "row"], "left"), grid)


def vectorize(raster: RasterFrame, merge: bool = False, band: int = 0) -> FeatureFrame:
    """Cells as polygons (col, row, x, y, value); merged: contiguous cells (by edges) of one value as one polygon (value, n_cells, geom)."""
    rows = raster.band(band)
    if not merge:
        cells = rows.cells().where("value IS NOT NULL")
        out = cells.withColumn(FID, F.col("row").cast("long") * raster.grid.width + F.col("col")).drop("band")
        return FeatureFrame(out, "Polygon", raster.grid.crs)
    label = regions(rows)
    # A run of cells is one box: fewer shapes to unite.
    runs = label.groupBy("region", "run", "row").agg(F.min("col").alias("c0"), (F.max("col") + 1).alias("c1"))
    corners = [_corner(raster.grid, F.col(c), F.col("row") + r) for r, c in ((0, "c0"), (0, "c1"), (1, "c1"), (1, "c0"))]
    squares = runs.withColumn(GEOM, G.polygon(F.array(*(G.vertex(x, y) for x, y in [*corners, corners[0]]))))
    from geoframe.operators.overlay import dissolve

    shapes = dissolve(squares.select("region", GEOM), ["region"])
    counted = label.groupBy("region").agg(F.first("value").alias("value"), F.count("*").alias("n_cells"))
    return FeatureFrame(counted.join(shapes, "region").withColumnRenamed("region", FID), "Polygon", raster.grid.crs)


def regions(raster: RasterFrame) -> DataFrame:
    """col, row, value, run and region, the smallest cell number of the contiguous cells of one value. Cells of a row that lie side by side are one run,
    runs of one value that touch are linked, and components of the links are the regions: rounds grow with the logarithm of the number of runs."""
    n = raster.grid.width
    rows = raster.band(0).df.where("value IS NOT NULL").select("col", "row", "value")
    along = Window.partitionBy("row").orderBy("col")
    goes_on = (F.lag("col").over(along) == F.col("col") - 1) & (F.lag("value").over(along) == F.col("value"))
    begins = F.when(F.coalesce(goes_on, F.lit(False)), None).otherwise(F.col("row").cast("long") * n + F.col("col"))
    cells = checkpointed(rows.withColumn("run", F.last(begins, True).over(along)))
    above = cells.select("col", (F.col("row") + 1).alias("row"), F.col("value").alias("v"), F.col("run").alias("up"))
    links = cells.join(above, ["col", "row"]).where(F.col("v") == F.col("value")).select(F.col("run").alias("a"), F.col("up").alias("b"))
    found = components(links)
    return cells.join(found.withColumnRenamed("id", "run"), "run", "left").select("col", "row", "value", "run", F.coalesce("component", "run").alias("region"))


def _point_cells(frame: FeatureFrame, grid: Grid, value) -> DataFrame:
    """Points with their fractional cell place (u, v), cell and value."""
    u, v = _place(grid, G.x(F.col(GEOM)), G.y(F.col(GEOM)))
    rows = frame.df.where(F.col(GEOM).isNotNull()).select(FID, u.alias("u"), v.alias("v"), G.x(F.col(GEOM)).alias("px"), G.y(F.col(GEOM)).alias("py"), stats.value_of(value).cast("double").alias("v_"))
    return rows.withColumn("pc", F.floor("u").cast("int")).withColumn("pr", F.floor("v").cast("int"))


#: Point cells of a block and cells of a part that interpolate() compares in one go.
POINT_BLOCK, CELL_PART = 4096, 65536


def interpolate(frame: FeatureFrame, grid: Grid, value, sensitivity: float = 3.0, stat: str = "mean") -> RasterFrame:
    """Inverse distance weights of all points: a cell that holds points has their statistic, any other sum(w v) / sum(w) with w = d^-s in
    cells. Points are first made one for each cell, so there are no more of them than cells; each cell takes all of them, as the method has it,
    in blocks of point cells and parts of cells, so that no task holds more than one of each."""
    points = _point_cells(frame, grid, value).where(f"pc >= 0 AND pr >= 0 AND pc < {grid.width} AND pr < {grid.height}")
    known = stats.aggregated(points, ["pc", "pr"], [("known", "v_", stat)])
    known = checkpointed(known.where("known IS NOT NULL"))
    blocks, parts = max(1, -(-known.count() // POINT_BLOCK)), max(1, -(-grid.width * grid.height // CELL_PART))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    cells = RasterFrame.empty(frame.df.sparkSession, grid).df.select("band", "col", "row", deal(parts, "col", "row").alias("part"), each(blocks).alias("block"))
    held = known.select("pc", "pr", "known", deal(blocks, "pc", "pr").alias("block"), each(parts).alias("part"))
    d2 = (F.col("col") - F.col("pc")) * (F.col("col") - F.col("pc")) + (F.col("row") - F.col("pr")) * (F.col("row") - F.col("pr"))
    w = F.when(d2 > 0, F.pow(d2.cast("double"), F.lit(-sensitivity / 2)))
    met = cells.join(held, ["block", "part"])
    out = met.groupBy(*CELL).agg(F.coalesce(F.max(F.when(d2 == 0, F.col("known"))), F.sum(w * F.col("known")) / F.sum(w)).alias("value"))
    return RasterFrame(out, grid)


def smooth(frame: FeatureFrame, grid: Grid, radius: float, value=None, method: str = "radial", stat: str | Callable = "sum") -> RasterFrame:
    """radial: at each cell's corner the statistic of value * (1 - d / radius) over the points within the radius, none if there are none;
    gauss: points binned into cells and smoothed, radius in cells."""
    if method == "gauss":
        binned = rasterize(frame, grid, value, stat)
        return binned.gauss(radius)
    size_x, size_y = abs(grid.affine[0]), abs(grid.affine[4])
    points = _point_cells(frame, grid, value)
    rc, rr = int(radius / size_x) + 1, int(radius / size_y) + 1
    cells = points.withColumn("col", F.explode(F.sequence(F.col("pc") - rc, F.col("pc") + rc))).withColumn("row", F.explode(F.sequence(F.col("pr") - rr, F.col("pr") + rr)))
    cells = cells.where(f"col >= 0 AND row >= 0 AND col < {grid.width} AND row < {grid.height}")
    x, y = _corner(grid, F.col("col"), F.col("row"))
    d = F.sqrt((x - F.col("px")) ** 2 + (y - F.col("py")) ** 2)
    near = stats.aggregated(cells.where(d <= radius), ["col", "row"], [("made", F.col("v_") * (1 - d / radius), stat)]).select("col", "row", F.col("made").cast("double").alias("value"))
    every = RasterFrame.empty(frame.df.sparkSession, grid).df.select("band", "col", "row")
    return RasterFrame(every.join(near, ["col", "row"], "left"), grid)


def density(frame: FeatureFrame, grid: Grid, radius: float, method: str = "radial") -> RasterFrame:
    return smooth(frame, grid, radius, F.lit(1.0), method)


def disperse(frame: FeatureFrame, grid: Grid, value, weight: RasterFrame | None = None) -> RasterFrame:
    """Each feature's value spread over its cells in proportion to a weight raster (evenly without); shares of several features add."""
    met = covered(frame, grid)
    if weight is not None:
        w = weight if weight.grid.affine == grid.affine else weight.resample(grid)
        met = met.join(w.band(0).df.select("col", "row", F.col("value").alias("__w")), ["col", "row"], "left")
    else:
        met = met.withColumn("__w", F.lit(1.0))
    met = met.select(FID, "col", "row", stats.value_of(value).cast("double").alias("__v"), "__w")
    total = met.groupBy(FID).agg(F.sum("__w").alias("__s"))
    share = met.join(total, FID).withColumn("__part", F.col("__v") * F.col("__w") / F.nullif(F.col("__s"), F.lit(0.0)))
    cells = share.groupBy("col", "row").agg(F.sum("__part").alias("value"))
    every = RasterFrame.empty(frame.df.sparkSession, grid).df.select("band", "col", "row")
    return RasterFrame(every.join(cells, ["col", "row"], "left"), grid)


def _envelope(gaps: np.ndarray, step: float) -> np.ndarray:
    """For each place i the least sqrt(gaps[k]^2 + (step (i - k))^2) over all k, by one sweep along the lower envelope of the parabolas."""
    squares = (gaps / step) ** 2
    at = np.flatnonzero(np.isfinite(squares))
    if not len(at):
        return np.full(len(gaps), np.nan)
    low, edge = [int(at[0])], [-math.inf]
    for k in at[1:].tolist():
        while True:
            j = low[-1]
            cross = (squares[k] + k * k - squares[j] - j * j) / (2 * (k - j))
            if cross > edge[-1]:
                break
            low.pop()
            edge.pop()
        low.append(k)
        edge.append(cross)
    places = np.arange(len(gaps))
    nearest = np.array(low)[np.searchsorted(np.array(edge), places, "right") - 1]
    return np.sqrt(squares[nearest] + (places - nearest) ** 2) * step


def distance(frame: FeatureFrame, grid: Grid) -> RasterFrame:
    """Distance of each cell's corner from the nearest covered cell's corner, 0 in covered cells. Two passes: the nearest covered
    cell in the same column for every cell (a window), then along each row one sweep, so the work grows with the cells."""
    on = covered(frame, grid).select("col", "row").distinct().withColumn("on", F.col("row"))
    every = RasterFrame.empty(frame.df.sparkSession, grid).df.select("col", "row").join(on, ["col", "row"], "left")
    up = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("col").orderBy("row").rowsBetween(0, Window.unboundedFollowing)
    sy, sx, width = abs(grid.affine[4]), abs(grid.affine[0]), grid.width
    gap = F.least(F.col("row") - F.last("on", True).over(up), F.first("on", True).over(down) - F.col("row")) * sy
    column = every.select("col", "row", gap.cast("double").alias("gap"))

    def swept(rows: pd.DataFrame) -> pd.DataFrame:
        gaps = np.full(width, np.inf)
        gaps[rows["col"].to_numpy()] = rows["gap"].fillna(np.inf).to_numpy()
        return pd.DataFrame({"col": np.arange(width, dtype=np.int32), "row": rows["row"].iloc[0], "value": _envelope(gaps, sx)})

    out = column.groupBy("row").applyInPandas(swept, "col int, row int, value double")
    return RasterFrame(out.select(F.lit(0).alias("band"), "col", "row", F.when(~F.isnan("value"), F.col("value")).alias("value")), grid)


def clip(raster: RasterFrame, frame: FeatureFrame) -> RasterFrame:
    """Nodata outside of the features."""
    return raster.clip(covered(frame, raster.grid))
