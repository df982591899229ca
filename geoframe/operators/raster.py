"""Rasters: cells as rows (band, col, row, value) and a Grid.  Null values are nodata.

Map algebra is a join on (band, col, row) and an expression; everything else is grouping, windows or moving cells' numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoframe.functions import stats
from geoframe.functions.exprparse import parse
from geoframe.functions.geometry import box
from geoframe.operators import bound
from geoframe.types import GEOM, Grid

CELL = ["band", "col", "row"]
_LIMITS = {"1bit": (0, 1), "int8": (0, 255)}
STATS = {
    "count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "stdev": F.stddev_pop, "var": F.var_pop,
    "majority": lambda v: F.mode(v, True),
}
#: The middle of the distinct values, however often each occurs, and the rarest value.
RANKED = {"median": "distinct_median", "minority": "minority"}


def statistics(rows: DataFrame, by: Sequence[str], named: Sequence[tuple[str, str | Callable]]) -> DataFrame:
    """rows grouped by columns, with statistics (name, statistic) of their value."""
    v = F.col("value")
    plain = [(s(v) if callable(s) else STATS[s](v)).alias(n) for n, s in named if callable(s) or s not in RANKED]
    out = stats.grouped(rows, by, plain, [(n, v, RANKED[s]) for n, s in named if not callable(s) and s in RANKED])
    return out.select(*by, *(n for n, _ in named))


class RasterFrame:
    #: Functions of the operator modules with this raster as their first argument (see operators.bound).
    manage, analyze = (bound.Group(bound.RASTER[g]) for g in ("manage", "analyze"))

    def __init__(self, df: DataFrame, grid: Grid):
        self.df, self.grid = df.select(*CELL, F.col("value").cast("double").alias("value")), grid

    @classmethod
    def empty(cls, spark: SparkSession, grid: Grid, bands: int = 1, value: float | None = None) -> RasterFrame:
        """All cells of a grid with one value."""
        n = grid.width * grid.height
        cell = F.pmod(F.col("id"), F.lit(n))
        rows = spark.range(n * bands).select(F.floor(F.col("id") / n).cast("int").alias("band"), (cell % grid.width).cast("int").alias("col"), F.floor(cell / grid.width).cast("int").alias("row"), F.lit(value).cast("double").alias("value"))
        return cls(rows, grid)

    @classmethod
    def from_lists(cls, spark: SparkSession, bands: Sequence, grid: Grid | None = None) -> RasterFrame:
        """From bands as lists of rows."""
        grid = grid or Grid(len(bands[0][0]), len(bands[0]))
        if any(len(b) != grid.height or any(len(r) != grid.width for r in b) for b in bands):
            raise ValueError("bands must have the grid's size")
        cells = [(i, c, r, None if v is None or v == grid.nodata else float(v)) for i, b in enumerate(bands) for r, line in enumerate(b) for c, v in enumerate(line)]
        return cls(spark.createDataFrame(cells, "band int, col int, row int, value double"), grid)

    def new(self, df: DataFrame, grid: Grid | None = None) -> RasterFrame:
        return RasterFrame(df, grid or self.grid)

    def __len__(self) -> int:
        return self.df.select("band").distinct().count()

    def __repr__(self) -> str:
        return f"<RasterFrame {self.grid.width} x {self.grid.height}, {self.grid.mode}>"

    def band(self, number: int) -> RasterFrame:
        return self.new(self.df.where(F.col("band") == number).withColumn("band", F.lit(0)))

    def add_band(self, other: RasterFrame) -> RasterFrame:
        if (other.grid.width, other.grid.height, other.grid.mode) != (self.grid.width, self.grid.height, self.grid.mode):
            raise ValueError("bands must agree in size and mode")
        top = self.df.agg((F.coalesce(F.max("band"), F.lit(-1)) + 1).alias("__top"))
        return self.new(self.df.unionByName(other.df.join(F.broadcast(top)).withColumn("band", (F.col("band") + F.col("__top")).cast("int")).drop("__top")))

    def cells(self) -> DataFrame:
        """Cells with their corner (x, y) and bbox polygon, by row and column."""
        a, b, c, d, e, f = self.grid.affine
        x = lambda i, j: a * (F.col("col") + i) + b * (F.col("row") + j) + c
        y = lambda i, j: d * (F.col("col") + i) + e * (F.col("row") + j) + f
        return self.df.select("*", x(0, 0).alias("x"), y(0, 0).alias("y"), box(x(0, 0), y(0, 0), x(1, 1), y(1, 1)).alias(GEOM))

    def get(self, x: float, y: float, band: int = 0) -> DataFrame:
        """The cell at a geographic position (none if it is outside)."""
        col, row = self.grid.to_cell(x, y)
        return self.df.where((F.col("band") == band) & (F.col("col") == col) & (F.col("row") == row))

    def set(self, col: int, row: int, value: float | None, band: int = 0) -> RasterFrame:
        here = (F.col("band") == band) & (F.col("col") == col) & (F.col("row") == row)
        return self.new(self.df.withColumn("value", F.when(here, F.lit(value).cast("double")).otherwise(F.col("value"))))

    # Local operators

    def _fit(self, value: Column) -> Column:
        """A value as the mode holds it: whole and within the limits for integers."""
        mode = self.grid.mode
        if mode in _LIMITS:
            lo, hi = _LIMITS[mode]
            return F.when(value.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.floor(value)))).cast("double")
        return F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("double") if mode.startswith("int") else value.cast("double")

    def combine(self, other: RasterFrame | float, how: Callable[[Column, Column], Column]) -> RasterFrame:
        """A cell-wise function of two rasters or a raster and a constant; null where either is."""
        if not isinstance(other, RasterFrame):
            return self.new(self.df.withColumn("value", how(F.col("value"), F.lit(float(other)))))
        b = other.df.withColumnRenamed("value", "__v")
        return self.new(self.df.join(b, CELL).withColumn("value", how(F.col("value"), F.col("__v")).cast("double")))

    def __add__(self, o): return self.combine(o, lambda a, b: a + b)
    def __sub__(self, o): return self.combine(o, lambda a, b: a - b)
    def __mul__(self, o): return self.combine(o, lambda a, b: a * b)
    def __truediv__(self, o): return self.combine(o, lambda a, b: a / F.nullif(b, F.lit(0.0)))
    def __pow__(self, o): return self.combine(o, F.pow)
    def __radd__(self, o): return self + o
    def __rsub__(self, o): return self.combine(o, lambda a, b: b - a)
    def __rmul__(self, o): return self * o
    def __rtruediv__(self, o): return self.combine(o, lambda a, b: b / F.nullif(a, F.lit(0.0)))
    def __rpow__(self, o): return self.combine(o, lambda a, b: F.pow(b, a))
    def __lt__(self, o): return self.combine(o, lambda a, b: (a < b).cast("double"))
    def __le__(self, o): return self.combine(o, lambda a, b: (a <= b).cast("double"))
    def __gt__(self, o): return self.combine(o, lambda a, b: (a > b).cast("double"))
    def __ge__(self, o): return self.combine(o, lambda a, b: (a >= b).cast("double"))
    def equals(self, o): return self.combine(o, lambda a, b: (a == b).cast("double"))
    def differs(self, o): return self.combine(o, lambda a, b: (a != b).cast("double"))
    def __and__(self, o): return self.combine(o, lambda a, b: ((a != 0) & (b != 0)).cast("double"))
    def __or__(self, o): return self.combine(o, lambda a, b: ((a != 0) | (b != 0)).cast("double"))
    def __xor__(self, o): return self.combine(o, lambda a, b: ((a != 0) != (b != 0)).cast("double"))

    def compute(self, expr: str | Column, condition: str | Column | None = None) -> RasterFrame:
        """val through an expression, in cells that hold the condition; nodata stays."""
        names = {"val": F.col("value")}
        new = self._fit(parse(expr, names) if isinstance(expr, str) else expr)
        test = None if condition is None else parse(condition, names) if isinstance(condition, str) else condition
        new = new if test is None else F.when(test, new).otherwise(F.col("value"))
        return self.new(self.df.withColumn("value", F.when(F.col("value").isNotNull(), new)))

    def recode(self, condition: str | Column, value: float | None) -> RasterFrame:
        test = parse(condition, {"val": F.col("value")}) if isinstance(condition, str) else condition
        return self.new(self.df.withColumn("value", F.when(test, F.lit(value).cast("double")).otherwise(F.col("value"))))

    def conditional(self, condition: str | Column) -> RasterFrame:
        """1 where the condition holds, else 0."""
        test = parse(condition, {"val": F.col("value")}) if isinstance(condition, str) else condition
        return self.new(self.df.withColumn("value", F.coalesce(test, F.lit(False)).cast("double")), self.grid.with_(mode="1bit"))

    def mask(self) -> DataFrame:
        """col, row, masked: whether a cell is nodata in all bands."""
        return self.df.groupBy("col", "row").agg(F.bool_and(F.col("value").isNull()).alias("masked"))

    def with_mask(self, mask: DataFrame) -> RasterFrame:
        """Nodata where mask (col, row, masked) says so."""
        out = self.df.join(mask, ["col", "row"], "left")
        return self.new(out.withColumn("value", F.when(~F.coalesce("masked", F.lit(False)), F.col("value"))))

    def clear(self) -> RasterFrame:
        return self.new(self.df.withColumn("value", F.lit(None).cast("double")))

    def convert(self, mode: str) -> RasterFrame:
        to = self.new(self.df, self.grid.with_(mode=mode))
        return to.new(to.df.withColumn("value", to._fit(F.col("value"))))

    def is_empty(self) -> bool:
        return self.df.where("value IS NOT NULL").isEmpty()

    # Statistics

    def summarystats(self, *names: str) -> DataFrame:
        names = names or ("count", "sum", "mean", "min", "max", "median", "majority", "minority")
        return statistics(self.df.where("value IS NOT NULL"), ["band"], [(n, n) for n in names])

    def histogram(self, bins: int = 10, band: int = 0) -> DataFrame:
        from geoframe.operators.table import FeatureFrame

        return FeatureFrame(self.df.where(F.col("band") == band).withColumn("__fid", F.lit(0).cast("long"))).histogram("value", bins)

    # Cells moved

    def crop(self, bbox: tuple[float, float, float, float], worldcoords: bool = True) -> RasterFrame:
        """The cells from the one at (x1, y1) to the one at (x2, y2), both in; no resampling."""
        (c1, r1), (c2, r2) = (self.grid.to_cell(bbox[0], bbox[1]), self.grid.to_cell(bbox[2], bbox[3])) if worldcoords else (bbox[:2], bbox[2:])
        c1, c2, r1, r2 = min(c1, c2), max(c1, c2) + 1, min(r1, r2), max(r1, r2) + 1
        c1, c2, r1, r2 = max(0, c1), min(self.grid.width, c2), max(0, r1), min(self.grid.height, r2)
        if c1 >= c2 or r1 >= r2:
            raise ValueError("the box is outside of the raster")
        a, b, _, d, e, _ = self.grid.affine
        x, y = self.grid.to_geo(c1, r1)
        inside = F.col("col").between(c1, c2 - 1) & F.col("row").between(r1, r2 - 1)
        out = self.df.where(inside).withColumn("col", F.col("col") - c1).withColumn("row", F.col("row") - r1)
        return self.new(out, self.grid.with_(width=c2 - c1, height=r2 - r1, affine=(a, b, x, d, e, y)))

    def tiled(self, tilesize: tuple[int, int] | None = None, tiles: tuple[int, int] = (10, 10)) -> DataFrame:
        """Cells with tile_x, tile_y; tiles cover the whole raster, those at the far edges may be smaller."""
        w, h = tilesize or (max(1, -(-self.grid.width // tiles[0])), max(1, -(-self.grid.height // tiles[1])))
        return self.df.withColumn("tile_x", F.floor(F.col("col") / w).cast("int")).withColumn("tile_y", F.floor(F.col("row") / h).cast("int"))

    def roll(self, x: float = 0, y: float = 0, worldcoords: bool = False) -> RasterFrame:
        a, _, _, _, e, _ = self.grid.affine
        dx, dy = (round(x / a), round(y / e)) if worldcoords else (int(x), int(y))
        return self.new(self.df.withColumn("col", F.pmod(F.col("col") + dx, F.lit(self.grid.width)).cast("int")).withColumn("row", F.pmod(F.col("row") + dy, F.lit(self.grid.height)).cast("int")))

    def upscale(self, width: int, height: int, stat: str | Callable = "mean") -> RasterFrame:
        """Blocks of cells made one; width and height must not exceed the raster's."""
        fx, fy = max(1, round(self.grid.width / width)), max(1, round(self.grid.height / height))
        w, h = -(-self.grid.width // fx), -(-self.grid.height // fy)
        blocks = self.df.select("band", F.floor(F.col("col") / fx).cast("int").alias("col"), F.floor(F.col("row") / fy).cast("int").alias("row"), "value")
        out = statistics(blocks, CELL, [("made", stat)]).select(*CELL, F.col("made").cast("double").alias("value"))
        a, b, c, d, e, f = self.grid.affine
        return self.new(out, self.grid.with_(width=w, height=h, affine=(a * fx, b * fy, c, d * fx, e * fy, f)))

    def reproject(self, tocrs: str, method: str = "nearest", grid: Grid | None = None) -> RasterFrame:
        """The raster in another projection: the middle of each cell of the target grid is taken back to the raster's own projection, and valued there as
        resample() does. Without a grid the target has as many cells, over the bbox of 21 x 21 reprojected points of the raster's."""
        from geoframe.functions.crs import reproject_bbox, transformer

        if grid is None:
            x1, y1, x2, y2 = reproject_bbox(self.df.sparkSession, self.grid.bbox, self.grid.crs, tocrs)
            grid = Grid.of_bbox((x1, y2, x2, y1), self.grid.width, self.grid.height, mode=self.grid.mode, nodata=self.grid.nodata)
        return self.resample(grid.with_(crs=tocrs), method, transformer(tocrs, self.grid.crs))

    def resample(self, grid: Grid, method: str = "nearest", via: Callable | None = None) -> RasterFrame:
        """Values at the cells' middles of another grid: of the nearest cell, or of 4 (bilinear) or 16 (bicubic) cells around by weight.
        Outside of the raster, and where one of the cells that count is nodata, there is none. via: a function of the columns x and y of a middle to
        those of its place in this raster."""
        target = RasterFrame.empty(self.df.sparkSession, grid).df.select("col", "row")
        a, b, c, d, e, f = grid.affine
        x, y = a * (F.col("col") + 0.5) + b * (F.col("row") + 0.5) + c, d * (F.col("col") + 0.5) + e * (F.col("row") + 0.5) + f
        if via is not None:
            x, y = via(x, y)
            target = target.withColumn("__x", x).withColumn("__y", y).where("__x IS NOT NULL AND __y IS NOT NULL AND NOT isnan(__x) AND NOT isnan(__y)")
            x, y = F.col("__x"), F.col("__y")
        a, b, c, d, e, f = self.grid.inverse
        u, v = a * x + b * y + c, d * x + e * y + f
        rows = target.select("col", "row", u.alias("u"), v.alias("v")).where(f"u >= 0 AND v >= 0 AND u <= {self.grid.width} AND v <= {self.grid.height}")
        if method == "nearest":
            want = rows.withColumn("sc", F.floor("u").cast("int")).withColumn("sr", F.floor("v").cast("int"))
            src = self.df.select("band", F.col("col").alias("sc"), F.col("row").alias("sr"), "value")
            return self.new(want.join(src, ["sc", "sr"]).select(*CELL, "value"), grid)
        reach, kernel = {"bilinear": ((0, 1), _linear), "bicubic": ((-1, 0, 1, 2), _cubic)}[method]
        rows = rows.withColumn("u", F.col("u") - 0.5).withColumn("v", F.col("v") - 0.5)
        offsets = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in reach for j in reach)))
        want = rows.withColumn("o", offsets).withColumn("sc", (F.floor("u") + F.col("o.i")).cast("int")).withColumn("sr", (F.floor("v") + F.col("o.j")).cast("int"))
        want = want.withColumn("w", kernel(F.col("u") - F.col("sc")) * kernel(F.col("v") - F.col("sr")))
        # Cells beyond the edge repeat the edge; centres outside of the raster have no value.
        want = want.where(f"u >= -0.5 AND v >= -0.5 AND u <= {self.grid.width - 0.5} AND v <= {self.grid.height - 0.5}")
        want = want.withColumn("sc", F.greatest(F.lit(0), F.least(F.lit(self.grid.width - 1), "sc"))).withColumn("sr", F.greatest(F.lit(0), F.least(F.lit(self.grid.height - 1), "sr")))
        src = self.df.select("band", F.col("col").alias("sc"), F.col("row").alias("sr"), "value")
        met = want.join(src, ["sc", "sr"]).groupBy(*CELL).agg(F.when(F.count(F.when(F.col("value").isNull() & (F.col("w") != 0), 1)) == 0, F.sum(F.col("w") * F.col("value"))).alias("value"))
        return self.new(met, grid)

    def align(self, grid: Grid) -> RasterFrame:
        """The cells on another grid of the same scale, shifted to its offset (resampled if the shift is no whole number of cells)."""
        if any(abs(p - q) > 1e-12 * max(1, abs(p)) for p, q in zip(self.grid.affine[:2] + self.grid.affine[3:5], grid.affine[:2] + grid.affine[3:5], strict=True)):
            raise ValueError("the grids differ in scale")
        col, row = grid.to_cell(*self.grid.to_geo(0, 0), fraction=True)
        if abs(col - round(col)) > 1e-9 or abs(row - round(row)) > 1e-9:
            return self.resample(grid)
        out = self.df.withColumn("col", (F.col("col") + round(col)).cast("int")).withColumn("row", (F.col("row") + round(row)).cast("int"))
        return self.new(out.where(f"col >= 0 AND row >= 0 AND col < {grid.width} AND row < {grid.height}"), grid)

    def clip(self, inside: DataFrame) -> RasterFrame:
        """Nodata where the cell (col, row) is not among those of inside."""
        hit = inside.select("col", "row").distinct().withColumn("__in", F.lit(True))
        return self.new(self.df.join(hit, ["col", "row"], "left").withColumn("value", F.when(F.col("__in"), F.col("value"))))

    def neighbours(self) -> DataFrame:
        """Each cell with the values of the (up to) 8 around it: band, col, row, n_col, n_row, n_value."""
        around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)))
        seen = self.df.withColumn("o", around).select("band", (F.col("col") + F.col("o.i")).alias("col"), (F.col("row") + F.col("o.j")).alias("row"), F.col("col").alias("n_col"), F.col("row").alias("n_row"), F.col("value").alias("n_value"))
        return seen.where(f"col >= 0 AND row >= 0 AND col < {self.grid.width} AND row < {self.grid.height}")

    def morphology(self, selection: str | Column, pattern: str | Sequence = "edge") -> RasterFrame:
        """Of the cells that hold the selection: dilation and erosion (dilation4, erosion4: edge neighbours only), edge (what erosion takes
        off), or a custom 3 x 3 pattern of 1 (must hold), 0 (must not) and None. 1 or 0; beyond the edge nothing is selected."""
        test = parse(selection, {"val": F.col("value")}) if isinstance(selection, str) else selection
        mine = self.df.withColumn("on", F.coalesce(test, F.lit(False)).cast("int"))
        if isinstance(pattern, str):
            reach = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if not pattern.endswith("4") or not (i and j)]
        else:
            reach = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        spread = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in reach)))
        # Each selected cell tells the cells around where it stands; only those that are told of are counted.
        said = mine.where("on = 1").withColumn("o", spread).groupBy("band", (F.col("col") - F.col("o.i")).alias("col"), (F.col("row") - F.col("o.j")).alias("row")).agg(F.count("*").alias("k"), F.collect_set(F.col("o.i") * 3 + F.col("o.j")).alias("set"))
        out = mine.join(said, CELL, "left")
        k = F.coalesce("k", F.lit(0))
        if isinstance(pattern, str):
            name = pattern.rstrip("48")
            full = k == len(reach)
            new = {"dilation": k > 0, "erosion": full, "edge": (F.col("on") == 1) & ~full}[name]
        else:
            cells = {(i, j): pattern[j + 1][i + 1] for i in (-1, 0, 1) for j in (-1, 0, 1)}
            held = F.coalesce("set", F.array().cast("array<int>"))
            new = F.lit(True)
            for (i, j), want in cells.items():
                if want is not None:
                    there = F.array_contains(held, i * 3 + j)
                    new = new & (there if want else ~there)
        return self.new(out.withColumn("value", new.cast("double")), self.grid.with_(mode="1bit"))

    def gauss(self, radius: float = 3.0) -> RasterFrame:
        """Gaussian smoothing with weights exp(-d2 / (2 r^2)) within int(2.57 r + 1) cells, edges repeated, weights summed to 1. The kernel is a product,
        so columns and rows go one after the other: 2n + 1 neighbours each instead of their square."""
        import math

        rs = int(2.57 * radius + 1)
        weights = [math.exp(-(k * k) / (2 * radius * radius)) for k in range(-rs, rs + 1)]
        total, out = sum(weights), self.df.withColumn("value", F.coalesce("value", F.lit(0.0)))
        for axis, size in (("col", self.grid.width), ("row", self.grid.height)):
            other = [c for c in CELL if c != axis]
            # A cell is source for the targets around it; at the edge it also stands for all that would lie beyond.
            taken = out.withColumn("__t", F.explode(F.sequence(F.greatest(F.lit(0), F.col(axis) - rs), F.least(F.lit(size - 1), F.col(axis) + rs))))
            gap = F.col(axis) - F.col("__t")
            near = F.exp(-(gap * gap) / (2.0 * radius * radius))
            tail = F.array(*map(F.lit, weights))
            beyond_low = F.aggregate(F.slice(tail, F.lit(1), F.greatest(F.lit(0), F.lit(rs) + gap)), F.lit(0.0), lambda s, w: s + w)
            beyond_high = F.aggregate(F.slice(tail, F.lit(rs + 2) + gap, F.greatest(F.lit(0), F.lit(rs) - gap)), F.lit(0.0), lambda s, w: s + w)
            w = near + F.when(F.col(axis) == 0, beyond_low).otherwise(0.0) + F.when(F.col(axis) == size - 1, beyond_high).otherwise(0.0)
            out = taken.groupBy(*other, F.col("__t").cast("int").alias(axis)).agg((F.sum(w * F.col("value")) / total).alias("value"))
        return self.new(out)


def _linear(d: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(d))


def _cubic(d: Column) -> Column:
    t = F.abs(d)
    return F.when(t <= 1, 1.5 * t * t * t - 2.5 * t * t + 1).when(t < 2, -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2).otherwise(0.0)


def mathexpr(expr: str, rasters: Sequence[RasterFrame], band: int = 0) -> RasterFrame:
    """An expression over rast1, rast2, ..., the others resampled to the first one's grid."""
    first = rasters[0]
    out = first.band(band).df.withColumnRenamed("value", "rast1")
    for i, r in enumerate(rasters[1:], 2):
        other = r if r.grid.affine == first.grid.affine and (r.grid.width, r.grid.height) == (first.grid.width, first.grid.height) else r.resample(first.grid)
        out = out.join(other.band(band).df.withColumnRenamed("value", f"rast{i}"), CELL, "left")
    names = {f"rast{i + 1}": F.col(f"rast{i + 1}") for i in range(len(rasters))}
    return RasterFrame(out.withColumn("value", parse(expr, names).cast("double")), first.grid)


def mosaic(rasters: Sequence[RasterFrame], overlaprule: str = "last") -> RasterFrame:
    """Rasters of one grid scale over each other on the first one's grid: the last (or first) value that is no nodata, or min, max, mean."""
    rows = None
    for i, r in enumerate(rasters):
        part = r.align(rasters[0].grid).df.withColumn("__i", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    v = F.col("value")
    order = F.when(v.isNotNull(), F.col("__i"))
    rule = {"last": F.max_by(v, order), "first": F.min_by(v, order), "min": F.min(v), "max": F.max(v), "mean": F.avg(v)}[overlaprule]
    return RasterFrame(rows.groupBy(*CELL).agg(rule.alias("value")), rasters[0].grid)


def union_grid(rasters: Sequence[RasterFrame]) -> Grid:
    """The first raster's grid widened to the bbox of all."""
    g = rasters[0].grid
    corners = [g.to_cell(x, y, True) for r in rasters for x, y in (r.grid.bbox[:2], r.grid.bbox[2:])]
    c1, r1 = (int(min(c[i] for c in corners) // 1) for i in (0, 1))
    c2, r2 = (int(-(-max(c[i] for c in corners) // 1)) for i in (0, 1))
    x, y = g.to_geo(c1, r1)
    a, b, _, d, e, _ = g.affine
    return g.with_(width=c2 - c1, height=r2 - r1, affine=(a, b, x, d, e, y))


def sequence(values: Sequence[float], rasters: Sequence[tuple[float, RasterFrame]]) -> DataFrame:
    """band, col, row, at, value: rasters known at some places of an axis, interpolated at others; outside of them is an error."""
    known = sorted(rasters, key=lambda r: r[0])
    keys = [k for k, _ in known]
    if any(v < keys[0] or v > keys[-1] for v in values):
        raise ValueError("a value is outside of the known rasters")
    out = None
    for v in values:
        i = max(k for k in range(len(keys)) if keys[k] <= v)
        if keys[i] == v:
            rows = known[i][1].df
        else:
            t = (v - keys[i]) / (keys[i + 1] - keys[i])
            rows = known[i][1].combine(known[i + 1][1], lambda a, b, t=t: a + (b - a) * t).df
        rows = rows.withColumn("at", F.lit(float(v)))
        out = rows if out is None else out.unionByName(rows)
    return out


def zonal_statistics(zones: RasterFrame, values: RasterFrame, stat: str | Callable = "mean", paint: bool = False) -> DataFrame:
    """zone, value: a statistic of the values in each zone; painted, the zone raster's cells (col, row) with it. One join, one grouping."""
    z = zones.band(0).df.where("value IS NOT NULL").select("col", "row", F.col("value").alias("zone"))
    v = values if values.grid.affine == zones.grid.affine else values.resample(zones.grid)
    met = z.join(v.band(0).df.where("value IS NOT NULL").select("col", "row", "value"), ["col", "row"])
    out = statistics(met, ["zone"], [("made", stat)]).withColumnRenamed("made", "value")
    return z.join(out, "zone", "left").select("col", "row", "zone", "value") if paint else out


def normalise(raster: RasterFrame, low: float = 0.0, high: float = 255.0) -> RasterFrame:
    """(value - min) / (max - min) of each band, scaled to [low, high]."""
    edge = raster.df.groupBy("band").agg(F.min("value").alias("__a"), F.max("value").alias("__b"))
    v = low + (high - low) * (F.col("value") - F.col("__a")) / F.nullif(F.col("__b") - F.col("__a"), F.lit(0.0))
    return raster.new(raster.df.join(F.broadcast(edge), "band").withColumn("value", v))


def stretch(raster: RasterFrame, center: float = 0.0, low: float = 0.0, high: float = 255.0) -> RasterFrame:
    """Values scaled to [low, high] so that center lies in the middle: the range reaches as far to either side as the farthest value of the band."""
    edge = raster.df.groupBy("band").agg(F.max(F.abs(F.col("value") - center)).alias("__far"))
    v = (low + high) / 2 + (high - low) / 2 * (F.col("value") - center) / F.nullif(F.col("__far"), F.lit(0.0))
    v = F.when(F.col("value").isNotNull(), F.coalesce(v, F.lit((low + high) / 2)))
    return raster.new(raster.df.join(F.broadcast(edge), "band").withColumn("value", v))
