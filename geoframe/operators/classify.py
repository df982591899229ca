"""Class breaks and what is done with them.

Breaks are made from a few aggregated numbers on the driver; values never come there, but for a bounded number of distinct ones, with counts, in natural().
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoframe.functions.stats import number
from geoframe.operators.table import checkpointed

#: Distinct values up to which natural() is exact; more are put into bins: so many of one width, cut again at so many quantiles.
NATURAL_DISTINCT, NATURAL_WIDTHS, NATURAL_QUANTILES = 1 << 18, 1 << 16, 1 << 12


def _range(df: DataFrame, value: Column) -> tuple[float, float, int]:
    r = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if not r[2]:
        raise ValueError("no numbers to classify")
    return r[0], r[1], r[2]


def equal(df: DataFrame, value: Column, classes: int = 5, interval: float | None = None, anchor: float | None = None, start: float | None = None, end: float | None = None) -> list[float]:
    lo, hi, n = _range(df, value)
    lo, hi = lo if start is None else start, hi if end is None else end
    if lo == hi:
        return [lo, lo]
    if interval is None:
        return [lo + i * (hi - lo) / classes for i in range(classes)] + [hi]
    first = lo if anchor is None else anchor + math.floor((lo - anchor) / interval) * interval
    out = [first]
    while out[-1] < hi:
        out.append(first + len(out) * interval)
    return [lo, *out[1:-1], hi]


def log(df: DataFrame, value: Column, classes: int = 5) -> list[float]:
    lo, hi, _ = _range(df, value)
    if lo < 0:
        raise ValueError("logarithmic breaks need values of 0 or more")
    a, b = math.log10(lo + 1), math.log10(hi + 1)
    return [10 ** (a + i * (b - a) / classes) - 1 for i in range(classes + 1)]


def quantile(df: DataFrame, value: Column, classes: int = 5) -> list[float]:
    """Interpolated between neighbours at places i/classes * n of the sorted values."""
    lo, hi, n = _range(df, value)
    if n <= classes:
        v = [r[0] for r in df.select(value.alias("v")).where("v IS NOT NULL").orderBy("v").collect()]
        return [*v, v[-1]]
    places = [i / classes * n for i in range(classes)]
    wanted = sorted({int(p) + k for p in places for k in (0, 1)})
    # Ranks by counts of equal values, summed along them: rows of one value are one row.
    counted = df.select(value.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    ranged = counted.repartitionByRange("v").withColumn("p", F.spark_partition_id())
    inside = checkpointed(ranged.withColumn("upto", F.sum("n").over(Window.partitionBy("p").orderBy("v"))))
    before = inside.groupBy("p").agg(F.sum("n").alias("n"))
    before = before.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    ends = inside.join(F.broadcast(before), "p").select("v", (F.col("upto") + F.col("b") - F.col("n")).alias("lo"), (F.col("upto") + F.col("b")).alias("hi"))
    at = {w: r[0] for r in ends.where(" OR ".join(f"(lo <= {w} AND {w} < hi)" for w in wanted)).select("v", "lo", "hi").collect() for w in wanted if r[1] <= w < r[2]}
    return [(1 - (p - int(p))) * at[int(p)] + (p - int(p)) * at.get(int(p) + 1, hi) for p in places] + [hi]


#: Steps of round numbers, and from which share of a power of ten on each is nearer to what was asked for than the one before it, if wide steps are
#: favoured by 1.5 to 1 (5s by 2.75 to 1), as the published method weighs them.
STEPS, TURNS = (1, 2, 5, 10), (1.4, 2.8, 7.0)


def round_step(width: float) -> float:
    """The round number (1, 2 or 5 times a power of ten) that stands for a class width."""
    power = 10.0 ** math.floor(math.log10(width))
    return STEPS[int(np.searchsorted(TURNS, width / power, "left"))] * power


def _pretty(lo: float, hi: float, classes: int) -> list[float]:
    """Multiples of a round step that cover the range, about as many classes as asked for and a third of them at least."""
    size = max(abs(lo), abs(hi))
    if hi - lo < size * 1e-13:  # nothing to divide: round numbers around the one value
        width = (size if size <= 10 else 9 + size / 10) / max(1, classes) if size else 1.0 / max(1, classes)
    else:
        width = (hi - lo) / classes
    step = round_step(max(width, 1e-300))
    first, last = math.floor(lo / step + 1e-7), math.ceil(hi / step - 1e-7)
    while last - first < classes // 3:
        first, last = (first, last + 1) if (last - first) % 2 == 0 or first == 0 <= lo else (first - 1, last)
    return [k * step for k in range(first, last + 1)]


def pretty(df: DataFrame, value: Column, classes: int = 5) -> list[float]:
    lo, hi, _ = _range(df, value)
    inner = [b for b in _pretty(lo, hi, classes) if lo < b < hi]
    return [lo, *inner, hi]


def stdev(df: DataFrame, value: Column) -> list[float]:
    """Pretty breaks of the standard scores, five classes at least, scaled back."""
    mean, sigma, lo, hi = df.agg(F.avg(value), F.stddev_pop(value), F.min(value), F.max(value)).first()
    if not sigma:
        return [lo, hi]
    a, b = (lo - mean) / sigma, (hi - mean) / sigma
    return [lo, *(z * sigma + mean for z in _pretty(a, b, 5) if a < z < b), hi]


def headtail(df: DataFrame, value: Column) -> list[float]:
    """Split at the mean as long as more values are below it than above: one aggregation for each break."""
    lo, hi, n = _range(df, value)
    out, rows = [lo], df.select(value.alias("v")).where("v IS NOT NULL")
    while n > 1:
        mean = rows.agg(F.avg("v")).first()[0]
        head, tail = rows.agg(F.count_if(F.col("v") >= mean), F.count_if(F.col("v") < mean)).first()
        if tail <= head:
            break
        out.append(mean)
        rows, n = rows.where(F.col("v") >= mean), head
    return [*out, hi]


def _binned(rows: DataFrame, lo: float, hi: float, widths: int, quantiles: int) -> DataFrame:
    """v (mean), last (largest) and n (rows) of each bin that is not empty, of all rows."""
    places = [float(p) for p in np.linspace(0, 1, quantiles + 1)[1:-1]]
    edges = np.unique(np.array(rows.distinct().agg(F.percentile_approx("v", places, 10 * quantiles)).first()[0], float))

    def run(batches):
        for b in batches:
            v = b["v"].to_numpy()
            wide = np.minimum(widths - 1, (v / 2 - lo / 2) / (hi / 2 - lo / 2) * widths).astype(np.int64)
            bins = pd.DataFrame({"bin": wide * (len(edges) + 1) + np.searchsorted(edges, v, "left"), "v": v})
            yield bins.groupby("bin")["v"].agg(["sum", "max", "count"]).reset_index()

    parts = rows.mapInPandas(run, "bin long, sum double, max double, count long")
    return parts.groupBy("bin").agg((F.sum("sum") / F.sum("count")).alias("v"), F.max("max").alias("last"), F.sum("count").alias("n"))


def natural(df: DataFrame, value: Column, classes: int = 5) -> list[float]:
    """Fisher's breaks of least squared deviation within classes, of all rows: exact with at most NATURAL_DISTINCT distinct values, else the best of those between bins."""
    lo, hi, n = _range(df, value)
    rows = df.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    if n <= classes:
        v = sorted(r[0] for r in rows.collect())
        return [*v, v[-1]]
    each = rows.groupBy("v").agg(F.count("*").alias("n")).limit(NATURAL_DISTINCT + 1).toPandas()
    if len(each) > NATURAL_DISTINCT:
        each = _binned(rows, float(lo), float(hi), NATURAL_WIDTHS, NATURAL_QUANTILES).toPandas()
    each = each.sort_values("v")
    v, weight = each["v"].to_numpy(float), each["n"].to_numpy(float)
    last = each["last"].to_numpy(float) if "last" in each else v
    if len(v) <= classes:
        return [float(lo), *last.tolist()]
    ends = _least_deviation(v, weight, classes)
    return [float(lo), *(float(last[i]) for i in ends)]


def _least_deviation(v: np.ndarray, weight: np.ndarray, classes: int) -> list[int]:
    """Where the classes of sorted, weighted values end. The best start of the last class never falls as values are added, so each
    round halves the gaps between settled places and searches between the starts of their neighbours only."""
    size, v = len(v), v - np.average(v, weights=weight)
    w, s, q = (np.r_[0, np.cumsum(weight * x)] for x in (np.ones(size), v, v * v))

    def cost(i, j):  # of v[i..j]
        return q[j + 1] - q[i] - (s[j + 1] - s[i]) ** 2 / (w[j + 1] - w[i])

    best, starts = cost(np.zeros(size, int), np.arange(size)), []
    for c in range(1, classes):
        new, start = np.full(size, np.inf), np.full(size, -1)
        todo = np.array([(c, size - 1, c, size - 1)])  # places, and starts that they may have
        while len(todo):
            a, b, least, most = todo.T
            mid = (a + b) // 2
            most_here = np.minimum(most, mid)
            length = most_here - least + 1
            first = np.cumsum(np.r_[0, length[:-1]])
            segment = np.repeat(np.arange(len(mid)), length)
            i = np.arange(length.sum()) - first[segment] + least[segment]
            costs = best[i - 1] + cost(i, mid[segment])
            low = np.minimum.reduceat(costs, first)
            hit = np.flatnonzero(costs == low[segment])
            _, where = np.unique(segment[hit], return_index=True)
            new[mid], start[mid] = low, i[hit[where]]
            left, right = np.c_[a, mid - 1, least, start[mid]], np.c_[mid + 1, b, start[mid], most]
            todo = np.r_[left[a < mid], right[mid < b]]
        best = new
        starts.append(start)
    out, j = [size - 1], size - 1
    for start in reversed(starts):
        j = int(start[j]) - 1
        out.append(j)
    return out[::-1]


ALGORITHMS = {"equal": equal, "histogram": equal, "log": log, "quantile": quantile, "pretty": pretty, "stdev": stdev, "headtail": headtail, "natural": natural}


def breaks(df: DataFrame, value: Column, algorithm: str | Sequence[float], classes: int = 5, extrabreaks: Sequence[float] = (), exclude: Sequence = (), minval: float | None = None, maxval: float | None = None, **more) -> list[float]:
    """Breaks of the numbers among the values, without excluded ones and those outside [minval, maxval], with extra breaks put in."""
    v = number(value)
    if exclude:
        v = F.when(~v.isin([float(e) for e in exclude]), v)
    if minval is not None:
        v = F.when(v >= minval, v)
    if maxval is not None:
        v = F.when(v <= maxval, v)
    if isinstance(algorithm, str):
        more = more if algorithm in ("stdev", "headtail") else {"classes": classes} | more
        out = ALGORITHMS[algorithm](df, v, **more)
    else:
        out = sorted(algorithm)
    return sorted([*out, *(b for b in extrabreaks if b not in out)]) if extrabreaks else out


def class_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of the class [a, b) that holds a value, the last one closed; equal edges hold just that value; null outside."""
    out = None
    last = len(edges) - 2
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        test = (value == a) if a == b else (value >= a) & (value <= b) if i == last else (value >= a) & (value < b)
        out = F.when(test, i) if out is None else out.when(test, i)
    return out


def find_class(value: Column, edges: Sequence[float]) -> Column:
    """Number of the first closed class [a, b] that holds a value, so an edge is in the lower one; null outside."""
    out = None
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out = F.when((value >= a) & (value <= b), i) if out is None else out.when((value >= a) & (value <= b), i)
    return out


def unique(df: DataFrame, value: Column, only: Sequence | None = None, exclude: Sequence = ()) -> DataFrame:
    """Distinct values with their counts."""
    rows = df.select(value.alias("value"))
    if only is not None:
        rows = rows.where(F.col("value").isin(list(only)))
    if exclude:
        rows = rows.where(~F.col("value").isin(list(exclude)))
    return rows.groupBy("value").agg(F.count("*").alias("n"))


def membership(df: DataFrame, value: Column, ranges: Sequence[tuple[float, float]]) -> DataFrame:
    """df once for each closed range that holds the value (range_id, range_min, range_max), ranges without members once, with nulls."""
    spark = df.sparkSession
    r = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(ranges)], "range_id int, range_min double, range_max double")
    held = F.filter(F.array(*(F.when((value >= a) & (value <= b), F.lit(i)) for i, (a, b) in enumerate(ranges))), lambda i: i.isNotNull())
    rows = df.withColumn("range_id", F.explode(held))
    return F.broadcast(r).join(rows, "range_id", "left")


def rescale(df: DataFrame, value: Column, newmin: float, newmax: float, name: str = "rescaled") -> DataFrame:
    """newmin + (newmax - newmin) * (v - min) / (max - min); newmax if all are equal."""
    edge = df.agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    out = newmin + (newmax - newmin) * (value - F.col("__a")) / F.nullif(F.col("__b") - F.col("__a"), F.lit(0))
    return df.join(F.broadcast(edge)).withColumn(name, F.when(value.isNotNull(), F.coalesce(out, F.lit(float(newmax))))).drop("__a", "__b")


def class_values(classes: int, stops: Sequence) -> list:
    """`classes` values spread linearly over the stops; stops are numbers or tuples."""
    if classes <= 1:
        return [stops[0]]
    out = []
    for c in range(classes):
        rel = c * (len(stops) - 1) / (classes - 1)
        i = min(int(rel), len(stops) - 2) if len(stops) > 1 else 0
        a, b, f = stops[i], stops[min(i + 1, len(stops) - 1)], rel - i
        out.append([x + (y - x) * f for x, y in zip(a, b, strict=True)] if isinstance(a, list | tuple) else a + (b - a) * f)
    return out


class Classifier:
    """Breaks (or unique values) of a column, with a value for each class; immutable, update() makes another."""

    def __init__(self, df: DataFrame, value: Column, algorithm: str | Sequence[float] = "natural", values: Sequence = (0.0, 1.0), classes: int = 5, default=None, **more):
        self.df, self.value, self.algorithm, self.values, self.classes, self.default, self.more = df, value, algorithm, values, classes, default, more
        if algorithm == "unique":
            self.edges = [r["value"] for r in unique(df, value, **more).orderBy("value").collect()]
            self.class_values = values if isinstance(values, dict) else {e: values[i % len(values)] for i, e in enumerate(self.edges)}
        elif algorithm == "proportional":
            lo, hi, _ = _range(df, number(value))
            self.edges, self.class_values = [lo, hi], list(values)
        else:
            self.edges = breaks(df, value, algorithm, classes, **more)
            self.class_values = class_values(len(self.edges) - 1, values)

    def update(self, **changes) -> Classifier:
        return Classifier(**({"df": self.df, "value": self.value, "algorithm": self.algorithm, "values": self.values, "classes": self.classes, "default": self.default} | self.more | changes))

    def find_class(self, value: Column) -> Column:
        return find_class(value, self.edges)

    def apply(self, df: DataFrame | None = None, name: str = "class_value") -> DataFrame:
        """df with the class's value, or the default where there is none."""
        df = self.df if df is None else df
        literal = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list | tuple) else F.lit(v)
        if self.algorithm == "unique":
            out = F.lit(None)
            for k, v in self.class_values.items():
                out = F.when(self.value == k, literal(v)).otherwise(out)
        elif self.algorithm == "proportional":
            (lo, hi), a, b = self.edges, self.class_values[0], self.class_values[-1]
            out = a + (b - a) * (number(self.value) - lo) / ((hi - lo) or 1)
        else:
            number_of = class_of(number(self.value), self.edges)
            out = F.get(F.array(*(literal(v) for v in self.class_values)), number_of)
        return df.withColumn(name, F.coalesce(out, literal(self.default)) if self.default is not None else out)


def cutoff(df: DataFrame, value: Column, percent: float) -> float | None:
    """The smallest value whose share of all values up to it reaches percent."""
    return df.select(value.alias("v")).agg(F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY v)")).first()[0]


def area_sizes(df: DataFrame, value: Column, smallest: float, largest: float, name: str = "size") -> DataFrame:
    """df with a point size whose area grows evenly with the value, from that of the smallest size at the least value to that of the largest at the greatest one."""
    edge = df.agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    share = F.coalesce((value - F.col("__a")) / F.nullif(F.col("__b") - F.col("__a"), F.lit(0.0)), F.lit(0.0))
    size = F.sqrt(F.lit(float(smallest) ** 2) + share * (float(largest) ** 2 - float(smallest) ** 2))
    return df.join(F.broadcast(edge)).withColumn(name, F.when(value.isNotNull(), size)).drop("__a", "__b")
