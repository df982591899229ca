"""The statistics of a field mapping, as aggregate or window expressions.

A field mapping is a list of (output name, value, statistic): value is a column name, a Column, or None for 1; statistic is one of STATS,
"<delimiter>concat", or a function from a Column to a Column.  Missing values (null, NaN) never count; sum, min, max, mean, median, stdev and
var take what can be read as a number; an empty group gives null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoframe.types import FID

NUMERIC = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg, "average": F.avg, "avg": F.avg, "median": F.median, "stdev": F.stddev_pop, "stddev": F.stddev_pop, "var": F.var_pop}
STATS = (*NUMERIC, "count", "first", "last", "majority", "minority")


def value_of(value) -> Column:
    return F.lit(1) if value is None else F.col(value) if isinstance(value, str) else value


def number(value: Column) -> Column:
    """What can be read as a number that is one, else null."""
    d = value.try_cast("double")
    return F.when(~F.isnan(d), d)


def missing_as_null(value: Column) -> Column:
    return F.when(value.isNotNull() & ~F.coalesce(F.isnan(value.try_cast("double")), F.lit(False)), value)


#: Statistics that rank the values of a group: grouped() makes them in steps, so that no group comes together in one task.
RANKED = ("minority", "distinct_median")


def grouped(rows: DataFrame, by: Sequence[str], plain: Sequence[Column], ranked: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """rows grouped by columns: those, the plain aggregates, and for each (name, value, statistic) of RANKED a column; nulls are a group of their own.

    minority: the rarest value, the smallest of them: counted by value first.  distinct_median: the middle of the distinct values, however often each
    occurs, the upper one of two: distinct values lie sorted in ranges of a table, each range's share of a group is counted, and only the range
    that holds a group's middle is ranked."""
    out = rows.groupBy(*by).agg(*(plain or [F.lit(0).alias("__none")])).drop("__none")
    for name, value, statistic in ranked:
        counted = rows.groupBy(*by, value.alias("__v")).agg(F.count("*").alias("__n")).where("__v IS NOT NULL")
        if statistic == "minority":
            told = counted.groupBy(*by).agg(F.min_by("__v", F.struct("__n", "__v")).alias(name))
        else:
            told = _middles(counted.select(*by, "__v"), list(by), name)
        told = told.select(*(F.col(b).alias(f"__of{b}") for b in by), name)
        out = out.join(told, [F.col(b).eqNullSafe(F.col(f"__of{b}")) for b in by], "left").drop(*(f"__of{b}" for b in by)) if by else out.withColumn(name, told.scalar())
    return out


def _middles(distinct: DataFrame, by: list[str], name: str) -> DataFrame:
    from geoframe.operators.table import checkpointed

    ranges = checkpointed(distinct.repartitionByRange(*by, "__v").withColumn("__range", F.spark_partition_id()))
    own = ranges.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*by)
    before = F.sum("__n").over(group.orderBy("__range")) - F.col("__n")
    own = own.withColumn("__before", before).withColumn("__at", F.floor(F.sum("__n").over(group) / 2))
    # The place, in its range, of each group's middle.
    wanted = own.where((F.col("__at") >= F.col("__before")) & (F.col("__at") < F.col("__before") + F.col("__n")))
    wanted = wanted.select(*(F.col(b).alias(f"__w{b}") for b in by), F.col("__range").alias("__wrange"), (F.col("__at") - F.col("__before")).alias("__place"))
    met = ranges.join(wanted, [F.col(b).eqNullSafe(F.col(f"__w{b}")) for b in by] + [F.col("__range") == F.col("__wrange")])
    rank = F.row_number().over(Window.partitionBy(*by, "__range").orderBy("__v")) - 1
    return met.withColumn("__rank", rank).where("__rank = __place").select(*by, F.col("__v").alias(name))


def stat(name, value, order: str = FID, when: Column | None = None) -> Column:
    """One statistic; when keeps only the rows that it holds for, inside the group."""
    raw = value_of(value)
    if when is not None:
        raw = F.when(when, raw)
    if callable(name):
        return name(raw)
    if name in NUMERIC:
        return NUMERIC[name](number(raw))
    v = missing_as_null(raw)
    if name == "count":
        return F.nullif(F.count(v), F.lit(0))
    if name == "first":
        return F.min_by(v, F.when(v.isNotNull(), F.col(order)))
    if name == "last":
        return F.max_by(v, F.when(v.isNotNull(), F.col(order)))
    if name == "majority":
        return F.mode(v, True)
    if name in RANKED:
        raise ValueError(f"{name} is no single aggregate: grouped() makes it")
    if name.endswith("concat"):
        parts = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(F.col(order).alias("o"), v.cast("string").alias("v")))))
        return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda p: p["v"]), name[: -len("concat")]))
    raise ValueError(f"unknown statistic: {name}")


def aggregated(rows: DataFrame, by: Sequence[str], mapping, order: str = FID, when: Column | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """rows grouped by columns, with the statistics of a field mapping; when keeps only the rows that it holds for, inside the groups."""
    plain = [stat(s, v, order, when).alias(n) for n, v, s in mapping if s not in RANKED]
    ranked = [(n, missing_as_null(value_of(v) if when is None else F.when(when, value_of(v))), s) for n, v, s in mapping if s in RANKED]
    return grouped(rows, by, [*plain, *more], ranked).select(*by, *(n for n, _, _ in mapping), *(c for c in _names(rows, more)))


def _names(rows: DataFrame, columns: Sequence[Column]) -> list[str]:
    return rows.limit(0).groupBy().agg(*columns).columns if columns else []
