"""query(): from, select, where, group by and limit as one plan.

With groups, they form first, the limit counts groups in key order, and where only filters inside a group, so a group that it empties is
still a row (of nulls).  Without groups, where comes before limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.functions import stats
from geoframe.operators.table import FeatureFrame, as_column
from geoframe.types import FID, GEOM


def product(frames: Sequence[tuple[str, FeatureFrame]]) -> DataFrame:
    """All combinations of the rows of several frames, columns as alias.field. An equality in where makes Catalyst join on it instead."""
    (name, first), *rest = frames
    out = first.df.alias(name)
    for n, f in rest:
        out = out.join(f.df.alias(n))
    return out


def query(source: FeatureFrame | DataFrame, select: Sequence[tuple], where=None, groupby: str | Column | Sequence | None = None, limit: int | None = None, geomselect: Column | None = None, order: str = FID) -> DataFrame:
    """select: (name, value) without groups, (name, value, statistic) with them; value is a name, Column or expression text."""
    df = source.df if isinstance(source, FeatureFrame) else source
    condition = None if where is None else as_column(where)
    if groupby is None:
        if condition is not None:
            df = df.where(condition)
        if limit is not None:
            df = (df.orderBy(order) if order in df.columns else df).limit(limit)
        columns = [(as_column(v) if isinstance(v, str) else v).alias(n) for n, v, *_ in select]
        return df.select(*columns, *([geomselect.alias(GEOM)] if geomselect is not None else []))
    keys = [groupby] if isinstance(groupby, str | Column) else list(groupby)
    named = [(F.col(k) if isinstance(k, str) else k).alias(f"__key{i}") for i, k in enumerate(keys)]
    names = [f"__key{i}" for i in range(len(keys))]
    rows = df.select("*", *named)
    if limit is not None:
        first = rows.select(*names).distinct().orderBy(*names).limit(limit)
        first = first.select(*(F.col(n).alias(f"f{n}") for n in names))
        rows = rows.join(first, [F.col(n).eqNullSafe(F.col(f"f{n}")) for n in names], "left_semi")
    out = stats.aggregated(rows, names, select, order, condition, [geomselect.alias(GEOM)] if geomselect is not None else [])
    return out.orderBy(*names).drop(*names)


def to_features(df: DataFrame) -> FeatureFrame:
    """A query's result as a frame; rows without geometry go if it has any geometry column."""
    return FeatureFrame(df.where(F.col(GEOM).isNotNull()) if GEOM in df.columns else df)
