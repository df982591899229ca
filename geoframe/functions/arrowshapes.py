"""Geometry columns as Arrow arrays on their way to kernels and back."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoframe.functions import kernels

_VERTEX = [("x", pa.float64()), ("y", pa.float64())]
ARROW = pa.struct([("type", pa.string()), ("multi", pa.bool_()), ("parts", pa.list_(pa.list_(pa.list_(pa.struct(_VERTEX))))), ("bbox", pa.struct([(n, pa.float64()) for n in ("xmin", "ymin", "xmax", "ymax")]))])
XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
SPARK = T.StructType([T.StructField("type", T.StringType()), T.StructField("multi", T.BooleanType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(XY)))), T.StructField("bbox", T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")]))])


def shapes(column: pa.Array) -> list:
    return [kernels.shape(g) for g in column.to_pylist()]


def geometries(made: list) -> pa.Array:
    return pa.array([kernels.struct(*s) if s else None for s in made], ARROW)


def of_shapes(function: Callable, inputs: str, result: str) -> Callable[..., Column]:
    """A column function from one of shapes and values. inputs: a letter for each argument, g a geometry, v any value; result: geometry,
    double, boolean or xy. Null geometries give null."""
    kinds = {"geometry": SPARK, "double": T.DoubleType(), "boolean": T.BooleanType(), "xy": XY}
    arrow = {"geometry": ARROW, "double": pa.float64(), "boolean": pa.bool_(), "xy": pa.struct(_VERTEX)}[result]

    def made(*columns: pa.Array) -> pa.Array:
        rows = zip(*(shapes(c) if k == "g" else c.to_pylist() for k, c in zip(inputs, columns, strict=True)), strict=True)
        out = [None if any(v is None for v in r) else function(*r) for r in rows]
        return geometries(out) if result == "geometry" else pa.array(out, arrow)

    def one(a: pa.Array) -> pa.Array:
        return made(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return made(a, b)

    def four(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        return made(a, b, c, d)

    udf = F.arrow_udf({1: one, 2: two, 4: four}[len(inputs)], kinds[result])
    # A kernel that makes geometries must not run again for each expression above it, as Catalyst may have it when it merges projections.
    return udf.asNondeterministic() if result == "geometry" else udf
