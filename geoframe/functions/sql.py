"""Functions for spark.sql: macros are not needed, as each is registered as a SQL function over the geometry struct."""

from __future__ import annotations

from pyspark.sql import SparkSession

from geoframe.functions import geodesy, kernels
from geoframe.functions.arrowshapes import of_shapes


def register(spark: SparkSession) -> list[str]:
    """geo_area, geo_length, geo_intersects and the other predicates, geo_distance, geo_distance_km; point and box constructors are SQL functions."""
    spark.udf.register("geo_area", of_shapes(kernels.area, "g", "double"))
    spark.udf.register("geo_length", of_shapes(kernels.length, "g", "double"))
    for name, f in kernels.PREDICATES.items():
        spark.udf.register(f"geo_{name}", of_shapes(lambda a, b, f=f: bool(f(a, b)), "gg", "boolean"))

    spark.udf.register("geo_distance", of_shapes(kernels.distance, "gg", "double"))
    spark.udf.register("geo_distance_km", geodesy.distance_km)
    vertex = "named_struct('x', double({}), 'y', double({}))"
    bbox = "named_struct('xmin', double({0}), 'ymin', double({1}), 'xmax', double({2}), 'ymax', double({3}))"
    whole = "named_struct('type', '{}', 'multi', false, 'parts', array(array({})), 'bbox', {})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION geo_point(x DOUBLE, y DOUBLE) RETURN {whole.format('Point', 'array(' + vertex.format('x', 'y') + ')', bbox.format('x', 'y', 'x', 'y'))}")
    ring = ", ".join(vertex.format(a, b) for a, b in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"), ("x1", "y1")))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION geo_box(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURN {whole.format('Polygon', 'array(' + ring + ')', bbox.format('least(x1, x2)', 'least(y1, y2)', 'greatest(x1, x2)', 'greatest(y1, y2)'))}")
    return ["geo_point", "geo_box", "geo_area", "geo_length", "geo_distance", "geo_distance_km", *(f"geo_{n}" for n in kernels.PREDICATES)]
