"""Module functions as methods of frames, and buffers with a limit of mitres."""

import math

import pytest
from pyspark.sql import functions as F

from geoframe.functions import geometry as G
from geoframe.functions import kernels
from geoframe.operators import bound, spatial
from geoframe.operators.raster import RasterFrame
from geoframe.operators.table import FeatureFrame
from geoframe.types import GEOM, Grid
from tests.test_spatial_levels import boxes, points


def test_frames_have_the_modules_functions(spark):
    some, other = boxes(spark, [(0, 0, 2, 2), (5, 5, 6, 6)]), points(spark, [(1, 1), (5.5, 5.5), (9, 9)], "o")
    got = some.manage.spatial_join(other, "contains").df.select("k", "o").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, spatial.spatial_join(some, other, "contains").df.select("k", "o").collect())) == [(0, 0), (1, 1)]
    assert some.convert.to_points().geometry_type == "Point" and some.manage.merge(some).df.count() == 4
    assert other.analyze.closest_point(other).df.count() == 3
    moved = other.manage.reproject("EPSG:3857")
    assert moved.crs == "EPSG:3857" and moved.df.agg(F.max(f"{GEOM}.bbox.xmax")).first()[0] == pytest.approx(math.radians(9) * 6378137)
    raster = RasterFrame.empty(spark, Grid(4, 4))
    assert raster.manage.crop((0, 0, 2, 2)).df.count() == raster.crop((0, 0, 2, 2)).df.count()
    with pytest.raises(AttributeError):
        some.manage.nothing


@pytest.mark.parametrize(("kind", "groups"), [(FeatureFrame, bound.VECTOR), (RasterFrame, bound.RASTER)])
def test_every_bound_name_is_there(spark, kind, groups):
    frame = points(spark, [(0, 0)]) if kind is FeatureFrame else RasterFrame.empty(spark, Grid(2, 2))
    for group, names in groups.items():
        held = getattr(frame, group)
        assert dir(held) == sorted(names) and all(callable(getattr(held, n)) for n in names)


def test_mitres_reach_no_farther_than_their_limit():
    corner = ("LineString", [[[(0, 0), (10, 0), (10, 10)]]])
    sharp = ("LineString", [[[(0, 0), (10, 0), (0, 2)]]])
    right = kernels.area(kernels.buffer(corner, 1, join="mitre", cap="flat"))
    assert right == pytest.approx(40)  # two strips, the square where they overlap, and the spike's square
    assert kernels.area(kernels.buffer(corner, 1, join="mitre", cap="flat", limit=1.2)) == pytest.approx(39.5) == kernels.area(kernels.buffer(corner, 1, join="bevel", cap="flat"))
    reach = lambda limit: max(x for p in kernels.buffer(sharp, 1, join="mitre", cap="flat", limit=limit)[1] for x, _ in p[0])
    assert reach(20.0) > 19 and reach(5.0) < 11.1


def test_buffers_of_frames_take_a_limit(spark):
    line = FeatureFrame.from_rows(spark, ["i"], [[1]], ['{"type": "LineString", "coordinates": [[0,0],[10,0],[10,10]]}'], geometry_type="LineString")
    area = lambda limit: line.manage.buffer(1.0, join="mitre", cap="flat", mitre_limit=limit).df.select(G.area(F.col(GEOM))).first()[0]
    assert area(5.0) == pytest.approx(40) and area(1.0) == pytest.approx(39.5)
