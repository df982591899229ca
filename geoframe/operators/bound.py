"""Functions of the operator modules as methods of a frame: frame.manage.cut(other), frame.analyze.closest_point(other), frame.convert.to_points().

A frame's group is looked up when it is asked for, and so is the module that a function is in; the frame goes in as its first argument.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, update_wrapper
from importlib import import_module

#: Group, then method: module and function, where that has another name.
VECTOR = {
    "manage": {"crop": "overlay", "tiled": "overlay", "where": "spatial", "spatial_join": "spatial", "split": "table.FeatureFrame", "merge": "table.FeatureFrame", "clean": "overlay", "snap": "overlay", "connect": "spatial", "buffer": "overlay", "cut": "overlay", "reproject": "overlay"},
    "analyze": {"spatial_stats": "spatial", "raster_stats": "spatial", "closest_point": "spatial"},
    "convert": {"to_points": "overlay", "to_lines": "overlay", "convex_hull": "overlay", "enclose": "overlay", "tessellate": "tessellation", "rasterize": "rastervec"},
}
RASTER = {
    "manage": {m: "raster.RasterFrame" for m in ("resample", "roll", "align", "upscale", "crop", "tiled", "reproject")} | {"clip": "rastervec", "vectorize": "rastervec"},
    "analyze": {"zonal_statistics": "raster", "morphology": "raster.RasterFrame", "gauss": "raster.RasterFrame", "summarystats": "raster.RasterFrame", "histogram": "raster.RasterFrame"},
}


class Bound:
    """The functions of one group with a frame as their first argument."""

    def __init__(self, frame, places: dict[str, str]) -> None:
        self._frame, self._places = frame, places

    def __getattr__(self, name: str) -> Callable:
        if name.startswith("_") or name not in self._places:
            raise AttributeError(f"no such method: {name}")
        module, _, inner = self._places[name].partition(".")
        home = import_module(f"geoframe.operators.{module}")
        function = getattr(getattr(home, inner) if inner else home, name)
        return update_wrapper(partial(function, self._frame), function)

    def __dir__(self) -> list[str]:
        return sorted(self._places)


class Group:
    """An attribute of a class of frames that binds a group's functions."""

    def __init__(self, places: dict[str, str]) -> None:
        self._places = places

    def __get__(self, frame, owner=None):
        return self if frame is None else Bound(frame, self._places)
