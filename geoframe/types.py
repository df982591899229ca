"""The geometry struct, and the metadata of feature and raster frames."""

from __future__ import annotations

from dataclasses import dataclass, replace

GEOM, FID = "geom", "__fid"
GEOMETRY = "struct<type:string,multi:boolean,parts:array<array<array<struct<x:double,y:double>>>>,bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>"
#: Columns of a raster frame.
CELLS = "band int, col int, row int, value double"
WGS84 = "+proj=longlat +datum=WGS84 +no_defs"


@dataclass(frozen=True)
class Grid:
    """A raster's georeference: affine (xscale, xskew, xoff, yskew, yscale, yoff), size, and what its values are."""

    width: int
    height: int
    affine: tuple[float, float, float, float, float, float] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    mode: str = "float32"
    nodata: float | None = -9999.0
    crs: str = WGS84

    @classmethod
    def of_bbox(cls, bbox: tuple[float, float, float, float], width: int | None = None, height: int | None = None, cellwidth: float | None = None, cellheight: float | None = None, **more) -> Grid:
        """bbox is xleft, ytop, xright, ybottom. Give the size, or the (positive) cell size: then the size is rounded and the far edges follow."""
        x1, y1, x2, y2 = bbox
        if width is None or height is None:
            if not cellwidth or not cellheight:
                raise ValueError("a grid needs width and height, or cellwidth and cellheight")
            width, height = max(1, round(abs(x2 - x1) / cellwidth)), max(1, round(abs(y2 - y1) / cellheight))
            x2, y2 = x1 + width * cellwidth * (1 if x2 >= x1 else -1), y1 + height * cellheight * (1 if y2 > y1 else -1)
        return cls(width, height, ((x2 - x1) / width, 0.0, x1, 0.0, (y2 - y1) / height, y1), **more)

    @classmethod
    def of_tie(cls, xy_cell: tuple[float, float], xy_geo: tuple[float, float], xscale: float, yscale: float, width: int, height: int, xskew: float = 0.0, yskew: float = 0.0, **more) -> Grid:
        """The grid in which the cell position xy_cell lies at xy_geo."""
        (c, r), (x, y) = xy_cell, xy_geo
        return cls(width, height, (xscale, xskew, x - c * xscale - r * xskew, yskew, yscale, y - c * yskew - r * yscale), **more)

    @classmethod
    def made(cls, width: int | None = None, height: int | None = None, affine: tuple | None = None, xscale: float | None = None, yscale: float | None = None, cellsize: float | None = None, xskew: float = 0.0, yskew: float = 0.0, xoffset: float | None = None, yoffset: float | None = None, xy_cell: tuple[float, float] | None = None, xy_geo: tuple[float, float] | None = None, bbox: tuple[float, float, float, float] | None = None, anchor: str = "corner", **more) -> Grid:
        """From whatever says it, in this order: an affine; scales (cellsize: square cells, rows going south) with offsets, or with a cell position that lies at a
        place; a bbox with the size, or with the scales, which the size then follows. anchor "center": offsets and xy_geo are those of a cell's middle."""
        if cellsize is not None:
            xscale, yscale = cellsize if xscale is None else xscale, -cellsize if yscale is None else yscale
        if affine is None and xscale is not None and yscale is not None and bbox is None:
            shift = {"corner": 0.0, "center": 0.5}[anchor]
            if xoffset is not None and yoffset is not None:
                (col, row), (x, y) = (shift, shift), (xoffset, yoffset)
            elif xy_cell is not None and xy_geo is not None:
                (col, row), (x, y) = (xy_cell[0] + shift, xy_cell[1] + shift), xy_geo
            else:
                raise ValueError("scales need offsets, or xy_cell and xy_geo, or a bbox")
            affine = (xscale, xskew, x - col * xscale - row * xskew, yskew, yscale, y - col * yskew - row * yscale)
        if affine is not None:
            if not width or not height:
                raise ValueError("a grid needs its width and height")
            return cls(width, height, tuple(map(float, affine)), **more)
        if bbox is None:
            raise ValueError("a grid needs an affine, scales with offsets, a tie point, or a bbox")
        return cls.of_bbox(bbox, width, height, None if xscale is None else abs(xscale), None if yscale is None else abs(yscale), **more)

    @property
    def inverse(self) -> tuple[float, float, float, float, float, float]:
        """The affine from places back to cell positions: the steps that one unit of x, one of y, and the way back from the offset are worth."""
        (col_x, row_x, off_x), (col_y, row_y, off_y) = self.affine[:3], self.affine[3:]
        cell = col_x * row_y - row_x * col_y
        if not cell:
            raise ValueError("the affine transform has no inverse")

        def steps(dx: float, dy: float) -> tuple[float, float]:
            return (dx * row_y - dy * row_x) / cell, (dy * col_x - dx * col_y) / cell

        by_x, by_y, start = steps(1.0, 0.0), steps(0.0, 1.0), steps(-off_x, -off_y)
        return by_x[0], by_y[0], start[0], by_x[1], by_y[1], start[1]

    def to_geo(self, col: float, row: float) -> tuple[float, float]:
        a, b, c, d, e, f = self.affine
        return a * col + b * row + c, d * col + e * row + f

    def to_cell(self, x: float, y: float, fraction: bool = False) -> tuple[float, float]:
        a, b, c, d, e, f = self.inverse
        col, row = a * x + b * y + c, d * x + e * y + f
        return (col, row) if fraction else (int(col // 1), int(row // 1))

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        return *self.to_geo(0, 0), *self.to_geo(self.width, self.height)

    def with_(self, **changes) -> Grid:
        return replace(self, **changes)
