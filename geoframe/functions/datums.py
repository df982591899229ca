"""Ellipsoids and datums: their sizes, how they lie to WGS84, and the names that texts of coordinate systems have for them."""

from __future__ import annotations

import math
import re
from functools import cached_property
from typing import NamedTuple

# Fixed values, as published: semi-major axis in metres and inverse flattening (0: a sphere).
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "clrk66": (6378206.4, 294.978698214), "clrk80": (6378249.145, 293.465), "intl": (6378388.0, 297.0),
    "bessel": (6377397.155, 299.1528128), "airy": (6377563.396, 299.3249646), "krass": (6378245.0, 298.3), "aust_SA": (6378160.0, 298.25), "sphere": (6370997.0, 0.0),
}
# Fixed values, as published: the ellipsoid of each datum, and what takes its earth-centred coordinates to those of WGS84 (metres, seconds of arc by
# the rule of the position vector, parts per million); NAD27: the mean of the contiguous United States, right to some 10 m.
DATUMS = {
    "WGS84": ("WGS84", ()), "NAD83": ("GRS80", ()), "ETRS89": ("GRS80", ()), "NAD27": ("clrk66", (-8.0, 160.0, 176.0)), "ED50": ("intl", (-87.0, -98.0, -121.0)),
    "OSGB36": ("airy", (446.448, -125.157, 542.06, 0.1502, 0.247, 0.8421, -20.4894)), "DHDN": ("bessel", (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)),
}
#: What texts call them, letters and digits only, without a leading D.
_CALLED = {
    "wgs84": "WGS84", "wgs1984": "WGS84", "worldgeodeticsystem1984": "WGS84", "nad83": "NAD83", "northamerican1983": "NAD83", "northamericandatum1983": "NAD83", "etrs89": "ETRS89", "etrs1989": "ETRS89",
    "europeanterrestrialreferencesystem1989": "ETRS89", "nad27": "NAD27", "northamerican1927": "NAD27", "northamericandatum1927": "NAD27", "ed50": "ED50", "european1950": "ED50", "europeandatum1950": "ED50",
    "osgb36": "OSGB36", "osgb1936": "OSGB36", "dhdn": "DHDN", "potsdam": "DHDN", "deutscheshauptdreiecksnetz": "DHDN",
}


class Ellipsoid(NamedTuple("Ellipsoid", [("a", float), ("rf", float)])):
    """Semi-major axis and inverse flattening, and what follows from them."""

    @cached_property
    def f(self) -> float:
        return 1 / self.rf if self.rf else 0.0

    @cached_property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @cached_property
    def e(self) -> float:
        return math.sqrt(self.e2)

    @cached_property
    def n(self) -> float:
        """The third flattening."""
        return self.f / (2 - self.f)

    @cached_property
    def rectifying(self) -> float:
        n = self.n
        return self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    # Series in n, for the transverse Mercator (there and back) and for geodetic from conformal latitudes.
    @cached_property
    def alpha(self) -> tuple[float, ...]:
        n = self.n
        return (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)

    @cached_property
    def beta(self) -> tuple[float, ...]:
        n = self.n
        return (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)

    @cached_property
    def delta(self) -> tuple[float, ...]:
        n = self.n
        return (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)

    @cached_property
    def authalic(self) -> tuple[float, ...]:
        """For geodetic from authalic latitudes."""
        e2 = self.e2
        return (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)


def ellipsoid(name: str) -> Ellipsoid:
    if name not in ELLIPSOIDS:
        raise ValueError(f"unknown ellipsoid: {name}")
    return Ellipsoid(*ELLIPSOIDS[name])


def plain(name: str) -> str:
    """Letters and digits in lower case."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def datum(name: str) -> str:
    """The datum's name here, whatever a text calls it."""
    short = plain(name.removeprefix("D_"))
    if short not in _CALLED:
        raise ValueError(f"unknown datum: {name}")
    return _CALLED[short]


def same_ellipsoid(a: float, rf: float) -> Ellipsoid:
    """One of the known ellipsoids, if it differs by less than texts round off."""
    for size, inverse in ELLIPSOIDS.values():
        if abs(size - a) < 5e-3 and abs((inverse or 0) - rf) < 5e-7:
            return Ellipsoid(size, inverse)
    return Ellipsoid(a, rf)
