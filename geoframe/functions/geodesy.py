"""Measures on the WGS84 ellipsoid: Vincenty's formulas in numpy, geodesic lengths, areas, walks and buffers as pandas functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoframe.functions.arrowshapes import of_shapes

# The WGS84 ellipsoid.
A, B, FLAT = 6378137.0, 6356752.314245, 1 / 298.257223563
MILES_PER_KM = 0.621371
#: About a quarter round, in km.
QUARTER = 10_000.0
_XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def inverse(lat1, lon1, lat2, lon2, miles: bool = False) -> np.ndarray:
    """Distance in km (or miles) of points, rounded to 6 decimals; NaN where 200 iterations do not converge (nearly antipodal points)."""
    lat1, lon1, lat2, lon2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (lat1, lon1, lat2, lon2)))
    u1, u2 = (np.arctan((1 - FLAT) * np.tan(np.radians(v))) for v in (lat1, lat2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    span = np.radians((lon2 - lon1 + 180) % 360 - 180)
    lam, done = span.copy(), np.zeros(span.shape, bool)
    with np.errstate(all="ignore"):
        for _ in range(200):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, cu1 * cu2 * sl / np.where(ss > 0, ss, 1), 0)
            c2a = 1 - sa * sa
            c2m = np.where(c2a > 0, cs - 2 * su1 * su2 / np.where(c2a > 0, c2a, 1), 0)
            c = FLAT / 16 * c2a * (4 + FLAT * (4 - 3 * c2a))
            new = span + (1 - c) * FLAT * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
            done |= (np.abs(new - lam) < 1e-12) & (np.abs(new) <= np.pi)  # beyond, it has found a way round the wrong side
            lam = np.where(done, lam, new)
            if done.all():
                break
        u = c2a * (A * A - B * B) / (B * B)
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        less = small * ss * (c2m + small / 4 * (cs * (2 * c2m**2 - 1) - small / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        km = B * big * (sigma - less) / 1000
    km = np.where((lat1 == lat2) & (lon1 == lon2), 0.0, np.where(done, km, np.nan))
    return np.round(km * (MILES_PER_KM if miles else 1), 6)


def apart_km(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Distance in km of any two points, nearly antipodal ones too: there the way leads over a place a quarter round from the first, in the direction that
    makes it shortest (searched by halving around the best of 72)."""
    places = np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, float)) for v in (lat1, lon1, lat2, lon2)))
    shape, places = places[0].shape, [v.ravel() for v in places]
    km = inverse(*places)
    far = np.flatnonzero(np.isnan(km) & np.isfinite(sum(places)))
    if len(far):
        p = [v[far] for v in places]

        def over(bearing: np.ndarray) -> np.ndarray:
            u, v = direct(p[1], p[0], bearing, QUARTER)
            return QUARTER + inverse(v, u, p[2], p[3])

        turns = np.arange(0.0, 360.0, 5.0)
        best = turns[np.nanargmin(np.stack([over(np.full(len(far), t)) for t in turns]), 0)]
        width = 5.0
        for _ in range(24):
            tried = np.stack([best - width / 2, best, best + width / 2])
            best = np.take_along_axis(tried, np.nanargmin(np.stack([over(t) for t in tried]), 0)[None], 0)[0]
            width /= 2
        km[far] = over(best)
    return km.reshape(shape)


def direct(lon, lat, bearing, km) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of the point at a bearing (degrees from north) and distance."""
    lon, lat, bearing, km = np.broadcast_arrays(*(np.asarray(v, float) for v in (lon, lat, bearing, km)))
    s, a1 = km * 1000, np.radians(bearing)
    tu = (1 - FLAT) * np.tan(np.radians(lat))
    cu = 1 / np.sqrt(1 + tu * tu)
    su = tu * cu
    s1, sa = np.arctan2(tu, np.cos(a1)), cu * np.sin(a1)
    c2a = 1 - sa * sa
    u = c2a * (A * A - B * B) / (B * B)
    big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    sigma = s / (B * big)
    for _ in range(200):
        c2m, ss, cs = np.cos(2 * s1 + sigma), np.sin(sigma), np.cos(sigma)
        more = small * ss * (c2m + small / 4 * (cs * (2 * c2m**2 - 1) - small / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        new = s / (B * big) + more
        stop = np.abs(new - sigma).max(initial=0) < 1e-12
        sigma = new
        if stop:
            break
    c2m, ss, cs = np.cos(2 * s1 + sigma), np.sin(sigma), np.cos(sigma)
    x = su * ss - cu * cs * np.cos(a1)
    lat2 = np.arctan2(su * cs + cu * ss * np.cos(a1), (1 - FLAT) * np.sqrt(sa * sa + x * x))
    lam = np.arctan2(ss * np.sin(a1), cu * cs - su * ss * np.cos(a1))
    c = FLAT / 16 * c2a * (4 + FLAT * (4 - 3 * c2a))
    span = lam - (1 - c) * FLAT * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
    return (lon + np.degrees(span) + 540) % 360 - 180, np.degrees(lat2)


def _authalic_q(lat) -> np.ndarray:
    e = np.sqrt(1 - (B / A) ** 2)
    s = np.sin(np.radians(lat))
    return (1 - e * e) * (s / (1 - e * e * s * s) - np.log((1 - e * s) / (1 + e * s)) / (2 * e))


def _along(lon1, lat1, lon2, lat2, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n + 1 points on the way between two points: the great circle through their reduced latitudes, which a geodesic follows to within
    the flattening times its bulge."""
    u1, u2 = (math.atan((1 - FLAT) * math.tan(math.radians(v))) if abs(v) < 90 else math.radians(v) for v in (lat1, lat2))
    span = math.radians((lon2 - lon1 + 180) % 360 - 180)
    p = np.array([math.cos(u1), 0.0, math.sin(u1)])
    q = np.array([math.cos(u2) * math.cos(span), math.cos(u2) * math.sin(span), math.sin(u2)])
    d = math.atan2(np.linalg.norm(np.cross(p, q)), p @ q)
    t = np.linspace(0, 1, n + 1)
    if math.sin(d) < 1e-12 or min(abs(u1), abs(u2)) > math.radians(90 - 1e-9) or abs(span) < 1e-15:
        return np.degrees(span * t), lat1 + t * (lat2 - lat1)
    v = (np.sin((1 - t) * d)[:, None] * p + np.sin(t * d)[:, None] * q) / math.sin(d)
    return np.degrees(np.unwrap(np.arctan2(v[:, 1], v[:, 0]))), np.degrees(np.arctan2(v[:, 2], (1 - FLAT) * np.hypot(v[:, 0], v[:, 1])))


def ring_km2(lon, lat, steps: int = 64) -> float:
    """Area of a ring of geodesics: the integral of the authalic sine over longitude, `steps` pieces for each edge."""
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    if len(lon) < 3:
        return 0.0
    if lon[0] != lon[-1] or lat[0] != lat[-1]:
        lon, lat = np.r_[lon, lon[0]], np.r_[lat, lat[0]]
    total = 0.0
    for i in range(len(lon) - 1):
        x, y = _along(lon[i], lat[i], lon[i + 1], lat[i + 1], steps)
        q, mid = _authalic_q(y), _authalic_q((y[1:] + y[:-1]) / 2)
        total += float(((q[1:] + q[:-1] + 4 * mid) / 6 * np.radians(np.diff(x))).sum())
    return abs(total) * A * A / 2 / 1e6


@F.pandas_udf(T.DoubleType())
def distance_km(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """Null where a coordinate is."""
    out = apart_km(lat1.astype(float), lon1.astype(float), lat2.astype(float), lon2.astype(float))
    return pd.Series(out).where(~np.isnan(out), None)


def _length_km(s) -> float:
    total = 0.0
    for part in s[1]:
        for ring in part:
            p = np.array(ring, float)
            if len(p) > 1:
                total += float(inverse(p[:-1, 1], p[:-1, 0], p[1:, 1], p[1:, 0]).sum())
    return total


def length_km(geom: Column) -> Column:
    """Length of lines over all their segments, 0 for points."""
    return of_shapes(_length_km, "g", "double")(geom)


def area_km2(geom: Column) -> Column:
    """Area of polygons, holes taken off."""
    one = lambda s: sum((1 if i == 0 else -1) * ring_km2(*zip(*r, strict=True)) for part in s[1] for i, r in enumerate(part)) if s[0] == "Polygon" else 0.0
    return of_shapes(one, "g", "double")(geom)


def buffer_km(geom: Column, km, resolution: int = 100) -> Column:
    """A polygon around each part of a point geometry: `resolution` vertices at equal bearings from north, the rings not closed; null for others."""
    km = F.lit(float(km)) if isinstance(km, int | float) else km.cast("double")

    def one(s, d):
        if s[0] != "Point":
            return None
        turn = np.arange(resolution) * 360.0 / resolution
        return "Polygon", [[list(zip(*(v.tolist() for v in direct(*part[0][0], turn, d)), strict=True))] for part in s[1]]

    return of_shapes(one, "gv", "geometry")(geom, km)


@F.pandas_udf(_XY)
def walk(lon: pd.Series, lat: pd.Series, bearing: pd.Series, km: pd.Series) -> pd.DataFrame:
    u, v = direct(lon, lat, bearing, km)
    return pd.DataFrame({"x": u, "y": v})
