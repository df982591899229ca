"""Coordinate systems as column functions between each other, always x before y.

Given by an EPSG code, a name, a proj text or well-known text (as in .prj files).  Projections: longlat; merc (sphere, also web mercator), eqc (plate
carree), sinu, cea and robin on the sphere; mercell (Mercator), utm and tmerc, lcc (Lambert conformal), aea (Albers), laea (Lambert azimuthal
equal-area) and polar stere on any ellipsoid.  Datums are shifted by way of earth-centred coordinates (see functions.datums); others, and words that
would change the result but are not known here, are refused by name.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.functions import datums, wkt
from geoframe.functions import geometry as G
from geoframe.functions.datums import Ellipsoid
from geoframe.types import GEOM

#: WGS84's radius, flattening and eccentricity.
R = 6378137.0
FLAT = 1 / 298.257223563
E = math.sqrt(FLAT * (2 - FLAT))
_WGS84 = datums.ellipsoid("WGS84")
_ALPHA, _RECTIFYING = _WGS84.alpha, _WGS84.rectifying
# What codes stand for.
NAMES = {
    "EPSG:4326": "+proj=longlat +datum=WGS84", "EPSG:4269": "+proj=longlat +datum=NAD83", "EPSG:4267": "+proj=longlat +datum=NAD27", "EPSG:4258": "+proj=longlat +datum=ETRS89", "EPSG:4230": "+proj=longlat +datum=ED50",
    "EPSG:4277": "+proj=longlat +datum=OSGB36", "EPSG:4314": "+proj=longlat +datum=DHDN", "EPSG:3857": "webmerc", "EPSG:3395": "mercell", "EPSG:4087": "eqc", "EPSG:32662": "eqc", "EPSG:54008": "sinu", "EPSG:54034": "cea", "EPSG:54030": "robin",
    "ESRI:54030": "robin", "EPSG:3035": "+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +datum=ETRS89", "EPSG:3031": "+proj=stere +lat_0=-90 +lat_ts=-71", "EPSG:3413": "+proj=stere +lat_0=90 +lat_ts=70 +lon_0=-45",
    "EPSG:3995": "+proj=stere +lat_0=90 +lat_ts=71", "EPSG:27700": "+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +datum=OSGB36", "EPSG:5070": "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +datum=NAD83",
    "EPSG:2154": "+proj=lcc +lat_1=49 +lat_2=44 +lat_0=46.5 +lon_0=3 +x_0=700000 +y_0=6600000 +datum=ETRS89",
}
#: The codes of UTM zones: those before the zone's two digits, the datum, the last zone, south.
_ZONES = {"EPSG:326": ("WGS84", 60, False), "EPSG:327": ("WGS84", 60, True), "EPSG:258": ("ETRS89", 38, False), "EPSG:269": ("NAD83", 23, False), "EPSG:267": ("NAD27", 22, False), "EPSG:230": ("ED50", 38, False)}
_UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "us-ft": 1200 / 3937}
#: Words of a proj text that are read, and those that say nothing here.
_READ = {"proj", "datum", "ellps", "a", "b", "rf", "R", "towgs84", "units", "to_meter", "lon_0", "lat_0", "lat_1", "lat_2", "lat_ts", "k", "k_0", "x_0", "y_0", "zone", "south"}
_IDLE = {"no_defs", "type", "wktext", "over", "vunits"}
#: Fixed values, as Robinson published them: for each 5 degrees of latitude the length of the parallel and its distance from the equator.
ROBINSON_LENGTH = (1.0, 0.9986, 0.9954, 0.99, 0.9822, 0.973, 0.96, 0.9427, 0.9216, 0.8962, 0.8679, 0.835, 0.7986, 0.7597, 0.7186, 0.6732, 0.6213, 0.5722, 0.5322)
ROBINSON_HEIGHT = (0.0, 0.062, 0.124, 0.186, 0.248, 0.31, 0.372, 0.434, 0.4958, 0.5571, 0.6176, 0.6769, 0.7346, 0.7903, 0.8435, 0.8936, 0.9394, 0.9761, 1.0)
ROBINSON_X, ROBINSON_Y = 0.8487, 1.3523


class Projection(NamedTuple):
    name: str
    lon_0: float = 0.0
    lat_0: float = 0.0
    lat_1: float = 0.0
    lat_2: float = 0.0
    lat_ts: float | None = None
    k_0: float = 1.0
    x_0: float = 0.0
    y_0: float = 0.0
    #: The ellipsoid; how its datum lies to WGS84; the datum's name, if it has one; metres of the unit of coordinates.
    a: float = R
    rf: float = 298.257223563
    shift: tuple[float, ...] = ()
    datum: str = "WGS84"
    unit: float = 1.0

    @property
    def body(self) -> Ellipsoid:
        return Ellipsoid(self.a, self.rf)


def projection(crs: str) -> Projection:
    """From an EPSG code, a name, a proj text or well-known text."""
    crs = crs.strip()
    if crs[:8] in _ZONES and len(crs) == 10 and crs[8:].isdigit():
        datum, last, south = _ZONES[crs[:8]]
        if 1 <= int(crs[8:]) <= last:
            return _of_words({"proj": "utm", "zone": crs[8:], "datum": datum} | ({"south": ""} if south else {}), crs)
    if crs[:7].upper() in ("PROJCS[", "GEOGCS[", "PROJCS(", "GEOGCS("):
        return _of_words(wkt.proj_words(crs), crs)
    if crs in ("webmerc", "merc", "mercell"):  # by name: on the sphere, or not
        return Projection("mercell" if crs == "mercell" else "merc")
    told = NAMES.get(crs, crs)
    words = [w.lstrip("+").split("=", 1) for w in told.split() if w.startswith("+")]
    if told in ("webmerc", "mercell"):
        return projection(told)
    given = {w[0]: w[1] if len(w) > 1 else "" for w in words} or {"proj": told}
    if unknown := set(given) - _READ - _IDLE - ({"nadgrids"} if given.get("nadgrids") == "@null" else set()) - ({"axis"} if given.get("axis") == "enu" else set()) - ({"pm"} if given.get("pm") in ("greenwich", "0") else set()):
        raise ValueError(f"unknown words of a coordinate system: {', '.join(sorted(unknown))}")
    return _of_words(given, crs)


def _of_words(given: dict[str, str], crs: str) -> Projection:
    name = {"latlong": "longlat", "lonlat": "longlat"}.get(given.get("proj", ""), given.get("proj", ""))
    datum = datums.datum(given["datum"]) if "datum" in given else ""
    body, shift = datums.ellipsoid(datums.DATUMS[datum][0]) if datum else _WGS84, datums.DATUMS[datum][1] if datum else ()
    if not datum:
        body = _size(given, body)
        shift = tuple(float(v) for v in given["towgs84"].split(",")) if given.get("towgs84") else ()
        if len(shift) not in (0, 3, 7):
            raise ValueError(f"a shift to WGS84 has three or seven numbers: {given['towgs84']}")
        shift = shift if any(shift) else ()
        # An ellipsoid alone says nothing of where it lies; near to WGS84's it is taken for that, as is a sphere.
        if not (shift or "towgs84" in given) and body.rf and abs(body.a - R) > 1:
            raise ValueError(f"an ellipsoid without a datum: {crs}")
        datum = "WGS84" if not shift and body == _WGS84 else ""
    if name == "merc" and body.rf and given.get("nadgrids") != "@null":
        name = "mercell"
    name = "merc" if name == "webmerc" else name
    if name == "utm":
        zone = int(given["zone"])
        if not 1 <= zone <= 60:
            raise ValueError(f"no zone of UTM: {zone}")
        return Projection("tmerc", lon_0=6.0 * zone - 183, k_0=0.9996, x_0=500_000.0, y_0=10_000_000.0 if "south" in given else 0.0, a=body.a, rf=body.rf, shift=shift, datum=datum)
    if name not in {"longlat", "merc", "mercell", "eqc", "sinu", "cea", "robin", "tmerc", "lcc", "aea", "laea", "stere"}:
        raise ValueError(f"unknown projection: {crs}")
    number = {k: float(given[k]) for k in ("lon_0", "lat_0", "lat_1", "lat_2", "lat_ts", "k_0", "x_0", "y_0") if k in given}
    if name == "lcc" and "lat_2" not in number:
        number["lat_1"] = number.get("lat_1", number.get("lat_0", 0.0))
        number["lat_2"] = number["lat_1"]
    if "k" in given:
        number["k_0"] = float(given["k"])
    if name == "stere" and abs(number.get("lat_0", 0.0)) != 90:
        raise ValueError(f"a stereographic projection that is not polar: {crs}")
    if name in ("eqc", "cea", "merc") and number.get("lat_ts"):
        raise ValueError(f"a cylinder on the sphere that does not touch the equator: {crs}")
    if name == "mercell" and number.pop("lat_ts", 0.0):
        s, c = math.sin(math.radians(float(given["lat_ts"]))), math.cos(math.radians(float(given["lat_ts"])))
        number["k_0"] = c / math.sqrt(1 - body.e2 * s * s)
    if name != "stere" and not number.get("lat_ts"):
        number.pop("lat_ts", None)
    unit = float(given["to_meter"]) if "to_meter" in given else _UNITS.get(given.get("units", "m"), 0.0)
    if not unit:
        raise ValueError(f"unknown unit: {given['units']}")
    return Projection(name, a=body.a, rf=body.rf, shift=shift, datum=datum, unit=unit, **number)


def _size(given: dict[str, str], body: Ellipsoid) -> Ellipsoid:
    if "ellps" in given:
        body = datums.ellipsoid(given["ellps"])
    if "R" in given:
        return Ellipsoid(float(given["R"]), 0.0)
    if "a" not in given:
        return body
    a = float(given["a"])
    if "b" in given:
        b = float(given["b"])
        return datums.same_ellipsoid(a, a / (a - b) if a != b else 0.0)
    return datums.same_ellipsoid(a, float(given["rf"]) if "rf" in given else 0.0)


def to_wkt(crs: str) -> str:
    """A coordinate system as well-known text."""
    return wkt.written(projection(crs))


def name_of(crs: str) -> str:
    """The projection's short name."""
    return projection(crs).name


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _geodetic(p: Projection, chi: Column) -> Column:
    """Latitude from conformal latitude."""
    return _let(chi, lambda c: c + sum(d * F.sin(2 * (j + 1) * c) for j, d in enumerate(p.body.delta)))


def _isometric(p: Projection, phi: Column) -> Column:
    return F.atanh(F.sin(phi)) - p.body.e * F.atanh(p.body.e * F.sin(phi))


def _tmerc(p: Projection, lon: Column, phi: Column) -> tuple[Column, Column]:
    at = F.struct(F.sinh(_isometric(p, phi)).alias("t"), lon.alias("l"))
    xi = _let(at, lambda v: F.struct(F.atan2(v["t"], F.cos(v["l"])).alias("xi"), F.atanh(F.sin(v["l"]) / F.sqrt(1 + v["t"] * v["t"])).alias("eta")))

    def along(v: Column) -> Column:
        return v["xi"] + sum(a * F.sin(2 * (j + 1) * v["xi"]) * F.cosh(2 * (j + 1) * v["eta"]) for j, a in enumerate(p.body.alpha))

    def across(v: Column) -> Column:
        return v["eta"] + sum(a * F.cos(2 * (j + 1) * v["xi"]) * F.sinh(2 * (j + 1) * v["eta"]) for j, a in enumerate(p.body.alpha))

    scale = p.k_0 * p.body.rectifying
    return scale * _let(xi, across), scale * (_let(xi, along) - _meridian(p))


def _meridian(p: Projection) -> float:
    phi, e = math.radians(p.lat_0), p.body.e
    xi = math.atan(math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi))))
    return xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(p.body.alpha))


def _tmerc_back(p: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    scale = p.k_0 * p.body.rectifying
    at = F.struct((y / scale + _meridian(p)).alias("xi"), (x / scale).alias("eta"))

    def straight(v: Column) -> Column:
        xi = v["xi"] - sum(b * F.sin(2 * (j + 1) * v["xi"]) * F.cosh(2 * (j + 1) * v["eta"]) for j, b in enumerate(p.body.beta))
        eta = v["eta"] - sum(b * F.cos(2 * (j + 1) * v["xi"]) * F.sinh(2 * (j + 1) * v["eta"]) for j, b in enumerate(p.body.beta))
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    v = _let(at, straight)
    return _let(v, lambda u: F.atan2(F.sinh(u["eta"]), F.cos(u["xi"]))), _geodetic(p, _let(v, lambda u: F.asin(F.sin(u["xi"]) / F.cosh(u["eta"]))))


def _narrowing(p: Projection, lat: float) -> tuple[float, float, float]:
    """Of a latitude: the radius of its parallel, t as Snyder has it, and q (twice the area up to it), all on an ellipsoid of radius 1."""
    s, e = math.sin(math.radians(lat)), p.body.e
    m = math.cos(math.radians(lat)) / math.sqrt(1 - (e * s) ** 2)
    t = math.exp(-(math.atanh(s) - e * math.atanh(e * s))) if abs(s) < 1 else 0.0
    return m, t, (1 - e * e) * (s / (1 - (e * s) ** 2) + (math.atanh(e * s) / e if e else s))


def _q(p: Projection, phi: Column) -> Column:
    """q of a column of latitudes."""
    e, s = p.body.e, F.sin(phi)
    return (1 - e * e) * (s / (1 - e * e * s * s) + (F.atanh(e * s) / e if e else s))


def _cone(p: Projection) -> tuple[float, float, float]:
    """n, the constant, and the radius of lat_0, in units of R."""
    (m1, t1, q1), (m2, t2, q2), (_, t0, q0) = (_narrowing(p, v) for v in (p.lat_1, p.lat_2, p.lat_0))
    s1 = math.sin(math.radians(p.lat_1))
    if p.name == "lcc":
        n = (math.log(m1) - math.log(m2)) / (math.log(t1) - math.log(t2)) if abs(p.lat_1 - p.lat_2) > 1e-10 else s1
        c = p.k_0 * m1 / (n * t1**n)
        return n, c, c * t0**n
    n = (m1 * m1 - m2 * m2) / (q2 - q1) if abs(p.lat_1 - p.lat_2) > 1e-10 else s1
    c = m1 * m1 + n * q1
    return n, c, math.sqrt(c - n * q0) / n


def _conic(p: Projection, lon: Column, phi: Column) -> tuple[Column, Column]:
    n, c, rho_0 = _cone(p)
    rho = c * F.exp(-n * _isometric(p, phi)) if p.name == "lcc" else F.sqrt(F.greatest(F.lit(0.0), c - n * _q(p, phi))) / n
    at = F.struct(rho.alias("r"), (n * lon).alias("a"))
    return p.a * _let(at, lambda v: v["r"] * F.sin(v["a"])), p.a * (rho_0 - _let(at, lambda v: v["r"] * F.cos(v["a"])))


def _from_authalic(p: Projection, sine: Column) -> Column:
    """Latitude from the sine of the authalic latitude."""
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine)))
    return _let(beta, lambda b: b + sum(k * F.sin(2 * (j + 1) * b) for j, k in enumerate(p.body.authalic)))


def _conic_back(p: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    n, c, rho_0 = _cone(p)
    sign = math.copysign(1.0, n)
    u, v = x / p.a, rho_0 - y / p.a
    rho, angle = F.sqrt(u * u + v * v), F.atan2(sign * u, sign * v)
    if p.name == "lcc":
        return angle / n, _geodetic(p, math.pi / 2 - 2 * F.atan(F.pow(rho / abs(c), F.lit(1 / n))))
    return angle / n, _from_authalic(p, (c - rho * rho * n * n) / n / _narrowing(p, 90.0)[2])


def _stere_scale(p: Projection) -> float:
    """Metres from the pole for each unit of t."""
    e = p.body.e
    if p.lat_ts is not None and abs(p.lat_ts) < 90:
        m, t, _ = _narrowing(p, abs(p.lat_ts))
        return p.a * m / t * p.k_0
    return 2 * p.a * p.k_0 / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))


def _stere(p: Projection, lon: Column, phi: Column) -> tuple[Column, Column]:
    north = math.copysign(1.0, p.lat_0)
    at = F.struct((_stere_scale(p) * F.when(F.abs(phi) < math.pi / 2, F.exp(-_isometric(p, north * phi))).when(north * phi > 0, F.lit(0.0))).alias("r"), lon.alias("l"))
    return _let(at, lambda v: v["r"] * F.sin(v["l"])), -north * _let(at, lambda v: v["r"] * F.cos(v["l"]))


def _stere_back(p: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    north = math.copysign(1.0, p.lat_0)
    chi = math.pi / 2 - 2 * F.atan(F.sqrt(x * x + y * y) / _stere_scale(p))
    return F.atan2(x, -north * y), north * _geodetic(p, chi)


def _middle(p: Projection) -> tuple[float, float, float, float]:
    """q of the pole, sine and cosine of the origin's authalic latitude, and how far the ellipsoid is from a sphere there."""
    whole = _narrowing(p, 90.0)[2]
    m, _, q = _narrowing(p, p.lat_0)
    s = q / whole
    c = math.sqrt(max(0.0, 1 - s * s))
    return whole, s, c, m / (math.sqrt(whole / 2) * c) if abs(p.lat_0) < 90 else 1.0


def _laea(p: Projection, lon: Column, phi: Column) -> tuple[Column, Column]:
    whole, s, c, d = _middle(p)
    radius = p.a * math.sqrt(whole / 2)
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _q(p, phi) / whole))

    def placed(v: Column) -> Column:
        cosine = F.sqrt(1 - v["s"] * v["s"])
        near = 1 + s * v["s"] + c * cosine * F.cos(v["l"])
        b = F.when(near > 1e-12, radius * F.sqrt(2 / near))  # the antipode has no place
        return F.struct((b * d * cosine * F.sin(v["l"])).alias("x"), (b / d * (c * v["s"] - s * cosine * F.cos(v["l"]))).alias("y"))

    at = _let(F.struct(sine.alias("s"), lon.alias("l")), placed)
    return at["x"], at["y"]


def _laea_back(p: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    whole, s, c, d = _middle(p)
    radius = p.a * math.sqrt(whole / 2)
    u, v = x / d, y * d
    rho = F.sqrt(u * u + v * v)
    angle = 2 * F.asin(F.least(F.lit(1.0), rho / (2 * radius)))

    def turned(z: Column) -> Column:
        lon = F.atan2(z["u"] * F.sin(z["a"]), z["r"] * c * F.cos(z["a"]) - z["v"] * s * F.sin(z["a"]))
        return F.when(z["r"] == 0, F.struct(F.lit(s).alias("s"), F.lit(0.0).alias("l"))).otherwise(F.struct((F.cos(z["a"]) * s + z["v"] * F.sin(z["a"]) * c / z["r"]).alias("s"), lon.alias("l")))

    at = _let(F.struct(u.alias("u"), v.alias("v"), rho.alias("r"), angle.alias("a")), turned)
    return at["l"], _from_authalic(p, at["s"])


def _robinson_at(table: tuple[float, ...], lat: Column) -> Column:
    """A value between a table's, by the cubic through the four entries around; the table goes on below 0 as its kind (even or odd) has it."""
    sign = 1.0 if table[0] else -1.0
    whole = [sign * table[1], *table, 2 * table[-1] - table[-2]]
    cells = F.array(*(F.array(*map(F.lit, whole[k : k + 4])) for k in range(len(table) - 1)))
    place = F.abs(lat) / 5

    def between(u: Column) -> Column:
        k = F.least(F.lit(len(table) - 2), F.floor(u).cast("int"))
        return _let(F.struct(F.get(cells, k).alias("v"), (u - k).alias("t")), cubic)

    def cubic(z: Column) -> Column:
        v, t = z["v"], z["t"]
        return -F.get(v, 0) * t * (t - 1) * (t - 2) / 6 + F.get(v, 1) * (t + 1) * (t - 1) * (t - 2) / 2 - F.get(v, 2) * (t + 1) * t * (t - 2) / 2 + F.get(v, 3) * (t + 1) * t * (t - 1) / 6

    return _let(place, between)


def _robinson_back(r: float, x: Column, y: Column) -> tuple[Column, Column]:
    """Halving the interval of latitudes, as heights grow with them."""
    height = F.abs(y) / (r * ROBINSON_Y)

    def halved(state: Column, _: Column) -> Column:
        middle = (state["lo"] + state["hi"]) / 2
        high = _robinson_at(ROBINSON_HEIGHT, middle) > height
        return F.struct(F.when(high, state["lo"]).otherwise(middle).alias("lo"), F.when(high, middle).otherwise(state["hi"]).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(90.0).alias("hi"))
    lat = F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, halved, lambda s: (s["lo"] + s["hi"]) / 2)
    lat = F.when(height <= 1, F.signum(y) * lat)
    return _let(lat, lambda v: F.degrees(x / (r * ROBINSON_X * _robinson_at(ROBINSON_LENGTH, v)))), lat


_ROUND = {"tmerc": (_tmerc, _tmerc_back), "lcc": (_conic, _conic_back), "aea": (_conic, _conic_back), "laea": (_laea, _laea_back), "stere": (_stere, _stere_back)}


def _forward(p: Projection, lon: Column, lat: Column) -> tuple[Column, Column]:
    if p.name == "longlat":
        return lon, lat
    if p.lon_0:
        lon = F.pmod(lon - p.lon_0 + 180, F.lit(360.0)) - 180
    x, phi, r = F.radians(lon), F.radians(lat), p.a
    if p.name in ("merc", "mercell"):
        v = F.ln(F.tan(F.lit(math.pi / 4) + phi / 2))
        if p.name == "mercell":
            e = p.body.e
            v = v + (e / 2) * F.ln((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)))
        fine = F.abs(lat) < 90
        u, v = F.when(fine, r * p.k_0 * x), F.when(fine, r * p.k_0 * v)
    elif p.name == "eqc":
        u, v = r * x, r * phi
    elif p.name == "sinu":
        u, v = r * x * F.cos(phi), r * phi
    elif p.name == "cea":
        u, v = r * x, r * F.sin(phi)
    elif p.name == "robin":
        u, v = r * ROBINSON_X * _robinson_at(ROBINSON_LENGTH, lat) * x, r * ROBINSON_Y * F.signum(lat) * _robinson_at(ROBINSON_HEIGHT, lat)
    else:
        fine = F.abs(lat) <= 90 if p.name in ("laea", "stere") else F.abs(lat) < 90
        u, v = (F.when(fine, c) for c in _ROUND[p.name][0](p, x, phi))
    u, v = (u + p.x_0 if p.x_0 else u), (v + p.y_0 if p.y_0 else v)
    return (u, v) if p.unit == 1 else (u / p.unit, v / p.unit)


def _inverse(p: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    if p.name == "longlat":
        return x, y
    if p.unit != 1:
        x, y = x * p.unit, y * p.unit
    x, y, r = (x - p.x_0 if p.x_0 else x), (y - p.y_0 if p.y_0 else y), p.a
    if p.name == "merc":
        lon, lat = F.degrees(x / (r * p.k_0)), F.degrees(2 * F.atan(F.exp(y / (r * p.k_0))) - math.pi / 2)
    elif p.name == "mercell":
        lon, lat = F.degrees(x / (r * p.k_0)), F.degrees(_geodetic(p, 2 * F.atan(F.exp(y / (r * p.k_0))) - math.pi / 2))
    elif p.name == "eqc":
        lon, lat = F.degrees(x / r), F.degrees(y / r)
    elif p.name == "sinu":
        lon, lat = F.degrees(x / (r * F.cos(y / r))), F.degrees(y / r)
    elif p.name == "cea":
        lon, lat = F.degrees(x / r), F.degrees(F.asin(y / r))
    elif p.name == "robin":
        lon, lat = _robinson_back(r, x, y)
    else:
        lon, lat = (F.degrees(c) for c in _ROUND[p.name][1](p, x, y))
    return (F.pmod(lon + p.lon_0 + 180, F.lit(360.0)) - 180 if p.lon_0 else lon), lat


def _centred(body: Ellipsoid, lon: Column, lat: Column) -> Column:
    """Earth-centred x, y, z in metres of places on the ellipsoid."""
    phi, lam = F.radians(lat), F.radians(lon)

    def placed(v: Column) -> Column:
        n = body.a / F.sqrt(1 - body.e2 * v["s"] * v["s"])
        return F.struct((n * v["c"] * F.cos(v["l"])).alias("x"), (n * v["c"] * F.sin(v["l"])).alias("y"), (n * (1 - body.e2) * v["s"]).alias("z"))

    return _let(F.struct(F.sin(phi).alias("s"), F.cos(phi).alias("c"), lam.alias("l")), placed)


def _moved(shift: tuple[float, ...], v: Column, back: bool) -> Column:
    """To WGS84 by a shift, small turns and a scale, or back by their inverse."""
    tx, ty, tz, rx, ry, rz, ppm = (*shift, *(0.0,) * 7)[:7]
    rx, ry, rz = (math.radians(k / 3600) for k in (rx, ry, rz))
    turn = ((1.0, -rz, ry), (rz, 1.0, -rx), (-ry, rx, 1.0))
    m = tuple(tuple((1 + ppm * 1e-6) * k for k in row) for row in turn)
    if not back:
        return F.struct(*(sum((m[i][j] * v[c] for j, c in enumerate("xyz")), F.lit(t)).alias(n) for i, (n, t) in enumerate(zip("xyz", (tx, ty, tz), strict=True))))
    inverse = _inverse_matrix(m)
    return F.struct(*(sum((inverse[i][j] * (v[c] - t) for j, (c, t) in enumerate(zip("xyz", (tx, ty, tz), strict=True))), F.lit(0.0)).alias(n) for i, n in enumerate("xyz")))


def _inverse_matrix(m) -> tuple:
    """Of three rows of three, by cofactors."""
    minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = sum(m[0][j] * minor(0, j) for j in range(3))
    return tuple(tuple(minor(j, i) / det for j in range(3)) for i in range(3))


def _on_ellipsoid(body: Ellipsoid, v: Column) -> Column:
    """Longitude and latitude (a struct lon, lat) of earth-centred places, by Bowring's formula, twice."""
    b = body.a * (1 - body.f)
    second = body.e2 / (1 - body.e2)

    def latitude(z: Column) -> Column:
        # z: distance p from the axis, height h over the equator's plane, t: tangent of the reduced latitude so far
        cosine = 1 / F.sqrt(1 + z["t"] * z["t"])
        sine = z["t"] * cosine
        up, out = z["h"] + second * b * sine * sine * sine, z["p"] - body.e2 * body.a * cosine * cosine * cosine
        return F.struct(z["p"].alias("p"), z["h"].alias("h"), ((1 - body.f) * up / out).alias("t"), F.atan2(up, out).alias("phi"))

    def told(c: Column) -> Column:
        p = F.sqrt(c["x"] * c["x"] + c["y"] * c["y"])
        start = F.struct(p.alias("p"), c["z"].alias("h"), (c["z"] * body.a / (F.greatest(p, F.lit(1e-9)) * b)).alias("t"))
        return F.struct(F.degrees(F.atan2(c["y"], c["x"])).alias("lon"), F.degrees(_let(_let(start, latitude), latitude)["phi"]).alias("lat"))

    return _let(v, told)


def _shifted(a: Projection, b: Projection, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Places of one datum in another, by way of WGS84."""
    if a.shift == b.shift and (a.body == b.body or not a.shift):
        return lon, lat
    v = _centred(a.body, lon, lat)
    if a.shift:
        v = _let(v, lambda c: _moved(a.shift, c, False))
    if b.shift:
        v = _let(v, lambda c: _moved(b.shift, c, True))
    at = _on_ellipsoid(b.body if b.rf else _WGS84, v)
    return at["lon"], at["lat"]


def transformer(source: str, target: str):
    """A function of two columns to two columns."""
    a, b = projection(source), projection(target)
    return lambda x, y: (x, y) if a == b else _forward(b, *_shifted(a, b, *_inverse(a, x, y)))


def reproject(df: DataFrame, source: str, target: str) -> DataFrame:
    """Geometries in another projection; vertices that have no place there go."""
    go = transformer(source, target)
    return df.withColumn(GEOM, G.transform(F.col(GEOM), lambda x, y: go(x, y)[0], lambda x, y: go(x, y)[1]))


def reproject_bbox(spark, bbox, source: str, target: str, steps: int = 20) -> tuple[float, ...]:
    """The bbox of a grid of (steps + 1)^2 reprojected points of a bbox; points without a place are left out."""
    x1, y1, x2, y2 = map(float, bbox)
    grid = spark.range((steps + 1) ** 2).select((x1 + (x2 - x1) * (F.col("id") % (steps + 1)) / steps).alias("x"), (y1 + (y2 - y1) * F.floor(F.col("id") / (steps + 1)) / steps).alias("y"))
    u, v = transformer(source, target)(F.col("x"), F.col("y"))
    fine = grid.select(u.alias("u"), v.alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND NOT isnan(u) AND NOT isnan(v) AND abs(u) < double('infinity') AND abs(v) < double('infinity')")
    return tuple(fine.agg(F.min("u"), F.min("v"), F.max("u"), F.max("v")).first())


def group_bbox(frames, target: str) -> tuple[float, ...] | None:
    """The bbox, in one projection, of several frames of any: the least that holds their own bboxes once reprojected (see reproject_bbox). Frames without
    geometries, or without a place there, are left out; None if all are."""
    boxes = []
    for frame in frames:
        own = tuple(frame.bbox().first())
        if own[0] is not None:
            box = reproject_bbox(frame.df.sparkSession, own, frame.crs, target)
            if box[0] is not None:
                boxes.append(box)
    return (*(min(b[i] for b in boxes) for i in (0, 1)), *(max(b[i] for b in boxes) for i in (2, 3))) if boxes else None
