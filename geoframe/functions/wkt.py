"""Coordinate systems as well-known text (as in .prj files): read into words of a proj text, and written."""

from __future__ import annotations

import re
from typing import NamedTuple

from geoframe.functions import datums
from geoframe.functions.datums import plain

_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z_][A-Za-z_0-9]*)|([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)|([\[\](),]))')
# What methods and parameters of projections are called, letters and digits only.
METHODS = {
    "transversemercator": "tmerc", "gausskruger": "tmerc", "lambertconformalconic": "lcc", "lambertconformalconic1sp": "lcc", "lambertconformalconic2sp": "lcc", "albers": "aea", "albersconicequalarea": "aea",
    "albersequalarea": "aea", "mercator": "merc", "mercator1sp": "merc", "mercator2sp": "merc", "mercatorvarianta": "merc", "mercatorvariantb": "merc", "mercatorauxiliarysphere": "webmerc",
    "popularvisualisationpseudomercator": "webmerc", "lambertazimuthalequalarea": "laea", "polarstereographic": "stere", "stereographicnorthpole": "stere", "stereographicsouthpole": "stere", "platecarree": "eqc",
    "equidistantcylindrical": "eqc", "equirectangular": "eqc", "sinusoidal": "sinu", "cylindricalequalarea": "cea", "robinson": "robin",
}
PARAMETERS = {
    "falseeasting": "x_0", "falsenorthing": "y_0", "centralmeridian": "lon_0", "longitudeofcenter": "lon_0", "longitudeoforigin": "lon_0", "longitudeofnaturalorigin": "lon_0", "straightverticallongitudefrompole": "lon_0",
    "latitudeoforigin": "lat_0", "latitudeofcenter": "lat_0", "latitudeofnaturalorigin": "lat_0", "standardparallel1": "lat_1", "standardparallel2": "lat_2", "latitudeofstandardparallel": "lat_1", "scalefactor": "k_0",
    "scalefactoratnaturalorigin": "k_0", "auxiliaryspheretype": "",
}
#: How each projection is written: its method, and the parameters that it has.
WRITTEN = {
    "tmerc": ("Transverse_Mercator", ("x_0", "y_0", "lon_0", "k_0", "lat_0")), "lcc": ("Lambert_Conformal_Conic", ("x_0", "y_0", "lon_0", "lat_1", "lat_2", "k_0", "lat_0")), "aea": ("Albers", ("x_0", "y_0", "lon_0", "lat_1", "lat_2", "lat_0")),
    "mercell": ("Mercator", ("x_0", "y_0", "lon_0", "lat_ts")), "merc": ("Mercator_Auxiliary_Sphere", ("x_0", "y_0", "lon_0", "lat_ts")), "laea": ("Lambert_Azimuthal_Equal_Area", ("x_0", "y_0", "lon_0", "lat_0")), "eqc": ("Plate_Carree", ("x_0", "y_0", "lon_0")),
    "sinu": ("Sinusoidal", ("x_0", "y_0", "lon_0")), "cea": ("Cylindrical_Equal_Area", ("x_0", "y_0", "lon_0", "lat_ts")), "robin": ("Robinson", ("x_0", "y_0", "lon_0")), "stere": ("", ("x_0", "y_0", "lon_0", "k_0", "lat_ts")),
}
_SAID = {"x_0": "False_Easting", "y_0": "False_Northing", "lon_0": "Central_Meridian", "lat_0": "Latitude_Of_Origin", "lat_1": "Standard_Parallel_1", "lat_2": "Standard_Parallel_2", "lat_ts": "Standard_Parallel_1", "k_0": "Scale_Factor"}
DEGREE = 0.0174532925199433


class Node(NamedTuple):
    keyword: str
    values: list

    def child(self, *keywords: str) -> Node | None:
        return next((v for v in self.values if isinstance(v, Node) and v.keyword in keywords), None)

    def children(self, keyword: str) -> list[Node]:
        return [v for v in self.values if isinstance(v, Node) and v.keyword == keyword]


def parse(text: str) -> Node:
    """KEYWORD[value, ...] with texts, numbers, and further such nodes as values."""
    at, stack, node, name = 0, [], Node("", []), None
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not well-known text at {at}: {text[at : at + 20]!r}")
        at = m.end()
        quoted, word, number, sign = m.groups()
        if name is not None and sign not in ("[", "("):
            node.values.append(name)  # a word alone, as of an axis' direction
            name = None
        if quoted is not None:
            node.values.append(quoted.replace('""', '"'))
        elif word:
            name = word.upper()
        elif number:
            node.values.append(float(number))
        elif sign in "[(":
            stack.append(node)
            node, name = Node(name or "", []), None
            stack[-1].values.append(node)
        elif sign in "])":
            if not stack:
                raise ValueError("well-known text with more brackets closed than opened")
            node = stack.pop()
    if stack or len(node.values) != 1:
        raise ValueError("well-known text that does not end")
    return node.values[0]


def proj_words(text: str) -> dict[str, str]:
    """What a proj text would say: the words of PROJCS[...] or GEOGCS[...]."""
    root = parse(text)
    if root.keyword not in ("PROJCS", "GEOGCS"):
        raise ValueError(f"a coordinate system of another kind: {root.keyword}")
    geographic = root if root.keyword == "GEOGCS" else root.child("GEOGCS")
    if geographic is None or geographic.child("DATUM") is None:
        raise ValueError("a coordinate system without a datum")
    out = _datum_words(geographic)
    if root.keyword == "GEOGCS":
        return {"proj": "longlat", **out}
    unit = root.child("UNIT")
    metres = float(unit.values[1]) if unit else 1.0
    method = root.child("PROJECTION")
    called = plain(str(method.values[0])) if method else ""
    if called not in METHODS:
        raise ValueError(f"unknown projection: {method.values[0] if method else ''}")
    out["proj"] = METHODS[called]
    for p in root.children("PARAMETER"):
        name = plain(str(p.values[0]))
        if name not in PARAMETERS:
            raise ValueError(f"unknown parameter of a projection: {p.values[0]}")
        key, value = PARAMETERS[name], float(p.values[1])
        if key:
            out[key] = repr(value * metres if key in ("x_0", "y_0") else value)
    if out["proj"] in ("merc", "webmerc", "cea", "stere", "eqc") and "lat_1" in out:
        out["lat_ts"] = out.pop("lat_1")
    if out["proj"] == "stere":
        pole = {"stereographicnorthpole": 90.0, "stereographicsouthpole": -90.0}.get(called) or float(out.get("lat_0", 0.0))
        if abs(pole) != 90 and "lat_ts" not in out:  # the older way: the latitude of true scale in the origin's place
            out["lat_ts"], pole = out["lat_0"], 90.0 if pole > 0 else -90.0
        out["lat_0"] = repr(pole)
    if metres != 1:
        out["to_meter"] = repr(metres)
    return out


def _datum_words(geographic: Node) -> dict[str, str]:
    datum, meridian, unit = geographic.child("DATUM"), geographic.child("PRIMEM"), geographic.child("UNIT")
    if meridian is not None and float(meridian.values[1]):
        raise ValueError(f"a prime meridian other than Greenwich: {meridian.values[0]}")
    if unit is not None and abs(float(unit.values[1]) - DEGREE) > 1e-9:
        raise ValueError(f"angles in another unit than degrees: {unit.values[0]}")
    shift, spheroid = datum.child("TOWGS84"), datum.child("SPHEROID", "ELLIPSOID")
    if shift is not None:
        size = {"a": repr(float(spheroid.values[1])), "rf": repr(float(spheroid.values[2]))}
        return {**size, "towgs84": ",".join(repr(float(v)) for v in shift.values)}
    return {"datum": datums.datum(str(datum.values[0]))}


_NAMES = {"WGS84": ("GCS_WGS_1984", "D_WGS_1984", "WGS_1984"), "NAD83": ("GCS_North_American_1983", "D_North_American_1983", "GRS_1980"), "NAD27": ("GCS_North_American_1927", "D_North_American_1927", "Clarke_1866"), "ETRS89": ("GCS_ETRS_1989", "D_ETRS_1989", "GRS_1980"), "ED50": ("GCS_European_1950", "D_European_1950", "International_1924"), "OSGB36": ("GCS_OSGB_1936", "D_OSGB_1936", "Airy_1830"), "DHDN": ("GCS_Deutsches_Hauptdreiecksnetz", "D_Deutsches_Hauptdreiecksnetz", "Bessel_1841")}


def written(p) -> str:
    """The text of a projection (of functions.crs)."""
    names = _NAMES.get(p.datum, ("GCS_unknown", "D_unknown", "unknown"))
    shift = "" if p.datum else f",TOWGS84[{','.join(repr(float(v)) for v in (*p.shift, *(0.0,) * 7)[:7])}]"
    geographic = f'GEOGCS["{names[0]}",DATUM["{names[1]}",SPHEROID["{names[2]}",{p.a!r},{p.rf!r}]{shift}],PRIMEM["Greenwich",0.0],UNIT["Degree",{DEGREE}]]'
    if p.name == "longlat":
        return geographic
    method, keys = WRITTEN[p.name]
    if p.name == "stere":
        method = f"Stereographic_{'North' if p.lat_0 > 0 else 'South'}_Pole"
        keys = tuple(k for k in keys if k != "lat_ts" or p.lat_ts is not None)
    if p.name == "mercell" and p.k_0 != 1:
        method, keys = "Mercator_1SP", ("x_0", "y_0", "lon_0", "k_0")
    values = {k: getattr(p, k) for k in keys}
    values |= {k: values[k] / p.unit for k in ("x_0", "y_0")} | ({"lat_ts": values["lat_ts"] or 0.0} if "lat_ts" in values else {})
    said = "".join(f',PARAMETER["{_SAID[k]}",{values[k]!r}]' for k in keys)
    unit = 'UNIT["Meter",1.0]' if p.unit == 1 else f'UNIT["Unit",{p.unit!r}]'
    return f'PROJCS["{method}",{geographic},PROJECTION["{method}"]{said},{unit}]'
