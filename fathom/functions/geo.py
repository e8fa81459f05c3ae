"""Geometry on the sphere: EWKT and object constructors, containment, distance, trixel ids.

Points are (longitude, latitude) in degrees (SRID 4326). Tests are exact on the sphere, with
great-circle edges, and come out as Spark expressions over two columns, after a test of a
bounding box that scans can use; the trixel id of a point (hierarchical
triangular mesh) is an Arrow-batched function.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .crs import to_wgs84

EARTH_M = 6_371_000.0
SAME = 3e-8  # radians, some 20 cm: what the cosine of an angle can tell from 0
UNITS = {"nmi": 1852.0, "mi": 1609.344, "km": 1000.0, "m": 1.0, "cm": 0.01, "mm": 0.001, "ft": 0.3048, "in": 0.0254, "yd": 0.9144, "NM": 1852.0}
KINDS = ("POINT", "CIRCLE", "CONVEX", "POLYGON", "CHULL", "MULTIPOINT", "MULTICIRCLE", "MULTICONVEX", "MULTIPOLYGON", "MULTICHULL", "GEOMETRYCOLLECTION", "GEOMETRYINTERSECTION")


@dataclass
class Geometry:
    """kind; points (lon, lat) of a point, circle or ring; radius in metres; parts of a compound."""

    kind: str
    points: list[tuple[float, float]] = field(default_factory=list)
    radius: float = 0.0
    parts: list[Geometry] = field(default_factory=list)

    def centroid(self) -> tuple[float, float]:
        vectors = [unit(*p) for p in self.points] or [unit(*g.centroid()) for g in self.parts]
        x, y, z = (sum(v[k] for v in vectors) for k in range(3))
        return math.degrees(math.atan2(y, x)), math.degrees(math.atan2(z, math.hypot(x, y)))

    def moved(self, srid: int) -> Geometry:
        """The geometry of another reference system in WGS 84."""
        return Geometry(self.kind, [to_wgs84(*p, srid) for p in self.points], self.radius, [g.moved(srid) for g in self.parts])

    def cap(self) -> tuple[float, float, float] | None:
        """Longitude, latitude and radius (radians) of a circle around it; null if it is none of less than a hemisphere."""
        if self.kind == "CIRCLE":
            return *self.points[0], self.radius / EARTH_M
        if self.kind == "POINT":
            return *self.points[0], 2 * SAME
        inner = [((lon, lat), 0.0) for lon, lat in self.points] or [(c[:2], c[2]) for c in (g.cap() for g in self.parts) if c]
        if not inner or self.parts and len(inner) < len(self.parts):
            return None
        if self.kind in ("CONVEX", "GEOMETRYINTERSECTION"):
            return min((c for c in (g.cap() for g in self.parts) if c), key=lambda c: c[2])
        middle = self.centroid()
        around = max(math.acos(max(-1.0, min(1.0, _dot(unit(*p), unit(*middle))))) + r for p, r in inner)
        return (*middle, around + 1e-9) if around < math.pi / 2 - 1e-6 else None

    def within_box(self, lon: Column, lat: Column) -> Column:
        """A test on the bare columns, which a scan can use, that every point of the geometry passes.

        Longitudes are taken to be from -180 to 180 where it bounds them.
        """
        cap = self.cap()
        if cap is None:
            return F.lit(True)
        at, up, r = cap[0], math.radians(cap[1]), cap[2] + 1e-9
        low, high = math.degrees(up - r), math.degrees(up + r)
        out = (lat >= low) & (lat <= high)
        if low > -90 and high < 90:
            wide = math.degrees(math.asin(min(1.0, math.sin(r) / math.cos(up)))) + 1e-9
            if -180 <= at - wide and at + wide <= 180:
                out = out & (lon >= at - wide) & (lon <= at + wide) | (lon < -180) | (lon > 180)
        return out

    def contains(self, lon: Column, lat: Column) -> Column:
        """Whether the point of two columns is in the geometry."""
        return self.within_box(lon, lat) & self._holds(lon, lat)

    def _holds(self, lon: Column, lat: Column) -> Column:
        if self.kind == "POINT":
            return angle(lon, lat, *self.points[0]) <= SAME
        if self.kind == "CIRCLE":
            return angle(lon, lat, *self.points[0]) <= self.radius / EARTH_M
        if self.kind in ("POLYGON", "CHULL"):
            return _in_ring(lon, lat, hull(self.points) if self.kind == "CHULL" else self.points)
        tests = [g._holds(lon, lat) for g in self.parts]
        out = tests[0] if tests else F.lit(False)
        for t in tests[1:]:
            out = out & t if self.kind in ("CONVEX", "GEOMETRYINTERSECTION") else out | t
        return out


def unit(lon: float, lat: float) -> tuple[float, float, float]:
    a, b = math.radians(lon), math.radians(lat)
    return math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)


def angle(lon: Column, lat: Column, to_lon: float, to_lat: float) -> Column:
    """Radians between the point of two columns and a fixed one."""
    b, d = F.radians(lat), F.radians(lon - to_lon)
    c = math.radians(to_lat)
    dot = F.sin(b) * math.sin(c) + F.cos(b) * math.cos(c) * F.cos(d)
    return F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0)))


def mean_place(lon: Column, lat: Column) -> list[Column]:
    """Aggregates _longitude and _latitude of the mean of unit vectors, right across 180 degrees."""
    a, b = F.radians(lon), F.radians(lat)
    x, y, z = F.avg(F.cos(b) * F.cos(a)), F.avg(F.cos(b) * F.sin(a)), F.avg(F.sin(b) + a * 0)
    return [F.degrees(F.atan2(y, x)).alias("_longitude"), F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("_latitude")]


def _cross(u: tuple, v: tuple) -> tuple[float, float, float]:
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def _dot(u: tuple, v: tuple) -> float:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The convex hull on the sphere, counter-clockwise from outside, of points of one hemisphere.

    The points are projected from the centre onto the plane that touches the sphere at their
    mean, where great circles are straight lines.
    """
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    vectors = [unit(*p) for p in pts]
    mean = tuple(sum(v[k] for v in vectors) for k in range(3))
    size = math.sqrt(_dot(mean, mean))
    mean = tuple(x / size for x in mean) if size > 1e-9 else (0.0, 0.0, 1.0)
    if min(_dot(v, mean) for v in vectors) <= 1e-9:
        raise ValueError("the points of a convex hull must lie within a hemisphere")
    east = _cross((0.0, 0.0, 1.0), mean) if abs(mean[2]) < 0.9 else _cross((1.0, 0.0, 0.0), mean)
    north = _cross(mean, east)
    plane = sorted((_dot(v, east) / _dot(v, mean), _dot(v, north) / _dot(v, mean), p) for v, p in zip(vectors, pts, strict=True))

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 1e-15:
                out.pop()
            out.append(p)
        return out[:-1]

    return [p for _, _, p in half(plane) + half(plane[::-1])]


def _in_ring(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether the point is within the ring, whose edges are great-circle arcs.

    Even-odd rule: the meridian from the point to the north pole crosses an edge if the edge
    spans the point's longitude and passes north of it, and once more for a ring around the
    pole. The side of an edge is the sign of a product with the normal of its great circle.
    """
    pts = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
    a, b = F.radians(lon), F.radians(lat)
    point = F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)
    crossings, turns = F.lit(0), 0.0
    for p, q in zip(pts, [*pts[1:], pts[0]], strict=True):
        span = (q[0] - p[0] + 540.0) % 360.0 - 180.0  # the shorter way from p to q
        if span == -180.0 or span == 0.0:
            continue
        turns += span
        west = p[0] if span > 0 else q[0]
        off = F.pmod(lon - west, F.lit(360.0))
        normal = _cross(unit(*p), unit(*q)) if span > 0 else _cross(unit(*q), unit(*p))
        below = point[0] * normal[0] + point[1] * normal[1] + point[2] * normal[2] < 0  # south of an edge going east
        crossings = crossings + ((off < abs(span)) & below).cast("int")
    around = round(turns / 360.0) % 2 == 1  # the pole is inside, or outside of a ring around the other one
    pole = around and _pole_inside(pts)
    return crossings % 2 == (0 if pole else 1)


def _pole_inside(pts: list[tuple[float, float]]) -> bool:
    """Whether a ring around the earth's axis holds the north pole: the nearer one is inside."""
    return sum(p[1] for p in pts) > 0


def radius_of(value: str | float) -> float:
    """Metres of a number or of a string with a unit."""
    if isinstance(value, int | float):
        return float(value)
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", value)
    if not m or (m[2] or "m") not in UNITS:
        raise ValueError(f"bad radius {value!r}")
    return float(m[1]) * UNITS[m[2] or "m"]


def parse_ewkt(text: str) -> Geometry:
    """A geometry of EWKT, in WGS 84 or the system that an SRID=n; prefix names (see crs)."""
    body = text.strip()
    m = re.match(r"(?i)srid\s*=\s*(\d+)\s*;\s*", body)
    out, rest = _geometry(body[m.end() :] if m else body)
    if rest.strip():
        raise ValueError(f"text after the geometry: {rest!r}")
    return out.moved(int(m[1])) if m else out


def _group(text: str) -> tuple[str, str]:
    if not text.lstrip().startswith("("):
        raise ValueError(f"'(' expected: {text!r}")
    text, depth = text.lstrip(), 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth:
            return text[1:i], text[i + 1 :]
    raise ValueError("unbalanced parentheses")


def _split(text: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


def _point(text: str) -> tuple[float, float]:
    xs = [float(x) for x in text.replace("(", " ").replace(")", " ").split()]
    if not 2 <= len(xs) <= 3 or abs(xs[1]) > 90:
        raise ValueError(f"bad point {text!r}")
    return xs[0], xs[1]


def _circle(text: str) -> Geometry:
    where, radius = _split(text)
    return Geometry("CIRCLE", [_point(where)], radius_of(radius.strip()))


def _rings(text: str, kind: str) -> Geometry:
    rings = [[_point(p) for p in _split(_group(r)[0])] for r in _split(text)]
    if kind == "CHULL":
        return Geometry("CHULL", [p for r in rings for p in r])
    return Geometry("POLYGON", rings[0]) if len(rings) == 1 else Geometry("GEOMETRYCOLLECTION", parts=[Geometry("POLYGON", r) for r in rings])


def _geometry(text: str) -> tuple[Geometry, str]:
    m = re.match(r"\s*([A-Za-z]+)\s*(Z\s*)?", text)
    kind = m[1].upper() if m else ""
    if kind not in KINDS:
        raise ValueError(f"not a geometry: {text!r}")
    rest = text[m.end() :]
    if rest.upper().startswith("EMPTY"):
        return Geometry("GEOMETRYCOLLECTION"), rest[5:]
    inner, rest = _group(rest)
    if kind == "POINT":
        return Geometry("POINT", [_point(inner)]), rest
    if kind == "CIRCLE":
        return _circle(inner), rest
    if kind in ("POLYGON", "CHULL"):
        return _rings(inner, kind), rest
    if kind == "CONVEX":
        return Geometry("CONVEX", parts=[_circle(_group(c)[0]) for c in _split(inner)]), rest
    if kind == "MULTIPOINT":
        return Geometry(kind, parts=[Geometry("POINT", [_point(p)]) for p in _split(inner)]), rest
    if kind == "MULTICIRCLE":
        return Geometry(kind, parts=[_circle(_group(c)[0]) for c in _split(inner)]), rest
    if kind == "MULTICONVEX":
        return Geometry(kind, parts=[Geometry("CONVEX", parts=[_circle(_group(c)[0]) for c in _split(_group(x)[0])]) for x in _split(inner)]), rest
    if kind in ("MULTIPOLYGON", "MULTICHULL"):
        return Geometry(kind, parts=[_rings(_group(p)[0], kind[5:]) for p in _split(inner)]), rest
    parts, left = [], inner
    while left.strip():
        g, left = _geometry(left.lstrip(" ,"))
        parts.append(g)
    return Geometry(kind, parts=parts), rest


def from_object(kind: str, value: dict | list | str) -> Geometry:
    """A geometry of a query object such as {"_circle": {_latitude, _longitude, _radius}}."""
    name = kind.lstrip("_").lower()
    if isinstance(value, str):
        return parse_ewkt(value if value.upper().startswith(KINDS) or "SRID" in value.upper() else f"{name.upper()}{value}")
    pts = lambda v: [(float(a), float(b)) for a, b in (zip(v["_longitude"], v["_latitude"], strict=True) if isinstance(v, dict) and isinstance(v["_longitude"], list) else [(v["_longitude"], v["_latitude"])] if isinstance(v, dict) else [x[:2] for x in (v if isinstance(v[0], list | tuple) else [v])])]
    if name == "point":
        return Geometry("POINT", pts(value)[:1])
    if name == "circle":
        return Geometry("CIRCLE", pts(value)[:1], radius_of(value["_radius"]))
    if name in ("polygon", "chull"):
        return Geometry(name.upper(), pts(value))
    if name == "multipoint":
        return Geometry("MULTIPOINT", parts=[Geometry("POINT", [p]) for p in pts(value)])
    if name in ("convex", "multicircle"):
        return Geometry(name.upper(), parts=[from_object("circle", v) for v in value])
    if name in ("multipolygon", "multichull"):
        return Geometry(name.upper(), parts=[from_object(name[5:], v) for v in value])
    if name in ("geometrycollection", "geometryintersection"):
        items = value.items() if isinstance(value, dict) else [x for v in value for x in v.items()]
        return Geometry(name.upper(), parts=[from_object(k, v) for k, v in items])
    raise ValueError(f"unknown geometry {kind!r}")


_CORNERS = np.array([[0, 0, 1], [1, 0, 0], [0, 1, 0], [-1, 0, 0], [0, -1, 0], [0, 0, -1]], float)
_FACES = [(1, 5, 2), (2, 5, 3), (3, 5, 4), (4, 5, 1), (1, 0, 4), (4, 0, 3), (3, 0, 2), (2, 0, 1)]  # S0-S3, N0-N3


def trixel_ids(lon: np.ndarray, lat: np.ndarray, level: int) -> np.ndarray:
    """Mesh ids: 8 + the face, then two bits a level."""
    a, b = np.radians(lon), np.radians(lat)
    p = np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], 1)
    inside = lambda u, v: np.einsum("ij,ij->i", np.cross(u, v), p) >= -1e-15
    ids = np.zeros(len(p), np.int64)
    tri = np.zeros((len(p), 3, 3))
    todo = np.ones(len(p), bool)
    for k, face in enumerate(_FACES):
        v = np.broadcast_to(_CORNERS[list(face)], (len(p), 3, 3))
        hit = todo & inside(v[:, 0], v[:, 1]) & inside(v[:, 1], v[:, 2]) & inside(v[:, 2], v[:, 0])
        ids[hit], tri[hit] = 8 + k, v[hit]
        todo &= ~hit
    for _ in range(level):
        w = [tri[:, 1] + tri[:, 2], tri[:, 0] + tri[:, 2], tri[:, 0] + tri[:, 1]]
        w = [x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in w]
        kids = [(tri[:, 0], w[2], w[1]), (tri[:, 1], w[0], w[2]), (tri[:, 2], w[1], w[0]), (w[0], w[1], w[2])]
        child = np.full(len(p), 3)
        for k in (2, 1, 0):
            u, v, x = kids[k]
            child[inside(u, v) & inside(v, x) & inside(x, u)] = k
        ids = ids * 4 + child
        tri = np.stack([np.stack(kid, 1) for kid in kids], 0)[child, np.arange(len(p))]
    return ids


def cover(shape: Geometry, level: int, most: int = 64) -> list[tuple[int, int]]:
    """Ranges of mesh ids of a level (both ends included) that hold every point of the geometry.

    Convex shapes and intersections intersect their parts' covers, collections unite them;
    other shapes are covered by the triangles that meet a circle around them. The least gaps
    are closed until at most `most` ranges are left.
    """
    if shape.kind in ("CONVEX", "GEOMETRYINTERSECTION"):
        found = cover(shape.parts[0], level, most)
        for g in shape.parts[1:]:
            found = intersect_ranges(found, cover(g, level, most))
    elif shape.parts or shape.kind not in ("POINT", "CIRCLE", "POLYGON", "CHULL"):
        found = []
        for g in shape.parts:
            found = union_ranges(found, cover(g, level, most))
    else:
        found = _circle_cover(shape.cap(), level)
    while len(found) > most:
        k = min(range(1, len(found)), key=lambda i: found[i][0] - found[i - 1][1])
        found = [*found[: k - 1], (found[k - 1][0], found[k][1]), *found[k + 1 :]]
    return found


def _circle_cover(cap: tuple[float, float, float] | None, level: int) -> list[tuple[int, int]]:
    """Ranges of the triangles that meet a circle; triangles wholly within it aren't divided."""
    if cap is None:
        return [(8 << 2 * level, (16 << 2 * level) - 1)]
    middle, reach = unit(cap[0], cap[1]), cap[2] + 1e-9
    apart = lambda u, v: math.acos(max(-1.0, min(1.0, _dot(u, v))))
    out: list[tuple[int, int]] = []
    todo = [(8 + k, tuple(tuple(_CORNERS[i]) for i in face), 0) for k, face in enumerate(_FACES)]
    while todo:
        at, (u, v, w), depth = todo.pop()
        heart = _between(*(tuple(sum(c) for c in zip(u, v, w, strict=True)),) * 2)
        size = max(apart(heart, x) for x in (u, v, w))
        off = apart(heart, middle)
        if off > reach + size + 1e-9:
            continue
        shift = 2 * (level - depth)
        if shift == 0 or off + size <= reach and reach < math.pi / 2:
            out.append((at << shift, ((at + 1) << shift) - 1))
            continue
        a, b, c = _between(v, w), _between(u, w), _between(u, v)
        todo += [(4 * at + k, t, depth + 1) for k, t in enumerate([(u, c, b), (v, a, c), (w, b, a), (a, b, c)])]
    return union_ranges(out, [])


def _between(u: tuple, v: tuple) -> tuple[float, float, float]:
    """The middle of the arc between two points."""
    w = [float(x + y) for x, y in zip(u, v, strict=True)]
    size = math.sqrt(_dot(w, w))
    return w[0] / size, w[1] / size, w[2] / size


def trixel(lon: Column, lat: Column, level: int) -> Column:
    """The mesh id of the point at a level from 0 to 25."""
    if not 0 <= level <= 25:
        raise ValueError("levels are 0 to 25")

    @F.pandas_udf("long")
    def ids(x: pd.Series, y: pd.Series) -> pd.Series:
        ok = (x.notna() & y.notna()).to_numpy()
        out = pd.Series(pd.array([None] * len(x), "Int64"))
        out[ok] = trixel_ids(x[ok].to_numpy(float), y[ok].to_numpy(float), level)
        return out

    return ids(lon, lat)


def union_ranges(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(a + b):
        if out and s <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def intersect_ranges(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return union_ranges([], [(max(s, t), min(e, f)) for s, e in a for t, f in b if max(s, t) <= min(e, f)])


def xor_ranges(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    both, out = intersect_ranges(a, b), []
    for s, e in union_ranges(a, b):
        for t, f in [x for x in both if s <= x[0] <= e]:
            if s < t:
                out.append((s, t - 1))
            s = f + 1
        if s <= e:
            out.append((s, e))
    return out
