"""Geodetic reference systems: coordinates of other datums as WGS 84 longitude and latitude."""

from __future__ import annotations

import math

# Ellipsoids as semi-major and semi-minor axis in metres.
WGS_84 = (6378137.0, 6356752.314245179)
GRS_80 = (6378137.0, 6356752.314140356)
AIRY = (6377563.396, 6356256.909237285)
AIRY_MODIFIED = (6377340.189, 6356034.447938534)
INTERNATIONAL = (6378388.0, 6356911.946127946)
BESSEL = (6377397.155, 6356078.962818188)
HELMERT = (6378200.0, 6356818.169627891)
AUSTRALIAN = (6378160.0, 6356774.719195305)
CLARKE = (6378206.4, 6356583.79999898)
KRASSOVSKY = (6378245.0, 6356863.018773047)
WGS_72 = (6378135.0, 6356750.520016093)

# By SRID, the ellipsoid and the shift to WGS 84: metres along x, y and z,
# rotations about them in seconds of arc, and the scale's excess in parts per million.
DATUMS: dict[int, tuple[tuple[float, float], tuple[float, ...]]] = {
    3906: (BESSEL, (515.149, 186.233, 511.959, 5.49721, 3.51742, -12.948, 0.782)),
    4121: (GRS_80, (-199.87, 74.79, 246.62, 0.0, 0.0, 0.0, 0.0)),
    4178: (KRASSOVSKY, (21.58719, -97.541, -60.925, 1.01378, 0.58117, 0.2348, -4.6121)),
    4203: (AUSTRALIAN, (-116.0, -50.47, 141.69, 0.23, 0.39, 0.344, 0.0983)),
    4229: (HELMERT, (-130.0, 110.0, -13.0, 0.0, 0.0, 0.0, 0.0)),
    4230: (INTERNATIONAL, (-87.0, -98.0, -121.0, 0.0, 0.0, 0.0, 0.0)),
    4267: (CLARKE, (-8.0, 160.0, 176.0, 0.0, 0.0, 0.0, 0.0)),
    4269: (GRS_80, (1.0, 1.0, -1.0, 0.0, 0.0, 0.0, 0.0)),
    4277: (AIRY, (446.448, -125.157, 542.06, 0.15, 0.247, 0.8421, -20.4894)),
    4299: (AIRY_MODIFIED, (482.53, -130.596, 564.557, -1.042, -0.214, -0.631, 8.15)),
    4300: (AIRY_MODIFIED, (482.5, -130.6, 564.6, -1.042, -0.214, -0.631, 8.15)),
    4301: (BESSEL, (-148.0, 507.0, 685.0, 0.0, 0.0, 0.0, 0.0)),
    4314: (BESSEL, (582.0, 105.0, 414.0, 1.04, 0.35, -3.08, 8.3)),
    4322: (WGS_72, (0.0, 0.0, 4.5, 0.0, 0.0, 0.554, 0.219)),
    4326: (WGS_84, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)),
    4618: (AUSTRALIAN, (-57.0, 1.0, -41.0, 0.0, 0.0, 0.0, 0.0)),
    4668: (INTERNATIONAL, (-86.0, -98.0, -119.0, 0.0, 0.0, 0.0, 0.0)),
}


def geocentric(lon: float, lat: float, axes: tuple[float, float]) -> tuple[float, float, float]:
    """Metres from the earth's centre of a point on the ellipsoid."""
    major, minor = axes
    squeeze = (minor / major) ** 2
    a, b = math.radians(lon), math.radians(lat)
    radius = major / math.sqrt(math.cos(b) ** 2 + squeeze * math.sin(b) ** 2)
    return radius * math.cos(b) * math.cos(a), radius * math.cos(b) * math.sin(a), squeeze * radius * math.sin(b)


def geodetic(x: float, y: float, z: float, axes: tuple[float, float]) -> tuple[float, float]:
    """Longitude and latitude, by Bowring's iteration on the reduced latitude."""
    major, minor = axes
    flat = math.hypot(x, y)
    outer, inner = (major**2 - minor**2) / minor, (major**2 - minor**2) / major
    reduced = math.atan2(z * major, flat * minor)
    lat = reduced
    for _ in range(6):
        lat = math.atan2(z + outer * math.sin(reduced) ** 3, flat - inner * math.cos(reduced) ** 3)
        reduced = math.atan2(minor * math.sin(lat), major * math.cos(lat))
    return math.degrees(math.atan2(y, x)), math.degrees(lat)


def to_wgs84(lon: float, lat: float, srid: int) -> tuple[float, float]:
    """The WGS 84 longitude and latitude of a point of another datum (seven-parameter shift)."""
    if srid not in DATUMS:
        raise ValueError(f"SRID {srid} isn't supported")
    if srid == 4326:
        return lon, lat
    axes, (dx, dy, dz, *turns, excess) = DATUMS[srid]
    rx, ry, rz = (math.radians(t / 3600) for t in turns)
    x, y, z = geocentric(lon, lat, axes)
    scale = 1 + excess / 1e6
    shifted = dx + scale * (x - rz * y + ry * z), dy + scale * (rz * x + y - rx * z), dz + scale * (z - ry * x + rx * y)
    return geodetic(*shifted, WGS_84)
