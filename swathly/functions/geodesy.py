"""Ellipsoid, local frames and map projections.

Angles are radians unless a name says ``deg``. Projections are closed forms: a Krueger
series of fourth order for transverse Mercator (well under a millimetre within a zone) and the
published approximate formulas for the Swiss grid (about a metre). Other codes are refused.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import Mat, Vec, col, matvec, sub

# WGS 84.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)
WGS84_B = WGS84_A * (1 - WGS84_F)


def geodetic_to_ecef(lat, lon, h, degrees: bool = False) -> Vec:
    lat, lon, h = col(lat), col(lon), col(h)
    if degrees:
        lat, lon = F.radians(lat), F.radians(lon)
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(lat) * F.sin(lat))
    return [(n + h) * F.cos(lat) * F.cos(lon), (n + h) * F.cos(lat) * F.sin(lon), (n * (1 - WGS84_E2) + h) * F.sin(lat)]


def ecef_to_geodetic(x, y, z) -> Vec:
    """Bowring's formula, one pass: lat, lon, h."""
    x, y, z = col(x), col(y), col(z)
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * WGS84_A, p * WGS84_B)
    ep2 = WGS84_E2 / (1 - WGS84_E2)
    lat = F.atan2(z + ep2 * WGS84_B * F.pow(F.sin(theta), 3), p - WGS84_E2 * WGS84_A * F.pow(F.cos(theta), 3))
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(lat) * F.sin(lat))
    # The polar axis has no cosine to divide by.
    h = F.when(F.abs(F.cos(lat)) > 1e-9, p / F.cos(lat) - n).otherwise(F.abs(z) - WGS84_B)
    return [lat, F.atan2(y, x), h]


def ecef_to_ned(lat, lon) -> Mat:
    lat, lon = col(lat), col(lon)
    sl, cl, so, co = F.sin(lat), F.cos(lat), F.sin(lon), F.cos(lon)
    return [[-sl * co, -sl * so, cl], [-so, co, F.lit(0.0)], [-cl * co, -cl * so, -sl]]


def ecef_to_enu(lat, lon) -> Mat:
    n, e, d = ecef_to_ned(lat, lon)
    return [e, n, [-x for x in d]]


def swap_ned_enu(v: Vec) -> Vec:
    return [v[1], v[0], -v[2]]


def local_enu(point: Vec, lat, lon, h) -> Vec:
    """ECEF point relative to a geodetic origin, as east, north, up."""
    return matvec(ecef_to_enu(lat, lon), sub(point, geodetic_to_ecef(lat, lon, h)))


def metres_apart(lat1, lon1, lat2, lon2) -> Column:
    """Horizontal distance in metres of two points in degrees, at 111 000 metres a degree."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    dx = (lon2 - lon1) * 111_000.0 * F.cos(F.radians(lat1))
    dy = (lat2 - lat1) * 111_000.0
    return F.sqrt(dx * dx + dy * dy)


def refractive_index(altitude) -> Column:
    """Of air, falling linearly with altitude."""
    return 1.0003 - 0.0000205 * col(altitude) / 1000


def light_speed(altitude) -> Column:
    return 299_792_458.0 / refractive_index(altitude)


def utm_central_meridian(epsg: int) -> float:
    """Degrees, for the zones 326xx (north) and 327xx (south)."""
    zone = epsg % 100
    if epsg // 100 not in (326, 327) or not 1 <= zone <= 60:
        raise ValueError(f"EPSG:{epsg} is not a UTM zone of WGS 84")
    return zone * 6.0 - 183.0


_N = WGS84_F / (2 - WGS84_F)
_RADIUS = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# The published series in the third flattening, to its fourth power.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def utm_forward(lat_deg, lon_deg, epsg: int) -> Vec:
    """Easting and northing."""
    lat, lon = F.radians(col(lat_deg)), F.radians(col(lon_deg) - utm_central_meridian(epsg))
    k = 2 * math.sqrt(_N) / (1 + _N)
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(F.sin(lat)) - k * atanh(k * F.sin(lat)))
    xi = F.atan2(t, F.cos(lon))
    eta = atanh(F.sin(lon) / F.sqrt(1 + t * t))
    e, n = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n = n + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    south = 10_000_000.0 if epsg // 100 == 327 else 0.0
    return [500_000.0 + 0.9996 * _RADIUS * e, south + 0.9996 * _RADIUS * n]


def utm_inverse(east, north, epsg: int) -> Vec:
    """Latitude and longitude in degrees."""
    south = 10_000_000.0 if epsg // 100 == 327 else 0.0
    xi, eta = (col(north) - south) / (0.9996 * _RADIUS), (col(east) - 500_000.0) / (0.9996 * _RADIUS)
    x, y = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return [F.degrees(lat), utm_central_meridian(epsg) + F.degrees(F.atan2(F.sinh(y), F.cos(x)))]


def swiss_forward(lat_deg, lon_deg) -> Vec:
    """LV95 easting and northing by the published approximation (about a metre)."""
    p = (col(lat_deg) * 3600 - 169028.66) / 10000
    m = (col(lon_deg) * 3600 - 26782.5) / 10000
    e = 2600072.37 + 211455.93 * m - 10938.51 * m * p - 0.36 * m * p * p - 44.54 * m * m * m
    n = 1200147.07 + 308807.95 * p + 3745.25 * m * m + 76.63 * p * p - 194.56 * m * m * p + 119.79 * p * p * p
    return [e, n]


def swiss_inverse(east, north) -> Vec:
    """Latitude and longitude in degrees by the published approximation (about a metre)."""
    y, x = (col(east) - 2600000) / 1000000, (col(north) - 1200000) / 1000000
    lon = 2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y
    lat = 16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x
    return [lat * 100 / 36, lon * 100 / 36]


def project(lat_deg, lon_deg, epsg: int) -> Vec:
    """Forward transform from WGS 84 degrees; codes without a formula here are refused."""
    if epsg == 4326:
        return [col(lon_deg), col(lat_deg)]
    if epsg == 2056:
        return swiss_forward(lat_deg, lon_deg)
    if epsg == 3857:
        return web_mercator(lat_deg, lon_deg)
    return utm_forward(lat_deg, lon_deg, epsg)


def project3(lat_deg, lon_deg, h, epsg: int) -> Vec:
    """The same with heights over the ellipsoid, which 4978 (Earth-centred) and 4979 (geographic, longitude first) take in."""
    if epsg == 4978:
        return geodetic_to_ecef(lat_deg, lon_deg, h, degrees=True)
    return [*project(lat_deg, lon_deg, 4326 if epsg == 4979 else epsg), col(h)]


def unproject3(x, y, z, epsg: int) -> Vec:
    """Latitude and longitude in degrees, and height over the ellipsoid."""
    if epsg == 4978:
        lat, lon, h = ecef_to_geodetic(x, y, z)
        return [F.degrees(lat), F.degrees(lon), h]
    return [*unproject(x, y, 4326 if epsg == 4979 else epsg), col(z)]


def unproject(x, y, epsg: int) -> Vec:
    """Latitude and longitude in degrees from map coordinates."""
    if epsg == 4326:
        return [col(y), col(x)]
    if epsg == 2056:
        return swiss_inverse(x, y)
    return utm_inverse(x, y, epsg)


def grid_convergence(lat_deg, lon_deg, epsg: int, step: float = 0.01) -> Column:
    """Degrees between grid and true north, by a step along the meridian."""
    a, b = project(lat_deg, lon_deg, epsg), project(col(lat_deg) + step, lon_deg, epsg)
    return F.degrees(F.atan2(b[0] - a[0], b[1] - a[1]))


def swiss_geoid(east, north) -> Column:
    """Undulation in metres by a plane (1 to 2 m)."""
    return 49.5 + 1.5e-5 * (col(east) - 2_600_000) + 2.0e-5 * (col(north) - 1_200_000)


def within_swiss(east, north) -> Column:
    return col(east).between(2_485_000, 2_834_000) & col(north).between(1_075_000, 1_296_000)


def web_mercator(lat_deg, lon_deg) -> Vec:
    return [F.radians(col(lon_deg)) * WGS84_A, F.log(F.tan(math.pi / 4 + F.radians(col(lat_deg)) / 2)) * WGS84_A]


def earth_rate_heading(heading, wander, mode: str = "plus") -> Column:
    """True heading from platform heading and wander angle: plus, minus or raw."""
    if mode == "raw":
        return col(heading)
    h = col(heading) + col(wander) if mode == "plus" else col(heading) - col(wander)
    return F.pmod(h, F.lit(2 * math.pi)) if mode == "plus" else h
