"""Coordinate systems as pure Column expressions, inside whole-stage codegen.

Transverse Mercator by the textbook series on an ellipsoid (Snyder 1987,
eqs. 8-9 to 8-25), geocentric conversion with a fixed number of iterations,
and a seven-parameter Helmert shift. Null in, null out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

K0 = 0.9996


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inverse_f: float

    @property
    def f(self) -> float:
        return 1 / self.inverse_f

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def ep2(self) -> float:
        return self.e2 / (1 - self.e2)


# Fixed values of the two ellipsoids and of the datum shift between them.
WGS84 = Ellipsoid(6378137.0, 298.257223563)
EVEREST_1830 = Ellipsoid(6377276.345, 300.8017)
EVEREST_TO_WGS84 = (295.0, 736.0, 257.0, 0.0, 0.0, 0.0, 0.0)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def utm_zone(lon) -> Column:
    """Zone number 1 to 60 of a longitude."""
    return (F.pmod(F.floor((col(lon) + 180) / 6), F.lit(60)) + 1).cast("int")


def utm_epsg(zone, northern=True) -> Column:
    north = col(northern)
    return (F.when(north, 32600).otherwise(32700) + col(zone)).cast("int")


def central_meridian(zone) -> Column:
    """Degrees."""
    return (col(zone) - 1) * 6 - 180 + 3


def meridional_arc(phi: Column, ell: Ellipsoid = WGS84) -> Column:
    e2, e4, e6 = ell.e2, ell.e2**2, ell.e2**3
    return ell.a * (
        (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
        - (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
        + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi)
        - (35 * e6 / 3072) * F.sin(6 * phi)
    )


def geodetic_to_utm(lon, lat, zone, ell: Ellipsoid = WGS84) -> tuple[Column, Column]:
    """Easting and northing of degrees in a zone; false northing 1e7 south of the equator."""
    phi = F.radians(col(lat))
    lam = F.radians(col(lon) - central_meridian(zone))
    n = ell.a / F.sqrt(1 - ell.e2 * F.pow(F.sin(phi), 2))
    t = F.pow(F.tan(phi), 2)
    c = ell.ep2 * F.pow(F.cos(phi), 2)
    a = F.cos(phi) * lam
    east = K0 * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ell.ep2) * F.pow(a, 5) / 120) + 500000.0
    north = K0 * (
        meridional_arc(phi, ell)
        + n
        * F.tan(phi)
        * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ell.ep2) * F.pow(a, 6) / 720)
    )
    return east, north + F.when(col(lat) < 0, 1e7).otherwise(0.0)


def utm_to_geodetic(east, north, zone, northern: bool = True, ell: Ellipsoid = WGS84) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    x = col(east) - 500000.0
    m = (col(north) - (0.0 if northern else 1e7)) / K0
    e2 = ell.e2
    mu = m / (ell.a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    q = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    phi = (
        mu
        + (3 * q / 2 - 27 * q**3 / 32) * F.sin(2 * mu)
        + (21 * q**2 / 16 - 55 * q**4 / 32) * F.sin(4 * mu)
        + (151 * q**3 / 96) * F.sin(6 * mu)
        + (1097 * q**4 / 512) * F.sin(8 * mu)
    )
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    c1, t1 = ell.ep2 * c * c, t * t
    w = 1 - e2 * s * s
    n = ell.a / F.sqrt(w)
    r = ell.a * (1 - e2) / F.pow(w, 1.5)
    d = x / (n * K0)
    lat = phi - (n * t / r) * (
        d * d / 2
        - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * ell.ep2) * F.pow(d, 4) / 24
        + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * ell.ep2 - 3 * c1 * c1) * F.pow(d, 6) / 720
    )
    lon = (d - (1 + 2 * t1 + c1) * F.pow(d, 3) / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * ell.ep2 + 24 * t1 * t1) * F.pow(d, 5) / 120) / c
    return F.degrees(lon) + central_meridian(zone), F.degrees(lat)


def geodetic_to_ecef(lon, lat, h, ell: Ellipsoid) -> tuple[Column, Column, Column]:
    lam, phi, h = F.radians(col(lon)), F.radians(col(lat)), col(h)
    n = ell.a / F.sqrt(1 - ell.e2 * F.pow(F.sin(phi), 2))
    return (n + h) * F.cos(phi) * F.cos(lam), (n + h) * F.cos(phi) * F.sin(lam), (n * (1 - ell.e2) + h) * F.sin(phi)


def ecef_to_geodetic(x, y, z, ell: Ellipsoid, rounds: int = 8) -> tuple[Column, Column, Column]:
    """Fixed-point iteration folded over a constant sequence, so the expression stays small."""
    x, y, z = col(x), col(y), col(z)
    p = F.hypot(x, y)
    e2 = ell.e2

    def step(phi: Column, _: Column) -> Column:
        n = ell.a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
        h = p / F.cos(phi) - n
        return F.atan2(z, p * (1 - e2 * n / (n + h)))

    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.atan2(z, p * (1 - e2)), step)
    n = ell.a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    return F.degrees(F.atan2(y, x)), F.degrees(phi), p / F.cos(phi) - n


def helmert(x, y, z, p=EVEREST_TO_WGS84, inverse: bool = False) -> tuple[Column, Column, Column]:
    """Position-vector shift: translations in m, rotations in arc seconds, scale in ppm."""
    k = -1.0 if inverse else 1.0
    sec = 3.141592653589793 / (180 * 3600)
    tx, ty, tz, rx, ry, rz, s = (k * v for v in p)
    rx, ry, rz, s = rx * sec, ry * sec, rz * sec, 1 + s * 1e-6
    x, y, z = col(x), col(y), col(z)
    return tx + s * (x - rz * y + ry * z), ty + s * (rz * x + y - rx * z), tz + s * (-ry * x + rx * y + z)


def everest_to_wgs84(lon, lat, h=0.0) -> tuple[Column, Column, Column]:
    return ecef_to_geodetic(*helmert(*geodetic_to_ecef(lon, lat, h, EVEREST_1830)), WGS84)


def wgs84_to_everest(lon, lat, h=0.0) -> tuple[Column, Column, Column]:
    return ecef_to_geodetic(*helmert(*geodetic_to_ecef(lon, lat, h, WGS84), inverse=True), EVEREST_1830)
