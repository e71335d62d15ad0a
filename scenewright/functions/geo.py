"""Geodesy on WGS84 as Column expressions, so that it stays inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The WGS84 ellipsoid.
WGS84_A = 6378137.0
WGS84_B = 6356752.314245

_E2 = 1 - (WGS84_B / WGS84_A) ** 2
_EP2 = (WGS84_A / WGS84_B) ** 2 - 1


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def ecef_from_lla(lat, lon, alt=0.0) -> tuple[Column, Column, Column]:
    """Degrees and metres to earth-centred x, y, z."""
    la, lo, h = F.radians(_c(lat)), F.radians(_c(lon)), _c(alt)
    n = F.lit(WGS84_A) / F.sqrt(F.lit(1.0) - F.lit(_E2) * F.sin(la) * F.sin(la))
    return ((n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo), (n * F.lit(1 - _E2) + h) * F.sin(la))


def lla_from_ecef(x, y, z) -> tuple[Column, Column, Column]:
    """Earth-centred x, y, z to degrees and metres in closed form; below 10 km of height good to a micrometre.

    The expressions repeat their inputs: give plain columns, or use :func:`with_lla`.
    """
    x, y, z = _c(x), _c(y), _c(z)
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * F.lit(WGS84_A), p * F.lit(WGS84_B))
    lat = F.atan2(z + F.lit(_EP2 * WGS84_B) * F.pow(F.sin(t), 3), p - F.lit(_E2 * WGS84_A) * F.pow(F.cos(t), 3))
    s, c = F.sin(lat), F.cos(lat)
    alt = p * c + z * s - F.lit(WGS84_A) * F.sqrt(F.lit(1.0) - F.lit(_E2) * s * s)
    return F.degrees(lat), F.degrees(F.atan2(y, x)), alt


def with_lla(df: DataFrame, e, n, u, ref_lat, ref_lon, ref_alt=0.0, names: tuple[str, str, str] = ("lat", "lon", "alt")) -> DataFrame:
    """``df`` with degrees and metres of its topocentric positions, in two steps that keep the expressions short."""
    x, y, z = ecef_from_topocentric(e, n, u, ref_lat, ref_lon, ref_alt)
    df = df.withColumns({"_x": x, "_y": y, "_z": z})
    return df.withColumns(dict(zip(names, lla_from_ecef("_x", "_y", "_z")))).drop("_x", "_y", "_z")


def ecef_from_topocentric(e, n, u, ref_lat, ref_lon, ref_alt=0.0) -> tuple[Column, Column, Column]:
    """East, north, up in metres about a reference point to earth-centred x, y, z."""
    e, n, u = _c(e), _c(n), _c(u)
    la, lo = F.radians(_c(ref_lat)), F.radians(_c(ref_lon))
    x0, y0, z0 = ecef_from_lla(ref_lat, ref_lon, ref_alt)
    horizontal = F.cos(la) * u - F.sin(la) * n
    return (
        x0 + F.cos(lo) * horizontal - F.sin(lo) * e,
        y0 + F.sin(lo) * horizontal + F.cos(lo) * e,
        z0 + F.cos(la) * n + F.sin(la) * u,
    )


def topocentric_from_lla(lat, lon, alt, ref_lat, ref_lon, ref_alt=0.0) -> tuple[Column, Column, Column]:
    """Degrees and metres to east, north, up about a reference point."""
    x, y, z = ecef_from_lla(lat, lon, alt)
    x0, y0, z0 = ecef_from_lla(ref_lat, ref_lon, ref_alt)
    dx, dy, dz = x - x0, y - y0, z - z0
    la, lo = F.radians(_c(ref_lat)), F.radians(_c(ref_lon))
    radial = F.cos(lo) * dx + F.sin(lo) * dy
    return (
        F.cos(lo) * dy - F.sin(lo) * dx,
        F.cos(la) * dz - F.sin(la) * radial,
        F.cos(la) * radial + F.sin(la) * dz,
    )


def chord_metres(lat1, lon1, alt1, lat2, lon2, alt2) -> Column:
    """Straight-line distance between two points of the ellipsoid."""
    x, y, z = ecef_from_lla(lat1, lon1, alt1)
    a, b, c = ecef_from_lla(lat2, lon2, alt2)
    return F.sqrt((x - a) * (x - a) + (y - b) * (y - b) + (z - c) * (z - c))


def bearing_degrees(lat1, lon1, lat2, lon2) -> Column:
    """Initial compass bearing from one point to another, in [0, 360)."""
    a, b, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    t = F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))
    return F.pmod(F.degrees(t), F.lit(360.0))
