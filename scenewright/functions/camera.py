"""Camera models as Column expressions: points in front of a camera to normalised image coordinates, and rays back."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tangents of the angle from the axis up to which distortion polynomials of flat images are trusted.
WIDEST = 2.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def in_camera(px, py, pz, e, n, u, heading) -> tuple[Column, Column, Column]:
    """A point as right, down and forward of a level camera at (e, n, u) that looks along ``heading`` (radians from north)."""
    dx, dy, dz, h = _c(px) - _c(e), _c(py) - _c(n), _c(pz) - _c(u), _c(heading)
    return F.cos(h) * dx - F.sin(h) * dy, -dz, F.sin(h) * dx + F.cos(h) * dy


def projected(kind, x, y, z, focal, k1=0.0, k2=0.0) -> tuple[Column, Column]:
    """Normalised image coordinates under perspective, simple_radial, radial, brown (its radial part), fisheye, dual or spherical models.

    Null behind the camera, on the axis of a fisheye, or beyond ``WIDEST`` of a flat image, where the polynomial folds over. ``dual`` is the
    mean of perspective and fisheye; other kinds have none.
    """
    kind, x, y, z, f, k1, k2 = map(_c, (kind, x, y, z, focal, k1, k2))
    k1, k2 = F.coalesce(k1, F.lit(0.0)), F.when(kind == "simple_radial", 0.0).otherwise(F.coalesce(k2, F.lit(0.0)))
    flat = x * x + y * y
    seen = (z > 0) & (flat < WIDEST * WIDEST * z * z)
    r2 = flat / (z * z)
    bend = f / z * (1.0 + r2 * (k1 + r2 * k2))
    r = F.sqrt(flat)
    t = F.atan2(r, z)
    fish = f / r * t * (1.0 + t * t * (k1 + t * t * k2))
    turn = F.lit(2 * math.pi)

    def one(a: Column, sphere: Column) -> Column:
        return (
            F.when(kind.isin("perspective", "simple_radial", "radial", "brown") & seen, a * bend)
            .when((kind == "fisheye") & seen & (flat > 0), a * fish)
            .when((kind == "dual") & seen & (flat > 0), a * (bend + fish) / 2.0)
            .when(kind.isin("spherical", "equirectangular") & (flat + z * z > 0), sphere / turn)
        )

    return one(x, F.atan2(x, z)), one(y, F.atan2(y, F.sqrt(x * x + z * z)))


def ray(kind, u, v, focal, k1=0.0, k2=0.0, rounds: int = 20) -> Column:
    """Unit ray (array) of normalised image coordinates; the distortion is undone by Newton steps inside one loop expression."""
    kind, u, v, f, k1, k2 = map(_c, (kind, u, v, focal, k1, k2))
    k1, k2 = F.coalesce(k1, F.lit(0.0)), F.when(kind == "simple_radial", 0.0).otherwise(F.coalesce(k2, F.lit(0.0)))
    d = F.sqrt(u * u + v * v) / f

    def newton(r: Column, _i: Column) -> Column:
        value = r * (1.0 + r * r * (k1 + r * r * k2)) - d
        slope = 1.0 + r * r * (3.0 * k1 + 5.0 * k2 * r * r)
        return r - value / F.when(F.abs(slope) > 1e-9, slope).otherwise(1e-9)

    r = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), d, newton)
    t = F.when(kind == "fisheye", r).otherwise(F.atan(r))
    away = F.sqrt(u * u + v * v)
    side = F.when(away > 0, F.sin(t) / away).otherwise(0.0)
    lon, lat = u * 2 * math.pi, v * 2 * math.pi
    sphere = F.array(F.cos(lat) * F.sin(lon), F.sin(lat), F.cos(lat) * F.cos(lon))
    return F.when(kind.isin("spherical", "equirectangular"), sphere).otherwise(F.array(u * side, v * side, F.cos(t)))


def inside_frame(u, v, width, height) -> Column:
    """Whether normalised coordinates lie strictly inside a frame of ``width`` x ``height`` pixels."""
    size = F.greatest(_c(width), _c(height)).cast("double")
    return (F.abs(_c(u)) < _c(width) / size / 2.0) & (F.abs(_c(v)) < _c(height) / size / 2.0)


def angle_between(a: list, b: list) -> Column:
    """Angle of two vectors given by three columns each, 0 where one has no length."""
    dot = lambda p, q: sum((_c(x) * _c(y) for x, y in zip(p[1:], q[1:])), _c(p[0]) * _c(q[0]))
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, F.acos(F.least(F.greatest(dot(a, b) / size, F.lit(-1.0)), F.lit(1.0)))).otherwise(0.0)


def moved(x, y, z, scale: float, rotation: list[list[float]], shift: list[float]) -> tuple[Column, Column, Column]:
    """scale * rotation * (x, y, z) + shift."""
    p = (_c(x), _c(y), _c(z))
    return tuple(scale * (p[0] * r[0] + p[1] * r[1] + p[2] * r[2]) + t for r, t in zip(rotation, shift))
