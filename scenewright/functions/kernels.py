"""Numeric kernels for groups of rows, in plain numpy, and their wrappers over groups."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def triangulate_midpoint(centres: np.ndarray, bearings: np.ndarray) -> np.ndarray | None:
    """The point nearest to all rays, in least squares; None where rays are parallel or fewer than two."""
    if len(centres) < 2:
        return None
    b = bearings / np.linalg.norm(bearings, axis=1, keepdims=True)
    m = np.eye(3) - b[:, :, None] * b[:, None, :]
    a, r = m.sum(0), (m @ centres[:, :, None]).sum(0)[:, 0]
    return np.linalg.solve(a, r) if np.linalg.cond(a) < 1e10 else None


def similarity(source: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and shift that carry ``source`` onto ``target`` in least squares."""
    a, b = source.mean(0), target.mean(0)
    x, y = source - a, target - b
    u, d, vt = np.linalg.svd(y.T @ x / len(x))
    sign = np.diag([1.0] * (len(d) - 1) + [np.sign(np.linalg.det(u @ vt)) or 1.0])
    rotation = u @ sign @ vt
    scale = float((d * np.diag(sign)).sum() / max((x**2).sum() / len(x), 1e-300))
    return scale, rotation, b - scale * rotation @ a


def ransac(n: int, sample: int, estimate, errors, threshold: float, rounds: int = 500, seed: int = 42):
    """The model with most errors below ``threshold`` among seeded samples, refitted on its inliers, and their mask."""
    rng = np.random.default_rng(seed)
    best = np.zeros(n, dtype=bool)
    if n < sample:
        return None, best
    need = rounds
    k = 0
    while k < min(need, rounds):
        model = estimate(rng.choice(n, sample, replace=False))
        inside = errors(model) < threshold
        if inside.sum() > best.sum():
            best = inside
            share = min(max(inside.mean(), 1e-9), 1 - 1e-9)
            need = int(np.ceil(np.log(1e-5) / np.log(max(1 - share**sample, 1e-12)))) if share**sample < 1 else 1
        k += 1
    return (estimate(np.flatnonzero(best)) if best.sum() >= sample else None), best


def scores(errors: np.ndarray, threshold: float) -> dict[str, float]:
    """Scores of a model by its errors: inliers, truncated squares (msac), and the median, whose own threshold is 1.4826 times the median deviation (lmeds)."""
    e = np.abs(errors[np.isfinite(errors)])
    if not len(e):
        return {"ransac": 0.0, "msac": 0.0, "lmeds": 0.0, "lmeds_threshold": 0.0}
    middle = float(np.median(e))
    spread = 1.4826 * float(np.median(np.abs(e - middle)))
    return {"ransac": float((e < threshold).sum()), "msac": 1.0 / (float(np.minimum(e**2, threshold**2).sum()) + 1e-8), "lmeds": 1.0 / (middle + 1e-8), "lmeds_threshold": middle + spread}


def fit_line(points: np.ndarray, threshold: float) -> tuple[tuple[float, float] | None, np.ndarray]:
    """Slope and intercept of the line with most points within ``threshold`` of it."""

    def estimate(i):
        a = np.stack([points[i, 0], np.ones(len(i))], 1)
        return tuple(np.linalg.lstsq(a, points[i, 1], rcond=None)[0])

    def errors(m):
        return np.abs(points[:, 1] - m[0] * points[:, 0] - m[1]) / np.hypot(m[0], 1.0)

    return ransac(len(points), 2, estimate, errors, threshold)


def fit_similarity(source: np.ndarray, target: np.ndarray, threshold: float, rounds: int = 500):
    """The similarity with most points carried to within ``threshold`` of their targets."""

    def errors(m):
        return np.linalg.norm(m[0] * source @ m[1].T + m[2] - target, axis=1)

    return ransac(len(source), 3, lambda i: similarity(source[i], target[i]), errors, threshold, rounds)


@lru_cache(maxsize=1024)
def _picks(n: int, sample: int, rounds: int, seed: int) -> np.ndarray:
    """The samples that :func:`ransac` draws."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(n, sample, replace=False) for _ in range(rounds)])


def _plane_similarities(x: np.ndarray, y: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Factor (scale and rotation) and shift of :func:`similarity` along the last axis, for places as complex numbers."""
    if mask is None:
        n = x.shape[-1]
    else:
        n = np.maximum(mask.sum(-1), 1)
        x, y = np.where(mask, x, 0), np.where(mask, y, 0)
    a, b = x.sum(-1) / n, y.sum(-1) / n
    x, y = x - a[..., None], y - b[..., None]
    if mask is not None:
        x, y = np.where(mask, x, 0), np.where(mask, y, 0)
    factor = (x.conj() * y).sum(-1) / n / np.maximum((x.real**2 + x.imag**2).sum(-1) / n, 1e-300)
    return factor, b - factor * a


def fit_plane_similarities(source: np.ndarray, target: np.ndarray, threshold: float, rounds: int = 500, seed: int = 42):
    """:func:`fit_similarity` of many groups of equally many points at once, in closed form: factor, shift and inliers of each row of complex places.

    Samples, the rule that ends them early and the choice among models are those of :func:`ransac`. Factor and shift are NaN where there is no model.
    """
    groups, n = source.shape
    inside = np.zeros((groups, n), dtype=bool)
    none = np.full(groups, complex(np.nan, np.nan))
    if n < 3 or not groups:
        return none, none, inside
    picks = _picks(n, 3, rounds, seed)
    with np.errstate(invalid="ignore"):  # places that are no numbers are never inliers
        factor, shift = _plane_similarities(source[:, picks], target[:, picks])
    off = factor[:, :, None] * source[:, None, :] + shift[:, :, None] - target[:, None, :]
    near = off.real**2 + off.imag**2 < threshold**2
    counts = near.sum(2)
    share = np.clip(np.arange(n + 1) / n, 1e-9, 1 - 1e-9) ** 3
    with np.errstate(divide="ignore"):
        need = np.ceil(np.log(1e-5) / np.log(np.maximum(1 - share, 1e-12)))
    need[0] = rounds
    after = need[np.maximum.accumulate(counts, axis=1)]
    counts[:, 1:][np.arange(1, rounds) >= after[:, :-1]] = -1  # not drawn any more
    best = counts.argmax(1)
    inside = near[np.arange(groups), best]
    factor, shift = _plane_similarities(source, target, inside)
    few = inside.sum(1) < 3
    factor[few], shift[few] = none[few], none[few]
    return factor, shift, inside


def rotation_from_angle_axis(v: np.ndarray) -> np.ndarray:
    t = float(np.linalg.norm(v))
    if t < 1e-12:
        return np.eye(3)
    k = v / t
    m = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + np.sin(t) * m + (1 - np.cos(t)) * m @ m


def project_perspective(p: np.ndarray, focal: float, k1: float = 0.0, k2: float = 0.0) -> np.ndarray:
    x = p[:, :2] / p[:, 2:3]
    r2 = (x**2).sum(1, keepdims=True)
    return focal * x * (1 + r2 * (k1 + k2 * r2))


def project_fisheye(p: np.ndarray, focal: float, k1: float = 0.0, k2: float = 0.0) -> np.ndarray:
    r = np.hypot(p[:, 0], p[:, 1])
    t = np.arctan2(r, p[:, 2])
    d = t * (1 + t * t * (k1 + k2 * t * t))
    return focal * p[:, :2] * np.where(r > 1e-12, d / np.maximum(r, 1e-12), 1.0 / np.where(p[:, 2] == 0, 1, p[:, 2]))[:, None]


def project_spherical(p: np.ndarray) -> np.ndarray:
    return np.stack([np.arctan2(p[:, 0], p[:, 2]), np.arctan2(p[:, 1], np.hypot(p[:, 0], p[:, 2]))], 1) / (2 * np.pi)


def triangulated_tracks(rays: DataFrame, track: str = "track_id") -> DataFrame:
    """track_id, x, y, z from rays (track_id, ox, oy, oz, bx, by, bz): one small group a track; tracks without a point are left out."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = triangulate_midpoint(pdf[["ox", "oy", "oz"]].to_numpy(), pdf[["bx", "by", "bz"]].to_numpy())
        return pd.DataFrame([(pdf[track].iat[0], *p)] if p is not None else [], columns=[track, "x", "y", "z"])

    kind = rays.schema[track].dataType.simpleString()
    return rays.groupBy(track).applyInPandas(one, f"{track} {kind}, x double, y double, z double")
