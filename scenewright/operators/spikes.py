"""Implausible readings of a source: robust principal components for spikes, plain tests for runs and ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import group_codes, ordered_partitions, release, written

#: Readings in one profile (one row of a source's matrix), and readings between the starts of two profiles.
PROFILE, STRIDE = 8, 2
#: Metres beyond which nothing on a site can lie, or be wrong by.
SITE_LIMIT = 5000.0
#: An accuracy this many times the source's median, a position this many typical steps off its path.
ACCURACY_FACTOR, PATH_STEPS = 10.0, 20.0
#: How far the low-rank part may follow a spike: typical steps of a position, and the share, in logarithms, of an accuracy.
PATH_SLACK, LEVEL_SLACK = 4.0, 0.7
#: Positions that may leave the path together; readings of one value that make a run.
LONGEST_SPIKE, STUCK = 3, 7
#: A source repeats hardly ever: share of adjacent equal readings outside long runs at most, beside a chance repeat.
REPEATS = 0.08
#: Rows known on either side of a cut through a source.
HALO = 4 * PROFILE

POSITION, ACCURACY = 0, 1
#: What ``_repeat_counts`` gives.
COUNTS = ("n_other", "n_varied", "n_back", "n_pairs", "n_own")


def low_rank_parts(matrices: list[np.ndarray], rounds: int = 60) -> list[np.ndarray]:
    """The low-rank part of each matrix = low rank + sparse, by principal component pursuit.

    The sum of singular values of the low-rank part plus 1 / sqrt(longer side) times the sum of absolute
    values of the sparse part is least (augmented Lagrangian); no entry is sparse to begin with. The rows
    are taken about their own level, a profile's median, which is the constant component of the
    low-rank part. Matrices of at most ``PROFILE`` columns are padded and solved many at once.
    """
    out: list[np.ndarray] = [None] * len(matrices)
    order = sorted(range(len(matrices)), key=lambda i: len(matrices[i]))
    while order:
        most = len(matrices[order[-1]])
        many = max(1, 20_000 // max(most, 1))
        own, order = order[-many:], order[:-many]
        m = np.zeros((len(own), most, PROFILE))
        level = [np.median(matrices[i], axis=1, keepdims=True) for i in own]
        for k, (i, c) in enumerate(zip(own, level)):
            r, w = matrices[i].shape
            m[k, :r, :w] = matrices[i] - c
        weight = np.array([1.0 / np.sqrt(max(matrices[i].shape)) for i in own])
        low = _pursuit(m, weight, rounds)
        for k, (i, c) in enumerate(zip(own, level)):
            r, w = matrices[i].shape
            out[i] = low[k, :r, :w] + c
    return out


def _pursuit(m: np.ndarray, weight: np.ndarray, rounds: int) -> np.ndarray:
    weight = weight[:, None, None]
    turned = lambda x: np.swapaxes(x, 1, 2)
    size = np.maximum(np.sqrt((m * m).sum((1, 2))), 1e-12)
    spectral = np.sqrt(np.maximum(np.linalg.eigvalsh(turned(m) @ m)[:, -1], 1e-24))[:, None, None]
    dual = m / np.maximum(spectral, np.abs(m).max((1, 2))[:, None, None] / weight)
    mu = 1.25 / spectral
    sparse = np.zeros_like(m)
    for _ in range(rounds):
        x = m - sparse + dual / mu
        values, basis = np.linalg.eigh(turned(x) @ x)
        kept = np.maximum(1.0 - 1.0 / (mu[:, :, 0] * np.sqrt(np.maximum(values, 1e-24))), 0.0)
        low = x @ ((basis * kept[:, None, :]) @ turned(basis))
        rest = m - low + dual / mu
        sparse = rest - np.clip(rest, -weight / mu, weight / mu)
        off = m - low - sparse
        dual += mu * off
        mu = mu * 1.7
        if (np.sqrt((off * off).sum((1, 2))) <= 1e-5 * size).all():
            break
    return low


def off_normal(series: list[np.ndarray]) -> list[np.ndarray]:
    """For each series (readings x channels), how far each reading lies off the low-rank part of its source's profiles.

    Rows of a source's matrix are profiles of ``PROFILE`` successive readings of one channel, one every
    ``STRIDE`` readings and one that ends with the last. A reading is in several profiles; the one that
    it fits best counts, so a profile that a lasting move cuts in two flags nothing. Result: norms over
    the channels; of a single channel the amount above the low-rank part.
    """
    places, matrices = [], []
    for x in series:
        width = min(PROFILE, len(x))
        starts = np.unique(np.append(np.arange(0, len(x) - width + 1, STRIDE), len(x) - width))
        at = starts[:, None] + np.arange(width)
        places.append(at)
        matrices.append(x.T[:, at].reshape(-1, width))
    out = []
    for x, at, m, low in zip(series, places, matrices, low_rank_parts(matrices)):
        rest = (m - low).reshape(x.shape[1], *at.shape)
        off = np.linalg.norm(rest, axis=0) if x.shape[1] > 1 else rest[0]
        best = np.full(len(x), np.inf)
        np.minimum.at(best, at.ravel(), off.ravel())
        out.append(best)
    return out


def _long_runs(x: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` belong to at least ``STUCK`` equal successive rows."""
    n = len(x)
    same = (x[1:] == x[:-1]).all(axis=1) if n > 1 else np.zeros(0, dtype=bool)
    run = np.concatenate([[0], np.cumsum(~same)])
    return (np.bincount(run) >= STUCK)[run]


def _leaves_path(off: np.ndarray) -> np.ndarray:
    """Readings off the path by more than ``PATH_STEPS`` in runs of at most ``LONGEST_SPIKE``, with readings on the path on either side."""
    away = np.concatenate([[True], off > PATH_STEPS - PATH_SLACK, [True]])
    run = np.concatenate([[0], np.cumsum(away[1:] != away[:-1])])
    short = np.bincount(run)[run] <= LONGEST_SPIKE
    short &= (run != run[0]) & (run != run[-1])
    return (away & short)[1:-1]


def _impossible(field: int, x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", over="ignore"):
        if field == POSITION:
            return ~(np.sqrt((x * x).sum(axis=1)) <= SITE_LIMIT)
        return ~((x[:, 0] >= 0) & (x[:, 0] <= SITE_LIMIT))


def _typical(field: int, x: np.ndarray) -> np.ndarray:
    """The values whose median is typical: steps between possible positions, or reported accuracies."""
    good = x[~_impossible(field, x)]
    if field == POSITION:
        return np.linalg.norm(np.diff(good, axis=0), axis=1)
    return good[good[:, 0] > 0, 0]


def _repeat_counts(field: int, x: np.ndarray, core: np.ndarray) -> tuple[int, int, int, int, int]:
    """Of possible, reported core readings: those outside long runs, those of them of other values than the runs',
    those inside long runs whose value makes another one, too, adjacent equal pairs outside long runs, and those of them of a run's value.
    """
    counts = core & ~_impossible(field, x)
    if field == ACCURACY:
        counts &= x[:, 0] != 0
    long = _long_runs(x)
    pair = np.zeros(len(x), dtype=bool)
    pair[1:] = (x[1:] == x[:-1]).all(axis=1) & ~long[1:] & ~long[:-1]
    of_run, back = long.copy(), np.zeros(len(x), dtype=bool)
    if long.any():
        value = np.unique(x, axis=0, return_inverse=True)[1].ravel()
        new = np.concatenate([[True], value[1:] != value[:-1]])
        longest = np.zeros(value.max() + 1, dtype=np.int64)
        np.maximum.at(longest, value[new], np.diff(np.append(np.flatnonzero(new), len(x))))
        of_run = longest[value] >= STUCK
        back = long & (np.bincount(value[long], minlength=len(longest)) > longest)[value]
    other = counts & ~long
    return int(other.sum()), int((other & ~of_run).sum()), int((counts & back).sum()), int((pair & counts).sum()), int((pair & counts & of_run).sum())


def _stuck(field: int, x: np.ndarray, n_other: int, n_varied: int, n_back: int, n_pairs: int, n_own: int) -> np.ndarray:
    """Readings in long runs of one value, unless the source repeats more often than by chance."""
    # one reading beside the runs can't show that readings hardly ever repeat; a run's value seen twice again is no chance
    if not (n_varied > 1 and n_back <= n_varied and n_pairs <= max(0 if n_own else 1, REPEATS * n_other)):
        return np.zeros(len(x), dtype=bool)
    stuck = _long_runs(x)
    return stuck & (x[:, 0] != 0) if field == ACCURACY else stuck


def _normalised(field: int, x: np.ndarray, typical: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the possible, reported readings, and these in typical steps, or logarithms over the typical accuracy."""
    ok = ~_impossible(field, x)
    if field == ACCURACY:
        ok &= x[:, 0] > 0
    at = np.flatnonzero(ok) if typical > 0 else np.zeros(0, dtype=np.int64)
    return at, np.log(x[at] / typical) if field == ACCURACY else x[at] / (typical or 1.0)


def implausible_readings(measurements: DataFrame) -> DataFrame:
    """shot_id, field_name of every implausible ``gps_position`` or ``gps_accuracy``, relative to its ``sequence_key``.

    Readings of a source are taken in order of shot_id, nulls left out; a position with a missing or
    further coordinate can't be true. Impossible readings are flagged first and take no part in the path.
    A source's matrix of profiles (positions in typical steps; logarithms of accuracies over their median) is
    split into a low-rank and a sparse part by principal component pursuit. The low-rank part is what
    the source normally shows: up to three successive positions more than twenty typical steps off it, with
    the path going on after them, and accuracies that stand off it and are ten times the median are flagged.
    The low-rank part follows a spike by a little, which ``PATH_SLACK`` and ``LEVEL_SLACK`` allow for.
    Runs of one value are tested separately, in sources that hardly ever repeat
    outside them; where one value comes back in run after run and outnumbers the others, it is the source's constant.
    Zero accuracies are unreported. Repeated deliveries count once; measurements without a sequence form
    one source; null shots are left out; empty tables give no rows.

    Sources are range-partitioned by order of record, so a source of any size spreads over tasks that know
    ``HALO`` readings beyond their cut; medians of a source across a cut are exact, too.
    """
    parts = ordered_partitions(readings(measurements), ["field", "sequence_key"], ["shot_id"], HALO)
    known = _statistics(parts) if parts.spanning else {}
    sent = parts.df.sparkSession.sparkContext.broadcast(known)
    return parts.map(lambda pdf, pid: flagged_rows(pdf, sent.value), "shot_id string, field_name string").distinct()


def readings(measurements: DataFrame) -> DataFrame:
    """field, sequence_key, shot_id, x, y, z: each non-null reading once; accuracies in x."""
    d = measurements.where("shot_id is not null").select("sequence_key", "shot_id", "gps_position", "gps_accuracy").distinct()
    three = F.size("gps_position") == 3
    at = lambda i: F.when(three, F.coalesce(F.get("gps_position", F.lit(i)), F.lit(float("nan")))).otherwise(F.lit(float("nan")))
    nan = F.lit(float("nan"))
    p = d.where("gps_position is not null").select(F.lit(POSITION).cast("byte").alias("field"), "sequence_key", "shot_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    a = d.where("gps_accuracy is not null").select(F.lit(ACCURACY).cast("byte").alias("field"), "sequence_key", "shot_id", F.col("gps_accuracy").alias("x"), nan.alias("y"), nan.alias("z"))
    return p.unionByName(a)


def flagged_rows(pdf: pd.DataFrame, known: dict) -> pd.DataFrame:
    """shot_id, field_name of the flagged core rows of readings in order; ``known``: statistics of sources that are not here as a whole."""
    starts, _ = group_codes(pdf, ["field", "sequence_key"])
    ends = np.append(starts[1:], len(pdf))
    fields, core = pdf["field"].to_numpy(), pdf["_core"].to_numpy(dtype=bool)
    xyz = pdf[["x", "y", "z"]].to_numpy(dtype=float)
    bad = np.zeros(len(pdf), dtype=bool)
    spans, series = [], []
    for i, j in zip(starts.tolist(), ends.tolist()):
        field = int(fields[i])
        x = xyz[i:j] if field == POSITION else xyz[i:j, :1]
        name = pdf["sequence_key"].iat[i]
        got = known.get((field, "\0null" if pd.isna(name) else name))
        if got is None:
            values = _typical(field, x)
            got = (float(np.median(values)) if len(values) else 0.0, *_repeat_counts(field, x, core[i:j]))
        bad[i:j] = _impossible(field, x) | _stuck(field, x, *got[1:])
        at, y = _normalised(field, x, got[0])
        if len(y):
            spans.append((field, i + at))
            series.append(y)
    tenfold = np.log(ACCURACY_FACTOR)
    for (field, at), y, off in zip(spans, series, off_normal(series)):
        bad[at] |= _leaves_path(off) if field == POSITION else (off > tenfold - LEVEL_SLACK) & (y[:, 0] >= tenfold)
    bad &= core
    return pd.DataFrame({"shot_id": pdf["shot_id"][bad], "field_name": np.where(fields[bad] == POSITION, "gps_position", "gps_accuracy")})


def _statistics(parts) -> dict:
    """(field, source) -> typical value and repeat counts, for the few sources across a cut."""
    spanning = parts.df.sparkSession.sparkContext.broadcast(parts.spanning)

    def measure(pdf: pd.DataFrame, pid: int) -> pd.DataFrame:
        starts, _ = group_codes(pdf, ["field", "sequence_key"])
        ends = np.append(starts[1:], len(pdf))
        out = []
        for i, j in zip(starts.tolist(), ends.tolist()):
            field, name = int(pdf["field"].iat[i]), pdf["sequence_key"].iat[i]
            name = "\0null" if pd.isna(name) else name
            if (field, name) not in spanning.value:
                continue
            own = pdf.iloc[i:j]
            core = own["_core"].to_numpy(dtype=bool)
            x = own[["x", "y", "z"]].to_numpy(dtype=float)[:, : 3 if field == POSITION else 1]
            counts = _repeat_counts(field, x, core)
            values = _typical(field, x[core])
            rows = pd.DataFrame({"v": np.append(values, np.nan)})
            rows["field"], rows["name"] = field, name
            for c, k in zip(COUNTS, counts):
                rows[c] = np.append(np.zeros(len(values), dtype=np.int64), k)
            out.append(rows)
        return pd.concat(out) if out else None

    measured = written(parts.map(measure, "v double, field int, name string, " + ", ".join(f"{c} long" for c in COUNTS)))
    v = F.when(~F.isnan("v"), F.col("v"))
    about = F.percentile_approx(v, F.array(F.lit(0.5 - 1e-4), F.lit(0.5 + 1e-4)), 100_000)
    rows = measured.groupBy("field", "name").agg(F.count(v).alias("n"), about.alias("about"), *(F.sum(c).alias(c) for c in COUNTS))
    rows = written(rows.withColumns({"low": F.get("about", F.lit(0)), "high": F.get("about", F.lit(1))}).drop("about"))
    # the approximate quantiles enclose the median; the few values between them decide it exactly
    near = measured.join(F.broadcast(rows.select("field", "name", "low", "high")), ["field", "name"]).where("not isnan(v) and v <= high")
    below = near.where("v < low").groupBy("field", "name").agg(F.count(F.lit(1)).alias("below"))
    within = near.where("v >= low").groupBy("field", "name", "v").agg(F.count(F.lit(1)).alias("k")).groupBy("field", "name").agg(F.array_sort(F.collect_list(F.struct("v", "k"))).alias("within"))
    found = {}
    for r in rows.join(below, ["field", "name"], "left").join(within, ["field", "name"], "left").collect():
        middle = 0.0
        if r["n"]:
            value, k = np.array([w["v"] for w in r["within"]]), np.cumsum([w["k"] for w in r["within"]]) + (r["below"] or 0)
            middle = float(np.mean([value[min(np.searchsorted(k, rank, "right"), len(value) - 1)] for rank in ((r["n"] - 1) // 2, r["n"] // 2)]))
        found[r["field"], r["name"]] = (middle, *(r[c] for c in COUNTS))
    release(measured, rows)
    return found
