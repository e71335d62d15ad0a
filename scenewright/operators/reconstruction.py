"""Algebra of reconstructions: shots with pose and camera, points, and the observations that join them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import camera, kernels
from ..runtime import checkpointed

#: Matches that are gathered before their groups are fitted, and places that are transformed at once.
FIT_ROWS, FIT_PLACES = 200_000, 1 << 20


def reprojections(obs: DataFrame, shots: DataFrame, points: DataFrame) -> DataFrame:
    """Each observation whose shot and point exist, with the point in the camera (cx, cy, cz) and its projection (pu, pv; null where not seen).

    ``obs``: shot_id, track_id, x, y, scale; ``shots``: reconstruction_id, shot_id, e, n, u, heading, kind, focal, k1, k2, width,
    height; ``points``: reconstruction_id, track_id, px, py, pz. Unknown shots and points are ignored.
    """
    j = obs.join(shots, "shot_id").join(points, ["reconstruction_id", "track_id"])
    x, y, z = camera.in_camera("px", "py", "pz", "e", "n", "u", "heading")
    j = j.withColumns({"cx": x, "cy": y, "cz": z})
    u, v = camera.projected("kind", "cx", "cy", "cz", "focal", "k1", "k2")
    return j.withColumns({"pu": u, "pv": v})


def with_errors(projections: DataFrame) -> DataFrame:
    """Adds error (in image sizes), pixels, normalized (over the feature's scale) and angle (between the rays of both places)."""
    e = F.sqrt(F.pow(F.col("x") - F.col("pu"), 2) + F.pow(F.col("y") - F.col("pv"), 2))
    size = F.greatest("width", "height").cast("double")
    p = projections.where("pu is not null and pv is not null").withColumn("error", e)
    p = p.withColumns({"_a": camera.ray("kind", "x", "y", "focal", "k1", "k2"), "_b": camera.ray("kind", "pu", "pv", "focal", "k1", "k2")})
    three = lambda c: [F.get(c, F.lit(i)) for i in range(3)]
    return p.withColumns({"pixels": F.col("error") * size, "normalized": F.col("error") / F.nullif(F.col("scale"), F.lit(0.0)), "angle": camera.angle_between(three("_a"), three("_b"))}).drop("_a", "_b")


def depth_ranges(projections: DataFrame) -> DataFrame:
    """reconstruction_id, shot_id, min_depth, max_depth: nine tenths of the tenth percentile of depths, eleven tenths of the ninetieth."""
    g = projections.groupBy("reconstruction_id", "shot_id").agg(F.percentile("cz", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    return g.select("reconstruction_id", "shot_id", (F.get("q", F.lit(0)) * 0.9).alias("min_depth"), (F.get("q", F.lit(1)) * 1.1).alias("max_depth"))


def neighbouring_shots(obs: DataFrame, shots: DataFrame, points: DataFrame, least: int, k: int, low: float = np.pi / 60, high: float = np.pi / 6) -> DataFrame:
    """shot_id, other, score: the ``k`` shots with most common points seen under an angle between ``low`` and ``high``, of those with more than ``least``.

    Give observations of good tracks: pairs grow with the square of a track's length.
    """
    o = obs.select("shot_id", "track_id").join(shots.select("reconstruction_id", "shot_id", "e", "n", "u"), "shot_id").join(points, ["reconstruction_id", "track_id"])
    side = lambda s: o.select("reconstruction_id", "track_id", F.col("shot_id").alias(f"s{s}"), *((F.col(a) - F.col(p)).alias(f"{a}{s}") for a, p in zip("enu", ("px", "py", "pz"))))
    pairs = side(1).join(side(2), ["reconstruction_id", "track_id"]).where("s1 <> s2")
    angle = camera.angle_between([f"{a}1" for a in "enu"], [f"{a}2" for a in "enu"])
    g = pairs.where((angle > low) & (angle < high)).groupBy(F.col("s1").alias("shot_id"), F.col("s2").alias("other")).agg(F.count(F.lit(1)).alias("score"))
    w = Window.partitionBy("shot_id").orderBy(F.desc("score"), "other")
    return g.where(F.col("score") > least).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def triangulated(rays: DataFrame, keys: list[str], min_angle: float = 0.0, min_depth: float = 1e-6, max_error: float | None = None) -> DataFrame:
    """keys, x, y, z, n: the point nearest to all rays of each track in least squares, where it passes the gates.

    ``rays``: keys, ox, oy, oz (origin) and bx, by, bz (direction, unit not needed). The normal matrix is a sum over rays, so
    a track of any length is aggregated before the shuffle; its 3 x 3 system is solved in closed form. Gates:
    two rays or more, a largest angle to the track's mean ray of half ``min_angle`` (radians) at least, every ray's point
    farther than ``min_depth`` in front, and every ray within ``max_error`` (radians) of the point. Parallel rays give no point.
    """
    size = F.sqrt(F.col("bx") * F.col("bx") + F.col("by") * F.col("by") + F.col("bz") * F.col("bz"))
    r = rays.where(size > 0).withColumns({c: F.col(c) / size for c in ("bx", "by", "bz")})
    axes = "xyz"
    m = {(i, j): (F.lit(1.0 if i == j else 0.0) - F.col(f"b{i}") * F.col(f"b{j}")) for i in axes for j in axes}
    sums = [F.sum(m[i, j]).alias(f"m{i}{j}") for i, j in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))]
    right = [F.sum(m[i, "x"] * F.col("ox") + m[i, "y"] * F.col("oy") + m[i, "z"] * F.col("oz")).alias(f"r{i}") for i in axes]
    g = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *right, *(F.avg(f"b{i}").alias(f"a{i}") for i in axes))
    c = lambda a, b: F.col(f"m{min(a, b)}{max(a, b)}")
    cof = {}
    for i, a in enumerate(axes):
        for j, b in enumerate(axes):
            p, q = [x for x in axes if x != a]
            s, t = [x for x in axes if x != b]
            cof[a, b] = (c(p, s) * c(q, t) - c(p, t) * c(q, s)) * (1.0 if (i + j) % 2 == 0 else -1.0)
    g = g.withColumn("det", c("x", "x") * cof["x", "x"] + c("x", "y") * cof["x", "y"] + c("x", "z") * cof["x", "z"])
    g = g.where(F.abs("det") > 1e-10).withColumns({i: (cof[i, "x"] * F.col("rx") + cof[i, "y"] * F.col("ry") + cof[i, "z"] * F.col("rz")) / F.col("det") for i in axes}).where("n >= 2")
    points = g.select(*keys, "x", "y", "z", "n", "ax", "ay", "az")
    back = r.join(points, keys)
    to = [F.col(i) - F.col(f"o{i}") for i in axes]
    depth = to[0] * F.col("bx") + to[1] * F.col("by") + to[2] * F.col("bz")
    gates = back.groupBy(*keys).agg(
        F.min(depth).alias("_depth"), F.max(camera.angle_between(to, ["bx", "by", "bz"])).alias("_error"), F.max(camera.angle_between(["ax", "ay", "az"], ["bx", "by", "bz"])).alias("_angle")
    )
    good = (F.col("_depth") > min_depth) & (F.col("_angle") >= min_angle / 2)
    good = good & (F.col("_error") <= max_error) if max_error is not None else good
    return points.join(gates.where(good), keys).select(*keys, "x", "y", "z", "n")


def isolated(neighbour_distances: DataFrame, key: str, spread: float = 1.25) -> DataFrame:
    """key, mean2 of points whose mean squared distance to their neighbours exceeds the mean over all points by ``spread`` deviations.

    ``neighbour_distances``: key and d2, one row for each of a point's nearest neighbours.
    """
    g = checkpointed(neighbour_distances.groupBy(key).agg(F.avg("d2").alias("mean2")))
    limit = g.agg((F.avg("mean2") + spread * F.stddev_pop("mean2")).alias("_limit"))
    return g.join(F.broadcast(limit)).where("mean2 > _limit").drop("_limit")


def rig_instances(images: DataFrame, image: str, patterns: dict[str, str]) -> DataFrame:
    """image, rig_camera, instance: the first pattern whose removal changes the name and leaves some of it; null where none does."""
    camera_, rest = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(list(patterns.items())):
        left = F.regexp_replace(image, pattern, "")
        fits = (left != "") & (left != F.col(image))
        camera_, rest = F.when(fits, name).otherwise(camera_), F.when(fits, left).otherwise(rest)
    return images.select(image, camera_.alias("rig_camera"), rest.alias("instance"))


def moving_matches(matches: DataFrame, pair: list[str], least2: float = 1e-6, most_static: float = 0.85) -> DataFrame:
    """Matches (x1, y1, x2, y2) of a pair that moved; a pair in which more than ``most_static`` of them did not keeps all."""
    d2 = F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2)
    m = matches.withColumn("_still", ~(d2 >= least2))
    share = m.groupBy(*pair).agg(F.avg(F.col("_still").cast("int")).alias("_share"))
    return m.join(share, pair).where((F.col("_share") > most_static) | ~F.col("_still")).drop("_still", "_share")


def unfiltered(matches: DataFrame, kept: DataFrame) -> DataFrame:
    """im1, im2, f1, f2 of matches between positions among the features that a mask kept: (image, position, feature_id)."""
    side = lambda n: kept.select(F.col("image").alias(f"im{n}"), F.col("position").alias(f"p{n}"), F.col("feature_id").alias(f"f{n}"))
    return matches.join(side(1), ["im1", "p1"]).join(side(2), ["im2", "p2"]).select("im1", "im2", "f1", "f2")


def word_matches(first: DataFrame, second: DataFrame, ratio: float) -> DataFrame:
    """f1, f2, distance: of the features of ``second`` that share a word with a feature of ``first``, the nearest, if nearer than ``ratio`` times the next.

    Both: pair (what is matched with what), feature, vector, words (array). A single candidate passes. All candidates are
    compared; give words of several assignments a feature to find more.
    """
    a = first.select("pair", F.col("feature").alias("f1"), F.col("vector").alias("v1"), F.explode(F.array_distinct("words")).alias("word"))
    b = second.select("pair", F.col("feature").alias("f2"), F.col("vector").alias("v2"), F.explode(F.array_distinct("words")).alias("word"))
    d = F.sqrt(F.aggregate(F.zip_with("v1", "v2", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    near = a.join(b, ["pair", "word"]).select("pair", "f1", "f2", d.alias("distance")).distinct()
    two = near.groupBy("pair", "f1").agg(F.min(F.struct("distance", "f2")).alias("m"), F.expr("array_sort(slice(array_sort(collect_list(distance)), 1, 2))").alias("two"))
    second_best = F.coalesce(F.get("two", F.lit(1)), F.lit(float("inf")))
    return two.where(F.col("m.distance") < ratio * second_best).select("pair", "f1", F.col("m.f2").alias("f2"), F.col("m.distance").alias("distance"))


def per_group(df: DataFrame, keys: list[str], kernel: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """keys and what ``kernel`` finds in each group's rows; for groups of bounded size, such as the matches of two images."""
    names = schema.replace(",", " ").split()[::2]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = kernel(pdf)
        return pd.DataFrame([[*key, *(got[n] for n in names)]], columns=[*keys, *names])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.groupBy(*keys).applyInPandas(run, f"{kinds}, {schema}")


def pair_similarities(matches: DataFrame, pair: list[str], least: int, threshold: float, rounds: int) -> DataFrame:
    """pair, n, n_inliers, msac, lmeds: a robust similarity between the places (x1, y1, x2, y2) of each pair with ``least`` matches or more, and its scores.

    Samples are drawn from the matches in order of place, so the same rows give the same result. Rows of several pairs go to Python together and groups of one size are fitted together.
    """
    places = ["x1", "y1", "x2", "y2"]
    m = matches.groupBy(*pair).agg(F.collect_list(F.struct(*places)).alias("_m")).where(F.size("_m") >= least)
    rows = m.select(*pair, F.posexplode(F.array_sort("_m")).alias("_at", "_m")).select(*pair, "_at", *(F.col(f"_m.{c}").cast("double").alias(c) for c in places))
    kinds = ", ".join(f"`{k}` {matches.schema[k].dataType.simpleString()}" for k in pair)

    def fitted(t: pa.Table) -> pa.RecordBatch:
        at = t["_at"].to_numpy()
        x1, y1, x2, y2 = (t[c].to_numpy(zero_copy_only=False).astype(float) for c in places)
        x, y = x1 + 1j * y1, x2 + 1j * y2
        starts = np.flatnonzero(at == 0)
        sizes = np.diff(np.append(starts, len(at)))
        inliers, msac, lmeds = np.zeros(len(starts), dtype=np.int32), np.zeros(len(starts)), np.zeros(len(starts))
        for n in np.unique(sizes):
            own = np.flatnonzero(sizes == n)
            step = max(1, FIT_PLACES // (rounds * int(n)))
            for some in (own[i : i + step] for i in range(0, len(own), step)):
                rows = starts[some][:, None] + np.arange(n)
                a, b = x[rows], y[rows]
                factor, shift, inside = kernels.fit_plane_similarities(a, b, threshold, rounds)
                inliers[some] = inside.sum(1)
                e = np.abs(factor[:, None] * a + shift[:, None] - b)
                all_ = np.isfinite(e).all(1)
                for i in np.flatnonzero(~all_):
                    s = kernels.scores(e[i], threshold)
                    msac[some[i]], lmeds[some[i]] = s["msac"], s["lmeds"]
                msac[some[all_]] = 1.0 / (np.minimum(e[all_] ** 2, threshold**2).sum(1) + 1e-8)
                lmeds[some[all_]] = 1.0 / (np.median(e[all_], axis=1) + 1e-8)
        first = t.take(pa.array(starts))
        columns = [pa.concat_arrays(first[k].chunks) for k in pair] + [pa.array(v) for v in (sizes.astype(np.int32), inliers, msac, lmeds)]
        return pa.RecordBatch.from_arrays(columns, names=[*pair, "n", "n_inliers", "msac", "lmeds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for b in batches:
            kept.append(b)
            n += len(b)
            starts = np.flatnonzero(b["_at"].to_numpy() == 0)
            if n >= FIT_ROWS and len(starts):  # the last group may go on in the next batch
                t = pa.Table.from_batches(kept)
                end = n - len(b) + int(starts[-1])
                if end:
                    yield fitted(t.slice(0, end))
                kept, n = t.slice(end).to_batches(), n - end
        if n:
            yield fitted(pa.Table.from_batches(kept))

    return rows.mapInArrow(run, f"{kinds}, n int, n_inliers int, msac double, lmeds double")


def merged(parts: list[DataFrame], key: str) -> DataFrame:
    """All parts with keys R0_key, R1_key and so on."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn(key, F.concat(F.lit(f"R{i}_"), F.col(key).cast("string")))
        out = p if out is None else out.unionByName(p)
    return out


def resplit(both: DataFrame, key: str) -> DataFrame:
    """The part number and the key as it was before :func:`merged`."""
    pattern = r"(?s)^R(\d+)_(.*)$"
    return both.withColumns({"part": F.regexp_extract(key, pattern, 1).cast("int"), key: F.regexp_extract(key, pattern, 2)})


def linear_motion(positions: DataFrame, group: str, key: str, axes: list[str]) -> DataFrame:
    """group, key, error: how far the middle of three successive positions lies from the mean of the other two."""
    w = Window.partitionBy(group).orderBy(key)
    off = [F.col(a) - (F.lag(a).over(w) + F.lead(a).over(w)) / 2 for a in axes]
    return positions.withColumn("error", F.sqrt(sum((o * o for o in off[1:]), off[0] * off[0]))).where("error is not null").select(group, key, "error")


def best_by_score(features: DataFrame, group: str, key: str, score: str, most: int) -> DataFrame:
    """The ``most`` features of highest score of each group; ties by key. The rank cut prunes before the shuffle's sort ends."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    return features.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def first_known(*candidates: Column) -> Column:
    """The first positive of several sources of one number: known calibrations, metadata, the default."""
    return F.coalesce(*(F.when(c > 0, c) for c in candidates))
