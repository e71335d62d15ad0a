"""Algebra of observations(shot_id, track_id, feature_id, x, y, ...): co-visibility, sub-tracks, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_observations(obs: DataFrame) -> DataFrame:
    """Repeated deliveries removed; rows without shot, track or feature have no place in a track."""
    return obs.where("shot_id is not null and track_id is not null and feature_id is not null").distinct()


def good_tracks(obs: DataFrame, min_length: int = 2) -> DataFrame:
    """track_id, length of tracks with at least ``min_length`` observations and no shot twice."""
    g = obs.groupBy("track_id").agg(F.count(F.lit(1)).alias("length"), F.count_distinct("shot_id").alias("_shots"))
    return g.where((F.col("length") >= min_length) & (F.col("length") == F.col("_shots"))).select("track_id", "length")


def in_good_tracks(obs: DataFrame, min_length: int = 2) -> DataFrame:
    return obs.join(good_tracks(obs, min_length).select("track_id"), "track_id", "left_semi")


def common_observations(obs: DataFrame, first: str, second: str) -> DataFrame:
    """Tracks that two shots share, with both features; none for unknown shots."""
    a = obs.where(F.col("shot_id") == first).select("track_id", F.col("feature_id").alias("feature1"))
    b = obs.where(F.col("shot_id") == second).select("track_id", F.col("feature_id").alias("feature2"))
    return a.join(b, "track_id")


def _paired(obs: DataFrame) -> DataFrame:
    a = obs.select("track_id", F.col("shot_id").alias("im1"))
    b = obs.select("track_id", F.col("shot_id").alias("im2"))
    return a.join(b, "track_id").where("im1 < im2")


def covisibility(obs: DataFrame, min_length: int = 2) -> DataFrame:
    """im1 < im2, n_common: how many good tracks two shots share; good tracks hold no shot twice, so a hot faulty track makes no pairs."""
    return _paired(in_good_tracks(obs, min_length).select("track_id", "shot_id")).groupBy("im1", "im2").agg(F.count(F.lit(1)).alias("n_common"))


def common_tracks(obs: DataFrame, min_common: int) -> DataFrame:
    """im1, im2, tracks: sorted lists of shared good tracks of pairs with at least ``min_common``."""
    pairs = _paired(in_good_tracks(obs).select("track_id", "shot_id"))
    g = pairs.groupBy("im1", "im2").agg(F.array_sort(F.collect_list("track_id")).alias("tracks"))
    return g.where(F.size("tracks") >= min_common)


def sub_tracks(obs: DataFrame, tracks: DataFrame, shots: DataFrame) -> DataFrame:
    """Observations of the given tracks in the given shots; unknown ids are ignored."""
    return obs.join(tracks.select("track_id").distinct(), "track_id", "left_semi").join(shots.select("shot_id").distinct(), "shot_id", "left_semi")


def corresponding_tracks(first: DataFrame, second: DataFrame) -> DataFrame:
    """track1, track2 of two runs that have an observation (shot, feature) in common."""
    a = first.select("shot_id", "feature_id", F.col("track_id").alias("track1"))
    b = second.select("shot_id", "feature_id", F.col("track_id").alias("track2"))
    return a.join(b, ["shot_id", "feature_id"]).select("track1", "track2").distinct()


def visible_points(images: DataFrame, obs: DataFrame, points: DataFrame) -> DataFrame:
    """shot_id, n_points for every image, zero counts kept."""
    seen = obs.join(points.select("track_id").distinct(), "track_id", "left_semi").groupBy("shot_id").agg(F.count_distinct("track_id").alias("n"))
    return images.where("shot_id is not null").select("shot_id").distinct().join(seen, "shot_id", "left").select("shot_id", F.coalesce("n", F.lit(0)).alias("n_points"))


def min_observations(obs: DataFrame, least: int) -> DataFrame:
    """Observations of tracks that at least ``least`` of them."""
    keep = obs.groupBy("track_id").count().where(F.col("count") >= least).select("track_id")
    return obs.join(keep, "track_id", "left_semi")


def remove_outliers(obs: DataFrame, error2: Column, threshold: float) -> DataFrame:
    """Observations within ``threshold``; tracks that lost some and are left with fewer than two lose all."""
    marked = obs.withColumn("_bad", F.coalesce(error2 > threshold * threshold, F.lit(False)))
    state = marked.groupBy("track_id").agg(F.count(F.when(F.col("_bad"), 1)).alias("_lost"), F.count(F.when(~F.col("_bad"), 1)).alias("_left"))
    kept = state.where("_lost = 0 or _left >= 2").select("track_id")
    return marked.where("not _bad").drop("_bad").join(kept, "track_id", "left_semi")


def decimated(points: DataFrame, group: str, key: str, most: int, seed: int = 0) -> DataFrame:
    """A seeded sample of at most ``most`` points of each group; the rank cut prunes before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), key), key)
    return points.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def track_colours(obs: DataFrame) -> DataFrame:
    """Median colour of tracks with two observations or more, and the colour in their first shot."""
    g = obs.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.percentile(c, 0.5).alias(f"median_{c}") for c in "rgb"),
        F.min(F.struct("shot_id", "feature_id", "r", "g", "b")).alias("_first"),
    )
    return g.where("n >= 2").select("track_id", "median_r", "median_g", "median_b", F.col("_first.r").alias("first_r"), F.col("_first.g").alias("first_g"), F.col("_first.b").alias("first_b"))
