"""Points near other points: overlapping latitude strips, a longitude sweep in each, one owner a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..runtime import BROADCAST_BYTES, checkpointed

#: Rows of either side beyond which a strip is split further.
STRIP_ROWS = 50_000
#: Pairs that are verified at once.
_PAIRS = 1_000_000


def _splits(points: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """keys, parts: only places with more than ``rows`` points; at most count / rows of them."""
    return checkpointed(points.groupBy(*keys).count().where(F.col("count") > rows).select(*keys, F.ceil(F.col("count") / rows).cast("int").alias("parts")))


def _with_parts(points: DataFrame, splits: DataFrame, keys: list[str], name: str) -> DataFrame:
    n = splits.count()
    side = F.broadcast(splits) if n * 64 <= BROADCAST_BYTES else splits
    return points.join(side.withColumnRenamed("parts", name), keys, "left").fillna(1, [name])


def near_pairs(left: DataFrame, right: DataFrame, radius: float, strip_rows: int = STRIP_ROWS) -> DataFrame:
    """(left_id, right_id) of all points at most ``radius`` metres apart over the ground of WGS84.

    Both inputs: id, lat, lon in degrees. Rows with a null or non-finite coordinate, a latitude beyond
    90 degrees or a null id have no neighbours. Distances are chords between the points at height 0,
    which holds across the 180th meridian and at the poles. Rows given twice count once.

    ``right`` points belong to one strip of latitude; ``left`` points go to every strip that their
    radius touches, so a pair meets in the strip of its right point and nowhere else. A strip with more
    than ``strip_rows`` rows of a side is cut at meridians four radii apart, again with left points on either side of
    a cut they are near to. Only a block of that size which is still as crowded is cut by a hash of that side's id, against
    copies of the other side's pieces: no task holds more than ``strip_rows`` of either, wherever the points crowd.
    """
    metres = 110_500.0  # a degree of latitude is never shorter
    height = 4.0 * radius / metres
    reach = 1.001 * radius / metres

    def valid(d: DataFrame) -> DataFrame:
        lon = F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0
        d = d.select(F.col("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
        return d.where("id is not null and lat between -90 and 90 and lon > -1e6 and lon < 1e6").withColumn("lon", lon).distinct()

    right = checkpointed(valid(right).withColumn("strip", F.floor(F.col("lat") / height)))
    left = valid(left).withColumn("strip", F.explode(F.sequence(F.floor((F.col("lat") - reach) / height), F.floor((F.col("lat") + reach) / height))))
    left = checkpointed(left)
    crowded = _splits(left, ["strip"], strip_rows).unionByName(_splits(right, ["strip"], strip_rows)).groupBy("strip").agg(F.max("parts").alias("parts"))
    top = F.least(F.greatest(F.abs(F.col("strip")), F.abs(F.col("strip") + 1)) * height + reach, F.lit(90.0))
    wide = F.when(top < 89.9, F.degrees(F.lit(1.01 * radius / 6.33e6) / F.cos(F.radians(top)))).otherwise(360.0)

    def blocks(d: DataFrame, copies: bool) -> DataFrame:
        """Adds block, 0 in strips that are not crowded."""
        d = _with_parts(d, crowded, ["strip"], "_n").withColumn("_wide", wide)
        d = d.withColumn("_n", F.when(F.col("_n") > 1, F.greatest(F.floor(90.0 / F.col("_wide")), F.lit(1))).otherwise(1))
        at = lambda lon: F.floor((lon + 180.0) * F.col("_n") / 360.0)
        if copies:
            near = F.sequence(at(F.col("lon") - F.col("_wide")), at(F.col("lon") + F.col("_wide")))
            near = F.array_distinct(F.transform(near, lambda b: F.pmod(b, F.col("_n"))))
            d = d.withColumn("block", F.explode(F.when(F.col("_n") > 1, near).otherwise(F.array(F.lit(0).cast("long")))))
        else:
            d = d.withColumn("block", F.pmod(at(F.col("lon")), F.col("_n")))
        return d.drop("_n", "_wide")

    left, right = checkpointed(blocks(left, True)), checkpointed(blocks(right, False))
    place = ["strip", "block"]
    hot_right, hot_left = _splits(right, place, strip_rows), _splits(left, place, strip_rows)

    def pieces(d: DataFrame, own: str, other: str, side: int) -> DataFrame:
        d = _with_parts(_with_parts(d, hot_left, place, "lp"), hot_right, place, "rp")
        d = d.withColumn(own, F.pmod(F.xxhash64("id"), F.col(own + "p")).cast("int"))
        d = d.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other + "p") - 1)))
        return d.select(*place, "l", "r", F.lit(side).cast("byte").alias("side"), "lon", "lat", "id")

    both = pieces(left, "l", "r", 0).unionByName(pieces(right, "r", "l", 1))
    both = both.repartitionByRange(*place, "l", "r").sortWithinPartitions(*place, "l", "r", "lon")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for b in batches:
            if not len(b):
                continue
            rows = b if held is None else pd.concat([held, b], ignore_index=True)
            where = rows[["strip", "block", "l", "r"]].to_numpy()
            cuts = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist()]
            for i, j in zip(bounds, bounds[1:]):
                yield from _sweep_strip(rows.iloc[i:j], radius)
            held = rows.iloc[bounds[-1] :].reset_index(drop=True)
        if held is not None:
            yield from _sweep_strip(held, radius)

    lt, rt = left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()
    if lt != rt:
        raise ValueError(f"ids of both sides must have one type, not {lt} and {rt}")
    return both.mapInPandas(sweep, f"left_id {lt}, right_id {rt}").distinct()


def _xyz(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    e2 = 1 - (geo.WGS84_B / geo.WGS84_A) ** 2
    n = geo.WGS84_A / np.sqrt(1 - e2 * np.sin(la) ** 2)
    return np.stack([n * np.cos(la) * np.cos(lo), n * np.cos(la) * np.sin(lo), n * (1 - e2) * np.sin(la)], axis=1)


def _sweep_strip(rows: pd.DataFrame, radius: float) -> Iterator[pd.DataFrame]:
    """Rows of one strip in order of longitude: for each left point the right points then active, verified."""
    side = rows["side"].to_numpy()
    if side.min() == side.max():
        return
    lon, lat, ids = rows["lon"].to_numpy(), rows["lat"].to_numpy(), rows["id"].to_numpy()
    li, ri = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    xyz = _xyz(lat, lon)
    top = np.abs(lat[li]) + radius / 110_500.0
    with np.errstate(divide="ignore", invalid="ignore"):
        width = np.where(top >= 89.999, 360.0, np.degrees(1.01 * radius / (6.33e6 * np.cos(np.radians(np.minimum(top, 89.999))))))
    # the longitudes once more on either side, for windows across the 180th meridian
    around = np.concatenate([lon[ri] - 360.0, lon[ri], lon[ri] + 360.0])
    number = np.concatenate([ri, ri, ri])
    width = np.minimum(width, 180.0)
    first = np.searchsorted(around, lon[li] - width, "left")
    last = np.searchsorted(around, lon[li] + width, "right")
    n = last - first
    done = 0
    ends = np.cumsum(n)
    while done < len(li):
        base = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, base + _PAIRS, "right")))
        k = n[done:upto]
        a = np.repeat(li[done:upto], k)
        b = number[np.repeat(first[done:upto] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())]
        near = ((xyz[a] - xyz[b]) ** 2).sum(1) <= radius * radius
        if near.any():
            yield pd.DataFrame({"left_id": ids[a[near]], "right_id": ids[b[near]]})
        done = upto


def shot_locations(measurements: DataFrame, groups: DataFrame, site_limit: float = 5000.0) -> DataFrame:
    """id, lat, lon of every shot whose position is finite and within ``site_limit`` of its group's reference on all axes."""
    p = measurements.select(F.col("shot_id").alias("id"), "sequence_key", *(F.get("gps_position", F.lit(i)).alias(a) for i, a in enumerate("enu")))
    for a in "enu":
        p = p.where(F.abs(F.col(a)) <= site_limit)  # false for null; NaN is larger than any number
    ref = groups.select("sequence_key", "reference_lla.latitude", "reference_lla.longitude", F.coalesce("reference_lla.altitude", F.lit(0.0)).alias("altitude")).distinct()
    p = p.distinct().join(ref, "sequence_key")
    return checkpointed(geo.with_lla(p, "e", "n", "u", "latitude", "longitude", "altitude").select("id", "lat", "lon"))


def shots_near_control_points(gcps: DataFrame, measurements: DataFrame, groups: DataFrame, radius: float = 30.0) -> DataFrame:
    """gcp_id, shot_id: every shot recorded within ``radius`` metres of a ground control point."""
    points = gcps.select("id", F.col("position.latitude").alias("lat"), F.col("position.longitude").alias("lon"))
    return near_pairs(points, shot_locations(measurements, groups), radius).select(F.col("left_id").alias("gcp_id"), F.col("right_id").alias("shot_id"))
