"""Summary statistics of scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal_width_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, n: ``bins`` equal bins between the extremes, the last one closed, empty bins kept; no values, no bins.

    A single distinct value gets a range of one half on either side. The range is one row, so the join with
    it is a broadcast of constants.
    """
    v = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(value).cast("double").alias("v"))
    r = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    r = r.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    b = v.join(F.broadcast(r)).select(F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = r.where("lo is not null").select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def axis_errors(df: DataFrame, group: str, axes: list[str]) -> DataFrame:
    """Per group and axis the mean, population deviation and root mean square, and the mean norm over all axes."""
    aggs = []
    for a in axes:
        c = F.col(a)
        aggs += [F.avg(c).alias(f"mean_{a}"), F.stddev_pop(c).alias(f"std_{a}"), F.sqrt(F.avg(c * c)).alias(f"rmse_{a}")]
    norm = F.sqrt(sum((F.col(a) * F.col(a) for a in axes[1:]), F.col(axes[0]) * F.col(axes[0])))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *aggs, F.avg(norm).alias("mean_norm"))


def grid_cells(x: Column, y: Column, columns: int, rows: int, width: float, height: float) -> tuple[Column, Column]:
    """Clamped cell of normalised coordinates about the centre of a frame of ``width`` x ``height``."""
    cell = lambda v, size, n: F.least(F.greatest(F.floor((v + size / 2) / size * n), F.lit(0)), F.lit(n - 1)).cast("int")
    return cell(x, width, columns), cell(y, height, rows)


def robust_spread(df: DataFrame, group: str, axes: list[str]) -> DataFrame:
    """Median of each axis and 1.486 times the median distance from it."""
    m = df.groupBy(group).agg(*(F.percentile(a, 0.5).alias(f"median_{a}") for a in axes))
    d = df.join(m, group)
    dist = F.sqrt(sum(((F.col(a) - F.col(f"median_{a}")) * (F.col(a) - F.col(f"median_{a}")) for a in axes[1:]), (F.col(axes[0]) - F.col(f"median_{axes[0]}")) * (F.col(axes[0]) - F.col(f"median_{axes[0]}"))))
    s = d.groupBy(group).agg((F.percentile(dist, 0.5) * 1.486).alias("robust_sigma"))
    return m.join(s, group)
