"""Ordered analytics: neighbours in time and order, as-of interpolation, resampling, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def order_band_pairs(records: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """im1, im2 of one group with i - n <= j < i + n in order of key, n = k / 2 rounded up, i <> j.

    Neighbours come from one window over the group's order; nothing is joined.
    """
    n = (k + 1) // 2
    w = Window.partitionBy(group).orderBy(key)
    rows = records.select(group, key).where(F.col(key).isNotNull()).distinct()
    near = F.array(*(F.lag(key, i).over(w) for i in range(1, n + 1)), *(F.lead(key, i).over(w) for i in range(1, n)))
    rows = rows.withColumn("_near", near)
    return rows.select(F.col(key).alias("im1"), F.explode(F.array_compact("_near")).alias("im2"))


def time_neighbours(records: DataFrame, group: str, key: str, at: str, k: int) -> DataFrame:
    """im1, im2: the k records of a group nearest in time to each, ties by key; among k rows on either side in order."""
    rows = records.select(group, key, _micros(at).alias("_t")).where(F.col(key).isNotNull() & F.col("_t").isNotNull()).distinct()
    w = Window.partitionBy(group).orderBy("_t", key)
    s = F.struct("_t", key)
    rows = rows.withColumn("_near", F.array(*(f(s, i).over(w) for i in range(1, k + 1) for f in (F.lag, F.lead))))
    gaps = rows.select(F.col(key).alias("im1"), F.col("_t").alias("_own"), F.explode(F.array_compact("_near")).alias("o"))
    gaps = gaps.select("im1", F.col(f"o.{key}").alias("im2"), F.abs(F.col("o._t") - F.col("_own")).alias("gap"))
    best = Window.partitionBy("im1").orderBy("gap", "im2")
    return gaps.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("im1", "im2", "gap")


def asof_interpolated(queries: DataFrame, fixes: DataFrame, group: str, at: str, value: str, key: str) -> DataFrame:
    """key, value_at: ``value`` of the fixes of a group at each query's time, linear between the enclosing two.

    Queries before the first or at or after the last fix have none. One union and two running windows; no join.
    """
    q = queries.select(group, _micros(at).alias("_t"), F.col(key).alias("_k"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_side"))
    f = fixes.where(F.col(value).isNotNull()).groupBy(group, _micros(at).alias("_t")).agg(F.max(value).alias("_v"))
    f = f.select(group, "_t", F.lit(None).cast(queries.schema[key].dataType).alias("_k"), F.col("_v").cast("double"), F.lit(0).alias("_side"))
    w = Window.partitionBy(group).orderBy("_t", "_side")
    fix = F.when(F.col("_side") == 0, F.struct("_t", "_v"))
    both = q.unionByName(f).withColumn("_fix", fix)
    before = F.last("_fix", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_fix", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    r = both.withColumns({"_a": before, "_b": after}).where("_side = 1 and _a is not null and _b is not null")
    share = (F.col("_t") - F.col("_a._t")) / (F.col("_b._t") - F.col("_a._t"))
    return r.select(F.col("_k").alias(key), (F.col("_a._v") + share * (F.col("_b._v") - F.col("_a._v"))).alias("value_at"))


def resampled(fixes: DataFrame, group: str, at: str, value: str, seconds: int) -> DataFrame:
    """group, at, value every ``seconds`` from the first fix of each group to its last, linear in between.

    Each pair of successive fixes makes the samples between them, so no group is gathered.
    """
    f = fixes.where(F.col(value).isNotNull() & F.col(at).isNotNull()).groupBy(group, _micros(at).alias("_t")).agg(F.max(value).cast("double").alias("_v"))
    w = Window.partitionBy(group).orderBy("_t")
    f = f.withColumns({"_t1": F.lead("_t").over(w), "_v1": F.lead("_v").over(w), "_t0": F.first("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    step = F.lit(seconds * 1_000_000).cast("long")
    low = F.ceil((F.col("_t") - F.col("_t0")) / step)
    high = F.ceil((F.col("_t1") - F.col("_t0")) / step) - 1
    j = F.when(F.col("_t1").isNull(), F.when((F.col("_t") - F.col("_t0")) % step == 0, F.array(low))).when(high >= low, F.sequence(low, high))
    r = f.select(group, "_t", "_v", "_t1", "_v1", "_t0", F.explode(j).alias("_j")).withColumn("_s", F.col("_t0") + F.col("_j") * step)
    share = F.coalesce((F.col("_s") - F.col("_t")) / (F.col("_t1") - F.col("_t")), F.lit(0.0))
    return r.select(group, F.timestamp_micros("_s").alias("at"), (F.col("_v") + share * (F.coalesce("_v1", "_v") - F.col("_v"))).alias("value"))


def path_segments(positions: DataFrame, group: str, key: str) -> DataFrame:
    """Successive positions (e, n, u) of a group with their distance and the path length so far."""
    w = Window.partitionBy(group).orderBy(key)
    p = positions.withColumns({"next_key": F.lead(key).over(w), **{f"_{a}": F.lead(a).over(w) for a in "enu"}})
    d = F.sqrt(sum(((F.col(f"_{a}") - F.col(a)) * (F.col(f"_{a}") - F.col(a)) for a in "nu"), (F.col("_e") - F.col("e")) * (F.col("_e") - F.col("e"))))
    p = p.withColumn("distance", d).where("next_key is not null")
    return p.select(group, key, "next_key", "distance", F.sum("distance").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("travelled"))
