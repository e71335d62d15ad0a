"""Streaming variants over events: an extension, the scene pipeline itself works on whole datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Count, sum and mean of value per window and type; events later than ``late`` behind the newest are dropped."""
    e = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    g = e.groupBy(F.window("_at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def first_deliveries(records: DataFrame, key: str, at: str = "ingested_at", late: str = "1 day") -> DataFrame:
    """Each record once: repeats within ``late`` of the first delivery are dropped, state beyond it is forgotten."""
    return records.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")
