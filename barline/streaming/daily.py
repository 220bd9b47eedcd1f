"""Daily last prices of a tick stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_last(ticks: DataFrame, value: str = "price", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """asset, date and the last non-missing value of each day, of values at one instant the greatest.

    Days close once the watermark has passed them.
    """
    timed = ticks.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    grouped = timed.where(F.col(value).isNotNull()).groupBy("asset", F.window("__ts", "1 day").alias("day"))
    return grouped.agg(F.max(F.struct("__ts", F.col(value).alias("last")))["last"].alias(value)).select("asset", F.to_date("day.start").alias("date"), value)
