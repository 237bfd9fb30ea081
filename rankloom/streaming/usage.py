"""Daily usage counts over a stream of usage events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.plans.usage import RETENTION_DAYS


def usage_stream(events: DataFrame, exact: bool = False) -> DataFrame:
    """``user_id, usage_date, credits_used`` for update-mode sinks.

    The watermark stands in for the retention purge: days older than the
    retention lose their state, and events that late are dropped. The state of
    a user's day is one row, combined on the map side first.
    """
    first = F.min_by("count", F.struct("ts", "event_id"))
    total = F.sum("count")
    used = total if exact else total - first + 1
    day = F.window("ts", "1 day")
    days = (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", f"{RETENTION_DAYS} days")
        .groupBy(day.alias("day"), "user_id")
        .agg(used.cast("long").alias("credits_used"))
    )
    return days.select("user_id", F.to_date("day.start").alias("usage_date"), "credits_used")
