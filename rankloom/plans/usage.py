"""Daily usage roll-up and its retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETENTION_DAYS = 7


def usage_daily(
    events: DataFrame, existing: DataFrame | None = None, exact: bool = False
) -> DataFrame:
    """``user_id, usage_date, credits_used`` from ``event_id, user_id, ts, count``.

    The first event of a user's day starts the row at 1 whatever its count and
    later ones add theirs; ``exact=True`` adds every count. ``existing`` rows
    are carried forward (the upsert).
    """
    first = F.min_by("count", F.struct("ts", "event_id"))
    days = events.groupBy("user_id", F.to_date("ts").alias("usage_date")).agg(
        F.sum("count").cast("long").alias("total"), first.cast("long").alias("first")
    )
    opened = F.col("total") if exact else F.col("total") - F.col("first") + 1
    if existing is None:
        return days.select("user_id", "usage_date", opened.alias("credits_used"))
    joined = existing.join(days, ["user_id", "usage_date"], "full_outer")
    used = F.when(F.col("credits_used").isNull(), opened).otherwise(
        F.col("credits_used") + F.coalesce("total", F.lit(0))
    )
    return joined.select("user_id", "usage_date", used.cast("long").alias("credits_used"))


def usage_retained(usage: DataFrame, asof: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows not older than ``days`` before ``asof`` (UTC date)."""
    return usage.where(F.col("usage_date") >= F.date_sub(F.lit(asof).cast("date"), days))
