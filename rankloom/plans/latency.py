"""Request latency report with exact percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.running import GROUP_ROWS, running


def latency_summary(
    samples: DataFrame, group: str, value: str, at: str, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Mean, median, p95, p99, min, max, count and rate per ``group``.

    Percentiles follow the exclusive method on the sorted samples and fall back
    to the maximum for at most 20 (p95) or 100 (p99) samples. Equal values are
    counted before anything is ordered, and values are ranked with a running
    count, so no task ever holds a group.
    """
    samples = samples.where(F.col(value).isNotNull())
    counts = samples.groupBy(group, value).agg(
        F.count(F.lit(1)).alias("_n"), F.min(at).alias("_from"), F.max(at).alias("_to")
    )
    ranked = running(counts.select(group, value, "_n"), [group], [value], {"_upto": ("sum", "_n")}, group_rows=group_rows)
    totals = counts.groupBy(group).agg(
        F.sum("_n").alias("n"),
        (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.min("_from").alias("_from"),
        F.max("_to").alias("_to"),
    )
    # A group of its own may be NULL.
    totals = totals.withColumnRenamed(group, "_group")
    joined = ranked.join(totals, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    n = F.col("n")

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") >= rank, F.col(value)))

    def cut(parts: int, i: int) -> tuple[Column, Column]:
        position = (n + 1) * i
        low = F.least(F.greatest(F.floor(position / parts), F.lit(1)), n - 1)
        return low, position - low * parts

    def quantile(parts: int, i: int) -> Column:
        low, delta = cut(parts, i)
        return (at_rank(low) * F.max(parts - delta) + at_rank(low + 1) * F.max(delta)) / parts

    median = (at_rank(F.floor((n + 1) / 2)) + at_rank(F.floor(n / 2) + 1)) / 2
    report = joined.groupBy(group).agg(
        *[F.first(c).alias(c) for c in ("n", "mean", "min", "max", "_from", "_to")],
        median.alias("median"),
        quantile(20, 19).alias("_p95"),
        quantile(100, 99).alias("_p99"),
    )
    seconds = F.timestamp_diff("MICROSECOND", "_from", "_to") / 1e6
    return report.select(
        group, "n", "mean", "median",
        F.when(n > 20, F.col("_p95")).otherwise(F.col("max")).alias("p95"),
        F.when(n > 100, F.col("_p99")).otherwise(F.col("max")).alias("p99"),
        "min", "max",
        F.try_divide(n.cast("double"), seconds).alias("rate"),
    )
