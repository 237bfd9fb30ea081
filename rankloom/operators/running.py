"""Running aggregates over ordered groups, also when one group is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import durable

# A group with more rows than this is scanned in chunks by several tasks.
GROUP_ROWS = 2_000_000

_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(kind: str, before: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before + local, before, local)
    return F.least(before, local) if kind == "min" else F.greatest(before, local)


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the biggest group and of all; a map-side combined count."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest, total = counts.agg(F.max("n"), F.sum("n")).first()
    return largest or 0, total or 0


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, tuple[str, str]],
    exclude_current: bool = False,
    group_rows: int = GROUP_ROWS,
    chunks: int | None = None,
) -> DataFrame:
    """Add ``name = kind(source)`` over the rows up to and including each row.

    ``columns`` maps a new name to ``(kind, source)`` with kind sum, min or
    max; ``exclude_current`` stops one row earlier. ``order`` must be a total
    order within a group. Groups of bounded size use plain windows. Beyond
    that the rows are range-partitioned by (keys, order), every partition
    scans its own part of each group, and what went before is added from the
    partition totals. At most one group per partition continues from an
    earlier one, so the totals that matter are never more than the partitions.
    """
    last = -1 if exclude_current else Window.currentRow
    unbounded = Window.unboundedPreceding

    def scan(part: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(unbounded, last)
        added = {n: _AGGREGATE[kind](source).over(w) for n, (kind, source) in columns.items()}
        return part.withColumns(added)

    largest, total = group_sizes(df, keys)
    if largest <= group_rows:
        return scan(df, keys)
    # Chunks grow with the rows, so that a task's share does not.
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = chunks or max(usual, -(-total // group_rows))
    ranged = df.repartitionByRange(n, *keys, *order).withColumn("_chunk", F.spark_partition_id())
    # The chunk number must not change between its two uses.
    ranged = durable(ranged)
    totals = ranged.groupBy(*keys, "_chunk").agg(
        *[_AGGREGATE[kind](source).alias(f"_t_{n}") for n, (kind, source) in columns.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(unbounded, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_chunk").alias("_k_chunk"),
        F.count(F.lit(1)).over(earlier).alias("_seen"),
        *[_AGGREGATE[kind](f"_t_{n}").over(earlier).alias(f"_b_{n}") for n, (kind, _) in columns.items()],
    ).where("_seen > 0")
    local = scan(ranged, [*keys, "_chunk"])
    same = F.col("_chunk") == F.col("_k_chunk")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(F.broadcast(carried), same, "left")
    combined = {
        n: _combine(kind, F.col(f"_b_{n}"), F.col(n)) for n, (kind, _) in columns.items()
    }
    return joined.withColumns(combined).select(*df.columns, *columns)
