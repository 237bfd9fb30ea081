"""Top-k per query, pages and first-wins selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scores import MAX_CANDIDATES


def top_per_query(
    df: DataFrame, order: list[Column], rank: str, depth: str, cap: int = MAX_CANDIDATES
) -> DataFrame:
    """Number rows per ``query_id`` and keep ``rank <= least(cap, depth)``.

    The literal cap lets Spark prune inside each map task before the shuffle,
    so a query matching most of the corpus never ships more than ``cap`` rows
    per task; the per-row depth column then cuts exactly.
    """
    w = Window.partitionBy("query_id").orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= cap)
    return ranked.where(F.col(rank) <= F.col(depth)).withColumn(rank, F.col(rank).cast("long"))


def page(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Rows ``offset+1 .. offset+limit`` per query; ``rank`` counts across pages."""
    w = Window.partitionBy("query_id").orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w).cast("long"))
    return ranked.where(
        (F.col(rank) > F.col("offset")) & (F.col(rank) <= F.col("offset") + F.col("limit"))
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``.

    ``row_number() = 1`` plans a group limit in each map task, so a key holding
    a third of all rows sends one row per task, not its whole group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def newest(df: DataFrame, offset: int = 0, limit: int = 5) -> DataFrame:
    """A listing page: newest first, NULL dates in front, ties by id."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    return df.orderBy(F.col("created_at").desc_nulls_first(), F.col("id")).offset(offset).limit(limit)


def nearest(corpus: DataFrame, vector: list[float], k: int) -> DataFrame:
    """k nearest rows to one constant vector (a take-ordered plan, no shuffle)."""
    from rankloom.functions.vectors import cosine_distance

    probe = F.array(*[F.lit(float(x)) for x in vector])
    scored = corpus.withColumn("distance", cosine_distance(F.col("embedding"), probe))
    return scored.orderBy(F.col("distance").asc_nulls_last(), F.col("id")).limit(k)


def write_ordered(found: DataFrame, path: str, order: tuple[str, ...] = ("query_id", "rank"), files: int | None = None) -> None:
    """Write results so that the files, read in the order of their names, are sorted as a whole.

    Rows are ranged by ``order`` into partitions and sorted within them; no task sees more than
    its range. Without a number of ``files`` their sizes decide.
    """
    ranged = found.repartitionByRange(files, *order) if files else found.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.parquet(path)
