"""Reading only the tenants that a set of queries asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tenants that are stated in a scan as literals, so that files and folders are pruned.
STATED_TENANTS = 1000


def tenant_bucket(tenant: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(tenant), F.lit(buckets)).cast("int")


def with_buckets(corpus: DataFrame, buckets: int) -> DataFrame:
    """Note on the ``tenant_bucket`` column how many buckets its folders were made for."""
    noted = F.col("tenant_bucket").alias("tenant_bucket", metadata={"buckets": buckets})
    return corpus.select(*[noted if c == "tenant_bucket" else c for c in corpus.columns])


def of_tenants(corpus: DataFrame, tenants: list[str]) -> DataFrame:
    """The rows of these tenants; states the folder predicate that Spark cannot infer."""
    rows = corpus.where(F.col("tenant").isin(tenants))
    if "tenant_bucket" in corpus.columns:
        buckets = corpus.schema["tenant_bucket"].metadata.get("buckets")
        if buckets:
            # Hashes of literals are folded to constants by the optimizer.
            own = [tenant_bucket(F.lit(t), buckets) for t in tenants]
            rows = rows.where(F.col("tenant_bucket").isin(own) if own else F.lit(False))
    return rows


def file_part(rows: DataFrame, folder: list[str], by: str, file_rows: int) -> Column:
    """A number per row that splits each folder into one file for every ``file_rows`` rows.

    The rows of each folder are counted; at most one number per folder comes to the driver.
    """
    counted = rows.groupBy(*folder).count().where(F.col("count") > file_rows).collect()
    parts = F.lit(1)
    for r in counted:
        here = F.lit(True)
        for name in folder:
            here &= F.col(name).eqNullSafe(F.lit(r[name]))
        parts = F.when(here, -(-r["count"] // file_rows)).otherwise(parts)
    return F.pmod(F.xxhash64(by), parts)
