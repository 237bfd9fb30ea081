"""Proportional stratified interleaving: shards that all hold the mixture of the sources.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is
(rank - 1/2) / rows of its source. Sorted by it, the sources are interleaved in proportion,
and any cut into equal row counts holds the mixture.

A rank over a whole source, or over all rows, would be one task. Both ranks are taken in
two steps instead: rows fall into ordered buckets of some ``bucket_rows`` rows, are numbered
inside their bucket, and the bucket's offset (a prefix sum over bucket counts) is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import whole_text

BUCKET_ROWS = 4096


def stratified_shards(
    docs: DataFrame, shards: int = 24, seed: int = 20, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Deal every row to one of ``shards`` shards; row counts differ by one at most.

    Returns doc_id, source, size (UTF-8 bytes + 8), text_crc32, shard and slot (gapless from
    0 within the shard). A null text has no bytes; a null source is a source of its own; rows
    that repeat are dealt like any others; an empty table gives no rows; columns other than
    the three named ones are not read.
    """
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        # A null source must not equal any given name.
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("stratum"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        # Without its sign, so that its leading bits are ordered as the whole.
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 1).alias("h"),
    )
    total = docs.count()
    buckets = max(1, math.ceil(total / bucket_rows))
    bits = min(40, math.ceil(math.log2(buckets)))
    rows = rows.withColumn("bucket", F.shiftright("h", 63 - bits))

    ranked = _numbered(rows, ["stratum"], ["h", "doc_id", "text_crc32", "size"], totals=True)
    fraction = (2 * F.col("place") + 1) / (2 * F.col("among"))
    ranked = ranked.withColumn("fraction", fraction).drop("place", "among")
    ranked = ranked.withColumn("bucket", F.floor(F.col("fraction") * buckets))
    placed = _numbered(ranked, [], ["fraction", F.xxhash64("stratum"), "stratum", "h", "doc_id", "text_crc32", "size"])

    shard = F.expr(f"(place * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "source", "size", "text_crc32", "shard", (F.col("place") - first).alias("slot")
    )


def _numbered(rows: DataFrame, within: list[str], order: list[str | Column], totals: bool = False) -> DataFrame:
    """Add ``place``, the row's number from 0 in the order of (bucket, ``order``)."""
    key = [*within, "bucket"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*within).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    if totals:
        offsets = offsets.withColumn("among", F.sum("n").over(Window.partitionBy(*within)))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    numbered = rows.withColumn("place", inside).join(offsets.drop("n"), key)
    return numbered.withColumn("place", F.col("before") + F.col("place") - 1).drop("before", "bucket")
