"""Ingest streams: request rows to the corpus, rejects to a quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.sources.corpus import TENANT_BUCKETS, ingest_images, ingest_text, tenant_bucket


def start_ingest(
    requests: DataFrame,
    embed,
    corpus_path: str,
    quarantine_path: str,
    checkpoint: str,
    kind: str = "text",
    trigger: dict | None = None,
    **ids,
) -> list[StreamingQuery]:
    """Two exactly-once file sinks over one stream of insert requests."""
    ingest = {"text": ingest_text, "image": ingest_images}[kind]
    rows, rejected = ingest(requests, embed, **ids)
    laid = rows.withColumn("tenant_bucket", tenant_bucket(F.col("tenant"), TENANT_BUCKETS))
    how = trigger or {"availableNow": True}
    sinks = [
        (laid, corpus_path, "rows", ["region", "tenant_bucket"]),
        (rejected, quarantine_path, "rejected", ["reject_reason"]),
    ]
    return [
        df.writeStream.format("parquet")
        .partitionBy(*parts)
        .option("path", path)
        .option("checkpointLocation", f"{checkpoint}/{name}")
        .trigger(**how)
        .start()
        for df, path, name, parts in sinks
    ]


def charges(accepted: DataFrame) -> DataFrame:
    """One unit charge per accepted request, whether or not embedding succeeds."""
    return accepted.select("user_id", "event_id", "ts", F.lit(-1).cast("long").alias("delta"))
