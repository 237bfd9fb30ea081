"""Bulk loads of text, PDF and image files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import one_line
from rankloom.sources.corpus import project


def _owned(files: DataFrame, user_id: int, database: str, region: str) -> DataFrame:
    return (
        files.withColumn("user_id", F.lit(user_id))
        .withColumn("database", F.lit(database))
        .withColumn("region", F.lit(region))
        .withColumn("metadata", F.to_json(F.struct(F.col("name").alias("filename"))))
    )


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_name").alias("name"), F.col("content").alias("data")
    )


def load_files(
    spark: SparkSession,
    path: str,
    files_type: str,
    user_id: int,
    database: str,
    region: str,
    embed,
    extract: Callable[[Column], Column] | None = None,
    **ids,
) -> DataFrame | None:
    """Corpus rows for every file under ``path``; None for other file types.

    ``embed`` maps text (or bytes for images) to embeddings; ``extract`` is a
    pandas UDF from PDF bytes to text.
    """
    if files_type == "text":
        files = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_name").alias("name"), F.col("value").alias("content")
        )
        embedded = files.withColumn("embedding", embed(F.col("content")))
    elif files_type == "pdf":
        if extract is None:
            raise ValueError("loading PDF files needs an extractor")
        text = one_line(extract(F.col("data")))
        files = _binary(spark, path).select("name", text.alias("content"))
        embedded = files.withColumn("embedding", embed(F.col("content")))
    elif files_type == "image":
        files = _binary(spark, path)
        embedded = files.select(
            "name", F.lit(None).cast("string").alias("content"), embed(F.col("data")).alias("embedding")
        )
    else:
        return None
    return project(_owned(embedded, user_id, database, region), **ids)
