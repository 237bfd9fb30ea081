"""Moderation reports from detector labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.cleaning import decode_base64
from rankloom.functions.scores import percent

# Labels that make an image unsafe, compared exactly.
UNSAFE = ("Explicit Nudity", "Nudity", "Sexual Activity", "Graphic Violence", "Violence")


def is_unsafe(name: Column) -> Column:
    return F.coalesce(name.isin(*UNSAFE), F.lit(False))


def shown_label(name: Column) -> Column:
    return F.coalesce(name, F.lit("Unknown"))


def shown_confidence(confidence: Column) -> Column:
    return F.coalesce(confidence, F.lit(0.0))


def report_from_arrays(items: DataFrame) -> DataFrame:
    """Row-wise report when ``labels`` is the detector's array per item (no shuffle)."""
    shown = F.transform(
        F.coalesce(F.col("labels"), F.array().cast("array<struct<name:string,confidence:double>>")),
        lambda x: F.struct(
            shown_label(x["name"]).alias("label"),
            percent(shown_confidence(x["confidence"])).alias("confidence"),
        ),
    )
    unsafe = F.coalesce(F.exists("labels", lambda x: is_unsafe(x["name"])), F.lit(False))
    return items.withColumn("nsfw", unsafe).withColumn("labels", shown)


def report(items: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per item: flag, number of labels, and the labels sorted.

    ``items``: ``item_id``; ``labels``: ``item_id, name, confidence`` rows. One
    detector response bounds an item's labels, so the array stays small; items
    without labels are safe.
    """
    entry = F.struct(
        shown_label(F.col("name")).alias("label"),
        shown_confidence(F.col("confidence")).alias("confidence"),
    )
    grouped = labels.groupBy("item_id").agg(
        F.bool_or(is_unsafe(F.col("name"))).alias("nsfw"),
        F.count(F.lit(1)).alias("n_labels"),
        F.sort_array(F.collect_list(entry)).alias("labels"),
    )
    joined = items.select("item_id").join(grouped, "item_id", "left")
    return joined.select(
        "item_id",
        F.coalesce("nsfw", F.lit(False)).alias("nsfw"),
        F.coalesce("n_labels", F.lit(0)).alias("n_labels"),
        "labels",
    )


def detect(requests: DataFrame, detector) -> tuple[DataFrame, DataFrame]:
    """(report, rejected) for base64 images.

    ``detector`` is a pandas UDF from bytes to
    ``array<struct<name:string,confidence:double>>``.
    """
    decoded = requests.withColumn("_bytes", decode_base64(F.col("image")))
    rejected = decoded.where("_bytes IS NULL").drop("_bytes")
    labelled = decoded.where("_bytes IS NOT NULL").withColumn("labels", detector("_bytes"))
    return report_from_arrays(labelled.drop("_bytes", "image")), rejected
