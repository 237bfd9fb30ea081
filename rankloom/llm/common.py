"""Helpers that the operators of this folder share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import shared_folder

# The letters that ASCII lower-casing maps.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place that all executors share."""
    return f"{shared_folder(spark)}/rankloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """Write ``df`` to a table in a shared folder and read it back: its lineage ends there."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` is fast, and the same where all is ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def pieces_of(texts: list[str], most: int = 1 << 21):
    """A list of texts in parts of about ``most`` letters, so that their words fit in memory."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def settings(spark: SparkSession, **values):
    """Session settings for the length of a ``with`` block."""
    return _Settings(spark, {k.replace("__", "."): v for k, v in values.items()})


class _Settings:
    def __init__(self, spark, values):
        self.spark, self.values = spark, values

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k, None) for k in self.values}
        for key, value in self.values.items():
            self.spark.conf.set(key, value)

    def __exit__(self, *_):
        for key, value in self.before.items():
            if value is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, value)
