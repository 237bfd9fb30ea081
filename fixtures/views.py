"""Search, control and event tables derived from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import WORD_BREAK


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """One partition per core for the given tables, which are one small file each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def owner_region(owner) -> F.Column:
    return (
        F.when(owner % 3 == 0, "us-east").when(owner % 3 == 1, "us-west").otherwise("eu")
    )


def minutes_after(start: str, minutes) -> F.Column:
    """A timestamp without zone, ``minutes`` after ``start`` (UTC session)."""
    return F.timestamp_seconds(
        F.unix_timestamp(F.lit(start)) + minutes * 60
    ).cast("timestamp_ntz")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows from `documents`, image rows from `embeddings`."""
    docs = table(spark, sf_dir, "documents")
    embeddings = table(spark, sf_dir, "embeddings")
    doc_owner = 1000 + F.col("doc_id") % 2
    text_meta = F.concat(
        F.lit('{"lang":"'), "lang", F.lit('","source":"'), "source",
        F.lit('","size":{"chars":'), F.col("n_chars").cast("string"), F.lit("}}"),
    )
    text_rows = docs.join(
        embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left"
    ).select(
        F.col("doc_id").alias("id"),
        F.concat(doc_owner.cast("string"), F.lit("-docs")).alias("tenant"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("vector_id"),
        "embedding",
        F.col("text").alias("content"),
        text_meta.alias("metadata"),
        minutes_after("2024-01-01 00:00:00", F.col("doc_id")).alias("created_at"),
        owner_region(doc_owner).alias("region"),
    )
    image_owner = 1000 + F.col("vec_id") % 2
    image_rows = embeddings.select(
        (F.lit(1000000).cast("long") + F.col("vec_id")).alias("id"),
        F.concat(image_owner.cast("string"), F.lit("-images")).alias("tenant"),
        F.concat(F.lit("i"), F.col("vec_id").cast("string")).alias("vector_id"),
        "embedding",
        F.lit(None).cast("string").alias("content"),
        F.concat(F.lit('{"label":'), F.col("label").cast("string"), F.lit("}")).alias("metadata"),
        minutes_after("2024-01-01 00:00:00", F.col("vec_id")).alias("created_at"),
        owner_region(image_owner).alias("region"),
    )
    return spread(text_rows.unionByName(image_rows))


def doc_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per embedding: its vector, and words of the document it belongs to.

    Labels vary the shape: no text, punctuation only, a word without hits, and
    different pages, limits and filters.
    """
    return doc_queries_of(table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents"))


def doc_queries_of(e: DataFrame, documents: DataFrame) -> DataFrame:
    d = documents.select(
        F.col("doc_id").alias("vec_id"),
        F.array_remove(F.split("text", WORD_BREAK, 5), "").alias("words"),
    )
    parts = [F.lower(F.try_element_at("words", F.lit(n))) for n in (1, 2, 3)]
    opening = F.concat_ws(" ", parts[0], parts[1], F.left(parts[2], F.lit(2)))
    d = d.select("vec_id", opening.alias("opening"))
    own_words = F.coalesce("opening", F.lit(""))
    label = F.col("label")
    text = (
        F.when(label == 3, "  ")
        .when(label == 5, "?! --")
        .when(label == 7, "zzzqx nohit")
        .when(label == 8, "the and th")
        .otherwise(own_words)
    )
    wanted = (
        F.when(label == 0, '{"lang":"en"}')
        .when(label == 1, '{"size":{}}')
        .when(label == 2, '{"source":"src3"}')
        .when(label == 4, '{"lang":"fr","source":"src0"}')
        .when(label == 6, "null")
        .when(label == 8, '{"lang":5}')
    )
    return e.join(d, "vec_id", "left").select(
        F.col("vec_id").alias("query_id"),
        F.concat((1000 + F.col("vec_id") % 2).cast("string"), F.lit("-docs")).alias("tenant"),
        text.alias("text"),
        F.col("embedding").alias("vector"),
        wanted.alias("wanted"),
        F.when(label == 4, 2).when(label == 6, 3).cast("int").alias("page"),
        F.when(label == 4, 2).when(label == 6, 1).when(label == 8, 500).cast("int").alias("limit"),
    )


def image_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector-only query per embedding against the image databases."""
    return table(spark, sf_dir, "embeddings").select(
        (F.lit(1000000).cast("long") + F.col("vec_id")).alias("query_id"),
        F.concat((1000 + F.col("vec_id") % 2).cast("string"), F.lit("-images")).alias("tenant"),
        F.lit(None).cast("string").alias("text"),
        F.col("embedding").alias("vector"),
        F.when(F.col("label") < 5, F.concat(F.lit('{"label":'), F.col("label").cast("string"), F.lit("}"))).alias("wanted"),
        F.lit(None).cast("int").alias("page"),
        F.lit(None).cast("int").alias("limit"),
    )


def queries(spark: SparkSession, sf_dir: str, filtered: bool = False, images: bool = True) -> DataFrame:
    q = doc_queries(spark, sf_dir)
    if images:
        q = q.unionByName(image_queries(spark, sf_dir))
    return q.withColumnRenamed("wanted", "filter") if filtered else q.drop("wanted")
