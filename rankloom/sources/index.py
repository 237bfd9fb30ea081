"""Stored word indexes: words by term, and posting lists with their vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.fulltext import corpus_tokens
from rankloom.operators.postings import Postings, block_words, lists_of
from rankloom.operators.scan import file_part

TERM_BUCKETS = 256
FILE_ROWS = 5_000_000
# Words that a file of posting lists may have for each of its lists.
LIST_WORDS = 50


def write_index(corpus: DataFrame, path: str, mode: str = "append", buckets: int = TERM_BUCKETS,
                file_rows: int = FILE_ROWS) -> None:
    """Write ``tenant, id, pos, term`` in folders by term hash.

    A folder gets one file for every ``file_rows`` of its words, so the words of a
    frequent term are written by many tasks.
    """
    words = corpus_tokens(corpus.drop("filter_bits"))
    keyed = words.withColumn("term_bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    part = file_part(keyed, ["term_bucket"], "id", file_rows)
    (
        keyed.repartition("term_bucket", part)
        .sortWithinPartitions("term_bucket", "tenant", "term", "id", "pos")
        .write.mode(mode).option("maxRecordsPerFile", file_rows)
        .partitionBy("term_bucket")
        .parquet(path)
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Words for the ``terms`` argument of the search plans."""
    return spark.read.parquet(path).select("tenant", "id", "pos", "term")


def write_postings(corpus: DataFrame, path: str, buckets: int = TERM_BUCKETS, file_rows: int = FILE_ROWS // LIST_WORDS) -> None:
    """Store posting lists in folders by term hash, and the documents of every term sorted by term.

    A folder gets one file for every ``LIST_WORDS * file_rows`` of its words, and ``file_rows`` lists at most.
    Lists of a term lie together, by block. Words are counted in place and shuffled once, to their files.
    """
    spark = corpus.sparkSession
    words = block_words(corpus_tokens(corpus)).withColumn(
        "term_bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    words = words.withColumn("_part", file_part(words, ["term_bucket"], "block", LIST_WORDS * file_rows))
    keyed = lists_of(words, ["term_bucket", "_part"]).drop("_part")
    keyed = keyed.select(*(c for c in keyed.columns if c != "term_bucket"), "term_bucket")
    (
        keyed.sortWithinPartitions("term_bucket", "tenant", "term", "block")
        .write.option("maxRecordsPerFile", file_rows).partitionBy("term_bucket").parquet(f"{path}/lists")
    )
    keyed.limit(0).write.parquet(f"{path}/columns")
    lists = read_lists(spark, path)
    terms = lists.groupBy("tenant", "term").agg(F.sum("n_docs").alias("docs"))
    terms.repartitionByRange("term", "tenant").sortWithinPartitions("term", "tenant").write.parquet(f"{path}/vocabulary")
    spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/layout")


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/lists")


def read_postings(spark: SparkSession, path: str) -> Postings:
    """Stored posting lists for the ``terms`` argument of the search plans."""
    buckets = spark.read.parquet(f"{path}/layout").first().buckets
    return Postings(read_lists(spark, path), spark.read.parquet(f"{path}/vocabulary"), buckets)
