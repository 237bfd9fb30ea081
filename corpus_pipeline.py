"""Documents to training ids: five stages, each over all that the one before kept.

``run`` writes every stage's result as Parquet in the folder that all executors share and
reads it back as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import decontam, exact, pieces, similar, toxicity
from rankloom.llm.common import documents, run_folder, stored
from rankloom.session import configure

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; a score of the text alone decides.

    Null and empty texts are scored like any other; rows that repeat, null ids and extra columns
    stay as they are; a table of no rows has none left.
    """
    labels = configure(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, labels)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the document with the largest id stays.

    Null and empty texts are equal; a null id is smaller than any other; of rows that repeat
    one stays, with all its columns; no rows give no rows.
    """
    configure(spark)
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that 5-word Jaccard >= 0.8 links the document with the smallest id stays.

    Fingerprints of 5-word shingles within two bits bring texts together first. They find only some
    copies of this similarity, so prefixes of the shingle sets bring the rest, and every link is
    confirmed on whole sets. Texts without words are equal; texts of any
    length are compared whole; of an id with two texts, and of null ids, rows are told apart by
    their texts; rows that repeat are cut to one; no rows give no rows.
    """
    configure(spark)
    return similar.drop_similar(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go.

    Null and empty texts hold none; rows that repeat, null ids and extra columns stay as they
    are; texts of any length are searched whole; no documents or no items drop nothing.
    """
    benchmark = configure(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.drop_contaminated(docs, benchmark)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text.

    Null and empty texts have no ids; null ids and repeated rows are all returned; no rows give
    no rows.
    """
    configure(spark)
    made = pieces.round_trip(docs, pieces.Model.read(PIECES))
    return made.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), F.col("exact").alias("decodes_exactly"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("sentencepiece", encode),
]

# A fitted model, hashed shingles and pieces have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = run_folder(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
