"""Tokens per document from flat token files that have no index, by a separator scan.

Files are cut into blocks. Each block is searched for the end id in one vectorised pass; a
document's place in its file is the number of end ids before it, which a prefix scan over
the blocks' counts gives. Pieces of a document that lies across blocks get the same place,
and only those pieces are summed by a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import run_folder, stored
from rankloom.llm.tokenfiles import NO_ID, _mapped, manifest_of, scan_files

BLOCK_IDS = 1 << 21


def separator_scan(
    spark: SparkSession, folder: str, end_id: int, dtype: str = "<u2", block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Count the ids between end ids in every file of a set.

    Returns one row per document: part, place (from 0 in its file), n_tokens (without the
    end id), closed (an end id was found). An empty document counts 0; ids after a file's
    last end id are an open document; files without ids, and no files, give no rows.
    """
    blocks = manifest_of(spark, folder).where("n_ids > 0").select(
        "part", "file", "n_ids", F.explode(F.expr(f"sequence(0L, (n_ids - 1) div {block_ids}L)")).alias("block"))

    def search(folder, row):
        begin = row["block"] * block_ids
        ids = _mapped(folder, f"{row['file']}.ids", dtype, begin, min(block_ids, row["n_ids"] - begin))
        ends = np.flatnonzero(ids == end_id)
        tail = len(ids) - (ends[-1] + 1 if len(ends) else 0)
        lengths = np.diff(ends, prepend=-1) - 1
        if tail:
            lengths = np.append(lengths, tail)
        n = len(lengths)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(np.full(n, row["part"]), pa.int32()), "block": np.full(n, row["block"], np.int64),
            "piece": np.arange(n), "n_tokens": lengths.astype(np.int64), "closed": np.arange(n) < len(ends),
        })

    schema = "part int, block long, piece long, n_tokens long, closed boolean"
    pieces = stored(scan_files(spark, folder, search, schema, blocks), run_folder(spark, "pieces"))
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = pieces.groupBy("part", "block").agg(F.count_if("closed").alias("ends"))
    ends = ends.select("part", "block", F.coalesce(F.sum("ends").over(earlier), F.lit(0).cast("long")).alias("before"))
    placed = pieces.join(ends, ["part", "block"]).withColumn("place", F.col("before") + F.col("piece"))
    # A piece that neither opens nor leaves its block is a whole document.
    inner = F.col("closed") & (F.col("piece") > 0)
    whole = placed.where(inner).select("part", "place", "n_tokens", "closed")
    edges = placed.where(~inner).groupBy("part", "place").agg(
        F.sum("n_tokens").alias("n_tokens"), F.bool_or("closed").alias("closed"))
    return whole.unionByName(edges)


def document_order(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of the documents of a set by their place: part, place, doc_id."""
    def each(folder, row):
        ids = np.array(_mapped(folder, f"{row['file']}.doc", "<i8"))
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(np.full(len(ids), row["part"]), pa.int32()), "place": np.arange(len(ids)),
            "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID),
        })
    return scan_files(spark, folder, each, "part int, place long, doc_id long")
