"""Exact deduplication by a streaming job with keyed state on disk.

A table of (digest, identifier, locator) is streamed into keyed state that never expires:
for each digest the number of rows, the largest identifier and where its text lies. The
state store (RocksDB, checkpointed in the shared folder) is the result; it is read with
Spark's state reader, and a later run over new rows goes on from it. A digest with several
rows is a hit: the full bytes of its rows are compared before they count as copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import ascii_lower, run_folder, settings, stored, whole_text

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Groups are compared in so many parts: one for each SALTED_ROWS rows of the largest group.
SALTED_ROWS, MOST_SALTS = 256, 64


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalised(text_col: str = "text") -> Column:
    return ascii_lower(whole_text(text_col))


def digests(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = normalised(text_col)
    return docs.select(
        digest(text).alias("digest"), sha256(text).alias("text_sha256"),
        F.col(id_col).alias("doc_id"), F.input_file_name().alias("locator"),
    )


def absorb(spark: SparkSession, arrivals: str, schema, state: str) -> DataFrame:
    """Stream the digest files in ``arrivals`` that ``state`` has not seen into it.

    Returns all that the state now holds: digest, keep_id, locator, group_size.
    """
    incoming = spark.readStream.schema(schema).parquet(arrivals)
    seen = incoming.groupBy("digest").agg(
        F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    with settings(
        spark,
        spark__sql__streaming__stateStore__providerClass=_ROCKS,
        spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true",
        spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
        spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="256",
        # Many small stores: without this each would hold some MB of empty log files.
        spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",
    ):
        seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(
            availableNow=True
        ).start().awaitTermination()
        held = spark.read.format("statestore").load(state)
    keep, size = (F.col(f"value.`{f.name}`") for f in held.schema["value"].dataType.fields)
    return held.select(
        F.col("key.digest").alias("digest"), keep["doc_id"].alias("keep_id"), keep["locator"].alias("locator"),
        size.alias("group_size"),
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256, folder: str | None = None,
) -> DataFrame:
    """Group the rows whose texts are equal after lower-casing A-Z; the largest id stays.

    Returns one row per row: doc_id, keep_id, group_size, kept, text_sha256, keep_locator.
    Null texts count as empty, and empty texts are one group. A null id is smaller than any
    other. Of rows that repeat both id and text one is kept. An empty table gives no rows.
    Other columns are not read. ``folder`` holds the state and the digests; a new one is
    taken if none is given.
    """
    spark = docs.sparkSession
    folder = folder or run_folder(spark, "exact")
    keyed = stored(digests(docs, id_col, text_col, digest), f"{folder}/digests")
    if keyed.isEmpty():
        return _shaped(_without_rows(keyed))
    held = stored(absorb(spark, f"{folder}/digests", keyed.schema, f"{folder}/state"), f"{folder}/groups")
    different = _different(docs, held, id_col, text_col, digest, f"{folder}/different")

    copies = keyed.groupBy("digest", "text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    if different is None:
        return _shaped(copies.join(held, "digest"))
    # Digests that different texts share: their rows are grouped by the texts themselves.
    apart = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("body"))
    apart = apart.withColumn("digest", digest(F.col("body"))).join(different, "digest", "left_semi")
    own = apart.groupBy("digest", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    apart = apart.groupBy("digest", "body", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    apart = apart.join(own, ["digest", "body"]).withColumns({"text_sha256": sha256(F.col("body")), "locator": F.lit(None).cast("string")})
    alike = copies.join(different, "digest", "left_anti").join(held, "digest")
    return _shaped(alike).unionByName(_shaped(apart))


def _different(docs, held, id_col, text_col, digest, folder) -> DataFrame | None:
    """The digests whose rows are not all the same bytes; None if there are none.

    The smallest and the largest text of a digest are equal only if all of them are. Large
    groups are dealt to several tasks by a salt, and each gives one pair of texts.
    """
    largest = held.agg(F.max("group_size")).collect()[0][0]
    salts = max(1, min(MOST_SALTS, largest // SALTED_ROWS))
    hits = held.where("group_size > 1").select(
        "digest", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    texts = docs.select(
        normalised(text_col).alias("body"), F.pmod(F.hash(id_col), F.lit(salts)).cast("int").alias("salt"))
    texts = texts.withColumn("digest", digest(F.col("body")))
    ends = (F.min("low").alias("low"), F.max("high").alias("high"))
    compared = texts.join(hits, ["digest", "salt"], "left_semi").groupBy("digest", "salt").agg(
        F.min("body").alias("low"), F.max("body").alias("high")).groupBy("digest").agg(*ends)
    found = stored(compared.where("low <> high").select("digest"), folder)
    return None if found.isEmpty() else found


def _shaped(rows: DataFrame) -> DataFrame:
    """One row for each copy; the first copy of the kept id stays."""
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256", F.col("locator").alias("keep_locator"),
    )


def _without_rows(keyed: DataFrame) -> DataFrame:
    one = F.lit(1).cast("long")
    return keyed.withColumns({"keep_id": F.col("doc_id"), "group_size": one, "copies": one})


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; nothing else is compared.

    Rows with a null id stay only where no other row has their text.
    """
    spark = docs.sparkSession
    groups = exact_groups(docs, id_col, text_col)
    verdicts = stored(groups.select("doc_id", "kept", "text_sha256"), run_folder(spark, "verdicts"))
    gone = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha"))
    repeats = verdicts.where("kept").join(
        gone, F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.col("text_sha256") == F.col("_sha")), "left_semi")
    if repeats.isEmpty():
        same = F.col(id_col).eqNullSafe(F.col("_gone")) & (sha256(normalised(text_col)) == F.col("_sha"))
        return docs.join(gone.distinct(), same, "left_anti")
    # Some rows repeat both id and text: one row of each such pair stays.
    marked = docs.withColumn("_key", sha256(normalised(text_col)))
    first = marked.dropDuplicates([id_col, "_key"])
    kept = verdicts.where("kept").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha"))
    same = F.col(id_col).eqNullSafe(F.col("_gone")) & (F.col("_key") == F.col("_sha"))
    return first.join(kept, same, "left_semi").drop("_key")
