"""Flat files of unsigned token ids with 64-bit document offsets, memory-mapped for reading.

A set of files is one folder that all executors share:

* ``<file>.ids``  unsigned little-endian ids, each document closed by the end id;
* ``<file>.off``  signed 64-bit offsets, in ids from the start of the file: one per document
  and the total;
* ``<file>.doc``  signed 64-bit document ids, one per document;
* ``manifest``    a Parquet table (part, file, n_docs, n_ids, base).

A task writes its own files under names that hold its attempt, and reports them as one
manifest row; only files in the manifest count, so an attempt that was lost or repeated
leaves nothing that a reader would take. ``base``, the ids of all earlier files, is the
prefix sum of the manifest's counts, and base + offset places a document in the whole set.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import stored, whole_text

_MANIFEST = "part int, file string, n_docs long, n_ids long"
# A null document id is stored as the smallest number.
NO_ID = -(2**63)


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _mapped(folder: str, name: str, dtype: str, begin: int = 0, count: int | None = None) -> np.ndarray:
    """Part of a flat file: mapped where the file is local, else read from the store."""
    from pyarrow import fs

    store, base = _store(folder)
    path, width = f"{base}/{name}", np.dtype(dtype).itemsize
    if count is None:
        count = store.get_file_info(path).size // width - begin
    if count == 0:
        return np.empty(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r", begin * width, (count,))
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read_at(count * width, begin * width), dtype)


def write_tokens(
    docs: DataFrame, folder: str, encoder, end_id: int = 0, ordered: bool = True, offsets: bool = True,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode every whole text, close it with ``end_id`` and write the set; returns the manifest.

    With ``ordered`` the set is in ascending id order (rows that repeat an id by text);
    without, rows stay where they lie and nothing is shuffled. ``offsets=False`` leaves the
    ``.off`` files out. A null text is an empty document, a null id comes first; no rows
    give an empty manifest; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    if ordered:
        rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first())
        rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    shared = docs.sparkSession.sparkContext.broadcast(encoder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode, dtype = TaskContext.get(), None, shared.value.dtype
        end = np.array([end_id], dtype).tobytes()
        name, n_docs, n_ids = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, 0
        sinks = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if encode is None:
                store, base = _store(folder)
                store.create_dir(base, recursive=True)
                encode = shared.value.start()
                sinks = {k: store.open_output_stream(f"{base}/{name}.{k}") for k in ("ids", "doc", *["off"] * offsets)}
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            coded = encode(batch.column(1).to_pylist())
            lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // len(end) + 1
            sinks["ids"].write(end.join([*coded, b""]))
            sinks["doc"].write(ids.astype("<i8").tobytes())
            if offsets:
                starts = n_ids + np.cumsum(lengths) - lengths
                sinks["off"].write(starts.astype("<i8").tobytes())
            n_docs, n_ids = n_docs + len(coded), n_ids + int(lengths.sum())
        if offsets and n_docs:
            sinks["off"].write(np.array([n_ids], "<i8").tobytes())
        for sink in sinks.values():
            sink.close()
        if n_docs:
            row = {"part": pa.array([task.partitionId()], pa.int32()), "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]}
            yield pa.RecordBatch.from_pydict(row)

    written = stored(rows.mapInArrow(write, _MANIFEST), f"{folder}/written")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = written.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))
    return stored(based, f"{folder}/manifest")


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def scan_files(spark: SparkSession, folder: str, each: Callable, schema: str, rows: DataFrame | None = None) -> DataFrame:
    """Run ``each(folder, row)`` for every manifest row (or every row of ``rows``), spread over tasks."""
    rows = manifest_of(spark, folder) if rows is None else rows
    tasks = max(1, rows.count())

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from each(folder, row)

    return rows.repartition(min(tasks, 1 << 15)).mapInArrow(scan, schema)


def _documents(dtype: str, digest: bool):
    def each(folder, row):
        doc_ids = _mapped(folder, f"{row['file']}.doc", "<i8")
        offsets = _mapped(folder, f"{row['file']}.off", "<i8")
        ids = _mapped(folder, f"{row['file']}.ids", dtype)
        for i in range(0, len(doc_ids), 1024):
            some, marks = np.array(doc_ids[i:i + 1024]), np.array(offsets[i:i + 1025])
            parts = [ids[a:b].astype("<u4") for a, b in zip(marks[:-1], marks[1:])]
            columns = {
                "doc_id": pa.array(some, pa.int64(), mask=some == NO_ID),
                "start": row["base"] + marks[:-1], "n_tokens": np.diff(marks),
            }
            if digest:
                columns["ids_crc32"] = pa.array([zlib.crc32(p) for p in parts], pa.int64())
            else:
                columns["ids"] = pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)
    return each


def read_tokens(spark: SparkSession, folder: str, dtype: str = "<u2") -> DataFrame:
    """The documents of a set: doc_id, start, n_tokens (with the end id), ids."""
    return scan_files(spark, folder, _documents(dtype, False), "doc_id long, start long, n_tokens long, ids array<long>")


def token_digests(spark: SparkSession, folder: str, dtype: str = "<u2") -> DataFrame:
    """As ``read_tokens``, with the CRC-32 of the ids as unsigned 32-bit integers in their place."""
    return scan_files(spark, folder, _documents(dtype, True), "doc_id long, start long, n_tokens long, ids_crc32 long")
