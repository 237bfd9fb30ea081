"""Harmonic packing of documents into training sequences.

A piece of r ids belongs to class ``capacity // r``, the number of such pieces that a bin
holds. Every bin of a class takes exactly that many pieces, so a worker fills bins from its own
documents in one pass, whatever the others do, and no bin looks for the best fit. What a bin
leaves empty depends on the piece alone: little at the top of a class, a lot at its bottom. A
document is therefore cut where that costs least: full sequences first, and a rest that would
leave more than ``slack`` of its share empty in a few pieces that top their classes.

Pieces that do not fill a bin of their worker are numbered through all workers by prefix sums
over a table of counts, one row for each worker and class, and fill bins of their class. Of
each class less than one bin is left then, so the last pieces have a bound that does not grow
with the input: they are fitted by decreasing size in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import run_folder, stored, whole_text

CAPACITY = 4096
# The share of a bin that a whole piece may leave empty, and the shortest piece that is cut for it.
SLACK = 1 / 64
SHORTEST = 32

_PIECES = ("worker long, place long, doc_id long, start long, length int, doc_tokens long, kind int, bin long, slot int, "
           "ids binary, ids_crc32 long")


def cut_table(capacity: int = CAPACITY, slack: float = SLACK, shortest: int = SHORTEST) -> np.ndarray:
    """For every length up to the capacity, how many ids its first piece takes (itself: it stays whole).

    What is left after the first piece is looked up again. Of all ways to cut, each further
    piece counted as ``shortest / 4`` ids of waste, the table leads to the cheapest.
    """
    lengths = np.arange(capacity + 1)
    kinds = capacity // np.maximum(lengths, 1)
    waste = capacity / kinds - lengths
    waste[0] = 0
    first, cost = lengths.copy(), waste.copy()
    tops = np.unique(capacity // np.arange(1, capacity + 1))
    tops = tops[tops >= shortest]
    for r in np.flatnonzero(waste > slack * capacity / kinds):
        heads = tops[(tops < r) & (r - tops >= min(shortest, r // 2))]
        if len(heads):
            total = waste[heads] + cost[r - heads] + shortest / 4
            best = int(np.argmin(total))
            if total[best] < cost[r]:
                first[r], cost[r] = heads[best], total[best]
    return first


def cuts(n: int, table: np.ndarray) -> list[int]:
    """The lengths of the pieces of a document of ``n`` ids, in order."""
    capacity = len(table) - 1
    full, rest = divmod(n, capacity)
    out = [capacity] * full
    while rest:
        head = int(table[rest])
        out.append(head)
        rest -= head
    return out


def fit(pieces: list[tuple], capacity: int) -> list[tuple]:
    """(bin, offset) of each (length, ...) piece, in order: decreasing lengths, first bin with room."""
    order = sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], *pieces[i][1:]))
    free, out = np.zeros(0, np.int64), [None] * len(pieces)
    for i in order:
        length = pieces[i][0]
        fits = np.flatnonzero(free >= length)
        if len(fits):
            at = int(fits[0])
        else:
            at, free = len(free), np.append(free, capacity)
        out[i] = at, int(capacity - free[at])
        free[at] -= length
    return out


def _pieces(rows: DataFrame, encoder, end_id: int, capacity: int, slack: float, shortest: int) -> DataFrame:
    """Every piece: worker, place, kind (its class), and bin and slot if its worker filled the bin."""
    spark = rows.sparkSession
    shared, table = spark.sparkContext.broadcast(encoder), cut_table(capacity, slack, shortest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, dtype = shared.value.start(), shared.value.dtype
        end = np.array([end_id], dtype).tobytes()
        width, worker = len(end), TaskContext.get().partitionId()
        held: dict[int, int] = {}  # pieces of each class so far
        place = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                columns: dict = {n: [] for n in ("doc_id", "start", "length", "doc_tokens", "kind", "number", "ids", "ids_crc32")}
                for doc_id, coded in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    coded += end
                    total, start = len(coded) // width, 0
                    wide = np.frombuffer(coded, dtype).astype("<u4").tobytes()
                    for length in cuts(total, table):
                        kind = capacity // length
                        number = held.get(kind, 0)
                        held[kind] = number + 1
                        values = (doc_id, start, length, total, kind, number, coded[start * width:(start + length) * width],
                                  zlib.crc32(wide[4 * start:4 * (start + length)]))
                        for name, value in zip(columns, values):
                            columns[name].append(value)
                        start += length
                n = len(columns["start"])
                kind, number = np.array(columns.pop("kind"), np.int64), np.array(columns.pop("number"), np.int64)
                yield pa.RecordBatch.from_pydict({
                    "worker": np.full(n, worker), "place": place + np.arange(n),
                    "doc_id": pa.array(columns["doc_id"], pa.int64()), "start": columns["start"],
                    "length": pa.array(columns["length"], pa.int32()), "doc_tokens": columns["doc_tokens"],
                    "kind": kind.astype(np.int32), "bin": number // kind, "slot": (number % kind).astype(np.int32),
                    "ids": pa.array(columns["ids"], pa.binary()), "ids_crc32": pa.array(columns["ids_crc32"], pa.int64()),
                })
                place += n

    return rows.mapInArrow(run, _PIECES)


def pack_documents(
    docs: DataFrame, encoder, end_id: int, capacity: int = CAPACITY, slack: float = SLACK, shortest: int = SHORTEST,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Cut and pack all documents: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    ``ids`` holds a piece's ids as the encoder writes them; each document is closed by
    ``end_id``. The ids of a sequence, by offset, leave no gap; ``sequences`` joins them. A null text is
    empty, so its one piece is the end id; a null id stays null; rows that repeat are packed
    each; a text of any length is cut into full sequences and a rest. No rows give no rows;
    other columns are not read.
    """
    folder = run_folder(docs.sparkSession, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    pieces = stored(_pieces(rows, encoder, end_id, capacity, slack, shortest), f"{folder}/pieces")

    # One row for each worker and class: how many bins it filled, how many pieces it has left.
    filled = pieces.groupBy("worker", "kind").agg(F.count(F.lit(1)).alias("n"))
    filled = filled.select("worker", "kind", F.expr("n div kind").alias("bins"), (F.col("n") % F.col("kind")).alias("left"))
    before = Window.partitionBy("kind").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    workers = stored(filled.withColumn("before", F.coalesce(F.sum("left").over(before), F.lit(0))), f"{folder}/workers")
    kinds = workers.groupBy("kind").agg(F.sum("bins").alias("own"), F.sum("left").alias("left"))
    kinds = kinds.withColumn("shared", F.expr("left div kind"))

    # Sequences are numbered by class: each worker's own bins, then those that workers share.
    every = Window.orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("base", F.coalesce(F.sum(F.col("own") + F.col("shared")).over(every), F.lit(0)))
    kinds = stored(kinds, f"{folder}/kinds")
    own_before = F.coalesce(F.sum("bins").over(before), F.lit(0))
    bases = workers.withColumn("own_before", own_before).join(
        kinds.select("kind", "own", "shared", "base"), "kind")
    placed = pieces.join(bases, ["worker", "kind"])
    rank = F.col("before") + F.col("slot")
    in_own = F.col("bin") < F.col("bins")
    in_shared = ~in_own & (F.expr("(before + slot) div kind") < F.col("shared"))
    placed = placed.withColumns({
        "in_own": in_own, "in_shared": in_shared,
        "sequence": F.when(in_own, F.col("base") + F.col("own_before") + F.col("bin")).when(
            in_shared, F.col("base") + F.col("own") + F.expr("(before + slot) div kind")),
        "turn": F.when(in_own, F.col("slot").cast("long")).otherwise(rank % F.col("kind")),
    })

    # Less than one bin of each class is left: a number of pieces that the capacity bounds.
    last = placed.where("sequence IS NULL").select("length", "worker", "place")
    last = stored(last.repartition(1).mapInArrow(_fitted(capacity), "worker long, place long, bin long, offset long"), f"{folder}/last")
    packed_bins = kinds.agg(F.coalesce(F.sum(F.col("own") + F.col("shared")), F.lit(0)).alias("packed_bins"))
    last = last.join(F.broadcast(packed_bins)).select(
        "worker", "place", (F.col("packed_bins") + F.col("bin")).alias("last_sequence"), F.col("offset").alias("last_offset"))

    # Offsets are running sums over a bin, which holds the capacity at most.
    wanted = ["worker", "place", "length", "sequence", "turn"]
    inside = Window.partitionBy("sequence").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    places = placed.where("sequence IS NOT NULL").select(*wanted).withColumn(
        "offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
    places = places.select("worker", "place", F.col("sequence").alias("sequence_id"), "offset").unionByName(
        last.select("worker", "place", F.col("last_sequence").alias("sequence_id"), F.col("last_offset").alias("offset")))
    return pieces.join(places, ["worker", "place"]).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids", "ids_crc32", "doc_tokens",
        F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def _fitted(capacity: int):
    def run(batches):
        rows = [(x["length"], x["worker"], x["place"]) for b in batches for x in b.to_pylist()]
        found = fit(rows, capacity)
        yield pa.RecordBatch.from_pydict({
            "worker": pa.array([r[1] for r in rows], pa.int64()), "place": pa.array([r[2] for r in rows], pa.int64()),
            "bin": pa.array([f[0] for f in found], pa.int64()), "offset": pa.array([f[1] for f in found], pa.int64())})
    return run


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and the ids of every sequence as bytes, without its padding."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda s, p: F.concat(s, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
