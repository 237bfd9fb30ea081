"""Hard negatives by length buckets and sorted coordinate lists.

Vectors are scaled and floored to integers, so scores are exact. Rows are ranged by length
and packed in blocks of bounded size; a block is a few length buckets, each with its rows
sorted along every coordinate. An anchor that needs scores of at least ``floor`` skips a
bucket whose longest row cannot reach it. In any other bucket it takes its largest
coordinates as focus: a unit vector whose cosine with the anchor is at least c has its
coordinate f within ``a_f * c`` plus or minus ``sqrt(1 - a_f^2) * sqrt(1 - c^2)``. Each range
is a stretch of a sorted list; rows that lie in all of them are scored exactly.

Anchors and rows meet as a grid of blocks: every block of rows is moved once, and blocks of
anchors, a small share of the rows, once for every slot of rows. Tasks hand on the best few
rows of each anchor only. No pair exists as a row, whatever many rows share a vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import run_folder, stored

# Rows of a block, rows of a length bucket in it, and anchors of a block.
BLOCK = 8192
BUCKET = 1024
ANCHORS = 2048
FOCUS = 3
# Beyond this share of a bucket, scoring all of it costs less than meeting lists.
DENSE = 0.25
_SLACK = 1e-6

_PACKED = "slot int, width int, n int, ids binary, labels binary, vectors binary"


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable_rows(
    embeddings: DataFrame, scale: int, label: Column | None, id_col: str, vector_col: str, label_col: str,
) -> DataFrame:
    """vec_id, label, q (scaled), width, length of the rows that take part, once each."""
    vector = F.col(vector_col)
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"), (F.col(label_col) if label is None else label).cast("long").alias("label"),
        F.when(sound, scaled(vector, scale)).alias("q"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL AND size(q) > 0").distinct()
    length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("vec_id", "label", "q", F.size("q").alias("width"), length.alias("length"))


def _pack(block: int):
    """Rows of a partition, in their order, as blocks of one width."""
    def run(batches):
        slot = TaskContext.get().partitionId()
        for batch in batches:
            widths = batch.column(3).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(widths)] if len(widths) else []
            for lo, hi in zip(edges, edges[1:]):
                for at in range(lo, hi, block):
                    part = batch.slice(at, min(block, hi - at))
                    matrix = part.column(2).flatten().to_numpy().astype("<f8")
                    yield pa.RecordBatch.from_pydict({
                        "slot": pa.array([slot], pa.int32()), "width": pa.array([int(widths[lo])], pa.int32()),
                        "n": pa.array([part.num_rows], pa.int32()),
                        "ids": [part.column(0).to_numpy().astype("<i8").tobytes()],
                        "labels": [part.column(1).to_numpy().astype("<i8").tobytes()],
                        "vectors": [_small(matrix)],
                    })
    return run


def _small(matrix: np.ndarray) -> bytes:
    """A tag and the numbers, as 16-bit integers if all fit."""
    if len(matrix) == 0 or np.abs(matrix).max() < 1 << 15:
        return b"h" + matrix.astype("<i2").tobytes()
    return b"d" + matrix.tobytes()


def _unpacked(row: dict, prefix: str = ""):
    raw = row[f"{prefix}vectors"]
    matrix = np.frombuffer(raw, "<i2" if raw[:1] == b"h" else "<f8", offset=1) if raw[:1] == b"h" else np.frombuffer(raw[1:], "<f8")
    return (np.frombuffer(row[f"{prefix}ids"], "<i8"), np.frombuffer(row[f"{prefix}labels"], "<i8"),
            matrix.astype(np.float64).reshape(row[f"{prefix}n"], row["width"]))


class Buckets:
    """A block of rows in length buckets, each with its sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, size: int = BUCKET):
        lengths = np.sqrt((matrix * matrix).sum(axis=1))
        order = np.lexsort((ids, -lengths))
        self.ids, self.labels, self.matrix, self.lengths = ids[order], labels[order], matrix[order], lengths[order]
        self.parts = [slice(i, min(i + size, len(ids))) for i in range(0, len(ids), size)]
        self._lists: dict = {}

    def lists(self, number: int):
        """Row numbers of a bucket sorted along each coordinate, and the sorted values."""
        if number not in self._lists:
            part = self.parts[number]
            unit = self.matrix[part] / np.maximum(self.lengths[part, None], 1e-300)
            order = np.argsort(unit, axis=0, kind="stable").T.copy()
            self._lists[number] = order, np.take_along_axis(unit.T, order, axis=1)
        return self._lists[number]

    def candidates(self, number: int, unit: np.ndarray, needed: float, focus: np.ndarray) -> np.ndarray | None:
        """Row numbers that the focus coordinates allow a cosine of ``needed``; None for the whole bucket."""
        order, values = self.lists(number)
        n = order.shape[1]
        apart = np.sqrt(np.maximum(1.0 - needed * needed, 0.0))
        stretches = []
        for f in focus:
            reach = np.sqrt(max(1.0 - unit[f] * unit[f], 0.0)) * apart + _SLACK
            low = np.searchsorted(values[f], unit[f] * needed - reach)
            # A cosine above the needed one may put the coordinate up to the anchor's own side of the range.
            top = 1.0 if unit[f] >= needed else unit[f] * needed + reach
            bottom = -1.0 - _SLACK if unit[f] <= -needed else None
            low = 0 if bottom is not None else low
            high = np.searchsorted(values[f], top + _SLACK, side="right")
            stretches.append((high - low, f, low, high))
        stretches.sort()
        if stretches[0][0] > DENSE * n:
            return None
        found = order[stretches[0][1], stretches[0][2]:stretches[0][3]]
        for size, f, low, high in stretches[1:]:
            if size > DENSE * n or not len(found):
                break
            found = np.intersect1d(found, order[f, low:high])
        return found


def retrieve(buckets: Buckets, vectors: np.ndarray, floors, take, focus: int = FOCUS) -> None:
    """Hand ``take(anchor, rows, scores)`` every row of each anchor whose score can reach its floor.

    ``floors(anchor)`` is asked again before every bucket, so that it may rise with what was
    taken. Rows below the floor may be handed over as well.
    """
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    units = vectors / np.maximum(lengths[:, None], 1e-300)
    leading = np.argsort(-np.abs(units), axis=1, kind="stable")[:, :focus]
    for number, part in enumerate(buckets.parts):
        longest, rows, whole = buckets.lengths[part.start], np.arange(part.start, part.stop), []
        shortest = buckets.lengths[part.stop - 1]
        for a in range(len(vectors)):
            floor = floors(a)
            if floor > lengths[a] * longest * (1 + _SLACK) + _SLACK:
                continue
            found = None
            # A positive floor asks for this cosine at least, of a row without length for none.
            if floor > 0 and shortest > 0:
                found = buckets.candidates(number, units[a], min(floor / (lengths[a] * longest), 1.0), leading[a])
            if found is None:
                whole.append(a)
            elif len(found):
                picked = part.start + np.sort(found)
                take(a, picked, buckets.matrix[picked] @ vectors[a])
        if whole:
            scores = vectors[whole] @ buckets.matrix[part].T
            for a, own in zip(whole, scores):
                take(a, rows, own)


def _best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the best: higher scores first, then smaller ids."""
    if len(scores) > 8 * count:
        least = np.partition(scores, len(scores) - count)[len(scores) - count]
        kept = np.flatnonzero(scores >= least)
        return kept[np.lexsort((ids[kept], -scores[kept]))[:count]]
    return np.lexsort((ids, -scores))[:count]


class _Top:
    """The best rows of an anchor so far."""

    def __init__(self, count: int):
        self.count, self.scores, self.ids = count, np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores, ids):
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        kept = _best(scores, ids, self.count)
        self.scores, self.ids = scores[kept], ids[kept]

    def floor(self) -> float:
        return self.scores[-1] if len(self.scores) == self.count else -np.inf


def _positives(count: int):
    def run(batches):
        held: tuple = (None, None)
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["slot"], row["block"])
                if held[0] != key:
                    held = key, Buckets(*_unpacked(row))
                buckets = held[1]
                ids, labels, vectors = _unpacked(row, "a_")
                tops = [_Top(count) for _ in ids]

                def take(a, rows, scores):
                    own = (buckets.labels[rows] == labels[a]) & (buckets.ids[rows] != ids[a]) & (scores >= tops[a].floor())
                    if own.any():
                        tops[a].add(scores[own], buckets.ids[rows[own]])

                retrieve(buckets, vectors, lambda a: tops[a].floor(), take)
                at = np.repeat(np.arange(len(ids)), [len(t.ids) for t in tops])
                yield pa.RecordBatch.from_pydict({
                    "a_block": pa.array([row["a_block"]] * len(at), pa.int64()), "place": pa.array(at, pa.int32()),
                    "anchor_id": ids[at], "positive_id": np.concatenate([t.ids for t in tops]),
                    "positive_score": np.concatenate([t.scores for t in tops]).astype(np.int64),
                })
    return run


def _negatives(count: int, low: int, high: int):
    def run(batches):
        held: tuple = (None, None)
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["slot"], row["block"])
                if held[0] != key:
                    held = key, Buckets(*_unpacked(row))
                buckets = held[1]
                ids, labels, vectors = _unpacked(row, "a_")
                wanted: dict = {}
                for p in row["positives"]:
                    wanted.setdefault(p["place"], []).append((p["number"], p["positive_id"], p["positive_score"], _Top(count)))
                floors = [
                    min((low * w[2] / 100 for w in wanted.get(a, ()) if w[2] >= 0), default=np.inf) for a in range(len(ids))]

                def floor(a):
                    # Once every positive has its fill, only scores above the least of them matter.
                    full = [w[3].floor() for w in wanted.get(a, ()) if w[2] >= 0]
                    return max(floors[a], min(full, default=np.inf))

                def take(a, rows, scores):
                    other = buckets.labels[rows] != labels[a]
                    for _, _, positive, top in wanted.get(a, ()):
                        own = other & (low * positive <= 100 * scores) & (100 * scores <= high * positive) & (scores >= top.floor())
                        if own.any():
                            top.add(scores[own], buckets.ids[rows[own]])

                retrieve(buckets, vectors, floor, take)
                out = [(a, *w) for a, ws in wanted.items() for w in ws]
                sizes = [len(o[4].ids) for o in out]
                column = lambda i: np.repeat(np.array([o[i] for o in out], np.int64), sizes)
                if not sum(sizes):
                    continue
                yield pa.RecordBatch.from_pydict({
                    "a_block": pa.array([row["a_block"]] * sum(sizes), pa.int64()), "place": column(0).astype(np.int32),
                    "number": column(1).astype(np.int32), "anchor_id": ids[column(0)], "positive_id": column(2),
                    "negative_id": np.concatenate([o[4].ids for o in out]), "positive_score": column(3),
                    "negative_score": np.concatenate([o[4].scores for o in out]).astype(np.int64),
                })
    return run


def hard_negatives(
    embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    scale: int = 256, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", block: int = BLOCK, anchors: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides. Scores are inner products of components
    floored after scaling; higher ones come first, ties by smaller id. Each anchor has its first
    ``positives`` other rows of the same label, and each of these the first ``negatives`` rows of
    other labels whose score is between ``low`` and ``high`` per cent of the positive's.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component
    take no part; rows that repeat wholly count once, and rows of the anchor's own id are never
    its positives. Vectors of another width than the anchor's are not compared with it. Scores
    are exact up to 2^53. No rows, or no anchors, give no rows; other columns are not read.
    """
    folder = run_folder(embeddings.sparkSession, "negatives")
    rows = usable_rows(embeddings, scale, label, id_col, vector_col, label_col)
    total = rows.count()
    slots = max(1, -(-total // block), min(12, -(-total // 512)))
    ranged = rows.repartitionByRange(slots, "width", F.desc("length"), "vec_id").sortWithinPartitions(
        "width", F.desc("length"), "vec_id", "label")
    columns = ["vec_id", "label", "q", "width"]
    packed = stored(
        ranged.select(*columns).mapInArrow(_pack(block), _PACKED).withColumn("block", F.monotonically_increasing_id()),
        f"{folder}/rows")
    asked = rows.where(F.col("vec_id") % every == 0)
    dealt = max(1, -(-asked.count() // anchors))
    asked = asked.repartitionByRange(dealt, "width", "vec_id").sortWithinPartitions("width", "vec_id", "label")
    asked = asked.select(*columns).mapInArrow(_pack(anchors), _PACKED).drop("slot")
    asked = asked.select(
        "width", F.monotonically_increasing_id().alias("a_block"), F.col("n").alias("a_n"), F.col("ids").alias("a_ids"),
        F.col("labels").alias("a_labels"), F.col("vectors").alias("a_vectors"))
    asked = stored(asked, f"{folder}/anchors")
    dealt_rows = packed.repartition(slots, "slot")
    every_slot = F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")

    def grid(side: DataFrame) -> DataFrame:
        # Rows of one block stay together, so its lists are sorted once.
        met = dealt_rows.join(side.select("*", every_slot), ["slot", "width"])
        return met.sortWithinPartitions("slot", "block")

    found = grid(asked).mapInArrow(
        _positives(positives), "a_block long, place int, anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("a_block", "place").orderBy(F.desc("positive_score"), "positive_id")
    found = stored(
        found.withColumn("number", F.row_number().over(first)).where(F.col("number") <= positives), f"{folder}/positives")

    wanted = found.groupBy("a_block").agg(
        F.collect_list(F.struct("place", "number", "positive_id", "positive_score")).alias("positives"))
    made = grid(asked.join(wanted, "a_block")).mapInArrow(
        _negatives(negatives, low, high),
        "a_block long, place int, number int, anchor_id long, positive_id long, negative_id long, "
        "positive_score long, negative_score long")
    order = Window.partitionBy("a_block", "place", "number").orderBy(F.desc("negative_score"), "negative_id")
    made = made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return made.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
