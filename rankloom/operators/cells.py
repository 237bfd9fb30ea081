"""Exact search through cells with bounds.

Every stored vector lies in the cell of its nearest centre, and a cell knows the least and the
largest angle between its vectors and the centre. Angles obey the triangle inequality: a
vector of the cell is at least ``angle(query, centre) - farthest`` and at least ``nearest -
angle(query, centre)`` away from a query. A cell is read only if that bound can hold the
distance that is asked for, so nothing is lost, however few cells are read.

A search that still asks for much goes in two waves. The first reads, for each query, the
cells with the lowest bounds until they hold as many rows as the query may keep; the k-th
distance found there is what the second wave asks the other cells for.

How many cells can be skipped depends on the vectors: clusters prune well, vectors that lie
evenly in all directions do not prune at all. ``cells_read`` tells before a search.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.metadata import ContainmentCheck
from rankloom.functions.scores import DISTANCE_THRESHOLD, MAX_CANDIDATES
from rankloom.functions.vectors import norm
from rankloom.operators.blocks import HITS, TopBuffer, by_tenant
from rankloom.operators.knn import BROADCAST_BYTES, BROADCAST_QUERIES, _query_sets, _score, _vectors, knn
from rankloom.operators.scan import STATED_TENANTS, file_part, of_tenants
from rankloom.operators.topk import top_per_query

# Centres are broadcast, so their number is bounded; beyond it cells get larger.
MOST_CELLS = 1 << 16
# Cells that are stated in a scan as literals.
STATED_CELLS = 10_000
FILE_ROWS = 1_000_000
# Rows from which a search is worth two waves.
TWO_WAVES = 1_000_000
# Bounds of queries by cells that the driver looks at.
BOUNDS = 1 << 24
# Beyond this share of cells that queries need, meeting all rows at once costs less.
DENSE = 0.25
# Entries of a matrix of vectors by cells that a task holds, and copies of queries that it hands over.
_ENTRIES = 1 << 21
_COPIES = 1 << 13
# What rounding may do to an angle.
_SLACK = 1e-7


def _usable(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("embedding").isNotNull() & (norm(F.col("embedding")) > 0))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def sampled_centres(corpus: DataFrame, most: int = MOST_CELLS) -> dict[int, np.ndarray]:
    """For every width of vectors, as many of them as the root of their number, drawn by a hash of their ids."""
    usable = _usable(corpus).select("id", "embedding", F.size("embedding").alias("width"))
    widths = usable.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()
    centres = {}
    for width, n in sorted((r.width, r.n) for r in widths):
        drawn = usable.where(F.col("width") == width).orderBy(F.xxhash64("id"), "id").select("embedding")
        drawn = drawn.limit(min(most, math.isqrt(n - 1) + 1)).toArrow()
        centres[width] = unit_rows(_vectors(drawn.column("embedding"), width)[1])
    return centres


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


def with_cells(corpus: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """The rows that have a direction, with ``cell`` (width and number of the centre) and ``angle``."""
    shared = corpus.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("cell string, angle double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        cells, angles = np.full(len(vectors), None, object), np.full(len(vectors), np.nan)
        widths = vectors.map(len).to_numpy()
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            step = max(1, _ENTRIES // len(shared.value[width]))
            for at in range(0, len(rows), step):
                some = rows[at:at + step]
                units = unit_rows(np.stack(vectors.iloc[some].tolist()).astype(np.float64))
                apart = _angles(units, shared.value[width])
                own = apart.argmin(axis=1)
                cells[some], angles[some] = [f"{width}-{c}" for c in own], apart[np.arange(len(some)), own]
        return pd.DataFrame({"cell": cells, "angle": angles})

    placed = _usable(corpus).withColumn("_place", place("embedding"))
    return placed.withColumns({"cell": F.col("_place.cell"), "angle": F.col("_place.angle")}).drop("_place")


def write_cells(corpus: DataFrame, folder: str, centres: dict[int, np.ndarray] | None = None, file_rows: int = FILE_ROWS) -> None:
    """Store the corpus by cell in ``folder/rows`` and what is known about the cells in ``folder/cells``.

    A cell gets one file for every ``file_rows`` of its rows. Rows without a vector, or with a
    zero vector, have no distance and are left out.
    """
    spark = corpus.sparkSession
    centres = sampled_centres(corpus) if centres is None else centres
    corpus.sparkSession.createDataFrame(
        [(f"{w}-{i}", w, c.tolist()) for w, own in centres.items() for i, c in enumerate(own)],
        "cell string, width int, centre array<double>").write.parquet(f"{folder}/centres")
    placed = with_cells(corpus, centres)
    part = file_part(placed, ["cell"], "id", file_rows) if file_rows else F.lit(0)
    placed.repartition("cell", part).sortWithinPartitions("cell", "tenant", "angle").write.partitionBy("cell").parquet(f"{folder}/rows")
    # A table of no rows has no files that could tell its columns.
    placed.limit(0).write.parquet(f"{folder}/columns")
    known = stored_rows(spark, folder).groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.min("angle").alias("nearest"), F.max("angle").alias("farthest"))
    made = spark.read.parquet(f"{folder}/centres").join(known, "cell")
    made.write.parquet(f"{folder}/cells")


def stored_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{folder}/columns").schema).parquet(f"{folder}/rows")


@dataclass
class Cells:
    """Centres, rows and angles of the cells of every width; a row for each cell that holds vectors."""

    names: dict[int, np.ndarray]
    centres: dict[int, np.ndarray]
    rows: dict[int, np.ndarray]
    nearest: dict[int, np.ndarray]
    farthest: dict[int, np.ndarray]

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Cells:
        table = spark.read.parquet(f"{folder}/cells").orderBy("width", "cell").toArrow()
        out = cls({}, {}, {}, {}, {})
        for width in pc.unique(table.column("width")).to_pylist():
            own = table.filter(pc.equal(table.column("width"), width))
            out.names[width] = np.array(own.column("cell").to_pylist(), object)
            out.centres[width] = _vectors(own.column("centre"), width)[1]
            for name in ("rows", "nearest", "farthest"):
                getattr(out, name)[width] = own.column(name).to_numpy()
        return out

    def bounds(self, units: np.ndarray, cells=slice(None)) -> np.ndarray:
        """The least cosine distance that a vector of each cell can have to each query."""
        width = units.shape[1]
        apart = _angles(units, self.centres[width][cells])
        least = np.maximum(apart - self.farthest[width][cells], self.nearest[width][cells] - apart) - _SLACK
        return 1.0 - np.cos(np.clip(least, 0.0, np.pi))


def _first_cells(bounds: np.ndarray, rows: np.ndarray, depth: np.ndarray, limit: float) -> np.ndarray:
    """For each query its cells of the lowest bounds, until they hold ``depth`` rows."""
    order = np.argsort(bounds, axis=1, kind="stable")
    held = np.cumsum(rows[order], axis=1) - rows[order]
    taken = held < depth[:, None]
    out = np.zeros(bounds.shape, bool)
    np.put_along_axis(out, order, taken, axis=1)
    return out & (bounds <= limit)


class _Part:
    """The buffer of a query set for some of its queries."""

    def __init__(self, buffer: TopBuffer, chosen: np.ndarray):
        self.buffer, self.chosen, self.cutoff = buffer, chosen, buffer.cutoff[chosen]

    def add(self, query, ids, cost):
        self.buffer.add(self.chosen[query], ids, cost)


class _Some:
    """Some queries of a query set."""

    def __init__(self, queries, chosen: np.ndarray):
        self.dim, self.ids, self.matrix = queries.dim, queries.ids[chosen], queries.matrix[chosen]
        self.filters = None if queries.filters is None else queries.filters[chosen]


def _scan(batches, sets: dict, cells: Cells, limits: dict, threshold, seen: dict | None):
    """Score every stretch of a cell with the queries whose bound allows it.

    ``limits`` holds, by tenant and query set, the distance up to which each query asks;
    ``seen`` the cells that each has already met.
    """
    check = ContainmentCheck()
    places = {w: {n: i for i, n in enumerate(names.tolist())} for w, names in cells.names.items()}
    buffers = {t: [TopBuffer(q.ids, q.depth) for q in found] for t, found in sets.items()}
    for batch in batches:
        for tenant, mine in by_tenant(batch, sets):
            named = mine.column("cell").dictionary_encode()
            codes = named.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(named.dictionary.to_pylist()):
                width = int(name.split("-")[0])
                own = mine if len(named.dictionary) == 1 else mine.take(pa.array(np.flatnonzero(codes == code)))
                for n, (queries, buffer) in enumerate(zip(sets[tenant], buffers[tenant])):
                    if queries.dim != width:
                        continue
                    cell = places[width][name]
                    bound = cells.bounds(queries.matrix, slice(cell, cell + 1))[:, 0]
                    wanted = bound <= np.minimum(limits[tenant][n], buffer.cutoff)
                    if seen is not None:
                        wanted &= ~seen[tenant][n][:, cell]
                    chosen = np.flatnonzero(wanted)
                    if len(chosen):
                        _score(own, _Some(queries, chosen), _Part(buffer, chosen), threshold, check)
                    if buffer.full():
                        yield from buffer.drain()
    for found in buffers.values():
        for buffer in found:
            yield from buffer.drain()


def _stated(rows: DataFrame, sets: dict, chosen: dict, cells: Cells) -> DataFrame:
    """The stored rows of the chosen cells and of the tenants that ask."""
    names = sorted({
        name for t, found in sets.items() for q, own in zip(found, chosen[t])
        for name in cells.names[q.dim][own.any(axis=0)].tolist()}) if chosen else []
    every = sum(map(len, cells.names.values()))
    if not names:
        rows = rows.where(F.lit(False))
    elif len(names) < every and len(names) <= STATED_CELLS:
        rows = rows.where(F.col("cell").isin(names))
    return of_tenants(rows, sorted(sets)) if len(sets) <= STATED_TENANTS else rows


def search_cells(
    spark: SparkSession, folder: str, queries: DataFrame, threshold: float | None = DISTANCE_THRESHOLD,
    cap: int = MAX_CANDIDATES, two_waves: int = TWO_WAVES, table: pa.Table | None = None,
) -> DataFrame:
    """``query_id, id, dist, vrank``: what the exact join finds, from the cells that can hold it.

    ``queries`` are those of `knn`. Few of them (checked by count and bytes) are broadcast and
    the chosen cells' folders are read in place. More are sent to the cells that they need and
    meet them there in blocks.
    """
    rows, cells = stored_rows(spark, folder), Cells.read(spark, folder)
    columns = ["query_id", "tenant", "vector", "candidates"]
    columns += [c for c in ("filter_bit", "filter") if c in queries.columns][:1]
    asked = queries.select(*columns).where(F.col("vector").isNotNull() & F.col("tenant").isNotNull())
    if table is None:
        head = asked.limit(BROADCAST_QUERIES + 1).toArrow()
        table = head if head.num_rows <= BROADCAST_QUERIES and head.nbytes <= BROADCAST_BYTES else None
    if table is None or table.num_rows * sum(map(len, cells.names.values())) > BOUNDS:
        return _by_cell(rows, cells, asked, threshold, cap)

    sets = {t: [q for q in found if q.dim in cells.names] for t, found in _query_sets(table.select(columns)).items()}
    limit = np.inf if threshold is None else threshold
    limits = {t: [np.full(len(q.ids), limit) for q in found] for t, found in sets.items()}
    bounds = {t: [cells.bounds(q.matrix) for q in found] for t, found in sets.items()}
    carried = [{"filter_bit": "filter_bits", "filter": "metadata"}[c] for c in columns[4:]]
    rows = rows.select("tenant", "id", "embedding", "cell", *carried, *[c for c in ("tenant_bucket",) if c in rows.columns])

    def wave(chosen: dict, seen: dict | None) -> DataFrame:
        shared = spark.sparkContext.broadcast((sets, cells, limits, seen))

        def run(batches):
            own, known, most, before = shared.value
            yield from _scan(batches, own, known, most, threshold, before)

        return _stated(rows, sets, chosen, cells).mapInArrow(run, HITS)

    def chosen_now() -> dict:
        return {t: [b <= m[:, None] for b, m in zip(bounds[t], limits[t])] for t in sets}

    order, hits = [F.col("cost"), F.col("id")], None
    needed = chosen_now()
    read = sum(int(cells.rows[q.dim][own.any(axis=0)].sum()) for t, found in sets.items() for q, own in zip(found, needed[t]))
    if read > two_waves:
        first = {
            t: [_first_cells(b, cells.rows[q.dim], q.depth, limit) for q, b in zip(sets[t], bounds[t])] for t in sets}
        hits = top_per_query(wave(first, {t: [~own for own in first[t]] for t in sets}), order, "vrank", "candidates", cap)
        hits = hits.cache()
        # A query that has as many hits as it may keep asks for nothing farther than its last.
        last = {r.query_id: r.cost for r in hits.where(
            F.col("vrank") == F.least(F.col("candidates"), F.lit(cap))).select("query_id", "cost").collect()}
        for t, found in sets.items():
            for q, most in zip(found, limits[t]):
                most[:] = np.minimum(most, [last.get(i, np.inf) for i in q.ids.tolist()])
        needed = {t: [now & ~own for now, own in zip(chosen_now()[t], first[t])] for t in sets}
        hits = hits.drop("vrank").unionByName(wave(needed, first))
    else:
        hits = wave(needed, None)
    ranked = top_per_query(hits, order, "vrank", "candidates", cap)
    return ranked.select("query_id", "id", F.col("cost").alias("dist"), "vrank")


def _chosen(vectors: pa.Array, cells: Cells, limit: float):
    """Rows of some of the vectors at a time, their width, and which cells of it can hold what they ask for."""
    for width, names in cells.names.items():
        rows, matrix = _vectors(vectors, width)
        norms = np.linalg.norm(matrix, axis=1)
        rows, units = rows[norms > 0], matrix[norms > 0] / norms[norms > 0, None]
        step = max(1, _ENTRIES // len(names))
        for at in range(0, len(rows), step):
            yield rows[at:at + step], width, cells.bounds(units[at:at + step]) <= limit


def _counted(spark: SparkSession, cells: Cells, queries: DataFrame, threshold: float | None) -> DataFrame:
    """``query_id, cells, rows``: the cells that each query needs, and their rows."""
    shared, limit = spark.sparkContext.broadcast(cells), np.inf if threshold is None else threshold

    def run(batches):
        known = shared.value
        for batch in batches:
            n = np.zeros((2, batch.num_rows), np.int64)
            for rows, width, own in _chosen(batch.column("vector"), known, limit):
                n[:, rows] = own.sum(axis=1), own @ known.rows[width]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(n[0]), pa.array(n[1])], names=["query_id", "cells", "rows"])

    counts = T.StructType([T.StructField("cells", T.LongType()), T.StructField("rows", T.LongType())])
    asked = queries.select("query_id", "vector")
    return asked.mapInArrow(run, T.StructType([asked.schema["query_id"], *counts.fields]))


def _sent(spark: SparkSession, cells: Cells, asked: DataFrame, threshold: float | None) -> DataFrame:
    """A copy of every query for each cell that it needs, with ``cell``."""
    shared, limit = spark.sparkContext.broadcast(cells), np.inf if threshold is None else threshold

    def run(batches):
        known = shared.value
        for batch in batches:
            for rows, width, own in _chosen(batch.column("vector"), known, limit):
                query, cell = np.nonzero(own)
                for at in range(0, len(query), _COPIES):
                    some = batch.take(pa.array(rows[query[at:at + _COPIES]]))
                    names = pa.array(known.names[width][cell[at:at + _COPIES]], pa.string())
                    yield pa.RecordBatch.from_arrays([*some.columns, names], names=[*some.schema.names, "cell"])

    return asked.mapInArrow(run, T.StructType([*asked.schema.fields, T.StructField("cell", T.StringType())]))


def _by_cell(rows: DataFrame, cells: Cells, asked: DataFrame, threshold, cap: int) -> DataFrame:
    """Many queries: each goes to the cells it needs, and cells meet their queries in blocks."""
    spark = rows.sparkSession
    every = max(1, sum(map(len, cells.names.values())))
    share = _counted(spark, cells, asked, threshold).agg(F.avg(F.col("cells") / every)).first()[0]
    if share is None or share > DENSE:
        return knn(rows, asked, threshold, cap, strategy="blocks")
    sent = _sent(spark, cells, asked, threshold)

    def in_cell(df: DataFrame) -> DataFrame:
        return df.withColumn("tenant", F.concat_ws("/", "tenant", "cell"))

    return knn(in_cell(rows), in_cell(sent), threshold, cap, strategy="blocks")


def cells_read(spark: SparkSession, folder: str, queries: DataFrame, threshold: float | None = DISTANCE_THRESHOLD) -> DataFrame:
    """``query_id, cells, rows``: how many cells a search has to read for each query, and their rows."""
    counted = _counted(spark, Cells.read(spark, folder), queries, threshold)
    return counted.groupBy("query_id").agg(F.sum("cells").alias("cells"), F.sum("rows").alias("rows"))
