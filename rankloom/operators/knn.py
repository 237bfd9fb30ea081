"""Exact k-nearest-neighbour join between a table of queries and a corpus.

Every query meets every row of its tenant, but the pairs never exist as rows:
Arrow blocks are multiplied as matrices and each block emits at most the
neighbours that can still be in a query's top k. Two physical forms:

* few queries (checked by count and bytes): the query matrix is broadcast and
  corpus partitions are scanned in place, so the corpus is never shuffled;
* otherwise: corpus and queries are cut into bounded hash blocks per tenant and
  each (tenant, query block, corpus block) rectangle is one co-group, so a
  tenant holding a third of both tables spreads over many tasks. The number of
  blocks on either side follows from counted sizes, so that the fewest copies
  of rows travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.metadata import ContainmentCheck
from rankloom.functions.scores import DISTANCE_THRESHOLD, MAX_CANDIDATES
from rankloom.operators.blocks import BUFFER_ROWS, HITS, HITS_ARROW, TopBuffer, by_tenant, filters_of, passing
from rankloom.operators.scan import STATED_TENANTS, of_tenants
from rankloom.operators.topk import top_per_query

BROADCAST_QUERIES = 8192
BROADCAST_BYTES = 64 << 20
# The most queries and corpus rows of a rectangle, and the pairs it is meant to have.
QUERY_BLOCK = 16384
CORPUS_BLOCK = 65536
PAIRS = 1 << 28
# What a query's hits in a block of the corpus weigh, in copies of a row.
HITS_WEIGHT = 14
# Rows that a task's buffer may have.
_MOST_ROWS = 6_000_000
_TILE = 2048
# Distances are compared at this precision so that ties break by id everywhere.
DISTANCE_DIGITS = 12

def _vectors(column: pa.ChunkedArray | pa.Array, dim: int):
    """Row numbers and float64 matrix of the vectors that are ``dim`` wide."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ok = pc.fill_null(pc.equal(pc.list_value_length(array), dim), False)
    rows = np.flatnonzero(ok.to_numpy(zero_copy_only=False))
    flat = array.filter(ok).flatten()
    matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return rows, matrix


class _QuerySet:
    """The queries of one tenant that share a vector width."""

    def __init__(self, table: pa.Table, dim: int):
        rows, self.matrix = _vectors(table.column("vector"), dim)
        norms = np.linalg.norm(self.matrix, axis=1)
        usable = norms > 0
        self.matrix = self.matrix[usable] / norms[usable, None]
        rows = rows[usable]
        self.dim = dim
        self.ids = table.column("query_id").to_numpy()[rows]
        self.depth = table.column("candidates").to_numpy()[rows]
        filters = filters_of(table)
        self.filters = None if filters is None else filters[rows]


def _query_sets(table: pa.Table) -> dict:
    sets: dict = {}
    lengths = pc.list_value_length(table.column("vector"))
    tenants = table.column("tenant")
    for tenant in pc.unique(tenants).to_pylist():
        if tenant is None:
            continue
        mine = pc.equal(tenants, tenant)
        for dim in pc.unique(lengths.filter(mine)).to_pylist():
            if dim:
                chosen = table.filter(pc.and_(mine, pc.equal(lengths, dim)))
                found = _QuerySet(chosen, dim)
                if len(found.ids):
                    sets.setdefault(tenant, []).append(found)
    return sets


def _score(batch: pa.RecordBatch, queries: _QuerySet, buffer: TopBuffer, threshold, check):
    """Multiply one corpus block with one query set and buffer the survivors."""
    rows, matrix = _vectors(batch.column("embedding"), queries.dim)
    norms = np.linalg.norm(matrix, axis=1)
    rows, matrix = rows[norms > 0], matrix[norms > 0] / norms[norms > 0, None]
    ids = batch.column("id").to_numpy()
    slack = 10.0**-DISTANCE_DIGITS
    bound = np.inf if threshold is None else threshold
    for r in range(0, len(rows), _TILE):
        block = matrix[r : r + _TILE]
        for c in range(0, len(queries.ids), _TILE):
            raw = 1.0 - np.clip(block @ queries.matrix[c : c + _TILE].T, -1.0, 1.0)
            limit = np.minimum(bound, buffer.cutoff[c : c + _TILE])
            doc, query = np.nonzero(raw <= limit + slack)
            dist = np.round(raw[doc, query], DISTANCE_DIGITS)
            keep = dist < bound
            doc, query, dist = rows[r + doc[keep]], query[keep] + c, dist[keep]
            if queries.filters is not None and len(doc):
                held = passing(batch, doc, queries.filters[query], check)
                doc, query, dist = doc[held], query[held], dist[held]
            buffer.add(query, ids[doc], dist)


def _rows(queries: _QuerySet) -> int:
    """Rows of a buffer that keeps the queries' best hits to the end, within bounds."""
    return int(np.clip(3 * queries.depth.sum(), BUFFER_ROWS, _MOST_ROWS))


def _scan(batches: Iterator[pa.RecordBatch], sets: dict, threshold):
    check = ContainmentCheck()
    buffers = {t: [TopBuffer(q.ids, q.depth, _rows(q)) for q in found] for t, found in sets.items()}
    for batch in batches:
        for tenant, mine in by_tenant(batch, sets):
            for queries, buffer in zip(sets[tenant], buffers[tenant]):
                _score(mine, queries, buffer, threshold, check)
                if buffer.full():
                    yield from buffer.drain()
    for found in buffers.values():
        for buffer in found:
            yield from buffer.drain()


def _broadcast_scan(corpus: DataFrame, table: pa.Table, threshold) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(_query_sets(table))
    tenants = [t for t in pc.unique(table.column("tenant")).to_pylist() if t is not None]
    if 0 < len(tenants) <= STATED_TENANTS:
        corpus = of_tenants(corpus, tenants)

    def run(batches):
        yield from _scan(batches, shared.value, threshold)

    return corpus.mapInArrow(run, HITS)


def grid(
    corpus: DataFrame, queries: DataFrame, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK, pairs: int = PAIRS,
    hits: float = 0,
) -> DataFrame:
    """``tenant, _query_blocks, _corpus_blocks``: the rectangles in which a tenant's rows meet its queries.

    A corpus row is sent once for every block of queries and a query once for every block of
    the corpus. Of all grids with enough rectangles for the tenant's pairs, n rows and q
    queries travel least when blocks stand as rows to queries: sqrt(rectangles * q / n) blocks
    of queries. Every block of the corpus also returns a query's hits, which weigh as much as
    ``hits`` copies of a row. Both kinds of blocks stay within their bounds.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("tenant").agg(F.count(F.lit(1)).cast("double").alias(name))

    sizes = counted(queries, "_q").join(counted(corpus, "_n"), "tenant")
    rectangles = F.ceil(F.col("_q") * F.col("_n") / pairs)
    balanced = F.round(F.sqrt(rectangles * (1 + hits) * F.col("_q") / F.col("_n")))
    if hits:
        # One block of the corpus needs no more rectangles than its pairs.
        balanced = F.least(balanced, rectangles)
    sizes = sizes.withColumn("_query_blocks", F.greatest(F.ceil(F.col("_q") / query_block), balanced, F.lit(1)).cast("int"))
    needed = F.ceil(rectangles / F.col("_query_blocks"))
    sizes = sizes.withColumn("_corpus_blocks", F.greatest(F.ceil(F.col("_n") / corpus_block), needed, F.lit(1)).cast("int"))
    return sizes.select("tenant", "_query_blocks", "_corpus_blocks")


def _blocked_join(
    corpus: DataFrame, queries: DataFrame, threshold, query_block: int, corpus_block: int
) -> DataFrame:
    plan = grid(corpus, queries, query_block, corpus_block, hits=HITS_WEIGHT)
    # Salting both sides of the size lookup keeps a hot tenant spread out when
    # there are too many tenants for the lookup to be broadcast.
    salts = max(32, int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plan = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def placed(df: DataFrame, key: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
        # A second seed keeps the block independent of the salt.
        spread = F.pmod(F.xxhash64(F.lit("block"), F.col(key)), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return (
            salted.join(plan, ["tenant", "_salt"])
            .withColumn(mine, spread)
            .withColumn(theirs, every)
            .drop("_salt", "_query_blocks", "_corpus_blocks")
        )

    left = placed(corpus, "id", "_corpus_blocks", "_query_blocks", "_cb", "_qb")
    right = placed(queries, "query_id", "_query_blocks", "_corpus_blocks", "_qb", "_cb")
    keys = ["tenant", "_qb", "_cb"]

    def rectangle(docs: pa.Table, table: pa.Table) -> pa.Table:
        out = _scan(iter(docs.combine_chunks().to_batches()), _query_sets(table), threshold)
        return pa.Table.from_batches(list(out), schema=HITS_ARROW)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rectangle, HITS)


def knn(
    corpus: DataFrame,
    queries: DataFrame,
    threshold: float | None = DISTANCE_THRESHOLD,
    cap: int = MAX_CANDIDATES,
    strategy: str = "auto",
    query_block: int = QUERY_BLOCK,
    corpus_block: int = CORPUS_BLOCK,
    table: pa.Table | None = None,
) -> DataFrame:
    """``query_id, id, dist, vrank``: the nearest rows of each query's tenant.

    ``corpus`` needs ``tenant, id, embedding`` and, for filtered queries,
    ``filter_bits`` or ``metadata``; ``queries`` needs ``query_id, tenant,
    vector, candidates`` and ``filter_bit`` or ``filter``. Rows at or beyond
    ``threshold`` are dropped; cutting before or after the top k is the same
    because both follow one ordering. NULL and zero vectors have no distance.
    ``table`` holds the rows of ``queries`` if the caller already has them.
    """
    filters = {"filter_bit": "filter_bits", "filter": "metadata"}
    asked = [c for c in filters if c in queries.columns][:1]
    corpus = corpus.select("tenant", "id", "embedding", *[filters[c] for c in asked])
    # Rows without a vector stay in the JVM.
    corpus = corpus.where(F.col("embedding").isNotNull() & F.col("tenant").isNotNull())
    columns = ["query_id", "tenant", "vector", "candidates", *asked]
    queries = queries.select(*columns).where(
        F.col("vector").isNotNull() & F.col("tenant").isNotNull()
    )
    if strategy == "blocks":
        table = None
    elif table is None:
        head = queries.limit(BROADCAST_QUERIES + 1).toArrow()
        if head.num_rows <= BROADCAST_QUERIES and head.nbytes <= BROADCAST_BYTES:
            table = head
        elif strategy == "broadcast":
            raise ValueError("too many queries to broadcast")
    if table is not None:
        hits = _broadcast_scan(corpus, table.select(columns), threshold)
    else:
        hits = _blocked_join(corpus, queries, threshold, query_block, corpus_block)
    order = [F.col("cost"), F.col("id")]
    ranked = top_per_query(hits, order, "vrank", "candidates", cap)
    return ranked.select("query_id", "id", F.col("cost").alias("dist"), "vrank")
