"""What block kernels share: bounded per-task top-k buffers and scan inputs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BUFFER_ROWS = 1_000_000
# Rows from which a buffer that has doubled is cut again, so that its cut-offs follow.
TIGHTEN_ROWS = 1 << 15
# Hits that are sorted at a time, about.
SORTED_ROWS = 1 << 19

HITS = "query_id bigint, id bigint, cost double, candidates bigint"
HITS_ARROW = pa.schema(
    [
        ("query_id", pa.int64()),
        ("id", pa.int64()),
        ("cost", pa.float64()),
        ("candidates", pa.int64()),
    ]
)


class TopBuffer:
    """Hits of one task, cut to each query's current best when they grow.

    Lower cost is better, ties go to the lower id. ``cutoff`` is a cost no
    further hit of the query may exceed, because enough better ones were seen.
    """

    def __init__(self, ids: np.ndarray, depth: np.ndarray, rows: int = BUFFER_ROWS):
        self.ids, self.depth, self.rows = ids, depth, rows
        self.cutoff = np.full(len(ids), np.inf)
        self.parts: list = []
        self.size = self.kept = 0

    def add(self, query: np.ndarray, ids: np.ndarray, cost: np.ndarray):
        keep = cost <= self.cutoff[query]
        self.parts.append((query[keep], ids[keep], cost[keep]))
        self.size += int(keep.sum())
        if self.size > self.rows:
            self.compact()

    def compact(self):
        """Keep each query's best; queries are sorted some at a time, which needs little besides the hits."""
        step = max(1, -(-len(self.ids) // (1 + self.size // SORTED_ROWS)))
        kept = [self._best(first, min(first + step, len(self.ids))) for first in range(0, len(self.ids), step)] if self.parts else []
        self.parts = [part for part in kept if len(part[0])]
        self.size = self.kept = sum(len(part[0]) for part in self.parts)

    def _best(self, first: int, end: int) -> tuple:
        """The best hits of the queries ``first .. end``, which set their cut-offs."""
        own = self.parts
        if end - first < len(self.ids):
            inside = [(query >= first) & (query < end) for query, _, _ in own]
            own = [tuple(x[held] for x in part) for part, held in zip(own, inside)]
        query, ids, cost = (np.concatenate(x) for x in zip(*own))
        order = np.lexsort((ids, cost, query))
        query, ids, cost = query[order], ids[order], cost[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else query
        counts = np.diff(np.r_[starts, len(query)])
        place = np.arange(len(query)) - np.repeat(starts, counts)
        last = place == self.depth[query] - 1
        self.cutoff[query[last]] = np.minimum(self.cutoff[query[last]], cost[last])
        keep = place < self.depth[query]
        return query[keep], ids[keep], cost[keep]

    def tighten(self):
        """Cut what was added to the current best, once it is as much again."""
        if self.size > max(2 * self.kept, TIGHTEN_ROWS):
            self.compact()

    def full(self) -> bool:
        """Still large after compaction: hand over, the cut-offs stay."""
        if self.size > self.rows // 2:
            self.compact()
        return self.size > self.rows // 2

    def drain(self):
        self.compact()
        for query, ids, cost in self.parts:
            columns = [self.ids[query], ids, cost, self.depth[query]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=HITS_ARROW)
        self.parts, self.size, self.kept = [], 0, 0


def by_tenant(batch: pa.RecordBatch, wanted):
    """Split a batch into (tenant, rows) for the tenants that have queries."""
    tenants = batch.column("tenant").dictionary_encode()
    names = tenants.dictionary.to_pylist()
    codes = tenants.indices.to_numpy(zero_copy_only=False)
    for code, name in enumerate(names):
        if name in wanted:
            whole = len(names) == 1 and tenants.null_count == 0
            yield name, batch if whole else batch.take(pa.array(np.flatnonzero(codes == code)))


def passing(batch: pa.RecordBatch, doc: np.ndarray, wanted: np.ndarray, check) -> np.ndarray:
    """Which (document, filter) candidates hold, by bit set or by containment."""
    if "filter_bits" in batch.schema.names:
        bits = batch.column("filter_bits").to_numpy()
        return (wanted < 0) | ((bits[doc] >> np.maximum(wanted, 0)) & 1 == 1)
    metadata = batch.column("metadata")
    held = (w is None or check(metadata[int(d)].as_py(), w) for d, w in zip(doc, wanted))
    return np.fromiter(held, dtype=bool, count=len(doc))


def filters_of(table: pa.Table) -> np.ndarray | None:
    if "filter_bit" in table.column_names:
        return table.column("filter_bit").to_numpy()
    if "filter" in table.column_names:
        return np.array(table.column("filter").to_pylist(), dtype=object)
    return None
