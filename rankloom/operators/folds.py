"""Balances with all-or-nothing charges, when one user's events are spread over many tasks.

A run of events is a function from its opening to its closing balance. Below its charge an
event leaves a balance as it is, above it takes the charge off; so the function is made of
pieces of slope one. A task describes the run that continues an earlier task's user by these
pieces. The descriptions, a few rows for each task, are applied in order, which gives every
run its true opening; then all runs are replayed side by side.

While a run is described, balances are an axis of intervals from 0 up, each with the openings
that have come to it. A charge c lays the first c of the axis over what follows, so openings
meet and stay together; a grant moves the axis up. The work for an event is what lies below
its charge, not the number of pieces.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import durable

# Pieces of a description; a run that needs more is described by several in a row.
PIECES = 100_000
_END = 2**62


class Run:
    """The closing balance of some events as a function of the opening."""

    def __init__(self):
        # Intervals of balances: length, and where the intervals of openings begin that came there.
        self.axis: deque = deque([(_END, [0])])
        self.pieces = 1

    def _take(self, length: int) -> list:
        """Cut the first ``length`` off the axis."""
        out = []
        while length:
            size, openings = self.axis.popleft()
            if size > length:
                self.axis.appendleft((size - length, [x + length for x in openings]))
                self.pieces += len(openings)
                size = length
            out.append((size, openings))
            length -= size
        return out

    def add(self, delta: int) -> None:
        if delta >= 0:
            if delta:
                self.axis.appendleft((delta, []))
            return
        met = []
        for size, low in self._take(-delta):
            while size:
                part, high = self.axis.popleft()
                taken = min(part, size)
                if part > taken:
                    self.axis.appendleft((part - taken, [x + taken for x in high]))
                    self.pieces += len(high)
                here = low
                if size > taken:
                    low = [x + taken for x in low]
                    self.pieces += len(low)
                if len(here) > len(high):
                    here, high = high, here
                met.append((taken, high + here if len(here) else high))
                size -= taken
        self.axis.extendleft(reversed(met))

    def described(self) -> tuple[list[int], list[int]]:
        """Where the pieces begin, and what each adds to the opening."""
        begins, shifts, at = [], [], 0
        for size, openings in self.axis:
            begins += openings
            shifts += [at - x for x in openings]
            at += size
        order = np.argsort(np.array(begins, np.int64), kind="stable")
        begins, shifts = np.array(begins, np.int64)[order], np.array(shifts, np.int64)[order]
        new = np.r_[True, shifts[1:] != shifts[:-1]]
        return begins[new].tolist(), shifts[new].tolist()


def closing(opening: int, begins, shifts) -> int:
    """The closing balance of a described run."""
    return int(opening + shifts[np.searchsorted(begins, opening, side="right") - 1])


def _described(pieces: int):
    """One task's rows: descriptions of the run of its first user, or the closing balance of its last."""
    def run(batches):
        chunk, first, user, balance, now, number, out = TaskContext.get().partitionId(), None, None, 0, Run(), 0, []

        def describe():
            begins, shifts = now.described()
            return (chunk, first, number, None, begins, shifts)

        for batch in batches:
            for u, delta, opening in zip(batch["user_id"].tolist(), batch["delta"].tolist(), batch["opening"].tolist()):
                if first is None:
                    first = user = u
                elif u != user:
                    user, balance = u, opening
                if user == first:
                    now.add(delta)
                    if now.pieces >= pieces:
                        out.append(describe())
                        now, number = Run(), number + 1
                elif delta >= 0 or balance + delta >= 0:
                    balance += delta
        if first is not None:
            out.append(describe())
            if user != first:
                out.append((chunk, user, 0, balance, None, None))
        yield pd.DataFrame(out, columns=["chunk", "user_id", "number", "balance", "begins", "shifts"])
    return run


def _opened(batches):
    """The opening of every run that continues an earlier one, from the descriptions in order."""
    user, balance, chunk = None, 0, None
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.user_id != user:
                user, balance, chunk = r.user_id, r.opening, None
            if r.chunk != chunk:
                chunk = r.chunk
                out.append((chunk, user, balance))
            balance = int(r.balance) if r.begins is None else closing(balance, r.begins, r.shifts)
        yield pd.DataFrame(out, columns=["chunk", "user_id", "opened"])


def _replayed(batches):
    user, balance = None, 0
    for batch in batches:
        balances, denials = [], []
        for u, delta, opening in zip(batch["user_id"].tolist(), batch["delta"].tolist(), batch["opening"].tolist()):
            if u != user:
                user, balance = u, opening
            denied = delta < 0 and balance + delta < 0
            balance = balance if denied else balance + delta
            balances.append(balance)
            denials.append(denied)
        out = batch.drop(columns="opening")
        out["balance"], out["denied"] = balances, denials
        yield out


def denied_ledger(events: DataFrame, order: list[str], chunks: int, pieces: int = PIECES) -> DataFrame:
    """``user_id``, the columns of ``order``, ``delta, balance, denied`` of events with an ``opening`` that is not negative.

    Events are ranged by user and order into ``chunks`` tasks, however many a user has.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    user, carried = f"user_id {kinds['user_id']}", ["user_id", *order, "delta"]
    ranged = durable(
        events.select(*carried, "opening").repartitionByRange(chunks, "user_id", *order)
        .withColumn("chunk", F.spark_partition_id()))
    runs = ranged.sortWithinPartitions("user_id", *order).select("user_id", "delta", "opening").mapInPandas(
        _described(pieces), f"chunk int, {user}, number int, balance long, begins array<long>, shifts array<long>")
    # A user who starts in a task has the same opening in each row; the descriptions are a few rows for each task.
    openings = ranged.groupBy("user_id").agg(F.first("opening").alias("opening"))
    runs = runs.join(openings, "user_id").repartition("user_id").sortWithinPartitions("user_id", "chunk", "number")
    opened = durable(runs.mapInPandas(_opened, f"chunk int, {user}, opened long"))
    # At most two runs of a task are described, so this has a bound by the tasks.
    known = ranged.join(
        F.broadcast(opened.select("chunk", "user_id", "opened")), ["chunk", "user_id"], "left")
    known = known.withColumn("opening", F.coalesce("opened", "opening")).select(*carried, "opening")
    known = known.sortWithinPartitions("user_id", *order)
    schema = ", ".join(f"{n} {kinds[n]}" for n in carried)
    return known.mapInPandas(_replayed, f"{schema}, balance bigint, denied boolean")
