"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms: its lower-cased words, and the first letters of
the longer ones, so that inflected and compound forms share what they start with. The
machine scores a set x as  b + sum w_i + sum over pairs <v_i, v_j> : beside the weight of
each term it learns, through the vectors v, that two terms count together.

It is fitted by one task on a sample of labelled rows of bounded size (``train_rows``);
the model holds the hashed terms that count, at most 2^bits, and is broadcast for scoring.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import run_folder, stored, whole_text

BITS = 20
FACTORS = 4
# The most labelled rows that a model is fitted on.
TRAIN_ROWS = 16_000
FOLDS, HELD_OUT = 5, 0
_WORD = re.compile(r"[^\W\d_]+")
# A word longer than that also counts by its first so many letters.
_STEMS = (4, 5, 6, 7)


def terms(text: str | None, bits: int = BITS) -> np.ndarray:
    """The distinct hashed terms of a text, sorted."""
    words = set(_WORD.findall((text or "").lower()))
    stems = {w[:n] for n in _STEMS for w in words if len(w) > n}
    hashed = {zlib.crc32(w.encode()) for w in words} | {zlib.crc32(b"^" + s.encode()) for s in stems}
    made = np.fromiter(hashed, np.int64, len(hashed)) & (1 << bits) - 1
    return np.unique(made.astype(np.int32))


@dataclass
class Machine:
    bias: float
    ids: np.ndarray  # the hashed terms that count, sorted
    weights: np.ndarray  # one for each
    factors: np.ndarray  # and one row

    def score(self, found: np.ndarray) -> float:
        place = np.searchsorted(self.ids, found)
        inside = place < len(self.ids)
        at = place[inside]
        at = at[self.ids[at] == found[inside]]
        v = self.factors[at]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)).sum())
        logit = self.bias + float(self.weights[at].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(logit, -35, 35))))


def fit(
    sets: list[np.ndarray], labels: np.ndarray, bits: int = BITS, k: int = FACTORS, epochs: int = 12,
    rate: float = 0.1, decay: float = 1e-4, least: float = 3.0, common: float = 0.1, pair_decay: float = 0.3,
    seed: int = 7, batch: int = 64,
) -> Machine:
    """Fit by mini-batches with Adagrad.

    A term whose log odds differ between the labels by fewer than ``least`` standard errors
    keeps weight 0: most terms are rare, and would only be learnt by heart. Such a term still
    has factors if it stands in at least the share ``common`` of the rows, as it may matter in
    pairs alone; they decay by ``pair_decay``, so that pairs without a meaning fade. Without
    both labels the machine has its bias only, the smoothed log odds of label 1.
    """
    n, size = len(sets), 1 << bits
    share = (float(labels.sum()) + 0.5) / (n + 2)
    bias = float(np.log(share / (1 - share)))
    if n == 0 or labels.min() == labels.max():
        return Machine(bias, np.empty(0, np.int32), np.empty(0, np.float32), np.empty((0, k), np.float32))
    rng = np.random.default_rng(seed)
    weighted = np.abs(_log_odds(sets, labels, size)) >= least
    used = weighted | (np.bincount(np.concatenate(sets), minlength=size) >= common * n)
    # Only the terms that count are kept, by their numbers.
    kept, number = np.flatnonzero(used).astype(np.int32), np.cumsum(used, dtype=np.int32) - 1
    sets, weighted = [number[s[used[s]]] for s in sets], weighted[kept]
    fade = np.where(weighted, decay, pair_decay).astype(np.float32)[:, None]
    w, v = np.zeros(len(kept), np.float32), rng.normal(0, 0.02, (len(kept), k)).astype(np.float32)
    gw, gv, gb = np.full(len(kept), 1e-2, np.float32), np.full((len(kept), k), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            rows = [r for r in order[i:i + batch] if len(sets[r])]
            if not rows:
                continue
            sizes = np.array([len(sets[r]) for r in rows])
            ids, at = np.concatenate([sets[r] for r in rows]), np.repeat(np.arange(len(rows)), sizes)
            cuts = np.cumsum(sizes) - sizes
            own = v[ids]
            total = np.add.reduceat(own, cuts)
            pairs = 0.5 * (total**2 - np.add.reduceat(own * own, cuts)).sum(1)
            logit = bias + np.add.reduceat(w[ids], cuts) + pairs
            slope = (1 / (1 + np.exp(-np.clip(logit, -35, 35))) - labels[rows]).astype(np.float32)
            # One sum per term of the batch.
            by = np.argsort(ids, kind="stable")
            uniq, first = np.unique(ids[by], return_index=True)
            grad_v = np.add.reduceat((slope[at][:, None] * (total[at] - own))[by], first) + fade[uniq] * v[uniq]
            grad_w = (np.add.reduceat(slope[at][by], first) + decay * w[uniq]) * weighted[uniq]
            gw[uniq] += grad_w**2
            gv[uniq] += grad_v**2
            w[uniq] -= rate * grad_w / np.sqrt(gw[uniq])
            v[uniq] -= rate * 0.5 * grad_v / np.sqrt(gv[uniq])
            gb += float(slope.sum()) ** 2
            bias -= rate * float(slope.sum()) / gb**0.5
    return Machine(float(bias), kept, w, v)


def _log_odds(sets, labels, size):
    """Difference of each term's log odds between the labels, in standard errors."""
    counts = []
    for label in (1, 0):
        own = [s for s, y in zip(sets, labels) if y == label]
        has = np.bincount(np.concatenate(own), minlength=size) + 0.5
        counts.append((has, len(own) + 1 - has))
    (a, b), (c, d) = counts
    return (np.log(a / b) - np.log(c / d)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    train_rows: int = TRAIN_ROWS, bits: int = BITS, k: int = FACTORS, seed: int = 7, **options,
) -> Machine:
    """Fit a machine on at most ``train_rows`` labelled rows that are not held out.

    The rows are the first in the order of a seeded hash. Of an id with several labels the
    largest counts; null ids and labels are left out.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    usable = usable.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = docs.select(F.col(id_col).alias("doc_id")).distinct()
    chosen = usable.join(known, "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(train_rows)
    folder = run_folder(docs.sparkSession, "toxicity")
    chosen = stored(chosen, f"{folder}/chosen")
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    # At most train_rows pairs of numbers are broadcast.
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def encode(batches):
        for batch in batches:
            sets = [terms(t, bits) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int32()))], names=["doc_id", "label", "terms"])

    def learn(batches):
        seen = {}
        for batch in batches:
            # Slices of the batch, not lists of numbers, which a worker would keep its memory for.
            values, ends = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
            for i, (doc_id, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if doc_id not in seen:
                    seen[doc_id] = (label, values[ends[i]:ends[i + 1]].copy())
        sets = [seen[i] for i in sorted(seen)]
        made = fit([s for _, s in sets], np.array([y for y, _ in sets], np.float32), bits, k, seed=seed, **options)
        yield pa.RecordBatch.from_pydict({
            "bias": [made.bias], "ids": [made.ids.tobytes()], "weights": [made.weights.tobytes()], "factors": [made.factors.tobytes()]})

    encoded = stored(rows.mapInArrow(encode, "doc_id long, label int, terms array<int>"), f"{folder}/terms")
    made = encoded.repartition(1).mapInArrow(
        learn, "bias double, ids binary, weights binary, factors binary").collect()[0]
    return Machine(
        made.bias, np.frombuffer(bytes(made.ids), np.int32), np.frombuffer(bytes(made.weights), np.float32),
        np.frombuffer(bytes(made.factors), np.float32).reshape(-1, k))


def with_scores(docs: DataFrame, machine: Machine, text_col: str = "text", name: str = "score", bits: int = BITS) -> DataFrame:
    """``docs`` with a column ``name``: the probability of label 1 of every whole text.

    Null and empty texts have no terms and score as the bias. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series([shared.value.score(terms(t, bits)) for t in texts], dtype="float64")

    return docs.withColumn(name, scored(whole_text(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Score every row: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Rows that repeat are all returned; a null id is not held out; no rows give no rows;
    without labels every score is the same, below 0.5. Other columns are never inputs.
    """
    machine = train(docs, labels, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_scores(rows, machine, bits=options.get("bits", BITS))
    return scored.select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    machine = train(docs, labels, id_col, text_col, **options)
    scored = with_scores(docs, machine, text_col, "_toxicity", options.get("bits", BITS))
    return scored.where(F.col("_toxicity") < 0.5).drop("_toxicity")
