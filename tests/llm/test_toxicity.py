from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from rankloom.llm.toxicity import Machine, drop_toxic, fit, terms, toxicity
from tests.llm.samples import SCHEMA, no_documents, odd_documents

LABELS = "doc_id long, quality int, toxic int"


def sample(spark, n=600, start=10_000):
    """Toxic are texts where an insult stands with a group; either alone is clean."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(start, start + n):
        words = [f"word{rng.randrange(300)}" for _ in range(rng.randint(5, 40))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["vermin"] * insult + ["neighbours"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 1, None, None))
        labels.append((i, 1, int(insult and group)))
    return rows, labels


def test_pairs_are_learned_that_sums_miss(spark):
    rows, labels = sample(spark)
    sets, y = [terms(r[1], 14) for r in rows], np.array([r[2] for r in labels], np.float32)
    paired, summed = fit(sets[:400], y[:400], 14), fit(sets[:400], y[:400], 14, k=1, epochs=0)
    def share(m):
        return np.mean([(m.score(s) >= 0.5) == t for s, t in zip(sets[400:], y[400:])])
    assert share(paired) > 0.95 > share(summed)


def test_pairs_of_terms_that_tell_nothing_alone():
    """Label 1 where both or neither of two terms stand: each alone leaves the odds as they are."""
    rng = random.Random(8)
    sets, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        sets.append(np.unique([*[1] * a, *[2] * b, *(rng.randrange(3, 60) for _ in range(8))]))
        y.append(float(a == b))
    y = np.array(y, np.float32)
    made = fit(sets[:1000], y[:1000], 8)
    assert np.mean([(made.score(s) >= 0.5) == t for s, t in zip(sets[1000:], y[1000:])]) > 0.9
    one, other = made.factors[np.searchsorted(made.ids, [1, 2])]
    assert one @ other > 0.5


def test_score_is_the_plain_sum_over_pairs():
    rng = np.random.default_rng(4)
    made = Machine(0.3, np.arange(0, 64, 2), rng.normal(size=32).astype(np.float32), rng.normal(size=(32, 4)).astype(np.float32) / 3)
    for size in (0, 1, 2, 9):
        ids = rng.choice(32, size, replace=False)
        logit = made.bias + sum(float(made.weights[i]) for i in ids)
        logit += sum(float(made.factors[i] @ made.factors[j]) for i, j in itertools.combinations(ids, 2))
        # Odd terms are not known.
        assert made.score(np.sort(np.r_[2 * ids, 2 * ids + 1])) == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)


def test_held_out_rows_teach_nothing(spark):
    rows, labels = sample(spark)
    docs = odd_documents(spark, rows)
    lies = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
    got, lied = (
        {r.doc_id: (r.held_out, r.score, r.predicted) for r in toxicity(docs, spark.createDataFrame(x, LABELS)).collect()}
        for x in (labels, lies))
    assert got == lied
    right = [got[i][2] == t for i, _, t in labels if got[i][0]]
    assert len(right) > 80 and np.mean(right) > 0.95
    assert all(got[i][0] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in labels)
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in got.values())


def test_odd_rows_and_labels(spark):
    rows, labels = sample(spark, 200)
    docs = odd_documents(spark, rows)
    known = spark.createDataFrame([*labels, (None, 1, 1), (1, 1, None), (999_999, 0, 1), labels[0]], LABELS)
    got = toxicity(docs, known, train_rows=150).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r.doc_id for r in docs.collect()), key=str)
    blank = {r.score for r in got if r.doc_id in (3, 4, 5)}
    assert len(blank) == 1
    assert toxicity(no_documents(spark), known).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    docs, none = odd_documents(spark), spark.createDataFrame([], LABELS)
    assert {r.predicted for r in toxicity(docs, none).collect()} == {0}
    left = drop_toxic(docs, none)
    assert left.columns == docs.columns and left.count() == docs.count()


def test_given_labels_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97
    assert sum(r.predicted for r in got if r.toxic == 0) <= 2


@pytest.mark.parametrize("labels", [[], [1.0, 1.0]])
def test_fit_without_both_labels(labels):
    made = fit([np.array([1, 2])] * len(labels), np.array(labels, np.float32), 8)
    assert made.weights.any() == False and np.isfinite(made.bias)  # noqa: E712
