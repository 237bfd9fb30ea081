from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from rankloom.llm.negatives import Buckets, hard_negatives, retrieve

SCHEMA = "vec_id long, embedding array<float>, label int, slot int, anchor_id string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=100, first=5, low=80, high=100):
    """Hard negatives by comparing every anchor with every row."""
    sound = {
        (i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label, *_ in rows
        if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, label, v in sound:
        if i % every:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in sound if len(w) == len(v))
        for p, j, _ in [x for x in scored if x[2] == label and x[1] != i][:first]:
            near = [(n, k) for n, k, other in scored if other != label and low * -p <= 100 * -n <= high * -p]
            out += [(i, j, rank, k, -p, -n) for rank, (n, k) in enumerate(near[:first], 1)]
    return sorted(out)


def made(rng, n, dim=6, spread=1.0):
    """Clustered vectors of single precision with many ties."""
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for i in range(n):
        v = [float(np.float32(round(c * rng.choice([0.5, 1, 1, 2]) + rng.gauss(0, spread), 2))) for c in rng.choice(centres)]
        rows.append((i, v, rng.randrange(3), i, str(i)))
    return rows


def answer(df, **options):
    return sorted(tuple(r[c] for c in COLUMNS) for r in hard_negatives(df, **options).collect())


def test_equals_brute_force(spark):
    rng = random.Random(3)
    for n, spread, every in ((900, 0.4, 50), (700, 1.5, 20)):
        rows = made(rng, n, spread=spread)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        want = brute(rows, every)
        assert want and answer(df, every=every, block=64, anchors=16) == want
        assert answer(df, every=every) == want


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = made(rng, 200)
    one = [float(np.float32(x)) for x in (0.5, -0.25, 0.75, 0.1, 0.2, 0.3)]
    rows += [(200 + i, one, i % 3, None, None) for i in range(150)]  # one vector for very many rows
    rows += [rows[7], rows[0], rows[0]]  # repeated rows, an anchor among them
    rows += [(0, one, 1, None, None)]  # an anchor's id with another vector
    rows += [(1000, None, 1, 1, "x"), (1001, [], 1, 1, "x"), (1100, one, None, 1, "x"), (None, one, 1, 1, "x"),
             (1200, [0.1, None, 1.0, 1.0, 1.0, 1.0], 1, 1, "x"), (1300, [float("nan")] + one[1:], 1, 1, "x"),
             (1400, [float("inf")] + one[1:], 1, 1, "x"), (1500, [0.0] * 6, 2, 1, "x"), (1600, one[:3], 1, 1, "x"),
             (1601, one[:3], 1, 1, "x"), (1602, [x * 0.9 for x in one[:3]], 2, 1, "x"), (1700, [-x for x in one], 0, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([(i, v and [None if x is None else float(np.float32(x)) for x in v], label, 0, 0) for i, v, label, *_ in rows])
    assert answer(df) == want and {r[0] for r in want} >= {0, 100, 200, 300, 1600}
    assert answer(df, block=16, anchors=2) == want


def test_no_rows_and_no_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(empty).columns == COLUMNS and answer(empty) == []
    assert answer(spark.createDataFrame([(1, [1.0], 1, 1, "x"), (2, [1.0], 2, 1, "x")], SCHEMA)) == []


def test_lists_prune_and_lose_nothing():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8))
    matrix = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 8))))
    buckets = Buckets(np.arange(4000), np.zeros(4000, np.int64), matrix, 500)
    anchors, seen = matrix[:30], []
    scores = anchors @ buckets.matrix.T
    floors = np.sort(scores, axis=1)[:, -20]

    def take(a, rows, own):
        assert np.array_equal(own, buckets.matrix[rows] @ anchors[a])
        seen.extend((a, int(r)) for r in rows)

    retrieve(buckets, anchors, lambda a: floors[a], take)
    wanted = {(a, r) for a, r in zip(*np.nonzero(scores >= floors[:, None]))}
    assert wanted <= set(seen) and len(seen) < 0.35 * scores.size


def test_query_adds_noise_to_labels(spark):
    from rankloom.llm import registered

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    noisy = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in rows]
    got = registered.queries()["op11_hard_negatives"](spark, d)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute(noisy)
    assert dict(got.dtypes) == {c: "int" if c == "rank" else "bigint" for c in COLUMNS}
