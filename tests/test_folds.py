from __future__ import annotations

import datetime as dt
import random

import pytest

from rankloom.operators.folds import Run, closing
from rankloom.plans.ledger import any_cost_ledger, closing_balances


def plain(opening, deltas):
    out, balance = [], opening
    for d in deltas:
        denied = d < 0 and balance + d < 0
        balance = balance if denied else balance + d
        out.append((balance, denied))
    return out


@pytest.mark.parametrize("big", [1, 1000, 10**12])
def test_described_runs_equal_plain_folds(big):
    rng = random.Random(7)
    for _ in range(150):
        deltas = [rng.choice([1, -1, -2, -3, -7, 5, 0]) * rng.randint(1, big) for _ in range(rng.randint(0, 40))]
        run = Run()
        for d in deltas:
            run.add(d)
        begins, shifts = run.described()
        assert begins[0] == 0 and begins == sorted(begins)
        openings = [*range(40), *begins, *(b - 1 for b in begins[1:]), 50 * big, rng.randint(0, 30 * big)]
        for x in openings:
            assert closing(x, begins, shifts) == (plain(x, deltas) or [(x, False)])[-1][0]


def test_halving_charges_have_as_many_pieces_as_openings():
    run = Run()
    for k in range(8, -1, -1):
        run.add(-(2**k))
    begins, shifts = run.described()
    assert [closing(x, begins, shifts) for x in range(600)] == [plain(x, [-(2**k) for k in range(8, -1, -1)])[-1][0] for x in range(600)]


EVENTS = "user_id int, event_id long, ts timestamp, delta long, opening long"


def test_a_user_in_many_chunks(spark, monkeypatch):
    from rankloom.operators import folds

    rng = random.Random(9)
    users = {u: [rng.choice([4, -1, -2, -3, -5]) for _ in range(n)] for u, n in ((1, 600), (2, 3), (3, 0), (4, 250), (5, 1))}
    users[6] = [9] * 20  # never denied
    start = dt.datetime(2024, 1, 1)
    rows = [
        (u, 1000 * u + i, start + dt.timedelta(minutes=i // 3), d, u % 4) for u, deltas in users.items() for i, d in enumerate(deltas)]
    want = {(u, 1000 * u + i): r for u, deltas in users.items() for i, r in enumerate(plain(u % 4, deltas))}
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, EVENTS)
    for chunks in (1, 7, 40):
        got = any_cost_ledger(events, chunks=chunks)
        assert {(r.user_id, r.event_id): (r.balance, r.denied) for r in got.collect()} == want
    # Descriptions of a few pieces follow one another.
    made = folds.denied_ledger(events.where("user_id < 6"), ["ts", "event_id"], 12, pieces=5)
    assert {(r.user_id, r.event_id): (r.balance, r.denied) for r in made.collect()} == {k: v for k, v in want.items() if k[0] < 6}
    assert {r.user_id: r.balance for r in closing_balances(got).collect()}[1] == want[1, 1599][0]
    assert any_cost_ledger(events.where("user_id > 9")).count() == 0
