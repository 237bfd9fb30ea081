from __future__ import annotations

import json
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rankloom.operators.running import running
from rankloom.plans import latency, ledger, moderation, payments, tenants, usage, verification

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def ledger_rows():
    rng = random.Random(5)
    rows = []
    for i in range(900):
        user = 1 if i % 3 else rng.randint(2, 6)  # one user holds two thirds
        rows.append((user, i, at(rng.randint(0, 300)), rng.choice([-1, -1, -1, 0, 2, 3]), user % 3))
    return rows


LEDGER = "user_id int, event_id long, ts timestamp_ntz, delta long, opening long"


def fold(rows):
    balances, out = {}, {}
    for user, event, ts, delta, opening in sorted(rows, key=lambda r: (r[2], r[1])):
        balance = balances.get(user, opening)
        denied = delta < 0 and balance + delta < 0
        balance = balance if denied else balance + delta
        balances[user] = balance
        out[event] = (balance, denied)
    return out


@pytest.mark.parametrize("options", [{}, {"group_rows": 50, "chunks": 7}])
def test_unit_ledger_equals_sequential_fold(spark, ledger_rows, options):
    events = spark.createDataFrame(ledger_rows, LEDGER)
    got = ledger.unit_ledger(events, **options).collect()
    assert {r.event_id: (r.balance, r.denied) for r in got} == fold(ledger_rows)


def test_any_cost_ledger_equals_sequential_fold(spark, ledger_rows):
    rows = [(u, e, t, d * (1 + e % 3) if d < 0 else d, o) for u, e, t, d, o in ledger_rows]
    got = ledger.any_cost_ledger(spark.createDataFrame(rows, LEDGER)).collect()
    assert {r.event_id: (r.balance, r.denied) for r in got} == fold(rows)


def test_negative_opening_is_an_error(spark):
    with pytest.raises(Exception, match="opening balance"):
        ledger.unit_ledger(spark.createDataFrame([(1, 1, START, -1, -5)], LEDGER)).collect()


@pytest.mark.parametrize("exclude", [True, False])
def test_running_in_chunks_equals_windows(spark, exclude):
    rng = random.Random(2)
    rows = [(None if i % 5 == 0 else i % 2, i, rng.choice([None, *range(-9, 9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    columns = {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}
    plain = running(df, ["k"], ["o"], columns, exclude)
    chunked = running(df, ["k"], ["o"], columns, exclude, group_rows=10, chunks=6)
    assert sorted(map(str, plain.collect())) == sorted(map(str, chunked.collect()))


def event(kind="transaction.completed", **changes):
    data = {
        "id": "t1", "customer_id": "c1", "status": "completed", "billed_at": "2024-01-02T03:04:05Z",
        "invoice_id": "i", "invoice_number": None, "custom_data": {"user_email": "a@x", "user_id": 1},
        "items": [{"price": {"id": "p", "name": "n", "description": "d", "custom_data": {"credits": "10"},
                             "unit_price": {"amount": "500"}}}],
        "payments": [{"method_details": {"type": "card"}}],
    }
    data.update(changes)
    return json.dumps({"event_type": kind, "data": data})


def settle(spark, payloads, **options):
    users = spark.createDataFrame([(1, "a@x", 5), (2, "b@x", 0)], "id int, email string, credits int")
    raw = spark.createDataFrame(list(enumerate(payloads)), "event_id long, payload string")
    return payments.settle(raw, users, **options), users


def outcomes(settled):
    return settled.accepted.unionByName(settled.rejected).collect()


def test_payment_events_are_validated(spark):
    bad_price = json.loads(event())["data"]["items"]
    bad_price[0]["price"]["custom_data"]["credits"] = "many"
    payloads = [
        event(), event(id="t2", items=[]), event(id="t3", payments=[]), event(id="t4", items=bad_price),
        event(id="t5", billed_at="yesterday"), event(id="t6", custom_data={"user_email": "a@x", "user_id": 1 << 40}),
        event(id="t7", custom_data={"user_email": "a@x", "user_id": 77}), event(id="t8", billed_at=None),
        event("subscription.updated", id="t9"), event(), "{broken",
    ]
    settled, users = settle(spark, payloads)
    assert {r.event_id: r.reject_reason for r in outcomes(settled)} == {
        0: None, 1: "MissingField", 2: "MissingPayment", 3: "InvalidCredits", 4: "InvalidBilledAt",
        5: "InvalidUserId", 6: "UnknownUser", 7: None, 9: "DuplicateTransaction",
    }
    grants = payments.credit_grants(settled)
    assert [(r.user_id, r.granted) for r in grants.collect()] == [(1, 20)]
    assert {r.id: r.credits for r in payments.grant_credits(users, grants).collect()} == {1: 25, 2: 0}


def test_failure_first_hides_the_completion_unless_asked(spark):
    payloads = [event("transaction.payment_failed"), event()]
    settled, _ = settle(spark, payloads)
    assert payments.credit_grants(settled).count() == 0
    settled, _ = settle(spark, payloads, policy="completed_wins")
    assert payments.credit_grants(settled).first().granted == 10


def test_rejected_events_do_not_claim_an_id(spark):
    settled, _ = settle(spark, [event(items=[]), event()])
    assert {r.event_id: r.reject_reason for r in outcomes(settled)} == {0: "MissingField", 1: None}
    stored = spark.createDataFrame([("t1",)], "transaction_id string")
    settled, _ = settle(spark, [event()], transactions=stored)
    assert [r.reject_reason for r in outcomes(settled)] == ["DuplicateTransaction"]


def test_usage_first_event_counts_one(spark):
    rows = [(1, 7, at(0), 3), (2, 7, at(1), 2), (3, 7, at(1440), 5), (4, 8, at(2), 1)]
    events = spark.createDataFrame(rows, "event_id long, user_id int, ts timestamp_ntz, count long")
    day = lambda df: {(r.user_id, str(r.usage_date)): r.credits_used for r in df.collect()}
    assert day(usage.usage_daily(events)) == {(7, "2024-01-01"): 3, (7, "2024-01-02"): 1, (8, "2024-01-01"): 1}
    assert day(usage.usage_daily(events, exact=True))[7, "2024-01-01"] == 5
    existing = spark.createDataFrame([(7, START.date(), 10), (9, START.date(), 4)], "user_id int, usage_date date, credits_used long")
    upserted = usage.usage_daily(events, existing)
    assert day(upserted) == {
        (7, "2024-01-01"): 15, (7, "2024-01-02"): 1, (8, "2024-01-01"): 1, (9, "2024-01-01"): 4
    }
    assert day(usage.usage_retained(upserted, "2024-01-09")) == {(7, "2024-01-02"): 1}


@pytest.mark.parametrize("options", [{}, {"group_rows": 2, "chunks": 3}])
def test_codes_are_used_once_and_expire(spark, options):
    codes = spark.createDataFrame(
        [(1, "a", 1, at(0)), (2, "a", 1, at(30)), (3, "b", 2, at(0))],
        "code_id long, email string, code short, issued_at timestamp_ntz")
    attempts = spark.createDataFrame(
        [(1, "a", 1, at(2)), (2, "a", 1, at(3)), (3, "a", 1, at(36)), (4, "a", 1, at(37)), (5, "b", 2, at(5)),
         (6, "b", 9, at(1))],
        "attempt_id long, email string, code short, attempted_at timestamp_ntz")
    got = verification.verification_outcomes(codes, attempts, **options).collect()
    assert {r.attempt_id: r.outcome for r in got} == {
        1: "ok", 2: "InvalidCode", 3: "CodeExpired", 4: "InvalidCode", 5: "ok", 6: "InvalidCode"
    }
    assert verification.remaining_codes(codes, attempts).count() == 0
    assert verification.issue(codes).where("expiry > issued_at + INTERVAL 4 MINUTES").count() == 3


def test_moderation_from_arrays_and_rows_agree(spark):
    rows = [(1, "Violence", 91.25), (1, None, None), (2, "violence", 50.0)]
    labels = spark.createDataFrame(rows, "item_id long, name string, confidence double")
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    by_rows = {r.item_id: (r.nsfw, r.n_labels) for r in moderation.report(items, labels).collect()}
    assert by_rows == {1: (True, 2), 2: (False, 1), 3: (False, 0)}
    arrays = labels.groupBy("item_id").agg(F.collect_list(F.struct("name", "confidence")).alias("labels"))
    by_array = moderation.report_from_arrays(items.join(arrays, "item_id", "left")).collect()
    assert {r.item_id: (r.nsfw, len(r.labels)) for r in by_array} == by_rows
    shown = [x for r in by_array if r.item_id == 1 for x in r.labels]
    assert ("Unknown", "0.0%") in [(x.label, x.confidence) for x in shown]


@pytest.mark.parametrize("n", [1, 2, 20, 21, 100, 101, 250])
def test_latency_percentiles_are_the_exclusive_method(spark, n):
    rng = random.Random(n)
    values = [float(rng.randint(0, 40)) for _ in range(n)]
    rows = [("g", v, at(i)) for i, v in enumerate(values)]
    row = latency.latency_summary(spark.createDataFrame(rows, "g string, v double, ts timestamp_ntz"), "g", "v", "ts").first()
    p95 = statistics.quantiles(values, n=20)[18] if n > 20 else max(values)
    p99 = statistics.quantiles(values, n=100)[98] if n > 100 else max(values)
    assert (row.n, row.median, row.p95, row.p99) == (n, statistics.median(values), pytest.approx(p95), pytest.approx(p99))
    assert row["mean"] == pytest.approx(statistics.mean(values))


def test_authorization_classes_and_case_of_names(spark):
    users = spark.createDataFrame([(1, 3), (2, 0)], "id int, credits int")
    dbs = spark.createDataFrame([(1, "docs", "eu", "text"), (2, "docs", "eu", "text")], "owner_id int, name string, region string, db_type string")
    keys = spark.createDataFrame([(1, "k"), (2, "z")], "owner_id int, key string").withColumn("key", F.sha2("key", 256))
    asked = spark.createDataFrame(
        [(1, "k", "docs"), (2, "k", "Docs"), (3, "z", "docs"), (4, "no", "docs")],
        "request_id long, api_key string, database string")
    got = {r.request_id: r.outcome for r in tenants.authorize(asked, keys, dbs, users).collect()}
    assert got == {1: "ok", 2: "DatabaseNotFound", 3: "NotEnoughCredits", 4: "InvalidApiKey"}


def test_cascade_listings_and_pages(spark):
    dbs = spark.createDataFrame([(1, "a"), (2, "b")], "owner_id int, name string")
    gone = spark.createDataFrame([(2,)], "id int")
    assert [r.owner_id for r in tenants.delete_owners(dbs, gone).collect()] == [1]
    corpus = spark.createDataFrame(
        [(i, "t", f"d{i}", None, "{}", None if i == 3 else at(i)) for i in range(8)],
        "id long, tenant string, vector_id string, content string, metadata string, created_at timestamp_ntz")
    page = [r.vector_id for r in tenants.document_page(corpus, "t", offset=1).collect()]
    assert page == ["d7", "d6", "d5", "d4", "d2"]  # the undated row comes first of all
    paged = sorted((r.position, r.vector_id) for r in tenants.document_pages(corpus, offset=1).collect())
    assert [v for _, v in paged] == page


def test_every_handled_payment_is_accepted_or_rejected(spark):
    users = spark.createDataFrame([(1, "a@x", 5)], "id int, email string, credits int")
    rows = [(i, event(id=f"t{i % 7}", items=[] if i == 3 else json.loads(event())["data"]["items"])) for i in range(20)]
    once = spark.createDataFrame(rows, "event_id long, payload string")
    # Sent again, under the same and under another event id.
    raw = once.unionByName(once).unionByName(once.limit(5).withColumn("event_id", F.col("event_id") + 100))
    raw = raw.unionByName(spark.createDataFrame([(0, event(id="t6"))], "event_id long, payload string"))
    for policy in ("first_wins", "completed_wins"):
        first, settled = payments.settle(once, users, policy=policy), payments.settle(raw, users, policy=policy)
        assert settled.accepted.count() == first.accepted.count() == 7
        assert settled.accepted.count() + settled.rejected.count() == raw.count() == 46
    stored = spark.createDataFrame([("t1",), ("t2",)], "transaction_id string")
    known = payments.settle(raw, users, stored)
    assert known.accepted.count() == 5 and known.accepted.count() + known.rejected.count() == 46


def test_latency_of_a_group_without_a_name(spark):
    rows = [(None if i % 2 else "g", float(i), datetime(2024, 1, 1, 0, 0, i)) for i in range(40)]
    samples = spark.createDataFrame(rows, "kind string, value double, ts timestamp_ntz")
    for group_rows in (10**6, 5):
        got = {r.kind: (r.n, r.min, r.max) for r in latency.latency_summary(samples, "kind", "value", "ts", group_rows).collect()}
        assert got == {None: (20, 1.0, 39.0), "g": (20, 0.0, 38.0)}


def test_any_cost_ledger_of_users_who_can_always_pay(spark):
    rows = [(u, u * 100 + i, at(i), 9 if i % 2 == 0 else -(1 + i % 5), 0 if u else 3) for u in range(4) for i in range(60)]
    rows += [(9, 900 + i, at(i), -2 if i % 2 else 1, 1) for i in range(20)]
    frame = spark.createDataFrame(rows, LEDGER)
    want, balances = set(), {}
    for user, event_id, _, delta, opening in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        balance = balances.get(user, opening)
        denied = delta < 0 and balance + delta < 0
        balances[user] = balance if denied else balance + delta
        want.add((event_id, balances[user], denied))
    for options in ({}, {"group_rows": 10, "chunks": 3}):
        made = ledger.any_cost_ledger(frame, **options)
        assert {(r.event_id, r.balance, r.denied) for r in made.collect()} == want
    assert {r[2] for r in want} == {True, False}
