"""Payment events to transactions, credit grants and a quarantine."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.cleaning import first_of, rfc3339, strict_int
from rankloom.operators.topk import first_per_key
from rankloom.schema import PAYMENT_EVENT

COMPLETED, FAILED = "transaction.completed", "transaction.payment_failed"

TRANSACTION_COLUMNS = [
    "user_id", "user_email", "transaction_id", "customer_id", "price_id", "plan_name",
    "plan_description", "credits_purchased", "amount_paid", "status", "billed_at",
    "invoice_id", "invoice_number", "payment_method",
]


def parse_events(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Typed events of the two handled kinds; other kinds are ignored.

    Adds the transaction columns, ``event_type`` and ``reject_reason`` (NULL
    when the event is well formed) to the remaining input columns.
    """
    event = F.from_json(F.col(column), PAYMENT_EVENT)
    # A generator keeps the filter above it, so each payload is parsed once.
    parsed = raw.withColumn("_e", F.explode(F.array(event))).where(F.col("_e.event_type").isin(COMPLETED, FAILED))
    data = F.col("_e.data")
    price = first_of(data["items"])["price"]
    method = first_of(data["payments"])["method_details"]["type"]
    user_id = data["custom_data"]["user_id"]
    typed = parsed.select(
        *[c for c in raw.columns if c != column],
        F.col("_e.event_type").alias("event_type"),
        user_id.try_cast("int").alias("user_id"),
        data["custom_data"]["user_email"].alias("user_email"),
        data["id"].alias("transaction_id"),
        data["customer_id"].alias("customer_id"),
        price["id"].alias("price_id"),
        price["name"].alias("plan_name"),
        price["description"].alias("plan_description"),
        strict_int(price["custom_data"]["credits"]).alias("credits_purchased"),
        strict_int(price["unit_price"]["amount"]).alias("amount_paid"),
        data["status"].alias("status"),
        rfc3339(data["billed_at"]).alias("billed_at"),
        data["invoice_id"].alias("invoice_id"),
        data["invoice_number"].alias("invoice_number"),
        method.alias("payment_method"),
        (data["billed_at"].isNotNull() & rfc3339(data["billed_at"]).isNull()).alias("_bad_date"),
    )
    required = [
        "user_email", "transaction_id", "customer_id", "status", "price_id", "plan_name",
        "plan_description",
    ]
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull()
    reason = (
        F.when(F.col("payment_method").isNull(), "MissingPayment")
        .when(missing, "MissingField")
        .when(F.col("user_id").isNull(), "InvalidUserId")
        .when(F.col("credits_purchased").isNull(), "InvalidCredits")
        .when(F.col("amount_paid").isNull(), "InvalidAmount")
        .when(F.col("_bad_date"), "InvalidBilledAt")
    )
    return typed.withColumn("reject_reason", reason).drop("_bad_date")


def check_references(events: DataFrame, users: DataFrame) -> DataFrame:
    """Marks well-formed events whose user id or email is not registered."""
    ids = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_id_known"))
    emails = users.select(F.col("email").alias("user_email"), F.lit(True).alias("_email_known"))
    joined = events.join(ids, "user_id", "left").join(emails, "user_email", "left")
    unknown = F.col("_id_known").isNull() | F.col("_email_known").isNull()
    reason = F.coalesce("reject_reason", F.when(unknown, "UnknownUser"))
    return joined.withColumn("reject_reason", reason).select(*events.columns)


class Settlement(NamedTuple):
    """What a set of payment events leads to."""

    accepted: DataFrame  # one event per transaction id
    rejected: DataFrame  # the others, with their ``reject_reason``


def settle(
    raw: DataFrame,
    users: DataFrame,
    transactions: DataFrame | None = None,
    arrival: str = "event_id",
    policy: str = "first_wins",
) -> Settlement:
    """Accept the first good event of every transaction id, reject the rest.

    A failure that arrives first hides a later completion;
    ``policy='completed_wins'`` prefers the completion. Rejected events never
    claim an id. ``transactions`` are those already stored.
    """
    if policy not in ("first_wins", "completed_wins"):
        raise ValueError(f"unknown policy {policy}")
    checked = check_references(parse_events(raw), users)
    good = checked.where("reject_reason IS NULL")
    # An event that was sent again is a row with a count; it stays one in what follows.
    once = good.groupBy(*good.columns).agg(F.count(F.lit(1)).alias("_times"))
    order = [F.col(arrival), *(F.col(c) for c in good.columns if c != arrival)]
    if policy == "completed_wins":
        order.insert(0, F.when(F.col("event_type") == COMPLETED, 0).otherwise(1))
    accepted = first_per_key(once, ["transaction_id"], order).drop("_times")
    if transactions is not None:
        # Only the ids of this batch are looked up, and a small batch is
        # broadcast to the stored table instead of shuffling it.
        known = transactions.select("transaction_id").join(
            accepted.select("transaction_id"), "transaction_id", "left_semi"
        )
        accepted = accepted.join(known, "transaction_id", "left_anti")
    # All other rows are late, and so is every repeat of an accepted one.
    row = F.struct(*good.columns)
    claimed = accepted.select("transaction_id", row.alias("_accepted"))
    late = once.join(claimed, "transaction_id", "left").select(*good.columns, "_accepted", "_times")
    own = F.col("_accepted").isNotNull() & row.eqNullSafe(F.col("_accepted"))
    left = F.col("_times") - F.when(own, 1).otherwise(0)
    copies = F.sequence(F.lit(1).cast("long"), left)
    late = late.where(left > 0).withColumn("_copy", F.explode(copies)).drop("_copy", "_times", "_accepted")
    late = late.withColumn("reject_reason", F.lit("DuplicateTransaction"))
    return Settlement(accepted, checked.where("reject_reason IS NOT NULL").unionByName(late))


def accepted_transactions(settled: Settlement) -> DataFrame:
    return settled.accepted.select(*TRANSACTION_COLUMNS)


def credit_grants(settled: Settlement) -> DataFrame:
    """Credits bought per user by completed, accepted transactions."""
    paid = settled.accepted.where(F.col("event_type") == COMPLETED)
    return paid.groupBy("user_id").agg(F.sum("credits_purchased").alias("granted"))


def grant_credits(users: DataFrame, grants: DataFrame) -> DataFrame:
    """Users snapshot after the grants."""
    granted = grants.select(F.col("user_id").alias("id"), "granted")
    joined = users.join(granted, "id", "left")
    total = (F.col("credits") + F.coalesce("granted", F.lit(0))).cast("int")
    return joined.withColumn("credits", total).select(*users.columns)
