"""One-time e-mail codes and the attempts to use them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.running import GROUP_ROWS, running

LIFETIME_MINUTES = 5


def issue(codes: DataFrame, lifetime_minutes: int = LIFETIME_MINUTES) -> DataFrame:
    """Adds ``expiry`` to ``email, code, issued_at``."""
    return codes.withColumn("expiry", F.col("issued_at") + F.make_interval(mins=F.lit(lifetime_minutes)))


def verification_outcomes(
    codes: DataFrame,
    attempts: DataFrame,
    lifetime_minutes: int = LIFETIME_MINUTES,
    group_rows: int = GROUP_ROWS,
    chunks: int | None = None,
) -> DataFrame:
    """``attempt_id, email, code, outcome``: ok, CodeExpired or InvalidCode.

    ``codes``: ``code_id, email, code, issued_at``; ``attempts``: ``attempt_id,
    email, code, attempted_at``. An attempt uses up every code it matches, even
    an expired one, so it finds a code only if one was issued since the last
    attempt with the same pair; of several, the latest decides. A code issued
    at the instant of an attempt counts as issued before it.
    """
    empty = F.lit(None).cast("timestamp_ntz")
    issued = codes.select(
        "email", "code", F.col("issued_at").alias("at"), F.lit(0).alias("kind"),
        F.col("code_id").alias("row_id"), F.col("issued_at").alias("issued"), empty.alias("tried"),
    )
    tried = attempts.select(
        "email", "code", F.col("attempted_at").alias("at"), F.lit(1).alias("kind"),
        F.col("attempt_id").alias("row_id"), empty.alias("issued"),
        F.col("attempted_at").alias("tried"),
    )
    events = issued.unionByName(tried)
    seen = running(
        events, ["email", "code"], ["at", "kind", "row_id"],
        {"_issued": ("max", "issued"), "_tried": ("max", "tried")},
        exclude_current=True, group_rows=group_rows, chunks=chunks,
    ).where("kind = 1")
    live = F.col("_issued").isNotNull() & (
        F.col("_tried").isNull() | (F.col("_issued") > F.col("_tried"))
    )
    expiry = F.col("_issued") + F.make_interval(mins=F.lit(lifetime_minutes))
    outcome = (
        F.when(~live, "InvalidCode").when(F.col("at") > expiry, "CodeExpired").otherwise("ok")
    )
    return seen.select(F.col("row_id").alias("attempt_id"), "email", "code", outcome.alias("outcome"))


def remaining_codes(codes: DataFrame, attempts: DataFrame) -> DataFrame:
    """Codes no later attempt has used up."""
    last = attempts.groupBy("email", "code").agg(F.max("attempted_at").alias("_last"))
    joined = codes.join(last, ["email", "code"], "left")
    kept = F.col("_last").isNull() | (F.col("issued_at") > F.col("_last"))
    return joined.where(kept).drop("_last")
