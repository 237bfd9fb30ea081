"""Registry, authorization, inventory, listings and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.cleaning import any_empty, key_hash, known_region, tenant_key
from rankloom.operators.topk import first_per_key, newest
from rankloom.schema import KEYS_PER_OWNER, STARTER_CREDITS
from rankloom.session import broadcastable

# Control tables are joined without hints: Spark broadcasts them when their
# size allows and otherwise splits hot keys at run time (skew join).


def authorize(
    requests: DataFrame, api_keys: DataFrame, databases: DataFrame, users: DataFrame
) -> DataFrame:
    """Adds ``user_id, region, db_type, outcome`` to ``request_id, api_key, database``.

    Outcomes: ``ok``, ``InvalidApiKey``, ``DatabaseNotFound``,
    ``NotEnoughCredits`` (also for an owner that no longer exists).
    """
    keys = api_keys.select(F.col("key").alias("_key"), F.col("owner_id").alias("user_id"))
    owned = databases.select(
        F.col("owner_id").alias("_owner"), F.col("name").alias("_name"), "region", "db_type"
    )
    credits = users.select(F.col("id").alias("_user"), F.col("credits").alias("_credits"))
    joined = (
        requests.withColumn("_hash", key_hash(F.col("api_key")))
        .join(keys, F.col("_hash") == F.col("_key"), "left")
        .join(owned, (F.col("user_id") == F.col("_owner")) & (F.col("database") == F.col("_name")), "left")
        .join(credits, F.col("user_id") == F.col("_user"), "left")
    )
    outcome = (
        F.when(F.col("user_id").isNull(), "InvalidApiKey")
        .when(F.col("_owner").isNull(), "DatabaseNotFound")
        .when(F.coalesce(F.col("_credits") > 0, F.lit(False)), "ok")
        .otherwise("NotEnoughCredits")
    )
    return joined.withColumn("outcome", outcome).select(
        *requests.columns, "user_id", "region", "db_type", "outcome"
    )


def resolve_owner(requests: DataFrame, api_keys: DataFrame, databases: DataFrame) -> DataFrame:
    """Key and database only, as deletes use it: no credit check, misses drop out."""
    keys = api_keys.select(F.col("key").alias("_key"), F.col("owner_id").alias("user_id"))
    owned = databases.select(
        F.col("owner_id").alias("user_id"), F.col("name").alias("database"), "region"
    )
    hashed = requests.withColumn("_key", key_hash(F.col("api_key")))
    return hashed.join(keys, "_key").join(owned, ["user_id", "database"]).drop("_key")


def append_unique(
    existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]
) -> DataFrame:
    """Incoming rows that keep ``keys`` unique: the first new row of each key."""
    return first_per_key(incoming, keys, order).join(existing.select(*keys), keys, "left_anti")


def add_users(users: DataFrame, incoming: DataFrame) -> DataFrame:
    """Registrations with no empty field and a new email, given starter credits."""
    named = incoming.where(~any_empty(F.col("email"), F.col("name"), F.col("company")))
    fresh = append_unique(users, named, ["email"], [F.col("created_at"), F.col("request_id")])
    return fresh.withColumn("credits", F.lit(STARTER_CREDITS))


def add_databases(databases: DataFrame, incoming: DataFrame) -> DataFrame:
    """New databases: lower-cased name, known region, (owner, name) not taken."""
    named = incoming.where(
        ~any_empty(F.col("name"), F.col("db_type"), F.col("region")) & known_region(F.col("region"))
    ).withColumn("name", F.lower("name"))
    order = [F.col("created_at"), F.col("request_id")]
    fresh = append_unique(databases, named, ["owner_id", "name"], order)
    return fresh.withColumn("requests", F.lit(0))


def add_api_keys(api_keys: DataFrame, incoming: DataFrame) -> DataFrame:
    """New keys, hashed, while their owner holds fewer than ten."""
    order = [F.col("created_at"), F.col("request_id")]
    named = incoming.where(~any_empty(F.col("name"))).withColumn("key", key_hash(F.col("api_key")))
    fresh = append_unique(api_keys, named, ["key"], order)
    held = api_keys.groupBy("owner_id").agg(F.count(F.lit(1)).alias("_held"))
    # The literal bound prunes before the shuffle; the exact room follows.
    w = Window.partitionBy("owner_id").orderBy(*order)
    ranked = fresh.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= KEYS_PER_OWNER)
    room = F.lit(KEYS_PER_OWNER) - F.coalesce(F.col("_held"), F.lit(0))
    return (
        ranked.join(held, "owner_id", "left")
        .where(F.col("_n") <= room)
        .drop("_n", "_held", "api_key")
    )


def tenant_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("tenant").agg(F.count(F.lit(1)).alias("record_count"))


def database_inventory(databases: DataFrame, corpus: DataFrame) -> DataFrame:
    """Every database with its number of records, 0 when it has none."""
    keyed = databases.withColumn("tenant", tenant_key(F.col("owner_id"), F.col("name")))
    counted = keyed.join(tenant_counts(corpus), "tenant", "left")
    return counted.withColumn("record_count", F.coalesce("record_count", F.lit(0))).drop("tenant")


def document_page(corpus: DataFrame, tenant: str, offset: int = 0, limit: int = 5) -> DataFrame:
    """Newest documents of one tenant, skipping ``offset`` rows (not pages)."""
    rows = newest(corpus.where(F.col("tenant") == tenant), offset, limit)
    return rows.select("vector_id", "content", "metadata", "created_at")


def document_pages(corpus: DataFrame, offset: int = 0, limit: int = 5) -> DataFrame:
    """The same listing page for every tenant at once.

    Positions are found on narrow rows; with a bounded number of tenants the
    few kept ones go to the corpus, which is then read in place.
    """
    w = Window.partitionBy("tenant").orderBy(F.col("created_at").desc_nulls_first(), "id")
    slim = corpus.select("tenant", "id", "created_at")
    ranked = slim.withColumn("position", F.row_number().over(w).cast("long"))
    kept = ranked.where((F.col("position") <= offset + limit) & (F.col("position") > offset))
    kept = kept.drop("created_at")
    tenants, name = corpus.select("tenant").distinct().agg(F.count(F.lit(1)), F.max(F.length("tenant"))).first()
    if broadcastable(tenants * limit, name):
        kept = F.broadcast(kept)
    documents = corpus.select("tenant", "id", "vector_id", "content", "metadata", "created_at")
    return documents.join(kept, ["tenant", "id"]).drop("id")


def delete_documents(corpus: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining corpus, deletes that matched nothing) by (tenant, vector_id)."""
    keys = ["tenant", "vector_id"]
    gone = deletes.select(*keys).distinct()
    missing = deletes.join(corpus.select(*keys), keys, "left_anti")
    return corpus.join(gone, keys, "left_anti"), missing


def delete_api_keys(api_keys: DataFrame, deletes: DataFrame) -> DataFrame:
    keys = ["owner_id", "name", "created_at"]
    return api_keys.join(deletes.select(*keys), keys, "left_anti")


def delete_owners(table: DataFrame, removed: DataFrame, owner: str = "owner_id") -> DataFrame:
    """Cascade of removed users over a table that references them."""
    gone = removed.select(F.col("id").alias(owner))
    return table.join(gone, owner, "left_anti")


def list_api_keys(api_keys: DataFrame, user_id: int | None = None) -> DataFrame:
    rows = api_keys if user_id is None else api_keys.where(F.col("owner_id") == user_id)
    return rows.select("owner_id", "name", "created_at")


def list_transactions(transactions: DataFrame, user_id: int | None = None) -> DataFrame:
    """Newest first, of one user or of all users in turn."""
    newest_first = [F.col("created_at").desc_nulls_first(), F.col("transaction_id")]
    if user_id is None:
        return transactions.orderBy("user_id", *newest_first)
    return transactions.where(F.col("user_id") == user_id).orderBy(*newest_first)


def list_usage(usage: DataFrame, user_id: int | None = None) -> DataFrame:
    rows = usage if user_id is None else usage.where(F.col("user_id") == user_id)
    return rows.select("user_id", "usage_date", "credits_used")


def user_credits(users: DataFrame, user_id: int | None = None) -> DataFrame:
    rows = users if user_id is None else users.where(F.col("id") == user_id)
    return rows.select("id", "credits")


def customer_ids(transactions: DataFrame) -> DataFrame:
    """Payment customer id per email, from the earliest transaction."""
    earliest = F.struct("created_at", "transaction_id")
    return transactions.groupBy("user_email").agg(F.min_by("customer_id", earliest).alias("customer_id"))
