"""Control, payment, ledger and request tables derived from `customer` and `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtures.views import doc_queries, minutes_after, owner_region, spread, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.withColumn("owner", (1000 + F.col("user_id")).cast("int"))


def one_line_base64(text) -> F.Column:
    return F.regexp_replace(F.base64(text.cast("binary")), "[\r\n]", "")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        (1000 + F.col("c_custkey")).cast("int").alias("id"),
        F.col("c_name").alias("email"),
        F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("company"),
        F.greatest(F.lit(0), F.col("c_acctbal").cast("int")).alias("credits"),
        minutes_after("2024-01-01 00:00:00", F.col("c_custkey")).alias("created_at"),
        F.col("c_nationkey").alias("nation"),
    )


def databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.array(F.struct(F.lit("docs").alias("name"), F.lit("text").alias("db_type")),
                              F.struct(F.lit("images").alias("name"), F.lit("image").alias("db_type"))))
    return users(spark, sf_dir).select("id", "created_at", kinds.alias("k")).select(
        F.col("k.name").alias("name"), F.col("k.db_type").alias("db_type"),
        owner_region(F.col("id")).alias("region"), F.lit(0).alias("requests"),
        F.col("id").alias("owner_id"), "created_at",
    )


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users(spark, sf_dir).where("nation <> 7").select(
        F.sha2(F.concat(F.lit("key-"), F.col("id").cast("string")), 256).alias("key"),
        F.lit("main").alias("name"), F.col("id").alias("owner_id"), "created_at",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, sf_dir).select(
        e.alias("request_id"),
        F.when(e % 11 == 0, "stolen").otherwise(F.concat(F.lit("key-"), F.col("owner").cast("string"))).alias("api_key"),
        F.when(e % 7 == 0, "nothing").when(F.col("event_type").isin("click", "view"), "docs").otherwise("images").alias("database"),
    )


def database_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    return _events(spark, sf_dir).select(
        e.alias("request_id"), F.col("owner").alias("owner_id"),
        F.when(kind == "view", "DOCS").when(kind == "click", "Clicks").when(kind == "signup", "")
        .otherwise(F.concat(F.lit("Db"), (e % 5).cast("string"))).alias("name"),
        F.lit("text").alias("db_type"),
        F.when(e % 4 == 3, "mars").otherwise(owner_region(e)).alias("region"),
        F.col("ts").alias("created_at"),
    )


def key_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"), F.col("owner").alias("owner_id"),
        F.concat(F.lit("new-"), F.col("event_id").cast("string")).alias("api_key"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("name"),
        F.col("ts").alias("created_at"),
    )


def user_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations: twice the known customers' range, with repeats and blanks."""
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("Customer#"), F.lpad((F.col("event_id") * 2 % 3001).cast("string"), 9, "0")).alias("email"),
        F.when(F.col("event_type") == "error", "").otherwise("someone").alias("name"),
        F.lit(None).cast("string").alias("company"),
        F.col("ts").alias("created_at"),
    )


def payment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payment_events_of(spread(_events(spark, sf_dir)))


def payment_events_of(events: DataFrame) -> DataFrame:
    """`event_id, payload`: nested JSON with repeats, gaps and bad fields."""
    e, value = F.col("event_id"), F.col("value")
    kind = F.col("event_type")
    event_type = (
        F.when(kind == "purchase", "transaction.completed")
        .when(kind == "error", "transaction.payment_failed")
        .otherwise("subscription.updated")
    )
    billed = (
        F.when(e % 4 == 0, F.lit(None).cast("string"))
        .when(e % 19 == 0, "yesterday")
        .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    )
    credits = F.when(e % 17 == 0, "12x").otherwise(value.cast("int").cast("string"))
    cents = (value * 100).cast("int").cast("string")
    amount = F.when(e % 5 == 0, F.concat(F.lit("+"), cents)).otherwise(cents)
    price = F.struct(
        F.concat(F.lit("pri-"), (e % 3).cast("string")).alias("id"),
        F.lit("Plan").alias("name"), F.lit("Credits").alias("description"),
        F.struct(credits.alias("credits")).alias("custom_data"),
        F.struct(amount.alias("amount")).alias("unit_price"),
    )
    items = F.array(F.struct(price.alias("price")))
    payments = F.array(F.struct(F.struct(F.lit("card").alias("type")).alias("method_details")))
    data = F.struct(
        F.concat(F.lit("txn-"), F.floor(e / 3).cast("string")).alias("id"),
        F.concat(F.lit("ctm-"), F.col("user_id").cast("string")).alias("customer_id"),
        F.when(kind == "purchase", "completed").otherwise("failed").alias("status"),
        billed.alias("billed_at"),
        F.concat(F.lit("inv-"), e.cast("string")).alias("invoice_id"),
        F.lit(None).cast("string").alias("invoice_number"),
        F.struct(
            F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("user_email"),
            F.when(e % 13 == 0, F.lit(999999999).cast("long")).when(e % 31 == 0, F.lit(1 << 40))
            .otherwise(F.col("owner").cast("long")).alias("user_id"),
        ).alias("custom_data"),
        F.when(e % 23 == 0, F.slice(items, 1, 0)).otherwise(items).alias("items"),
        F.when(e % 29 == 0, F.slice(payments, 1, 0)).otherwise(payments).alias("payments"),
    )
    payload = F.to_json(F.struct(event_type.alias("event_type"), data.alias("data")))
    return events.select("event_id", payload.alias("payload"))


def ledger_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with next to no credits, so that denials happen."""
    small = users(spark, sf_dir)
    return small.withColumn("credits", (F.col("id") % 4).cast("int"))


def ledger_events(spark: SparkSession, sf_dir: str, bulk: bool = False) -> DataFrame:
    """Purchases grant, everything else charges (one credit, or 1-3 in bulk)."""
    return ledger_of(_events(spark, sf_dir), bulk)


def ledger_of(events: DataFrame, bulk: bool = False) -> DataFrame:
    e = F.col("event_id")
    cost = -(1 + e % 3) if bulk else F.lit(-1).cast("long")
    return events.select(
        F.col("owner").alias("user_id"), "event_id", "ts",
        F.when(F.col("event_type") == "purchase", 1 + e % 5).otherwise(cost).alias("delta"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind.isin("click", "view"), "docs").when(kind == "signup", "images").otherwise("nothing")
    return _events(spark, sf_dir).select("event_id", F.col("owner").alias("user_id"), name.alias("database"))


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_of(_events(spark, sf_dir))


def usage_of(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("owner").alias("user_id"), "ts", (1 + F.col("event_id") % 3).alias("count")
    )


def existing_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A usage snapshot that half overlaps the days of the events."""
    return users(spark, sf_dir).select(
        F.col("id").alias("user_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("usage_date"),
        F.lit(100).cast("long").alias("credits_used"),
    )


def moderation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))


def moderation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(
        F.struct((F.col("toxic") == 1).alias("on"), F.lit("Violence").alias("name"), F.lit(91.25).alias("confidence")),
        F.struct((F.col("quality") == 0).alias("on"), F.lit("Suggestive").alias("name"), F.lit(55.5).alias("confidence")),
        F.struct(
            ((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("on"),
            F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("confidence"),
        ),
    )
    exploded = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.explode(rows).alias("l"))
    return exploded.where("l.on").select("item_id", "l.name", "l.confidence")


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes_of(_events(spark, sf_dir))


def codes_of(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'signup'").select(
        F.col("event_id").alias("code_id"), F.col("owner").cast("string").alias("email"),
        (1000 + F.col("event_id") % 2).cast("smallint").alias("code"), F.col("ts").alias("issued_at"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts_of(_events(spark, sf_dir))


def attempts_of(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'click'").select(
        F.col("event_id").alias("attempt_id"), F.col("owner").cast("string").alias("email"),
        (1000 + F.col("event_id") % 2).cast("smallint").alias("code"), F.col("ts").alias("attempted_at"),
    )


def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete requests, many of them for documents that do not exist."""
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        F.concat((1000 + F.col("user_id") % 2).cast("string"), F.lit("-docs")).alias("tenant"),
        F.concat(F.when(F.col("event_type") == "error", "gone").otherwise("d"), F.col("user_id").cast("string")).alias("vector_id"),
    )


def insert_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_requests_of(table(spark, sf_dir, "documents"))


def insert_requests_of(documents: DataFrame) -> DataFrame:
    """Text inserts with every shape of metadata, some for an unknown region."""
    d = F.col("doc_id")
    metadata = (
        F.when(d % 5 == 0, F.lit(None).cast("string")).when(d % 5 == 1, "[1,2]").when(d % 5 == 2, "7")
        .when(d % 5 == 3, F.concat(F.lit('{"lang":"'), "lang", F.lit('"}'))).otherwise("{bad")
    )
    return documents.select(
        d.alias("request_id"), (1000 + d % 2).cast("int").alias("user_id"), F.lit("docs").alias("database"),
        F.when(d % 9 == 0, "mars").otherwise(owner_region(1000 + d % 2)).alias("region"),
        "text", metadata.alias("metadata"),
    )


def image_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base64 payloads made of the raw pages, every seventh one damaged."""
    payload = one_line_base64(F.col("html"))
    p = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        p.alias("request_id"), (1000 + p % 2).cast("int").alias("user_id"), F.lit("images").alias("database"),
        owner_region(1000 + p % 2).alias("region"),
        F.when(p % 7 == 0, F.concat(F.lit("?"), payload)).otherwise(payload).alias("image"),
        F.to_json(F.struct("url")).alias("metadata"),
    )


def stored_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored transaction per purchase, as the listing reads them."""
    return _events(spark, sf_dir).where("event_type = 'purchase'").select(
        F.concat(F.lit("txn-"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.col("owner").alias("user_id"), F.col("ts").alias("created_at"),
    )


def dashboard_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per embedding a lookup by id, by the text of its document, or by its vector."""
    asked = doc_queries(spark, sf_dir).drop("wanted", "page", "limit")
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    kind = F.col("label") % 3
    return asked.join(labels, "query_id").select(
        "query_id", "tenant",
        F.when(kind == 0, "id").when(kind == 1, "text").otherwise("image").alias("search_type"),
        F.when(kind == 0, F.concat(F.lit("d"), F.col("query_id").cast("string"))).otherwise(F.col("text")).alias("data"),
        "vector",
    )


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests before embedding: documents' openings, some with an image."""
    asked = doc_queries(spark, sf_dir).select("query_id", "text")
    q = F.col("query_id")
    is_image = q % 2 == 0
    return asked.select(
        "query_id", F.concat((1000 + q % 2).cast("string"), F.when(is_image, "-images").otherwise("-docs")).alias("tenant"),
        F.when(is_image, "image").otherwise("text").alias("db_type"),
        F.when(q % 5 != 0, F.col("text")).alias("text"),
        F.when(q % 3 == 0, one_line_base64(F.col("text"))).alias("image"),
    )


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with arrays in their metadata."""
    d = F.col("doc_id")
    tags = F.concat(F.lit('{"tags":["'), "lang", F.lit('",'), (d % 4).cast("string"), F.lit(',{"even":'), (d % 2 == 0).cast("string"), F.lit("}]}"))
    return table(spark, sf_dir, "documents").select(d.alias("id"), tags.alias("metadata"))


# Filters over the arrays of `tagged`, by number.
TAG_FILTERS = ['{"tags":["en"]}', '{"tags":["de",1]}', '{"tags":[{"even":true},"fr"]}', '{"tags":[]}', '{"tags":["1"]}']


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as the JSON arrays of a model server; the element numbered by the label is no number."""
    odd = F.element_at(F.array(*map(F.lit, ('"x"', "null", "true", "[3]", '{"k":1}'))), (F.col("vec_id") % 5 + 1).cast("int"))
    parts = F.transform("embedding", lambda x, i: F.when(i == F.col("label"), odd).otherwise(x.cast("string")))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")).alias("text"))


def patterns(spark: SparkSession, d: str) -> DataFrame:
    """A piece of every 20th document in upper case, of 2, 5, 9 or 14 letters, asked of either tenant."""
    docs = table(spark, d, "documents").where("doc_id % 20 = 0")
    length = F.expr("element_at(array(2, 5, 9, 14), int(doc_id div 20 % 4) + 1)")
    return docs.select(
        F.col("doc_id").alias("query_id"), F.concat((1000 + F.expr("doc_id div 20 % 2")).cast("string"), F.lit("-docs")).alias("tenant"),
        F.upper(F.substring(F.col("text"), F.lit(7), length)).alias("text"))
