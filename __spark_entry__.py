
from __future__ import annotations

import json
import os
import sys
import uuid
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures import control, sql, views  # noqa: E402
from rankloom.functions import models  # noqa: E402
from rankloom.functions.metadata import contains  # noqa: E402
from rankloom.functions.text import one_line, tokens  # noqa: E402
from rankloom.functions.vectors import coerce_embedding, norm  # noqa: E402
from rankloom.operators import ann, cells  # noqa: E402
from rankloom.operators.fulltext import corpus_tokens  # noqa: E402
from rankloom.operators import trigram  # noqa: E402
from rankloom.plans import latency, ledger, moderation, payments, tenants, usage, verification  # noqa: E402
from rankloom.plans.search import (  # noqa: E402
    Asked, dashboard_route, dashboard_search, hybrid_search, route, search, text_search, vector_search,
)
from rankloom.session import configure, shared_folder  # noqa: E402
from rankloom.sources import corpus as store  # noqa: E402
from rankloom.sources import index  # noqa: E402
from rankloom.streaming import stateful, tables  # noqa: E402
from rankloom.streaming.ingest import start_ingest  # noqa: E402
from rankloom.streaming.run import drain_append, drain_updates  # noqa: E402
from rankloom.streaming.usage import usage_stream  # noqa: E402

try:
    import rankloom.llm.registered as llm
except ImportError as missing:  # the folder, or a library that only it needs, may have been taken away
    warnings.warn(f"queries over training text are left out: {missing}", stacklevel=2)
    llm = None

_FOUND = ["query_id", "rank", "vector_id", "content", "metadata", "round(score, 6) AS score"]


def entry(spark: SparkSession) -> DataFrame:
    """Hybrid search of every query against its tenant's documents."""
    return queries()["hybrid_rrf"](spark, "/root/testdata/sf0.001")


def _vector(filtered: bool):
    def run(spark, d):
        found = vector_search(views.vectors(spark, d), views.queries(spark, d, filtered))
        return found.selectExpr(*_FOUND)
    return run


def _text(filtered: bool):
    def run(spark, d):
        found = text_search(views.vectors(spark, d), views.queries(spark, d, filtered))
        return found.select("query_id", "id", F.round("rank", 6).alias("rank"), "trank")
    return run


def _hybrid(filtered: bool, every_mode: bool = False):
    def run(spark, d):
        corpus, asked = views.vectors(spark, d), views.queries(spark, d, filtered)
        return (search if every_mode else hybrid_search)(corpus, asked).selectExpr(*_FOUND)
    return run


def _vector_blocks(spark, d):
    found = vector_search(views.vectors(spark, d), views.queries(spark, d), strategy="blocks")
    return found.selectExpr(*_FOUND)


def _text_shuffled(spark, d):
    corpus = views.vectors(spark, d)
    found = text_search(corpus, views.queries(spark, d), terms=corpus_tokens(corpus))
    return found.select("query_id", "id", F.round("rank", 6).alias("rank"), "trank")


def _dashboard(spark, d):
    return dashboard_search(views.vectors(spark, d), control.dashboard_requests(spark, d)).selectExpr(*_FOUND)


def _dashboard_rejected(spark, d):
    asked = control.dashboard_requests(spark, d).drop("vector")
    kind = F.when(F.col("query_id") % 7 == 0, "audio").otherwise(F.col("search_type"))
    db = F.when(F.col("query_id") % 11 == 0, "sound").when(F.col("query_id") % 2 == 0, "image").otherwise("text")
    asked = asked.withColumns({"search_type": kind, "db_type": db})
    _, rejected = dashboard_route(
        asked, models.hashed_text_embedder(64), models.hashed_text_embedder(64, "cross-modal"),
        models.hashed_image_embedder(64))
    return rejected.where("reject_reason = 'UnknownSearch'").select("query_id", "search_type", "db_type")


def _router(spark, d):
    asked, _ = route(
        control.search_requests(spark, d), models.hashed_text_embedder(64),
        models.hashed_text_embedder(64, "cross-modal"), models.hashed_image_embedder(64),
    )
    return search(views.vectors(spark, d), asked, threshold=None).selectExpr(*_FOUND)


def _centres(spark, d):
    """Every 31st embedding is the centre of a cell."""
    given = views.table(spark, d, "embeddings").where("vec_id % 31 = 0").orderBy("vec_id").limit(4096)
    return {64: ann.unit_rows(np.array([r.embedding for r in given.collect()], dtype=np.float64))}


def _all_cells(spark, d):
    """Search through a stored index of cells, of which each query probes all."""
    corpus, asked = views.vectors(spark, d), Asked.of(views.queries(spark, d)).df
    centres, folder = _centres(spark, d), _folder(spark)
    ann.write_cells(ann.assign_cells(corpus.select("tenant", "id", "embedding"), centres), folder)
    found = ann.probe(spark.read.parquet(folder), asked, centres, sum(map(len, centres.values())))
    return found.select("query_id", "id", F.round("dist", 6).alias("dist"), "vrank")


def _bounded_cells(spark, d):
    """Search through stored cells, of which each query reads those that can hold a near vector."""
    asked, folder = Asked.of(views.queries(spark, d)), _folder(spark)
    cells.write_cells(views.vectors(spark, d).select("tenant", "id", "embedding"), folder)
    found = cells.search_cells(spark, folder, asked.df, table=asked.head)
    return found.select("query_id", "id", F.round("dist", 6).alias("dist"), "vrank")


def _cells_read(spark, d):
    """The cells that each query would read within a distance of 0.3, where bounds begin to tell."""
    folder = _folder(spark)
    cells.write_cells(views.vectors(spark, d).select("tenant", "id", "embedding"), folder, _centres(spark, d))
    return cells.cells_read(spark, folder, views.queries(spark, d), threshold=0.3)


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/fixture-{uuid.uuid4().hex}"


def _stored_hybrid(spark, d):
    """The flagship over a corpus that was written in its layout and read back."""
    folder = _folder(spark)
    rows = views.vectors(spark, d).withColumns({"tokens": tokens(F.col("content")), "norm": norm(F.col("embedding"))})
    store.write_corpus(rows, folder)
    return hybrid_search(store.read_corpus(spark, folder), views.queries(spark, d)).selectExpr(*_FOUND)


def _text_index(filtered: bool):
    def run(spark, d):
        corpus, folder = views.vectors(spark, d), _folder(spark)
        index.write_postings(corpus, folder)
        found = text_search(corpus, views.queries(spark, d, filtered), terms=index.read_postings(spark, folder))
        return found.select("query_id", "id", F.round("rank", 6).alias("rank"), "trank")
    return run


def _stream_of(spark, d, name):
    return spark.readStream.schema(views.table(spark, d, name).schema).parquet(f"{d}/{name}*.parquet")


def _finish(*running):
    for query in running:
        query.awaitTermination()


def _stream_payments(spark, d):
    folder = _folder(spark)
    events = control.payment_events_of(_from_stream(spark, d, lambda e: e))
    _finish(tables.start_payments(
        events, lambda: control.users(spark, d), f"{folder}/rows", f"{folder}/bad", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/rows").select(*payments.TRANSACTION_COLUMNS)


def _stream_search(spark, d):
    folder = _folder(spark)
    asked = views.doc_queries_of(_stream_of(spark, d, "embeddings"), views.table(spark, d, "documents")).drop("wanted")
    _finish(tables.start_search(asked, lambda: views.vectors(spark, d), f"{folder}/rows", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/rows").selectExpr(*_FOUND)


def _stream_ingest(spark, d):
    folder = _folder(spark)
    requests = control.insert_requests_of(_stream_of(spark, d, "documents"))
    _finish(*start_ingest(
        requests, models.hashed_text_embedder(8), f"{folder}/rows", f"{folder}/bad", f"{folder}/checkpoint",
        vector_id=store.content_id(F.col("tenant"), F.col("content"))))
    made = store.read_corpus(spark, f"{folder}/rows").withColumn("content", one_line(F.col("content")))
    return made.select("tenant", "vector_id", "content", "metadata", "region")


def _replayed(spark, d):
    """Every event twice: each is accepted or rejected, once for every time it was sent."""
    events = control.payment_events(spark, d)
    settled = payments.settle(events.unionByName(events), control.users(spark, d))
    accepted = settled.accepted.select("event_id", F.lit("").alias("reject_reason"))
    return accepted.unionByName(settled.rejected.select("event_id", "reject_reason"))


def _lookups(spark, d):
    found = store.find_documents(views.vectors(spark, d), control.deletes(spark, d))
    return found.select("request_id", "vector_id", F.md5(F.col("content").cast("binary")).alias("content"), "metadata")


def _promoted(spark, d):
    corpus = store.promote(views.vectors(spark, d), {"lang": "$.lang", "chars": "$.size.chars"})
    return corpus.where("lang = 'de'").select("id", "lang", "chars")


def _promoted_topk(spark, d):
    """Filtered search over a stored corpus whose hot metadata paths are columns."""
    folder = _folder(spark)
    rows = views.vectors(spark, d).withColumns({"tokens": tokens(F.col("content")), "norm": norm(F.col("embedding"))})
    fields = {"lang": "$.lang", "source": "$.source"}
    store.write_corpus(store.promote(rows, fields), folder)
    return vector_search(store.read_corpus(spark, folder, promoted=fields), views.queries(spark, d, True)).selectExpr(*_FOUND)


def _array_filters(spark, d):
    docs = control.tagged(spark, d)
    parsed = F.try_parse_json("metadata")
    held = F.array(*(F.when(contains(parsed, json.loads(f)), F.lit(i)) for i, f in enumerate(control.TAG_FILTERS)))
    return docs.select("id", F.explode(F.array_compact(held)).alias("filter"))


def _shown(vector) -> F.Column:
    return F.array_join(F.transform(vector, lambda x: F.format_number(x.cast("double"), 5)), " ")


def _coerced(spark, d):
    return control.embedding_texts(spark, d).select("vec_id", _shown(coerce_embedding(F.col("text"))).alias("embedding"))


def _embedded(spark, d):
    rows, _ = store.ingest_text(
        control.insert_requests(spark, d), models.hashed_text_embedder(64),
        vector_id=store.content_id(F.col("tenant"), F.col("content")),
    )
    return rows.select("tenant", "vector_id", _shown("embedding").alias("embedding"))


# A cap on encoded images that some of the given pages exceed.
IMAGE_CHARS = 4000


def _images(part: int):
    def run(spark, d):
        made = store.ingest_images(
            control.image_requests(spark, d), models.hashed_image_embedder(64), most_chars=IMAGE_CHARS,
            vector_id=F.col("request_id").cast("string"))
        if part:
            return made[1].select("request_id", "reject_reason")
        return made[0].select(
            "tenant", F.col("vector_id").cast("long").alias("request_id"), "content", "metadata", _shown("embedding").alias("embedding"))
    return run


def _detected(spark, d):
    found, _ = moderation.detect(control.image_requests(spark, d), models.hashed_detector())
    shown = F.transform("labels", lambda x: F.concat_ws(":", x["label"], x["confidence"]))
    return found.select("request_id", "nsfw", F.array_join(shown, ",").alias("labels"))


def _event_stream(spark, d):
    schema = views.table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")


def _from_stream(spark, d, build):
    """A fixture over the events, with the events read as a stream."""
    stream = _event_stream(spark, d)
    return build(stream.withColumn("owner", (1000 + F.col("user_id")).cast("int")))


def _stream_usage(spark, d):
    stream = _from_stream(spark, d, control.usage_of)
    days = drain_updates(usage_stream(stream), ["user_id", "usage_date"])
    return days.withColumn("usage_date", F.col("usage_date").cast("string"))


def _stream_ledger(spark, d):
    stream = ledger.with_opening(_from_stream(spark, d, control.ledger_of), control.ledger_users(spark, d))
    made = drain_append(stateful.ledger_stream(stream))
    return made.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _stream_ledger_ordered(spark, d):
    """The ledger by event time; without a delay the last event releases all."""
    stream = ledger.with_opening(_from_stream(spark, d, control.ledger_of), control.ledger_users(spark, d))
    made = drain_append(stateful.ordered_ledger_stream(stream, "0 seconds"))
    return made.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _stream_verification(spark, d):
    codes, attempts = _from_stream(spark, d, control.codes_of), _from_stream(spark, d, control.attempts_of)
    # The given events span a month, in which nothing is forgotten.
    return drain_append(stateful.verification_stream(codes, attempts, 720, retention_minutes=60 * 24 * 60))


def _trigrams(spark, d):
    docs = views.spread(views.table(spark, d, "documents")).select(
        F.lit("all").alias("tenant"), F.col("doc_id").alias("id"), F.col("text").alias("content"))
    asked = views.table(spark, d, "benchmark").select(
        F.lit("all").alias("tenant"), F.col("item_id").alias("query_id"), "text")
    return trigram.trigram_similarity(docs, asked).withColumn("similarity", F.round("similarity", 6))


def _substrings(spark, d):
    """Pieces of every 20th document and some short patterns, looked up in the documents of both tenants."""
    corpus, folder = views.vectors(spark, d), _folder(spark)
    trigram.write_windows(corpus, folder)
    return trigram.substring_lookup(corpus, control.patterns(spark, d), trigram.read_windows(spark, folder))


def _bulk_balances(spark, d):
    opened = ledger.with_opening(control.ledger_events(spark, d, bulk=True), control.ledger_users(spark, d))
    return ledger.closing_balances(ledger.any_cost_ledger(opened)).select("user_id", "balance")


def _document_pages(spark, d):
    return tenants.document_pages(views.vectors(spark, d), offset=3)


def _deletes(part: int, *columns: str):
    def run(spark, d):
        results = tenants.delete_documents(views.vectors(spark, d), control.deletes(spark, d))
        return results[part].select(*columns)
    return run


def _delete_api_keys(spark, d):
    keys = control.api_keys(spark, d)
    errors = views.table(spark, d, "events").where("event_type = 'error'")
    owners = errors.select((1000 + F.col("user_id")).cast("int").alias("owner_id"))
    asked = keys.join(owners, "owner_id", "left_semi")
    return tenants.delete_api_keys(keys, asked).select("owner_id", "name", "created_at")


def _authorize(spark, d):
    made = tenants.authorize(
        control.requests(spark, d), control.api_keys(spark, d), control.databases(spark, d), control.users(spark, d)
    )
    return made.withColumn("user_id", F.col("user_id").cast("string"))


def _resolve(spark, d):
    found = tenants.resolve_owner(control.requests(spark, d), control.api_keys(spark, d), control.databases(spark, d))
    return found.select("request_id", "user_id", "database", "region")


def _registry(spark, d):
    fresh = tenants.add_databases(control.databases(spark, d), control.database_requests(spark, d))
    return fresh.select("request_id", "owner_id", "name", "region")


def _new_users(spark, d):
    fresh = tenants.add_users(control.users(spark, d), control.user_requests(spark, d))
    return fresh.select("request_id", "email", "credits")


def _new_keys(spark, d):
    fresh = tenants.add_api_keys(control.api_keys(spark, d), control.key_requests(spark, d))
    return fresh.select("request_id", "owner_id", "name", "key")


def _settled(spark, d):
    return payments.settle(control.payment_events(spark, d), control.users(spark, d))


def _grants(spark, d):
    return payments.credit_grants(_settled(spark, d))


def _after_grants(spark, d):
    return payments.grant_credits(control.users(spark, d), _grants(spark, d)).select("id", "credits")


def _customer_ids(spark, d):
    accepted = _settled(spark, d).accepted
    return tenants.customer_ids(accepted.withColumn("created_at", F.col("event_id")))


def _ledger(spark, d):
    opened = ledger.with_opening(control.ledger_events(spark, d), control.ledger_users(spark, d))
    return ledger.unit_ledger(opened)


def _request_counts(spark, d):
    return ledger.database_request_counts(control.calls(spark, d), _ledger(spark, d), control.databases(spark, d))


def _usage(upsert: bool, retained: bool = False):
    def run(spark, d):
        existing = control.existing_usage(spark, d) if upsert else None
        days = usage.usage_daily(control.usage_events(spark, d), existing)
        if retained:
            days = usage.usage_retained(days, "2024-01-31")
        return days.withColumn("usage_date", F.col("usage_date").cast("string"))
    return run


def _moderation(spark, d):
    made = moderation.report(control.moderation_items(spark, d), control.moderation_labels(spark, d))
    shown = F.transform("labels", lambda x: F.concat_ws(":", x["label"], x["confidence"].cast("string")))
    return made.withColumn("labels", F.array_join(shown, ","))


def _verification(spark, d):
    return verification.verification_outcomes(control.codes(spark, d), control.attempts(spark, d), 720)


def _remaining(spark, d):
    left = verification.remaining_codes(control.codes(spark, d), control.attempts(spark, d))
    return left.select("email", "code", "issued_at")


def _latency(spark, d):
    made = latency.latency_summary(views.table(spark, d, "events"), "event_type", "value", "ts")
    rounded = {c: F.round(c, 6) for c in ("mean", "median", "p95", "p99", "rate")}
    return made.withColumns(rounded)


def _ingest(part: int):
    def run(spark, d):
        good, bad = store.check_inserts(control.insert_requests(spark, d))
        if part:
            return bad.select("request_id", "reject_reason")
        rows = good.withColumn("content", F.col("text")).withColumn("embedding", F.lit(None).cast("array<float>"))
        made = store.project(rows, vector_id=store.content_id(F.col("tenant"), F.col("content")))
        made = made.withColumn("content", one_line(F.col("content")))
        return made.select("tenant", "vector_id", "content", "metadata", "region")
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator family; each callable takes (spark, sf_dir)."""
    registered = {
        "vector_topk": _vector(False),
        "vector_topk_filtered": _vector(True),
        "text_rank": _text(False),
        "text_rank_filtered": _text(True),
        "hybrid_rrf": _hybrid(False),
        "hybrid_rrf_filtered": _hybrid(True),
        "search_all_modes": _hybrid(True, every_mode=True),
        "vector_topk_blocks": _vector_blocks,
        "text_rank_shuffled": _text_shuffled,
        "dashboard_search": _dashboard,
        "dashboard_rejected": _dashboard_rejected,
        "search_router": _router,
        "approximate_topk": _bounded_cells,
        "approximate_all_cells": _all_cells,
        "cells_read": _cells_read,
        "stored_hybrid": _stored_hybrid,
        "text_rank_index": _text_index(False),
        "text_rank_filtered_index": _text_index(True),
        "document_lookup": _lookups,
        "promoted_fields": _promoted,
        "promoted_topk_filtered": _promoted_topk,
        "array_filters": _array_filters,
        "coerced_embeddings": _coerced,
        "trigram_similarity": _trigrams,
        "substring_lookup": _substrings,
        "tenant_counts": lambda s, d: tenants.tenant_counts(views.vectors(s, d)),
        "database_inventory": lambda s, d: tenants.database_inventory(control.databases(s, d), views.vectors(s, d)),
        "document_pages": _document_pages,
        "delete_documents": _deletes(0, "id", "tenant", "vector_id"),
        "delete_misses": _deletes(1, "request_id", "tenant", "vector_id"),
        "delete_api_keys": _delete_api_keys,
        "authorize_requests": _authorize,
        "resolve_owner": _resolve,
        "registry_append": _registry,
        "user_append": _new_users,
        "api_key_cap": _new_keys,
        "payments_etl": lambda s, d: payments.accepted_transactions(_settled(s, d)),
        "payments_quarantine": lambda s, d: _settled(s, d).rejected.select("event_id", "reject_reason"),
        "payments_replayed": _replayed,
        "credit_grants": _grants,
        "users_after_grants": _after_grants,
        "customer_ids": _customer_ids,
        "credit_ledger": _ledger,
        "closing_balances": lambda s, d: ledger.closing_balances(_ledger(s, d)),
        "database_request_counts": _request_counts,
        "bulk_closing_balances": _bulk_balances,
        "transactions_listing": lambda s, d: tenants.list_transactions(control.stored_transactions(s, d)),
        "api_keys_listing": lambda s, d: tenants.list_api_keys(control.api_keys(s, d)),
        "usage_listing": lambda s, d: tenants.list_usage(control.existing_usage(s, d)).withColumn(
            "usage_date", F.col("usage_date").cast("string")),
        "user_credits": lambda s, d: tenants.user_credits(control.users(s, d)),
        "usage_daily": _usage(False),
        "usage_upserted": _usage(True),
        "usage_retained": _usage(True, retained=True),
        "moderation_report": _moderation,
        "verification_outcomes": _verification,
        "remaining_codes": _remaining,
        "latency_summary": _latency,
        "ingest_rows": _ingest(0),
        "ingest_rejected": _ingest(1),
        "ingest_embedded": _embedded,
        "image_ingest": _images(0),
        "image_rejected": _images(1),
        "moderation_detected": _detected,
        "stream_payments": _stream_payments,
        "stream_search": _stream_search,
        "stream_ingest": _stream_ingest,
        "stream_usage": _stream_usage,
        "stream_ledger": _stream_ledger,
        "stream_ledger_ordered": _stream_ledger_ordered,
        "stream_verification": _stream_verification,
    }

    if llm:
        registered |= llm.queries()

    def configured(run):
        return lambda spark, sf_dir: run(configure(spark), sf_dir)

    return {name: configured(run) for name, run in registered.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same columns and values as the query of that name."""
    return sql.oracle() | (llm.oracle_sql() if llm else {})
