from __future__ import annotations

import base64
import pytest
from pyspark.sql import functions as F

from rankloom.functions.models import hashed_image_embedder, hashed_text_embedder
from rankloom.plans import ledger, payments, usage, verification
from rankloom.plans.search import search
from rankloom.sources import corpus as store
from rankloom.sources.files import load_files
from rankloom.sources.index import read_index, write_index
from rankloom.streaming import ingest, stateful, tables
from rankloom.streaming import usage as usage_streams
from test_plans import at, event

def as_stream(spark, df, path, files=1):
    df.repartition(files).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def test_ingest_streams_write_rows_and_rejects(spark, tmp_path):
    rows = [(i, 1, "docs", "eu" if i % 4 else "mars", f"text number {i}", '{"n":%d}' % i if i % 2 else "[1]") for i in range(20)]
    df = spark.createDataFrame(rows, "request_id long, user_id int, database string, region string, text string, metadata string")
    stream = as_stream(spark, df, tmp_path / "in", 3)
    for query in ingest.start_ingest(
        stream, hashed_text_embedder(8), str(tmp_path / "corpus"), str(tmp_path / "bad"), str(tmp_path / "cp"),
        vector_id=store.content_id(F.col("tenant"), F.col("content")),
    ):
        query.awaitTermination(120)
    corpus = store.read_corpus(spark, str(tmp_path / "corpus"))
    assert corpus.count() == 15 and corpus.select("vector_id").distinct().count() == 15
    assert corpus.where("size(embedding) = 8 AND abs(norm - 1) < 1e-6").count() == 15
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 5
    one = store.scan_tenant(corpus, "1-docs", "eu")
    assert one.count() == 15
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = store.scan_tenant(corpus, "1-docs", "eu")._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "region" in pruned and "tenant_bucket" in pruned and "xxhash64" not in pruned
    found = corpus.first().vector_id
    assert store.find_document(corpus, "1-docs", found).count() == 1
    hits = search(corpus, spark.createDataFrame([(1, "1-docs", "number 1")], "query_id long, tenant string, text string"))
    assert {r.content for r in hits.collect()} == {f"text number {i}" for i in (1, 10, 11, 13, 14, 15, 17, 18, 19)}


def test_image_ingest_checks_the_payload(spark):
    rows = [(1, 7, "img", "eu", base64.b64encode(b"abc").decode(), None), (2, 7, "img", "eu", "???", None)]
    df = spark.createDataFrame(rows, "request_id long, user_id int, database string, region string, image string, metadata string")
    good, bad = store.ingest_images(df, hashed_image_embedder(8))
    row = good.first()
    assert (row.tenant, row.content, row.metadata, len(row.embedding)) == ("7-img", None, "{}", 8)
    assert [(r.request_id, r.reject_reason) for r in bad.collect()] == [(2, "ImageProcessing")]
    sized, wrong = store.check_inserts(df.withColumn("embedding", F.array(F.lit(1.0))), dim=2)
    assert sized.count() == 0 and {r.reject_reason for r in wrong.collect()} == {"EmbeddingDimension"}


def test_usage_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, at(i * 97 % 4000), 1 + i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, user_id int, ts timestamp_ntz, count long")
    got = drain(usage_streams.usage_stream(as_stream(spark, df, tmp_path / "in")), "usage_out", "update")
    key = lambda d: {(r.user_id, str(r.usage_date), r.credits_used) for r in d.collect()}
    assert key(got) == key(usage.usage_daily(df))


def test_ledger_stream_equals_batch(spark, tmp_path):
    rows = [(i % 4, i, at(i), -1 if i % 3 else 2, 1) for i in range(120)]
    df = spark.createDataFrame(rows, "user_id int, event_id long, ts timestamp_ntz, delta long, opening long")
    got = drain(stateful.ledger_stream(as_stream(spark, df, tmp_path / "in")), "ledger_out")
    key = lambda d: {(r.event_id, r.balance, r.denied) for r in d.collect()}
    assert key(got) == key(ledger.unit_ledger(df))
    assert ingest.charges(df).where("delta = -1").count() == 120


def test_verification_stream_equals_batch(spark, tmp_path):
    codes = spark.createDataFrame([(i, f"u{i % 5}", 1, at(i * 7)) for i in range(30)],
                                  "code_id long, email string, code short, issued_at timestamp_ntz")
    attempts = spark.createDataFrame([(i, f"u{i % 6}", 1, at(i * 5 + 1)) for i in range(40)],
                                     "attempt_id long, email string, code short, attempted_at timestamp_ntz")
    stream = stateful.verification_stream(
        as_stream(spark, codes, tmp_path / "c"), as_stream(spark, attempts, tmp_path / "a"))
    got = drain(stream, "codes_out")
    key = lambda d: {(r.attempt_id, r.outcome) for r in d.collect()}
    assert key(got) == key(verification.verification_outcomes(codes, attempts))
    assert len({o for _, o in key(got)}) == 3


def test_payment_stream_equals_batch(spark, tmp_path):
    users = spark.createDataFrame([(1, "a@x", 5)], "id int, email string, credits int")
    folder = str(tmp_path / "in")
    for part in range(3):
        rows = [(part * 10 + i, event(id=f"t{(part + i) % 5}", items=[] if i == 3 else event_items())) for i in range(5)]
        spark.createDataFrame(rows, "event_id long, payload string").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("event_id long, payload string").option("maxFilesPerTrigger", 1).parquet(folder)
    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    query = tables.start_payments(stream, users, out, bad, str(tmp_path / "cp"))
    query.awaitTermination(180)
    assert query.exception() is None
    batch = payments.settle(spark.read.parquet(folder), users)
    want = {r.transaction_id for r in payments.accepted_transactions(batch).collect()}
    got = [r.transaction_id for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert spark.read.parquet(bad).count() == batch.rejected.count()

    # A new checkpoint goes on from what is stored: no row is lost, no id is taken twice.
    later = stream.unionByName(stream.select((F.col("event_id") + 1000).alias("event_id"), F.lit(event(id="new")).alias("payload")))
    query = tables.start_payments(later, lambda: users, out, bad, str(tmp_path / "another"))
    query.awaitTermination(180)
    assert query.exception() is None
    got = [r.transaction_id for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == want | {"new"}


def event_items():
    import json
    return json.loads(event())["data"]["items"]


def test_search_stream_equals_batch(spark, tmp_path):
    corpus = spark.createDataFrame(
        [(i, "t", f"d{i}", [1.0, i / 9], f"word{i} common", "{}") for i in range(12)],
        "id long, tenant string, vector_id string, embedding array<float>, content string, metadata string")
    asked = spark.createDataFrame([(i, "t", "common wo", [1.0, i / 3]) for i in range(4)],
                                  "query_id long, tenant string, text string, vector array<float>")
    stream = as_stream(spark, asked, tmp_path / "in", 2)
    query = tables.start_search(stream, corpus, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(180)
    assert query.exception() is None
    key = lambda d: {(r.query_id, r["rank"], r.vector_id) for r in d.collect()}
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(search(corpus, asked))


def test_stored_word_index_gives_the_same_search(spark, tmp_path):
    corpus = spark.createDataFrame(
        [(i, f"t{i % 2}", f"d{i}", [1.0, i / 9], f"alpha beta{i} gamma alphabet", '{"p":%d}' % (i % 3)) for i in range(20)],
        "id long, tenant string, vector_id string, embedding array<float>, content string, metadata string")
    write_index(corpus, str(tmp_path / "index"), buckets=4, file_rows=30)
    asked = spark.createDataFrame(
        [(1, "t0", "gamma alph", [1.0, 0.2], None), (2, "t1", "beta", [1.0, 0.5], '{"p":1}')],
        "query_id long, tenant string, text string, vector array<float>, filter string")
    key = lambda d: {(r.query_id, r["rank"], r.vector_id, round(r.score, 9)) for r in d.collect()}
    want = key(search(corpus, asked))
    assert key(search(corpus, asked, terms=read_index(spark, str(tmp_path / "index")))) == want
    promoted = store.promote(corpus, {"p": "$.p"})
    assert promoted.where("p = '1'").count() == 7


def test_corpus_layout_and_file_loads(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.txt").write_text("hello\nworld")
    (folder / "b.txt").write_text("second file")
    texts = load_files(spark, str(folder), "text", 5, "docs", "eu", hashed_text_embedder(8))
    rows = {r.metadata: r for r in texts.collect()}
    assert rows['{"filename":"a.txt"}'].content == "hello\nworld"
    store.write_corpus(texts, str(tmp_path / "corpus"), buckets=4, file_rows=1)
    again = store.read_corpus(spark, str(tmp_path / "corpus"), buckets=4)
    assert store.scan_tenant(again, "5-docs").count() == 2

    @F.pandas_udf("string")
    def extract(data):
        return data.map(lambda b: b.decode())

    pdfs = load_files(spark, str(folder), "pdf", 5, "docs", "eu", hashed_text_embedder(8), extract)
    assert {r.content for r in pdfs.collect()} == {"hello world", "second file"}
    images = load_files(spark, str(folder), "image", 5, "pics", "eu", hashed_image_embedder(8))
    assert {(r.content, len(r.embedding)) for r in images.collect()} == {(None, 8)}
    assert load_files(spark, str(folder), "video", 5, "docs", "eu", None) is None
    with pytest.raises(ValueError):
        load_files(spark, str(folder), "pdf", 5, "docs", "eu", None)
