from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from rankloom.llm.sharding import stratified_shards
from tests.llm.samples import no_documents, odd_documents

MANY = [(1000 + i, f"text {i}", "en", "hot" if i % 3 else f"s{i % 5}", 1, None, None) for i in range(900)]


def test_every_row_once_in_even_gapless_shards(spark):
    docs = odd_documents(spark, MANY)
    got = stratified_shards(docs, 7, bucket_rows=64).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_every_shard_holds_the_mixture(spark):
    got = stratified_shards(odd_documents(spark, MANY), 6, bucket_rows=50).collect()
    total = Counter(r.source for r in got)
    for shard in range(6):
        share = Counter(r.source for r in got if r.shard == shard)
        assert all(abs(share[s] - n / 6) < 2.5 for s, n in total.items())


def test_order_does_not_depend_on_buckets_and_follows_the_seed(spark):
    docs = odd_documents(spark, MANY)
    whole = {tuple(r) for r in stratified_shards(docs, 5, bucket_rows=10**6).collect()}
    assert whole == {tuple(r) for r in stratified_shards(docs, 5, bucket_rows=16).collect()}
    assert whole != {tuple(r) for r in stratified_shards(docs, 5, seed=21).collect()}


def test_no_rows_and_fewer_rows_than_shards(spark):
    assert stratified_shards(no_documents(spark)).count() == 0
    assert stratified_shards(odd_documents(spark), 24).select("shard").distinct().count() == 11


def test_main_path_runs_no_python(spark):
    text = stratified_shards(odd_documents(spark)).select("shard")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in text and "Pandas" not in text
