"""Stored posting lists and three-letter runs: same rows as by plain loops, fewer folders read."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import postings, trigram
from rankloom.operators.fulltext import corpus_tokens, text_candidates
from rankloom.sources import index

ASKED = "query_id long, tenant string, text string, candidates long"


def texts(rng, n):
    words = ["red", "reddish", "rod", "cat", "catalog", "dog", "x", "Äpfel", "the", "the", "the"]
    rows = [(i * 700 - 900, f"t{i % 2}", " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(n)]
    return rows + [(10**9, "t0", None), (10**9 + 1, None, "red dog"), (10**9 + 2, "t1", ""), (10**9 + 3, "t1", "ab")]


def corpus_of(spark, rows):
    return spark.createDataFrame(rows, "id long, tenant string, content string")


def found(df):
    return sorted((r.query_id, r.id, r.trank, round(r["rank"], 9)) for r in df.collect())


@pytest.mark.parametrize("depth", [800, 3])
def test_stored_lists_give_the_rows_of_the_scan(spark, tmp_path, depth):
    corpus = corpus_of(spark, texts(random.Random(5), 150))
    asked = ["red", "the re", "the the red", "dog cat", "x nohit", "nohit", "cat dog the c", "äpfel", "the"]
    queries = spark.createDataFrame([(i * 2 + t, f"t{t}", q, depth) for i, q in enumerate(asked) for t in (0, 1)], ASKED)
    want = found(text_candidates(corpus, queries, True, [1, 2, 3, 4, 5]))
    index.write_postings(corpus, f"{tmp_path}/lists{depth}", buckets=16, file_rows=20)
    stored = index.read_postings(spark, f"{tmp_path}/lists{depth}")
    assert want and found(text_candidates(corpus, queries, True, [1, 2, 3, 4, 5], stored)) == want
    assert found(text_candidates(corpus, queries, False, [1, 2, 3, 4, 5], corpus_tokens(corpus))) == want
    scan = stored.of_terms(["red", "dog"])._jdf.queryExecution().executedPlan().toString()
    stated = re.search(r"PartitionFilters: \[[^\]]*term_bucket#\d+ (IN \([^)]*\)|= \d+)", scan)
    assert stated and stated[1].count(",") <= 1


def test_blocks_below_the_bound_are_left_out(spark):
    rows = [(i, "t", "a b " * (12 if i < 1024 else 1) + f"w{i}") for i in range(0, 4096, 8)]
    words = corpus_tokens(corpus_of(spark, rows))
    queries = spark.createDataFrame([(1, "t", "a b", 5)], ASKED)
    lists = postings.posting_rows(words).where("term = 'a'").collect()
    assert {(r.block, r.n_docs, r.most) for r in lists} == {(0, 128, 12), (1, 128, 1), (2, 128, 1), (3, 128, 1)}
    got = text_candidates(corpus_of(spark, rows), queries, False, [1], words).collect()
    assert sorted(r.id for r in got) == [0, 8, 16, 24, 32]


def test_no_rows(spark, tmp_path):
    empty = corpus_of(spark, []).where("id > 0")
    queries = spark.createDataFrame([(1, "t", "a b", 5)], ASKED)
    index.write_postings(empty, f"{tmp_path}/none")
    assert text_candidates(empty, queries, True, [1], index.read_postings(spark, f"{tmp_path}/none")).count() == 0
    trigram.write_windows(empty, f"{tmp_path}/windows")
    assert trigram.substring_lookup(empty, queries, trigram.read_windows(spark, f"{tmp_path}/windows")).count() == 0
    for strategy in ("auto", "prefix"):
        assert trigram.trigram_similarity(empty, queries, strategy=strategy).count() == 0


def test_substrings_equal_a_scan(spark, tmp_path):
    rows = texts(random.Random(6), 120) + [(7, "t0", "100% a_b 🙂🙂🙂 end"), (8, "t0", "🙂🙂"), (9, "t0", "100x aXb")]
    corpus = corpus_of(spark, rows)
    trigram.write_windows(corpus, f"{tmp_path}/windows", buckets=8, file_rows=50)
    stored = trigram.read_windows(spark, f"{tmp_path}/windows")
    asked = ["RED", "d D", "t", "ed", "dish the", "äp", "🙂🙂", "🙂🙂🙂", "100%", "a_b", "ab", "", None, "nothing here", "the the the the"]
    patterns = [(i * 2 + t, f"t{t}", p) for i, p in enumerate(asked) for t in (0, 1)] + [(99, None, "red")]
    want = sorted(
        (q, i) for q, t, p in patterns for i, tenant, text in rows
        if p and t is not None and t == tenant and text is not None and p.lower() in text.lower())
    df = spark.createDataFrame(patterns, "query_id long, tenant string, text string")
    assert sorted(map(tuple, trigram.substring_lookup(corpus, df, stored).collect())) == want
    assert sorted(map(tuple, trigram.substring_lookup(corpus, df, stored, rarest=1).collect())) == want
    plan = stored.of(["red"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", plan)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_rarest_pieces_lose_no_similar_pair(spark, threshold):
    rng = random.Random(4)
    words = ["red", "reddish", "rod", "cat", "catalog", "dog", "x", "the"]
    docs = [(i, f"t{i % 2}", " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(90)] + [(99, None, "red"), (98, "t0", None)]
    asked = [(q, f"t{q % 2}", " ".join(rng.choices(words, k=rng.randint(0, 4)))) for q in range(25)] + [(77, None, "red"), (78, "t1", None)]
    corpus = corpus_of(spark, docs)
    queries = spark.createDataFrame(asked, "query_id long, tenant string, text string")
    a, b = (sorted((r.query_id, r.id, round(r.similarity, 12)) for r in trigram.trigram_similarity(corpus, queries, threshold, s).collect())
            for s in ("auto", "prefix"))
    assert a == b and a


def test_filters_on_promoted_columns_are_pushed_down(spark, tmp_path):
    from rankloom.plans import filters
    from rankloom.plans.search import vector_search
    from rankloom.sources import corpus as store

    metadata = ['{"lang":"en","n":1}', '{"lang":"de","n":2}', '{"lang":5}', '{"lang":"5"}', '{"lang":["en"]}', None, '{"a":{"b":"x"}}']
    rows = [(i, "t", f"d{i}", [1.0, i / 40], "text", metadata[i % 7], "eu") for i in range(70)]
    corpus = spark.createDataFrame(
        rows, "id long, tenant string, vector_id string, embedding array<float>, content string, metadata string, region string")
    fields = {"lang": "$.lang", "b": "$.a.b"}
    store.write_corpus(store.promote(corpus, fields), f"{tmp_path}/rows", buckets=2)
    stored = store.read_corpus(spark, f"{tmp_path}/rows", buckets=2, promoted=fields)
    assert filters.promoted(stored) == {"$.lang": "lang", "$.a.b": "b"}
    asked = ['{"lang":"en"}', '{"lang":"5"}', '{"a":{"b":"x"}}', '{"lang":"de","n":2}', '{"lang":"de","n":3}']

    def found(df, texts):
        queries = spark.createDataFrame(
            [(i, "t", [1.0, 0.1], f) for i, f in enumerate(texts)], "query_id long, tenant string, vector array<float>, filter string")
        return queries, sorted((r.query_id, r["rank"], r.vector_id) for r in vector_search(df, queries).collect())

    for texts in (asked, [*asked, None], [*asked, '{"n":1}']):
        queries, want = found(corpus, texts)
        assert want and found(stored, texts)[1] == want
        plan = filters.bind_filters(stored, queries, sorted({t for t in texts if t}))[0]
        pushed = re.search(r"PushedFilters: \[([^\n]*)\]", plan._jdf.queryExecution().executedPlan().toString())[1]
        assert ("lang" in pushed) == (texts is asked)


def test_groups_of_searches_give_the_rows_of_one_scan(spark, monkeypatch):
    from rankloom.operators import fulltext, wordscan

    corpus = corpus_of(spark, texts(random.Random(5), 150)).withColumn("filter_bits", F.expr("pmod(id div 100, 4)"))
    corpus = corpus.unionByName(corpus.where("id % 3 = 0"))
    asked = ["red", "the re", "the the red", "dog cat", "x nohit", "cat dog the c", "the"]
    queries = spark.createDataFrame([(i * 2 + t, f"t{t}", q, 4) for i, q in enumerate(asked) for t in (0, 1)], ASKED)
    for bit in (None, 1):
        own = queries if bit is None else queries.withColumn("filter_bit", F.lit(bit).cast("long"))
        unique = corpus.dropDuplicates(["id", "tenant"]) if bit is None else corpus
        want = found(text_candidates(unique, own, True, [1, 2, 3]))
        scan, lists = fulltext.word_scan, fulltext.listed_matches
        monkeypatch.setattr(fulltext, "word_scan", lambda c, s: scan(c, s, 8))
        monkeypatch.setattr(fulltext, "listed_matches", lambda *a: lists(*a, hits=8))
        assert want and found(text_candidates(unique, own, True, [1, 2, 3])) == want
        listed = text_candidates(unique, own, True, [1, 2, 3], corpus_tokens(unique.dropDuplicates(["id", "tenant"])))
        assert found(listed) == want
        monkeypatch.undo()
    groups = wordscan.search_groups(queries.toArrow(), 8)
    assert [g.num_rows for g in groups] == [2] * 7


def test_a_task_keeps_its_best_hits(spark):
    """Before, a buffer that was full passed on all its hits: many searches emitted every match."""
    from rankloom.operators.blocks import TopBuffer

    buffer, out = TopBuffer(np.arange(300), np.full(300, 2), 1800), 0
    for n in range(50):
        buffer.add(np.arange(300), np.full(300, n), np.full(300, -1.0 * n))
        out += sum(b.num_rows for b in buffer.drain()) if buffer.full() else 0
    assert out == 0 and sum(b.num_rows for b in buffer.drain()) == 600


def test_lists_move_once_to_their_blocks(spark):
    words = corpus_tokens(corpus_of(spark, [(i, "t", f"a b w{i % 9}") for i in range(60)]))
    queries = spark.createDataFrame([(i, "t", f"a b w{i}", 5) for i in range(9)], ASKED)
    made = text_candidates(corpus_of(spark, []), queries, True, [2], words)
    assert len(made.collect()) == 9 * 5
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_substring_lists_take_two_bytes_a_document(spark, tmp_path):
    ids = [-4097, -4096, -1, 0, 4095, 4096, 1_000_003, (1 << 40) + 4095]
    corpus = spark.createDataFrame([("t", i, f"Some Words {i}") for i in ids] + [("u", 0, "other words")], "tenant string, id long, content string")
    trigram.write_windows(corpus, f"{tmp_path}/windows")
    stored = trigram.read_windows(spark, f"{tmp_path}/windows")
    assert dict(stored.rows.dtypes)["places"] == "array<smallint>"
    asked = spark.createDataFrame([(1, "t", "E WORDS"), (2, "t", "me"), (3, "u", "wor"), (4, "t", "4095")], "query_id long, tenant string, text string")
    found = sorted(map(tuple, trigram.substring_lookup(corpus, asked, stored).collect()))
    has = [i for i in ids if "4095" in str(i)]
    assert found == sorted([(q, i) for q in (1, 2) for i in ids] + [(3, 0)] + [(4, i) for i in has])


@pytest.mark.parametrize("asked_filter", [None, "bit", "text"])
def test_searches_beyond_broadcast_size_scan_in_groups(spark, monkeypatch, asked_filter):
    """Before, their lists were sent to every search, and every filtered match was shuffled."""
    from rankloom.operators import fulltext, wordscan

    corpus = corpus_of(spark, texts(random.Random(8), 120)).withColumn("filter_bits", F.expr("pmod(id div 100, 4)"))
    corpus = corpus.withColumn("metadata", F.concat(F.lit('{"n":'), (F.col("id") % 3).cast("string"), F.lit("}")))
    asked = ["red", "the re", "dog cat", "x nohit", "cat dog the c", "the", "the", ""]
    queries = spark.createDataFrame([(i * 2 + t, f"t{t}", q, 4) for i, q in enumerate(asked) for t in (0, 1)], ASKED)
    queries = queries.unionByName(queries.where("query_id = 2"))
    if asked_filter == "bit":
        queries = queries.withColumn("filter_bit", F.expr("query_id % 2"))
    if asked_filter == "text":
        queries = queries.withColumn("filter", F.when(F.col("query_id") % 4 < 2, '{"n":1}'))
    for terms in (None, corpus_tokens(corpus)):
        want = found(text_candidates(corpus, queries, True, [1, 2, 3], terms))
        made, scan, lists = [], fulltext.word_scan, fulltext.listed_matches
        fetch = wordscan.StoredGroups.__iter__
        monkeypatch.setattr(fulltext, "word_scan", lambda c, s: scan(c, s, 8))
        monkeypatch.setattr(fulltext, "listed_matches", lambda *a: lists(*a, hits=8))
        monkeypatch.setattr(wordscan.StoredGroups, "__iter__", lambda self: (made.append(g.num_rows) or g for g in fetch(self)))
        assert want and found(text_candidates(corpus, queries, False, [1, 2, 3], terms)) == want
        monkeypatch.undo()
        assert len(made) > 1 and max(made) <= 8


def test_only_documents_that_can_rank_are_scored(spark):
    """Before, the covers of every match were made, whatever the cut-off."""
    import pyarrow as pa

    from rankloom.operators import wordscan
    from rankloom.operators.blocks import TopBuffer

    slots = [[{"term": "a", "is_prefix": False}, {"term": "b", "is_prefix": True}]]
    table = pa.table({"query_id": [7], "candidates": [1], "slots": slots})
    searches, buffer = wordscan.Searches.build(table), TopBuffer(np.array([7]), np.array([1]))
    some = wordscan._postings(pa.array([["a", "b"], ["a", "x", "b"] * 9, ["x"], ["a"] * 50 + ["b"]]), searches)
    assert [d.tolist() for _, d, _ in wordscan._matches(some, searches, buffer.cutoff)] == [[0, 1, 3]]
    buffer.cutoff[:] = -0.3
    assert [d.tolist() for _, d, _ in wordscan._matches(some, searches, buffer.cutoff)] == [[1]]


def test_pieces_of_a_text_are_made_once(spark):
    """Before, each of two filters on the size of a set made it again."""
    corpus = corpus_of(spark, [(1, "t", "red dog red dog cat"), (2, "t", "!"), (3, "t", None), (4, "t", "dog dog")])
    queries = spark.createDataFrame([(7, "t", "dog red", 9)], ASKED)
    found = trigram.trigram_similarity(corpus, queries)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(flatten(") == 1
    assert {(r.id, round(r.similarity, 6)) for r in found.collect()} == {(1, round(8 / 12, 6)), (4, 0.5)}
    first = corpus.where("id = 1").select(trigram.trigrams(F.col("content"))).first()[0]
    assert first == ["  r", " re", "red", "ed ", "  d", " do", "dog", "og ", "  c", " ca", "cat", "at "]


def test_a_vocabulary_is_never_broadcast(spark):
    """Before, keys made of a vocabulary were broadcast by the size of its files: 5,093,939 rows of 7.6 MB."""
    from rankloom.operators import fulltext
    from rankloom.operators.postings import Postings, asked_rows, expanded_keys

    corpus = corpus_of(spark, texts(random.Random(9), 60))
    stored = Postings.of_words(corpus_tokens(corpus))
    asked = [(1, "t0", "red dog"), (2, "t0", "re"), (3, "t1", "the catalogues"), (4, "t1", "x reddish the c"), (5, "t0", "catalog")]
    queries = spark.createDataFrame(asked, "query_id long, tenant string, text string")
    slots = queries.select("query_id", "tenant", F.lit(3).alias("candidates"), fulltext.query_slots(F.col("text")).alias("slots"))
    slots, widths = fulltext.slots_of(slots), [1, 2, 3, 7, 10]
    keys = expanded_keys(stored.vocabulary, slots, widths, fulltext._keyed, fulltext._wanted)
    rows = asked_rows(stored.rows, slots, widths, fulltext._wanted)
    assert "Broadcast" not in keys._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in rows._jdf.queryExecution().executedPlan().toString()
    want = {("t0", t) for t in ("red", "dog", "reddish", "catalog")} | {("t1", t) for t in ("the", "x", "reddish", "cat", "catalog")}
    assert {(r.tenant, r.term) for r in keys.collect()} == {(r.tenant, r.term) for r in rows.collect()} == want
    assert postings.lists_of(postings.block_words(corpus_tokens(corpus)), ["tenant"])._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_covers_follow_from_the_neighbours_of_the_rarest_word(monkeypatch):
    """Before, every hit of every word of a match was sorted; now that is left to searches of many words."""
    import pyarrow as pa

    from rankloom.operators import wordscan
    from rankloom.operators.blocks import TopBuffer

    rng = random.Random(11)
    docs = [rng.choices(["a", "ab", "b", "c", "ca", "x", "y"], k=rng.randint(1, 30)) for _ in range(150)] + [["a"], ["x"] * 40 + ["a", "c", "b"]]
    asked = [[("a", False)], [("a", True)], [("b", False), ("a", True)], [("a", False), ("a", True)], [("a", False), ("b", False), ("c", True)],
             [("a", False), ("ab", False), ("a", True)], [("c", False), ("x", False), ("a", True)], [("a", False), ("b", False), ("c", False), ("x", True)]]
    slots = [[{"term": t, "is_prefix": p} for t, p in words] for words in asked]
    table = pa.table({"query_id": range(len(asked)), "candidates": [999] * len(asked), "slots": slots})
    batch = pa.record_batch({"id": pa.array(range(len(docs)), pa.int64()), "tokens": docs})

    def rank(words, doc):
        hits = [[i for i, t in enumerate(doc) if (t.startswith(w) if p else t == w)] for w, p in words]
        spots = sorted({i for own in hits for i in own})
        covers = [(s, e) for s in spots for e in spots if all(any(s <= i <= e for i in own) for own in hits)]
        least = [c for c in covers if not any(o != c and c[0] <= o[0] and o[1] <= c[1] for o in covers)]
        return sum(0.1 / (1 + e - s + 1 - sum(s <= i <= e for i in spots)) for s, e in least)

    def ranked(table, searches):
        buffer = TopBuffer(searches.ids, searches.depth)
        assert not list(wordscan.scan_tokens(batch, searches, buffer, None))
        return {(q, i): round(-c, 9) for b in buffer.drain() for q, i, c in zip(*(b.column(n).to_pylist() for n in range(3)))}

    want = {(q, i): round(r, 9) for q, words in enumerate(asked) for i, doc in enumerate(docs) if (r := rank(words, doc))}
    assert ranked(table, wordscan.Searches.build(table)) == want and len(want) > 500
    monkeypatch.setattr(wordscan, "_FEW", 0)
    assert ranked(table, wordscan.Searches.build(table)) == want
    monkeypatch.undo()
    monkeypatch.setattr(wordscan, "cover_ranks", None)
    few = table.slice(0, len(asked) - 1)
    assert ranked(few, wordscan.Searches.build(few)) == {at: r for at, r in want.items() if at[0] < few.num_rows}


def test_patterns_of_one_text_share_a_search(spark, tmp_path):
    """Before, every pattern was looked up alone, and a text was lower-cased for every pattern that it might hold."""
    corpus = corpus_of(spark, [(1, "t", "Red dog"), (1, "t", "red dogs"), (2, "t", "dog RED"), (1, "u", "red")])
    trigram.write_windows(corpus, f"{tmp_path}/windows")
    stored = trigram.read_windows(spark, f"{tmp_path}/windows")
    schema = "query_id long, tenant string, text string"
    asked = [(1, "t", "red"), (2, "t", "RED"), (3, "t", "Ed"), (4, "t", "eD"), (5, "u", "red"), (6, "t", "red dog")]
    found = trigram.substring_lookup(corpus, spark.createDataFrame(asked, schema), stored)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(content" in plan and "Contains(lower(" not in plan and "contains(lower(" not in plan.lower()
    want = sorted([(q, i) for q in (1, 2, 3, 4) for i in (1, 2)] + [(5, 1), (6, 1)])
    assert sorted(map(tuple, found.collect())) == want
    # The same pattern again, and a query with two patterns: a document is found once.
    again = spark.createDataFrame([*asked, asked[0], asked[3], (6, "t", "dog"), (5, "t", "dog")], schema)
    assert sorted(map(tuple, trigram.substring_lookup(corpus, again, stored).collect())) == sorted([*want, (6, 2), (5, 2)])


def test_best_hits_are_sorted_some_queries_at_a_time():
    """Before, all hits of a buffer were copied and sorted at once, which took several times their size."""
    import tracemalloc

    from rankloom.operators.blocks import TopBuffer

    rng = np.random.default_rng(3)
    query, ids, cost = rng.integers(0, 500, 3_000_000), rng.permutation(3_000_000), rng.integers(0, 900, 3_000_000) / 9
    buffer = TopBuffer(np.arange(500) + 7, np.full(500, 40), 10_000_000)
    for part in np.array_split(np.arange(3_000_000), 5):
        buffer.add(query[part], ids[part], cost[part])
    tracemalloc.start()
    out = list(buffer.drain())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 24 * 3_000_000 and not buffer.size
    got = [(q, c, i) for b in out for q, i, c in zip(*(b.column(n).to_pylist() for n in range(3)))]
    order = np.lexsort((ids, cost, query))
    place = np.arange(3_000_000) - np.searchsorted(query[order], query[order])
    best = order[place < 40]
    assert got == list(zip((query[best] + 7).tolist(), cost[best].tolist(), ids[best].tolist()))
    assert list(buffer.cutoff) == [got[40 * q + 39][1] for q in range(500)]


def test_hits_of_a_document_that_stands_twice_count_once():
    import pyarrow as pa

    from rankloom.operators import wordscan

    slots = [[{"term": "a", "is_prefix": False}, {"term": "b", "is_prefix": False}, {"term": "c", "is_prefix": True}], [{"term": "a", "is_prefix": True}]]
    searches = wordscan.Searches.build(pa.table({"query_id": [1, 2], "candidates": [9, 9], "slots": slots}))
    positions = {"a": [0, 3, 9], "b": [1, 6], "c": [2, 4, 5, 12], "ab": [7]}

    def ranks(times):
        flat = np.array([x for own in positions.values() for x in own for _ in range(times)])
        counts = np.array([times * len(own) for own in positions.values()])
        made, docs = wordscan.listed_postings(pa.array(list(positions)), np.ones(4, np.int64), np.full(4, 5), counts, flat, searches)
        found = list(wordscan._ranks(made, searches, np.array([0, 1]), np.array([0, 0]), searches.words))
        return docs.tolist(), [(p.tolist(), r.round(9).tolist()) for p, r in found]

    assert ranks(1) == ranks(2) == ranks(3)
