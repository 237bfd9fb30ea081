from __future__ import annotations

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions.models import hashed_image_embedder, hashed_text_embedder
from rankloom.operators import ann
from rankloom.operators.fulltext import corpus_tokens, text_candidates
from rankloom.operators.knn import knn
from rankloom.operators.topk import nearest
from rankloom.plans import search as plans
from rankloom.sources import corpus as store

CORPUS = "id long, tenant string, vector_id string, embedding array<float>, content string, metadata string"


def brute_knn(docs, queries, threshold):
    out = set()
    for qid, tenant, vector, depth in queries:
        found = []
        q = np.array(vector, dtype=float)
        for did, t, e in docs:
            if t != tenant or e is None or len(e) != len(vector):
                continue
            d = np.array(e, dtype=np.float32).astype(float)
            length = np.linalg.norm(d) * np.linalg.norm(q)
            if length:
                dist = round(1 - float(np.clip(d @ q / length, -1, 1)), 12)
                if threshold is None or dist < threshold:
                    found.append((round(dist, 9), did))
        found.sort()
        out |= {(qid, did, n + 1) for n, (_, did) in enumerate(found[:depth])}
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(3)
    vec = lambda: [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]
    # Two thirds of all rows belong to one tenant.
    docs = [(i, "big" if i % 3 else f"t{i % 4}", vec()) for i in range(400)]
    docs += [(1000, "big", None), (1001, "big", [0.0] * 6), (1002, "big", [1.0] * 5)]
    docs += [(1003, "big", docs[1][2]), (1004, "big", docs[1][2])]
    queries = [(q, "big" if q % 2 else f"t{q % 4}", vec(), 5 + q) for q in range(30)]
    queries += [(100, "big", docs[1][2], 3), (101, "big", [0.0] * 6, 3), (102, "nobody", vec(), 3)]
    return (
        docs, queries,
        spark.createDataFrame(docs, "id long, tenant string, embedding array<float>"),
        spark.createDataFrame(queries, "query_id long, tenant string, vector array<float>, candidates long"),
    )


@pytest.mark.parametrize("threshold", [0.7, None])
@pytest.mark.parametrize("strategy", ["broadcast", "blocks"])
def test_knn_equals_brute_force(vectors, threshold, strategy):
    docs, queries, corpus, asked = vectors
    got = knn(corpus, asked, threshold, strategy=strategy, query_block=4, corpus_block=50)
    assert {(r.query_id, r.id, r.vrank) for r in got.collect()} == brute_knn(docs, queries, threshold)


def test_nearest_to_one_vector(vectors):
    docs, queries, corpus, _ = vectors
    rows = nearest(corpus.where("tenant = 'big'"), queries[1][2], 5).collect()
    best = brute_knn(docs, [(1, "big", queries[1][2], 5)], None)
    assert [(1, r.id, n + 1) for n, r in enumerate(rows)] == sorted(best, key=lambda x: x[2])


def test_filters_as_data_match_compiled_filters(spark):
    rows = [(i, "t", f"d{i}", [1.0, i / 50], "word", f'{{"n":{i % 7},"tags":["x{i % 3}"]}}') for i in range(60)]
    corpus = spark.createDataFrame(rows, CORPUS)
    wanted = ['{"n":%d}' % n for n in range(7)] + ['{"tags":["x1"]}', None, "null", '{"n":"3"}']
    asked = spark.createDataFrame(
        [(i, "t", "wor", [1.0, 0.3], w) for i, w in enumerate(wanted)],
        "query_id long, tenant string, text string, vector array<float>, filter string",
    )
    few = {(r.query_id, r["rank"], r.vector_id) for r in plans.search(corpus, asked).collect()}
    # Seventy more filters than can be compiled, on other queries.
    more = spark.createDataFrame(
        [(1000 + i, "t", "wor", [1.0, 0.3], '{"n":%d}' % (100 + i)) for i in range(70)], asked.schema
    )
    many = {(r.query_id, r["rank"], r.vector_id) for r in plans.search(corpus, asked.unionByName(more)).collect()}
    assert few == many
    found = {q: {v for a, _, v in few if a == q} for q in range(len(wanted))}
    assert found[3] <= {f"d{i}" for i in range(60) if i % 7 == 3} and found[3]
    assert len(found[8]) == len(found[9]) == 10 and not found[10]


def minimal_covers(slots, hits):
    """All minimal spans holding every slot, by trying every span."""
    places = sorted({p for ps in hits for p in ps})
    spans = [
        (a, b) for a in places for b in places
        if a <= b and all(any(a <= p <= b for p in ps) for ps in hits)
    ]
    return [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)], places


def brute_text(docs, text):
    words = text.split()
    slots = list(dict.fromkeys(words[:-1]))
    ranks = {}
    for did, content in docs:
        tokens = content.split()
        hits = [[i for i, t in enumerate(tokens) if t == s] for s in slots]
        hits.append([i for i, t in enumerate(tokens) if t.startswith(words[-1])])
        if all(hits):
            covers, places = minimal_covers(slots, hits)
            rank = sum(0.1 / (1 + (b - a) - (sum(a <= p <= b for p in places) - 1)) for a, b in covers)
            ranks[did] = round(rank, 9)
    order = sorted(ranks, key=lambda d: (-ranks[d], d))
    return {(d, n + 1, ranks[d]) for n, d in enumerate(order)}


def test_cover_density_in_both_plans_equals_enumeration(spark):
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "ab", "abc", "x", "y"]) for _ in range(rng.randint(0, 14))))
            for i in range(120)]
    texts = ["a b", "b a b", "a a", "a", "x y a", "ab a b c", "nohit a", "abc"]
    corpus = spark.createDataFrame([(i, "t", c) for i, c in docs], "id long, tenant string, content string")
    asked = spark.createDataFrame(
        [(q, "t", t, 800) for q, t in enumerate(texts + texts)],
        "query_id long, tenant string, text string, candidates long",
    )
    want = {(q, *hit) for q, t in enumerate(texts + texts) for hit in brute_text(docs, t)}
    for options in ({"small": True}, {"small": False}, {"small": True, "terms": corpus_tokens(corpus)}):
        got = text_candidates(corpus, asked, widths=[1, 2, 3], **options)
        assert {(r.query_id, r.id, r.trank, round(r["rank"], 9)) for r in got.collect()} == want, options


def test_long_prefixes_are_verified(spark):
    words = ["abcdefghijklmnop", "abcdefghijklmxyz"]
    corpus = spark.createDataFrame([(i, "t", w) for i, w in enumerate(words)], "id long, tenant string, content string")
    asked = spark.createDataFrame([(1, "t", "abcdefghijklmn", 9)], "query_id long, tenant string, text string, candidates long")
    for small in (True, False):
        assert [r.id for r in text_candidates(corpus, asked, small, widths=[12]).collect()] == [0]


@pytest.fixture(scope="module")
def library(spark):
    rows = [
        (1, "u", "d1", [1.0, 0.0], "red apple pie", '{"k":1}'),
        (2, "u", "d2", [0.9, 0.1], "green apple", '{"k":2}'),
        (3, "u", "d3", [0.0, 1.0], "red car", None),
        (4, "u", "d4", None, "apple without vector", "{}"),
    ]
    return spark.createDataFrame(rows, CORPUS)


def ask(spark, *rows):
    ddl = "query_id long, tenant string, text string, vector array<float>, page int, limit int"
    return spark.createDataFrame(list(rows), ddl)


def test_hybrid_scores_and_modes(spark, library):
    got = plans.search(
        library,
        ask(spark, (1, "u", "red app", [1.0, 0.0], None, None), (2, "u", "?!", [1.0, 0.0], None, None),
            (3, "u", "  ", [1.0, 0.0], None, None), (4, "u", "apple", [0.0, -1.0], None, None)),
    ).collect()
    by = {(r.query_id, r.vector_id): r for r in got}
    assert by[1, "d1"].score == pytest.approx(100) and by[1, "d1"].score_pct == "100.0%"
    assert by[1, "d2"].score == pytest.approx(61 / 62 * 50)
    # Punctuation still means hybrid: no text leg, so half the scale at most.
    assert by[2, "d1"].score == pytest.approx(50)
    assert by[3, "d1"].score == pytest.approx(100) and by[3, "d2"].score == pytest.approx(99.388, abs=1e-3)
    # A document without a vector is still found by its text.
    assert {k[1] for k in by if k[0] == 4} == {"d1", "d2", "d4"}


def test_pages_and_limits(spark, library):
    got = plans.vector_search(
        library, ask(spark, (1, "u", None, [1.0, 0.1], 2, 1), (2, "u", None, [1.0, 0.1], 900, 1),
                     (3, "u", None, [1.0, 0.1], 1, 0)))
    assert [(r.query_id, r["rank"], r.vector_id) for r in got.collect()] in ([(1, 2, "d2")], [(1, 2, "d1")])
    with pytest.raises(Exception, match="page must be at least 1"):
        plans.vector_search(library, ask(spark, (1, "u", None, [1.0, 0.0], 0, 1))).collect()


def test_unpinned_query_tables_give_the_same_rows(spark, library, monkeypatch):
    asked = ask(spark, (1, "u", "red app", [1.0, 0.0], None, None), (2, "u", "", [0.0, 1.0], None, None),
                (3, "u", "apple", [0.5, 0.5], 1, 2))
    want = {(r.query_id, r["rank"], r.vector_id, round(r.score, 9)) for r in plans.search(library, asked).collect()}
    monkeypatch.setattr(plans, "BROADCAST_QUERIES", 0)
    monkeypatch.setattr(plans, "broadcastable", lambda rows, widest: False)
    got = plans.search(library, asked, strategy="blocks")
    assert {(r.query_id, r["rank"], r.vector_id, round(r.score, 9)) for r in got.collect()} == want


def test_dashboard_search(spark, library):
    rows = [(1, "u", "id", "d3", None), (2, "u", "text", "apple", [1.0, 0.0]), (3, "u", "image", "", [0.0, 1.0]),
            (4, "u", "id", "nothing", None)]
    asked = spark.createDataFrame(rows, "query_id long, tenant string, search_type string, data string, vector array<float>")
    got = plans.dashboard_search(library, asked).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert [(r.vector_id, r.score) for r in by[1]] == [("d3", None)]
    assert len(by[2]) == 3 and [r.vector_id for r in by[3]] == ["d3"] and 4 not in by


def test_router_picks_the_model(spark):
    image = base64.b64encode(b"picture").decode()
    rows = [(1, "u", "text", "hello", None), (2, "u", "image", "hello", None), (3, "u", "text", "hello", image),
            (4, "u", "text", None, None), (5, "u", "image", None, "***"), (6, "u", "image", None, image)]
    asked = spark.createDataFrame(rows, "query_id long, tenant string, db_type string, text string, image string")
    good, bad = plans.route(
        asked, hashed_text_embedder(8), hashed_text_embedder(8, "cross-modal"), hashed_image_embedder(8))
    got = {r.query_id: r for r in good.collect()}
    assert {r.query_id: r.reject_reason for r in bad.collect()} == {4: "MissingData", 5: "ImageProcessing"}
    assert got[1].vector != got[2].vector and got[3].vector == got[6].vector and got[3].text == "hello"


def test_approximate_search_reports_its_recall(spark, vectors):
    _, _, corpus, asked = vectors
    centres = ann.train_cells(corpus, 4)
    celled = ann.assign_cells(corpus.where("embedding IS NOT NULL AND size(embedding) = 6"), centres)
    exact = knn(corpus, asked)
    everything = ann.probe(celled, asked.where("query_id <> 101"), centres, probes=4)
    assert ann.recall(exact, everything).first().recall == 1.0
    some = ann.recall(exact, ann.probe(celled, asked, centres, probes=2)).first().recall
    assert 0.3 < some <= 1.0


def test_trigram_similarity_equals_brute_force(spark):
    from rankloom.operators.trigram import trigram_similarity

    def grams(text):
        return {f"  {w} "[i : i + 3] for w in text.lower().split() for i in range(len(w) + 1)}

    rng = random.Random(4)
    words = ["red", "reddish", "rod", "cat", "catalog", "dog", "x"]
    docs = [(i, f"t{i % 2}", " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(80)]
    asked = [(q, f"t{q % 2}", " ".join(rng.choices(words, k=rng.randint(0, 4)))) for q in range(20)]
    corpus = spark.createDataFrame(docs, "id long, tenant string, content string")
    queries = spark.createDataFrame(asked, "query_id long, tenant string, text string")
    for threshold in (0.3, 0.8, 1.0):
        want = set()
        for q, t, text in asked:
            for d, tenant, content in docs:
                a, b = grams(text), grams(content)
                if t == tenant and a and b and len(a & b) / len(a | b) >= threshold:
                    want.add((q, d, round(len(a & b) / len(a | b), 9)))
        got = trigram_similarity(corpus, queries, threshold).collect()
        assert len(got) == len(want)
        assert {(r.query_id, r.id, round(r.similarity, 9)) for r in got} == want


def repeated_ids(spark):
    """Ids 0-9 in two tenants each, with their own metadata."""
    rows = [(i, t, f"{t}{i}", [1.0, i / 9], f"alpha beta{i} gamma", '{"p":%d}' % ((i + shift) % 3))
            for t, shift in (("a", 0), ("b", 1)) for i in range(10)]
    return spark.createDataFrame(
        rows, "id long, tenant string, vector_id string, embedding array<float>, content string, metadata string")


@pytest.mark.parametrize("stored_words", [False, True])
@pytest.mark.parametrize("filters", [1, 70])
def test_ids_that_tenants_share_stay_apart(spark, filters, stored_words):
    corpus = repeated_ids(spark)
    wanted = ['{"p":1}'] if filters == 1 else ['{"p":1}'] + ['{"q":%d}' % i for i in range(filters)]
    rows = [(n, "ab"[n % 2], "gamma", [1.0, 0.2], w, 100) for n, w in enumerate(wanted)]
    rows.append((1000, "b", "gamma", [1.0, 0.2], '{"p":1}', 100))
    asked = spark.createDataFrame(
        rows, "query_id long, tenant string, text string, vector array<float>, filter string, limit int")
    terms = corpus_tokens(corpus) if stored_words else None
    found = plans.search(corpus, asked, terms=terms).collect()
    for query, tenant, shift in ((0, "a", 0), (1000, "b", 1)):
        own = sorted(r.vector_id for r in found if r.query_id == query)
        assert own == sorted(f"{tenant}{i}" for i in range(10) if (i + shift) % 3 == 1)
    assert {r.query_id for r in found} == {0, 1000}


def test_every_scan_of_a_stored_corpus_is_pruned(spark, tmp_path):
    rows = [(i, f"t{i % 9}", f"d{i}", [1.0, i / 90], f"common word{i}", "{}", ["common", f"word{i}"], 1.0, None, "eu") for i in range(90)]
    corpus = spark.createDataFrame(
        rows, "id long, tenant string, vector_id string, embedding array<float>, content string, metadata string, "
        "tokens array<string>, norm double, created_at timestamp_ntz, region string")
    # One tenant holds a third of all rows: its folder is cut into files by its size.
    hot = corpus.withColumn("tenant", F.when(F.col("id") % 3 == 0, "t0").otherwise(F.col("tenant")))
    store.write_corpus(hot, str(tmp_path / "c"), buckets=16, file_rows=10)
    again = store.read_corpus(spark, str(tmp_path / "c"), buckets=16)
    asked = spark.createDataFrame([(1, "t0", "common", [1.0, 0.2]), (2, "t4", "word4", [1.0, 0.2])],
                                  "query_id long, tenant string, text string, vector array<float>")
    found = plans.search(again, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) >= 3
    assert all("PartitionFilters: []" not in s and "tenant_bucket" in s.split("PartitionFilters:")[1] for s in scans)
    def key(df):
        return {(r.query_id, r["rank"], r.vector_id) for r in df.collect()}
    assert key(found) == key(plans.search(hot, asked))
    files = hot.where("tenant = 't0'").count() / 10
    assert again.where("tenant = 't0'").select(F.input_file_name().alias("f")).distinct().count() >= files / 2


def test_cells_of_every_width_prune_and_lose_nothing(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "t", [rng.gauss(0, 1) for _ in range(3 if i % 2 else 5 if i % 7 else 4)]) for i in range(200)]
    corpus = spark.createDataFrame(rows, "id long, tenant string, embedding array<float>")
    asked = spark.createDataFrame([(w, "t", [1.0] * w, 50) for w in (3, 4, 5, 6)],
                                  "query_id long, tenant string, vector array<float>, candidates int")
    centres = ann.train_cells(corpus, 6)
    assert set(centres) == {3, 4, 5}
    del centres[4]
    ann.write_cells(ann.assign_cells(corpus, centres), str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    exact = {(r.query_id, r.id) for r in knn(corpus, asked, None).collect()}
    every = ann.probe(stored, asked, centres, 6, None)
    assert {(r.query_id, r.id) for r in every.collect()} == exact
    some = ann.probe(stored, asked.where("query_id = 3"), centres, 2, None)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters:")[1].splitlines()[0]


def test_dashboard_requests_are_routed_or_rejected(spark, library):
    picture = base64.b64encode(b"some bytes").decode()
    rows = [(1, "u", "text", "text", "apple"), (2, "u", "image", "text", "apple"), (3, "u", "text", "image", picture),
            (4, "u", "text", "id", "d3"), (5, "u", "text", "audio", "x"), (6, "u", "sound", "text", "x"),
            (7, "u", "text", None, "x"), (8, "u", "text", "image", "?!")]
    asked = spark.createDataFrame(rows, "query_id long, tenant string, db_type string, search_type string, data string")
    good, bad = plans.dashboard_route(
        asked, hashed_text_embedder(2), hashed_text_embedder(2, "cross-modal"), hashed_image_embedder(2))
    assert {(r.query_id, r.vector is None) for r in good.collect()} == {(1, False), (2, False), (3, False), (4, True)}
    assert {(r.query_id, r.reject_reason) for r in bad.collect()} == {
        (5, "UnknownSearch"), (6, "UnknownSearch"), (7, "UnknownSearch"), (8, "ImageProcessing")}
    found = {r.query_id for r in plans.dashboard_search(library, good).collect()}
    assert 4 in found and not found & {5, 6, 7, 8}


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_registered_approximate_search_finds_nine_tenths(spark, size):
    import __spark_entry__ as contract

    names = "approximate_topk", "approximate_all_cells"
    got, exact = (contract.queries()[name](spark, f"/root/testdata/{size}") for name in names)
    assert ann.recall(exact, got).first().recall >= 0.9


def clustered(spark, rng, clusters=30, each=40, dim=8):
    """Vectors in tight clusters, of two tenants; some rows have no direction, some another width."""
    rows = []
    for c in range(clusters):
        centre = [rng.gauss(0, 1) for _ in range(dim)]
        for i in range(each):
            rows.append((c * each + i, f"t{i % 2}", [x + rng.gauss(0, 0.05) for x in centre]))
    n = len(rows)
    rows += [(n, "t0", None), (n + 1, "t0", [0.0] * dim), (n + 2, "t0", [1.0, 2.0]), (n + 3, "t1", []), (n + 4, None, rows[0][2])]
    corpus = spark.createDataFrame(rows, "id long, tenant string, embedding array<float>")
    asked = [(i, rows[i][1], rows[i][2], 7) for i in range(0, n, 29)]
    asked += [(n, "t0", [2.0, 1.0], 7), (n + 1, "t0", None, 7), (n + 2, "t0", [0.0] * dim, 7), (n + 3, "nobody", rows[0][2], 7)]
    return corpus, spark.createDataFrame(asked, "query_id long, tenant string, vector array<float>, candidates long")


@pytest.mark.parametrize("threshold", [0.7, 0.1, None])
def test_cells_with_bounds_equal_the_exact_join(spark, tmp_path, monkeypatch, threshold):
    from rankloom.operators import cells

    corpus, asked = clustered(spark, random.Random(2))
    folder = f"{tmp_path}/{threshold}"
    cells.write_cells(corpus, folder)

    def rows(df):
        return sorted((r.query_id, r.id, r.vrank, round(r.dist, 9)) for r in df.collect())

    want = rows(knn(corpus, asked, threshold))
    assert want and rows(cells.search_cells(spark, folder, asked, threshold)) == want
    # Two waves read the nearest cells first.
    assert rows(cells.search_cells(spark, folder, asked, threshold, two_waves=0)) == want
    # Many queries go to their cells; where they need most of them, all rows are met at once.
    monkeypatch.setattr(cells, "BROADCAST_QUERIES", 5)
    for dense in (cells.DENSE, 1.0, 0.0):
        monkeypatch.setattr(cells, "DENSE", dense)
        assert rows(cells.search_cells(spark, folder, asked, threshold)) == want


def test_cells_that_cannot_hold_a_hit_are_not_read(spark, tmp_path):
    from rankloom.operators import cells

    corpus, asked = clustered(spark, random.Random(2))
    cells.write_cells(corpus, f"{tmp_path}/cells")
    stored = cells.Cells.read(spark, f"{tmp_path}/cells")
    total = sum(int(r.sum()) for r in stored.rows.values())
    assert total == 1202 and len(stored.names[8]) <= 35 and len(stored.names[2]) == 1
    read = {r.query_id: r.rows for r in cells.cells_read(spark, f"{tmp_path}/cells", asked, 0.1).collect()}
    assert read[1201] == read[1202] == 0 and sum(read.values()) / (len(read) * total) < 0.35
    one = cells.search_cells(spark, f"{tmp_path}/cells", asked.where("query_id = 29"), 0.02)
    files = {f.rsplit("/", 2)[1] for f in one._jdf.queryExecution().optimizedPlan().toString() and _files(one)}
    assert len(files) < len(stored.names[8]) / 3


def _files(df):
    """The folders that the scans of a plan read."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    import re

    found = re.search(r"PartitionFilters: \[[^\]]*cell#\d+ (?:IN \(([^)]*)\)|= ([^,\]]*))", plan)
    return [f"x/{name.strip()}/y" for name in (found[1] or found[2]).split(",")]


def test_cells_of_no_rows(spark, tmp_path):
    from rankloom.operators import cells

    corpus, asked = clustered(spark, random.Random(2), clusters=1)
    cells.write_cells(corpus.where("id < 0"), f"{tmp_path}/none")
    assert cells.search_cells(spark, f"{tmp_path}/none", asked).count() == 0
    assert {r.rows for r in cells.cells_read(spark, f"{tmp_path}/none", asked).collect()} == {0}


def test_grid_sends_the_fewest_copies(spark):
    from rankloom.operators.knn import grid

    def table(counts, key):
        return spark.createDataFrame([(t, i) for t, n in counts.items() for i in range(n)], f"tenant string, {key} long")

    corpus = table({"a": 4000, "b": 30, "c": 10, "d": 5}, "id")
    queries = table({"a": 250, "b": 3000, "c": 10, "e": 7}, "query_id")
    made = {r.tenant: (r._query_blocks, r._corpus_blocks) for r in grid(corpus, queries, 100, 1000, pairs=20_000).collect()}
    # 50 rectangles of a: two blocks of queries would be balanced, three keep their bound.
    assert made == {"a": (3, 17), "b": (30, 1), "c": (1, 1)}
    assert 3 * 4000 + 17 * 250 < 10 * 4000 + 5 * 250 and 3 * 17 >= 50
    wide = {r.tenant: (r._query_blocks, r._corpus_blocks) for r in grid(corpus, queries, pairs=20_000).collect()}
    assert wide == {"a": (2, 25), "b": (22, 1), "c": (1, 1)}


def test_results_are_sorted_across_files(spark, tmp_path):
    import pyarrow.parquet as pq

    from rankloom.operators.topk import write_ordered

    rng = random.Random(3)
    rows = [(q, r, f"d{q}-{r}") for q in range(40) for r in range(1, 26)]
    rng.shuffle(rows)
    found = spark.createDataFrame(rows, "query_id long, rank long, vector_id string").repartition(7)
    write_ordered(found, f"{tmp_path}/found", files=5)
    files = sorted(p for p in (tmp_path / "found").iterdir() if p.suffix == ".parquet")
    read = [tuple(r.values()) for f in files for r in pq.read_table(f).to_pylist()]
    assert len(files) > 1 and read == sorted(rows)


def test_cells_are_counted_without_a_row_for_each(spark, tmp_path):
    from rankloom.operators import cells

    corpus, asked = clustered(spark, random.Random(2))
    cells.write_cells(corpus, f"{tmp_path}/cells")
    known = cells.Cells.read(spark, f"{tmp_path}/cells")
    # A query that comes twice counts twice, one without a vector reads none.
    asked = asked.unionByName(asked.where("query_id = 29")).unionByName(asked.limit(1).selectExpr(
        "-1L AS query_id", "tenant", "CAST(NULL AS array<float>) AS vector", "candidates"))
    made = cells.cells_read(spark, f"{tmp_path}/cells", asked, 0.3)
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for r in asked.collect():
        n = want.setdefault(r.query_id, [0, 0])
        length = np.linalg.norm(r.vector) if r.vector else 0
        if length and len(r.vector) in known.names:
            own = known.bounds(np.array(r.vector, np.float64)[None, :] / length)[0] <= 0.3
            n[0], n[1] = n[0] + int(own.sum()), n[1] + int(known.rows[len(r.vector)][own].sum())
    assert {r.query_id: [r.cells, r.rows] for r in made.collect()} == want


def test_probing_every_cell_copies_no_query(spark, vectors):
    _, _, corpus, asked = vectors
    centres = {6: ann.unit_rows(np.random.default_rng(1).normal(size=(7, 6)))}
    placed = ann.assign_cells(corpus, centres)
    made = ann.probe(placed, asked, centres, 7, None)
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    def rows(df):
        return sorted((r.query_id, r.id, r.vrank) for r in df.collect())

    assert rows(made) == rows(knn(corpus, asked, None))


def test_hits_weigh_against_blocks_of_the_corpus(spark):
    from rankloom.operators.knn import grid

    rows = spark.range(4000).selectExpr("'a' AS tenant", "id")
    asked = spark.range(250).selectExpr("'a' AS tenant", "id AS query_id")
    plain, weighed = grid(rows, asked, pairs=20_000).first(), grid(rows, asked, pairs=20_000, hits=14).first()
    assert (plain._query_blocks, plain._corpus_blocks) == (2, 25)
    assert (weighed._query_blocks, weighed._corpus_blocks) == (7, 8)
