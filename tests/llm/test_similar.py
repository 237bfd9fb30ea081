from __future__ import annotations

import random

import pytest

import corpus_pipeline
from rankloom.llm import similar
from rankloom.llm.simhash import drop_near_copies, simhash
from tests.llm.samples import no_documents, odd_documents
from tests.llm.test_simhash import reach


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.split(" ") if text and text.strip() else []
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def near_docs():
    rng = random.Random(11)
    words = [f"{rng.choice('abcdefgh')}{i}" for i in range(400)]
    notice = " ".join(rng.choice(words) for _ in range(12))
    rows = []
    for g in range(10):
        base = [rng.choice(words) for _ in range(rng.choice([6, 9, 30, 120, 300]))]
        for k in range(30 if g == 3 else 6):
            copy = list(base)
            for _ in range(k % 5):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((2000 + 100 * g + k, " ".join(copy) + f" {notice}" * (g % 2), "en", "s", 1, None, None))
    return rows


@pytest.mark.parametrize("sample", [similar.SAMPLE, 0, 1])
def test_groups_equal_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(similar, "SAMPLE", sample)
    rows = near_docs()
    docs = spark.createDataFrame(rows, no_documents(spark).schema)
    sets = {r[0]: plain_set(r[1]) for r in rows}
    want = reach(set(sets), lambda a, b: near(sets[a], sets[b]))
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()}
    assert got == want and 10 < len(set(want.values())) < len(rows)


def changed_copies(spark, copies, words, least, most):
    """A text and copies of it with some changed words, and their sets."""
    rng = random.Random(5)
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(10_000)}" for _ in range(words)]
    rows = [(1, " ".join(base))]
    for k in range(copies):
        copy = list(base)
        for at in rng.sample(range(words), rng.randint(least, most)):
            copy[at] = f"new{k}x{at}"
        rows.append((2 + k, " ".join(copy)))
    docs = spark.createDataFrame([(i, t, "en", "s", 1, None, None) for i, t in rows], no_documents(spark).schema)
    return docs, {i: plain_set(t) for i, t in rows}


def test_a_large_group_is_not_compared_in_pairs(spark, monkeypatch):
    docs, sets = changed_copies(spark, 150, 150, 1, 4)
    confirm, compared = similar._confirmed, []
    monkeypatch.setattr(similar, "_confirmed", lambda pairs, *rest: compared.append(pairs.count()) or confirm(pairs, *rest))
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()}
    assert got == reach(set(sets), lambda a, b: near(sets[a], sets[b]))
    assert len(compared) == 2 and sum(compared) < 10 * len(sets)  # pairs of nodes: 11,325


def test_a_pair_is_made_under_its_first_shared_key(spark, monkeypatch):
    docs, sets = changed_copies(spark, 15, 400, 40, 50)
    pairs, made = similar._pairs, []

    def counted(met, share):
        out = pairs(met, share)
        made.append((met.count(), out.count()))
        return out

    monkeypatch.setattr(similar, "_pairs", counted)
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()}
    assert got == reach(set(sets), lambda a, b: near(sets[a], sets[b])) and len(set(got.values())) > 5
    rows, distinct = made[-1]
    assert 0 < distinct <= rows < 2 * len(sets) ** 2 / 2


def test_fingerprints_bring_nodes_together(spark):
    prints = {b"a": (0, 10), b"b": (0, 10), b"c": (3, 10), b"d": (7, 10), b"e": (3, 30), b"f": (1 << 62, 9)}
    nodes = spark.createDataFrame([(n, fp, size) for n, (fp, size) in prints.items()], "node binary, fp long, n int")
    got = {(bytes(r.a), bytes(r.b)) for r in similar._close(nodes, 0.8, similar.run_folder(spark, "test")).collect()}
    # e is three times as long as the others; b is met through a, which has its fingerprint.
    assert got == {(b"a", b"b"), (b"a", b"c"), (b"a", b"f"), (b"c", b"d")}


def test_a_fingerprint_is_that_of_the_set():
    texts = [" ".join(f"w{i}" for i in range(k)) for k in (0, 1, 5, 40)]
    assert [similar.majority(similar.shingle_set(t).view("uint64")) for t in texts] == [simhash(t, similar.WIDTH) for t in texts]


def test_prefixes_of_similar_sets_meet():
    rng = random.Random(3)
    for n in (1, 2, 4, 5, 6, 19, 20, 21, 100):
        a = sorted(rng.sample(range(1000), n))
        for gone in range(n // 5 + 1):
            b = sorted(rng.sample(a, n - gone))
            if 5 * len(b) >= 4 * n:
                for common in ([], a[::2]):
                    held = similar.np.array(common, "int64"), similar.np.ones(len(common), "int64")
                    x, y = (similar.prefix(similar.np.array(s, "int64"), held, 0.8) for s in (a, b))
                    assert set(x.tolist()) & set(y.tolist())


def test_stage_drops_a_copy_with_changed_words(spark):
    words = [f"w{i}" for i in range(100)]
    changed = [*words[:20], "new", *words[21:60], "other", *words[61:]]
    docs = spark.createDataFrame(
        [(7, " ".join(words), "en", "s", 1, None, None), (8, " ".join(changed), "en", "s", 1, None, None)],
        no_documents(spark).schema)
    assert near(plain_set(" ".join(words)), plain_set(" ".join(changed)))
    assert drop_near_copies(docs).count() == 2  # the fingerprints are further apart than two bits
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert [r.doc_id for r in stage(spark, docs, "").collect()] == [7]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    left = similar.drop_similar(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([1, 3, 6, 7, 8, 9, None], key=str)
    assert similar.drop_similar(no_documents(spark)).count() == 0


def test_null_ids_and_an_id_of_two_texts_lose_no_text(spark):
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdefg"]
    rows = [(None, words[0]), (None, words[1]), (None, words[2]), (None, words[2]), (5, words[3]), (5, words[4]), (5, words[4]),
            (6, words[4] + " end"), (None, words[5]), (9, words[5] + " end"), (7, words[6]), (7, words[6] + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, None, None) for i, t in rows], no_documents(spark).schema)
    left = [(r.doc_id, r.text) for r in similar.drop_similar(docs).collect()]
    assert len(left) == 7 and len({t[:60] for _, t in left}) == 7
    assert {(i, t) for i, t in left} >= {
        (None, words[0]), (None, words[1]), (None, words[2]), (5, words[3]), (5, words[4]), (9, words[5] + " end")}
