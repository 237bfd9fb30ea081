from __future__ import annotations

import random

import numpy as np
import pytest

from rankloom.llm.decontam import GAP, MATCH, MISMATCH, Items, align, contamination, drop_contaminated, leaks
from tests.llm.samples import no_documents, odd_documents

ITEM = "item_id long, text string"


def plain_align(passage, item):
    best, table = 0.0, [[0.0] * (len(item) + 1) for _ in range(len(passage) + 1)]
    for i, a in enumerate(passage, 1):
        for j, b in enumerate(item, 1):
            step = MATCH if a == b else MISMATCH
            table[i][j] = max(0.0, table[i - 1][j - 1] + step, table[i - 1][j] + GAP, table[i][j - 1] + GAP)
            best = max(best, table[i][j])
    return best


def test_alignment_equals_the_plain_table():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randrange(4) for _ in range(rng.randint(0, 15))]
        b = [rng.randrange(4) for _ in range(rng.randint(1, 12))]
        score, end = align(np.array(a, np.int64), np.array(b, np.int64))
        assert score == plain_align(a, b)
        assert score == 0 or plain_align(a[:end], b) == score


def world(seed=4):
    rng = random.Random(seed)
    words = ["of", "the", "and", "to"] + [f"w{i}" for i in range(400)]
    def text(n):
        return [rng.choice(words[:4] if rng.random() < 0.4 else words) for _ in range(n)]
    items = [text(rng.randint(15, 60)) for _ in range(12)]
    docs, leaked = [], {}
    for d in range(120):
        body, i = text(rng.randint(0, 200)), rng.randrange(12)
        kind = ("clean", "exact", "edited", "cut", "grown")[d % 5]
        copy = list(items[i])
        if kind == "edited":
            for k in range(2, len(copy), 7):
                copy[k] = "changed"
        if kind == "cut":
            copy = copy[:max(3, int(0.8 * len(copy)))]
        if kind == "grown":
            for k in range(len(copy) - 3, 0, -9):
                copy.insert(k, "added")
        if kind != "clean":
            at = rng.randint(0, len(body))
            body[at:at] = copy
            leaked[d + 2000] = i
        joined = " ".join(body)
        docs.append((d + 2000, joined.title() if d % 3 else joined, "en", "s", 1, None, None))
    return docs, leaked, [(i, " ".join(w)) for i, w in enumerate(items)]


@pytest.mark.parametrize("block_bytes", [1 << 24, 400])
def test_copies_are_found_and_clean_texts_left(spark, block_bytes):
    docs, leaked, items = world()
    got = contamination(odd_documents(spark, docs), spark.createDataFrame(items, ITEM), block_bytes=block_bytes).collect()
    assert {r.doc_id for r in got if r.contaminated} == set(leaked)
    assert all(leaked[r.doc_id] in r.item_ids for r in got if r.contaminated)
    assert len(got) == 131


def test_equals_alignment_of_every_pair(spark):
    docs, _, items = world(9)
    table, frame = odd_documents(spark, docs), spark.createDataFrame(items, ITEM)
    got = {(r.doc_id, r.item_id) for r in leaks(table, frame).collect()}
    every = Items([([i], t) for i, t in items], 3)
    want = set()
    for r in table.collect():
        numbers = every.hits(r.text or "")[0]
        for ids, item in zip(every.ids, every.items):
            if align(numbers, item)[0] >= 0.5 * MATCH * len(item):
                want.add((r.doc_id, ids[0]))
    assert got == want


def test_a_much_leaked_item_is_still_found(spark):
    docs, _, items = world(1)
    many = [(5000 + i, items[0][1] + f" tail{i}", "en", "s", 1, None, None) for i in range(300)]
    got = contamination(odd_documents(spark, many), spark.createDataFrame(items, ITEM), rare_share=0.0)
    assert got.where("contaminated").count() == 300


def test_odd_items_and_no_rows(spark):
    docs, leaked, items = world(6)
    table = odd_documents(spark, docs)
    odd = [*items, (None, items[0][1]), (77, None), (78, ""), (79, "two words"), (80, items[1][1].upper())]
    frame = spark.createDataFrame(odd, ITEM)
    got = {r.doc_id: r for r in contamination(table, frame).collect()}
    assert {d for d, r in got.items() if r.contaminated} == set(leaked)
    assert all(r.item_ids == [1, 80] for d, r in got.items() if leaked.get(d) == 1)
    left = drop_contaminated(table, frame)
    assert left.columns == table.columns and left.count() == 131 - len(leaked)
    assert contamination(table, spark.createDataFrame([], ITEM)).where("contaminated").count() == 0
    assert contamination(no_documents(spark), frame).count() == 0


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Red Kettle"), (2, "kettle"), (3, "red, kettle!"), (4, "東京の天気は明日から雨になるでしょう"), (5, "กรุงเทพ"), (6, "?!")]
    texts = {
        100: ("a red kettle, and RED kettle", {1, 3}), 101: ("kettle red", set()), 102: ("Kettle!", {2}), 103: ("the kettle", set()),
        104: ("今日の新聞によると東京の天気は明日から大雨になるでしょうという", {4}), 105: ("東京の夏", set()),
        106: ("ไปกรุงเทพ", {5}), 107: (None, set()), 108: ("?!", set()),
    }
    docs = [(i, t, "en", "s", 1, None, None) for i, (t, _) in texts.items()]
    got = {r.doc_id: set(r.item_ids) for r in contamination(odd_documents(spark, docs), spark.createDataFrame(items, ITEM)).collect()}
    assert {i: got[i] for i in texts} == {i: want for i, (_, want) in texts.items()}
