from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rankloom.llm import registered
from rankloom.llm.encoders import WordEncoder
from rankloom.llm.packing import CAPACITY, cut_table, cuts, fit, pack_documents, sequences
from tests.llm.samples import no_documents, odd_documents

DATA = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts):
    tokenizer = Tokenizer.from_file(WORDS)
    return [e.ids + [2] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, wanted, capacity):
    """Every id of every document lies in one piece, and every sequence is full without gaps from 0."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    left = defaultdict(list)
    for doc_id, ids in wanted:
        left[doc_id].append(ids)
    assert set(by_doc) == set(left)
    for doc_id, pieces in by_doc.items():
        # Copies of a row are packed each: pieces come as often as the row does.
        n = len(left[doc_id])
        assert sum(p.length for p in pieces) == sum(map(len, left[doc_id])) and len(pieces) % n == 0
        ids, at = left[doc_id][0], 0
        for p in sorted(pieces, key=lambda p: p.start)[::n]:
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    sizes = [sum(n for _, n in parts) for parts in by_sequence.values()]
    assert set(by_sequence) == set(range(len(by_sequence)))
    return 1 - sum(sizes) / max(1, capacity * len(sizes))


@pytest.mark.parametrize("capacity", [64, 1000, 4096])
def test_cuts_waste_little(capacity):
    table = cut_table(capacity)
    wastes = []
    for n in range(1, capacity + 1):
        pieces = cuts(n, table)
        assert sum(pieces) == n and min(pieces) > 0
        assert cuts(3 * capacity + n, table) == [capacity] * 3 + pieces
        wastes.append(sum(capacity / (capacity // p) - p for p in pieces) / capacity)
    assert np.mean(wastes) < 0.02 if capacity == 4096 else np.mean(wastes) < 0.2


def test_fit_fills_by_first_fit():
    rng = np.random.default_rng(2)
    pieces = [(int(n), i, 0) for i, n in enumerate(rng.integers(1, 100, 500))]
    places, used = fit(pieces, 100), defaultdict(int)
    assert all(p is not None for p in places)
    for (length, *_), (at, offset) in sorted(zip(pieces, places), key=lambda x: x[1]):
        assert used[at] == offset
        used[at] += length
    assert max(used.values()) <= 100 and len(used) <= 1.1 * sum(p[0] for p in pieces) / 100 + 1 and fit([], 100) == []


def test_odd_rows(spark):
    docs = odd_documents(spark).repartition(3)
    encoder = WordEncoder.read(WORDS)
    rows = docs.select("doc_id", "text").collect()
    wanted = list(zip([r.doc_id for r in rows], library_ids([r.text for r in rows])))
    for capacity in (32, CAPACITY):
        packed = pack_documents(docs, encoder, end_id=2, capacity=capacity)
        check(packed.collect(), wanted, capacity)
        made = {r.sequence_id: (r.length, len(r.ids) // 2) for r in sequences(packed).collect()}
        assert all(a == b for a, b in made.values())
    assert pack_documents(no_documents(spark), encoder, end_id=2).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60")
    packed = pack_documents(docs, WordEncoder.read(WORDS), end_id=2).cache()
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u2").tolist() for r in sequences(packed).collect()}
    rows = docs.collect()
    ids = dict(zip([r.doc_id for r in rows], library_ids([r.text for r in rows])))
    for p in packed.collect():
        assert whole[p.sequence_id][p.offset:p.offset + p.length] == ids[p.doc_id][p.start:p.start + p.length]


def test_query_packs_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = registered.queries()["op12_packing"](spark, DATA)
    kinds = dict(got.dtypes)
    assert all(kinds[c] == "bigint" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
    wanted = list(zip([r.doc_id for r in rows], library_ids([r.text for r in rows])))
    assert check(got.collect(), wanted, CAPACITY) < 0.02


def test_encoder_equals_library():
    tokenizer = Tokenizer.from_file(WORDS)
    texts = [
        "don't Can'T 'S x's it’s", "a\xa0b\x85c d", "É é É", "İstanbul ΣΑΣ ς K K", "<|endoftext|> x <|ENDOFTEXT|> y",
        "wow!!! a., b .c,d e, ́x a ,b", "x\x1cy\x85z 12,3 a1, b", "日本語、テキスト。 ok.", "é, é. ß!\n\nq", "a.\x1cb", "", " ",
        "it's, we'll; x'd! 'll, \n", "a\n \x0b\x0c\r b,", "word," * 3 + " word, word. word",
    ]
    for limit in (600_000, 3):
        coded = WordEncoder(open(WORDS).read(), dtype="<u4", remembered=limit)._build()(texts)
        wanted = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(c, "<u4").tolist() for c in coded] == wanted
