from __future__ import annotations

import random

import numpy as np
import pytest

from rankloom.llm.runindex import RunIndex, drop_repeats, gram_hashes, repeated_starts, suffix_order
from tests.llm.samples import no_documents, odd_documents


def brute(texts, length):
    """Removed spans of every text, by counting all its windows."""
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i:i + length]] = count.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans, i = [], 0
        while i < len(t):
            if gone[i]:
                j = i
                while j < len(t) and gone[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out.append((len(t), bytes(b for b, g in zip(t, gone) if not g), spans))
    return out


def symbols_of(rng, n, kinds):
    return np.array([rng.randint(1, kinds) for _ in range(n)] + [0], np.uint16)


def test_suffixes_are_sorted():
    rng = random.Random(1)
    for n, kinds in [(0, 1), (1, 1), (50, 1), (300, 2), (500, 4), (200, 256)]:
        s = symbols_of(rng, n, kinds)
        plain = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert suffix_order(s).tolist() == plain


def test_statistics_are_the_longest_matches_elsewhere():
    rng = random.Random(2)
    for n, kinds in [(1, 1), (40, 1), (120, 2), (150, 3), (60, 200)]:
        s = symbols_of(rng, n, kinds)
        got = RunIndex(s).matching_statistics()
        for i in range(len(s)):
            longest = 0
            for j in range(len(s)):
                k = 0
                while j != i and max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                    k += 1
                longest = max(longest, k)
            assert got[i] == longest


def test_repetitive_texts_have_few_runs():
    rng = random.Random(3)
    base = [rng.randint(1, 250) for _ in range(2000)]
    assert RunIndex(np.array(base * 10 + [0], np.uint16)).runs < 2200


def test_repeated_starts_stay_in_their_text():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(8, 40))) for _ in range(30)]
    texts = list(dict.fromkeys(texts))
    count = {}
    for t in texts:
        for i in range(len(t) - 7):
            count[t[i:i + 8]] = count.get(t[i:i + 8], 0) + 1
    want = [[i for i in range(len(t) - 7) if count[t[i:i + 8]] > 1] for t in texts]
    assert [r.tolist() for r in repeated_starts(texts, 8)] == want


@pytest.mark.parametrize("gram", [1, 2, 5, 8, 23, 64])
def test_gram_hashes_depend_on_their_bytes_only(gram):
    data = np.frombuffer(bytes(random.Random(5).choice(b"abc") for _ in range(500)), np.uint8)
    made, seen = gram_hashes(data, gram), {}
    assert len(made) == 501 - gram
    for i, h in enumerate(made.tolist()):
        assert seen.setdefault(data[i:i + gram].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def repeats():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(30), prose(60), "é" + prose(25)]
    texts = []
    for i in range(60):
        parts = [prose(rng.randint(0, 60)), rng.choice(shared) if i % 3 else "", prose(rng.randint(0, 40))]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[0], "x" * 500, "ab" * 150, "x" * 60, prose(400) + shared[1] + prose(20) + shared[1], ""]
    # Two texts that share just as much, and one byte less.
    texts += [prose(20) + "|" + shared[2][:63] + "|" + prose(9), prose(20) + "!" + shared[2][:62] + "!" + prose(9)]
    return [(4000 + i, t, "en", "s", 1, None, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("length,gram,hot", [(64, 16, 10**6), (64, 16, 3), (200, 64, 10**6), (200, 64, 2), (33, 32, 10**6)])
def test_equals_brute_force(spark, length, gram, hot):
    docs = odd_documents(spark, repeats())
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = sorted(((d, *b) for (d, _), b in zip(rows, brute([t for _, t in rows], length))), key=str)
    got = drop_repeats(docs, length, gram, hot).collect()
    got = sorted(((r.doc_id, r.n_bytes, bytes(r.kept), [(s.begin, s.end) for s in r.spans]) for r in got), key=str)
    assert got == want


def test_no_rows(spark):
    assert drop_repeats(no_documents(spark)).count() == 0
