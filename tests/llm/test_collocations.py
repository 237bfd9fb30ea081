from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from rankloom.llm.collocations import _Buffer, collocations
from tests.llm.samples import SCHEMA, no_documents, odd_documents

_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=30, longest=4, top=2000, kept=80):
    """Collocations by plain dictionaries of counts."""
    f, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_AZ)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        found = []
        for p, a in candidates.items():
            inside = any(
                len(q) > len(p) and 100 * b >= kept * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                for q, b in candidates.items())
            if not inside:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def answer(docs, **options):
    return sorted(tuple(r[c] for c in COLUMNS) for r in collocations(docs, **options).collect())


def texts(rng, n):
    words = ["alpha", "Beta", "gamma", "delta", "ÄRGER", "eps", "zeta", "New", "York", "times", " nb", "x\x1cy"]
    fixed = ["new york times", "alpha beta gamma delta eps", "in the end", "zeta ärger"]
    out = []
    for _ in range(n):
        parts = [rng.choice([rng.choice(words), rng.choice(words), rng.choice(fixed)]) for _ in range(rng.randrange(1, 30))]
        out.append("".join(p + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\r", "!"]) for p in parts))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, t, rng.choice(["en", "en", "de", None, "und"]), None, None, None, None) for i, t in enumerate(texts(rng, 400))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    plain = [(r[2], r[1]) for r in rows]
    for options in ({}, {"least": 3}, {"least": 5, "top": 7}, {"least": 2, "longest": 2}, {"least": 4, "kept": 100}):
        want = brute(plain, **options)
        assert want and answer(docs, **options) == want
    # Bits that collide let more be counted, and change nothing.
    assert answer(docs, least=5, bits=64) == brute(plain, least=5)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    plain = [(r.lang, r.text) for r in docs.collect()]
    want = brute(plain, least=2)
    assert {r[0] for r in want} >= {"en", "fr"} and answer(docs, least=2) == want
    assert answer(no_documents(spark)) == [] and collocations(no_documents(spark)).columns == COLUMNS


def test_full_buffers_are_handed_on(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, t, "en", None, None, None, None) for i, t in enumerate(texts(rng, 300))]
    from rankloom.llm import collocations as module

    made = list(module._in_buffers(_batches(rows), lambda b: iter([(b.lang, b.size, len(b.numbers))])))
    monkeypatch.setattr(module, "BUFFER", 500)
    many = list(module._in_buffers(_batches(rows), lambda b: iter([(b.lang, b.size, len(b.numbers))])))
    assert len(made) == 1 and len(many) > 5 and sum(m[1] for m in many) == made[0][1]


def _batches(rows):
    import pyarrow as pa

    for at in range(0, len(rows), 20):
        part = rows[at:at + 20]
        yield pa.RecordBatch.from_pydict({"lang": [r[2] for r in part], "text": [r[1] for r in part]})


def test_words_end_at_blanks_and_tabs_only():
    buffer = _Buffer("en")
    buffer.add(["A b C\x1cd\te", "f"])
    words = buffer.words().to_pylist()
    assert [words[i] for i in buffer.ids()] == ["a b".encode(), b"c\x1cd", b"e", b"\n", b"f", b"\n"]
