from __future__ import annotations

import random

import pytest
import xxhash

from rankloom.llm.components import components
from rankloom.llm.simhash import drop_near_copies, near_groups, ring_links, simhash
from tests.llm.samples import no_documents, odd_documents


def plain_simhash(text):
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [words[i:i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64(" ".join(r).encode(), 42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(nodes, linked):
    """Smallest reachable node of each node, by plain search."""
    out = {}
    for n in sorted(nodes):
        if n not in out:
            todo = [n]
            out[n] = n
            while todo:
                x = todo.pop()
                for y in nodes:
                    if y not in out and linked(x, y):
                        out[y] = n
                        todo.append(y)
    return out


def near_docs():
    rng = random.Random(5)
    words = [rng.choice("abcdefgh") + str(i) for i in range(200)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(120)]
        for k in range(6):
            copy = list(base)
            for _ in range(k % 4):
                copy[rng.randrange(120)] = rng.choice(words)
            rows.append((1000 + 10 * g + k, " ".join(copy), "en", "s", 1, None, None))
    return rows


def test_fingerprint_equals_plain_one():
    for text in [None, "", " ", "One", "one two", "a b c", "A  b\tc\x0bd É e f", "x " * 300, " a b c d"]:
        assert simhash(text) == plain_simhash(text)


@pytest.mark.parametrize("bucket", [4096, 1])
def test_groups_equal_brute_force(spark, bucket):
    docs = odd_documents(spark, near_docs())
    rows = [(r.doc_id, plain_simhash(r.text)) for r in docs.collect()]
    labels = reach({f for _, f in rows}, lambda a, b: (a ^ b).bit_count() <= 2)
    lowest = {}
    for i, f in rows:
        if i is not None:
            lowest[labels[f]] = min(i, lowest.get(labels[f], i))
    want = sorted(((i, f"{f:016x}", lowest.get(labels[f])) for i, f in rows), key=str)
    got = near_groups(docs, bucket=bucket).collect()
    assert sorted(map(tuple, got), key=str) == want


@pytest.mark.parametrize("bucket", [4096, 2])
@pytest.mark.parametrize("distance,segments", [(2, 5), (2, 3), (3, 7), (1, 4)])
def test_ring_finds_every_link(spark, distance, segments, bucket):
    rng = random.Random(distance * 10 + segments)
    made = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        made.add(base)
        for _ in range(5):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            made.add(x)
    signed = {x - (1 << 64) if x >> 63 else x for x in made}
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= distance
    links = ring_links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance, segments, bucket)
    assert all(near(r.a, r.b) for r in links.collect())
    want = {n: l for n, l in reach(signed, near).items() if any(m != n and near(m, n) for m in signed)}
    assert {r.node: r.label for r in components(links).collect()} == want


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)] + [(500, 500 + i) for i in range(200)] + [(7, 7)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {500 + i: 500 for i in range(200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = odd_documents(spark, near_docs())
    groups = near_groups(docs).collect()
    left = drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted({r.component_id for r in groups}, key=str)
    assert drop_near_copies(no_documents(spark)).count() == 0
    assert near_groups(no_documents(spark)).columns == ["doc_id", "fingerprint", "component_id"]
