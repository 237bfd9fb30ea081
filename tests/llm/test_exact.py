from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.llm import exact
from rankloom.llm.common import run_folder
from tests.llm.samples import SCHEMA, no_documents, odd_documents

_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(_AZ)].append(doc_id)
    out = []
    for body, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        seen = False
        for i in ids:
            kept = i == keep and not seen
            seen |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


COPIES = [(100 + i, "THE same Line" if i % 2 else "the same line", "en", "a", 1, None, None) for i in range(40)]


@pytest.mark.parametrize("digest", [
    exact.sha256, lambda t: F.substring(exact.sha256(t), 1, 1), lambda t: F.lit("one")], ids=["sha", "weak", "constant"])
def test_equals_brute_force_under_any_digest(spark, digest):
    docs = odd_documents(spark, COPIES)
    got = exact.exact_groups(docs, digest=digest).drop("keep_locator").collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_no_rows(spark):
    made = exact.exact_groups(no_documents(spark))
    assert made.columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and made.count() == 0
    assert exact.drop_copies(no_documents(spark)).count() == 0


def test_state_goes_on_with_later_rows(spark):
    folder = run_folder(spark, "test")
    first = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    later = spark.createDataFrame([(9, "a"), (4, "c")], "doc_id long, text string")
    for docs in (first, later):
        keyed = exact.digests(docs, "doc_id", "text", exact.sha256)
        keyed.write.mode("append").parquet(f"{folder}/digests")
        held = exact.absorb(spark, f"{folder}/digests", keyed.schema, f"{folder}/state")
    assert sorted((r.keep_id, r.group_size) for r in held.collect()) == [(3, 1), (4, 1), (9, 3)]


@pytest.mark.parametrize("repeats", [False, True])
def test_drop_copies_keeps_columns_and_one_row_of_each_text(spark, repeats):
    docs = odd_documents(spark, COPIES)
    docs = docs if repeats else docs.where("doc_id <> 9 OR doc_id IS NULL")
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    want = sorted((r[0], r[4]) for r in brute([(r.doc_id, r.text) for r in docs.collect()]) if r[3] and r[0] is not None)
    got = left.select("doc_id", exact.sha256(exact.normalised()).alias("sha")).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
    assert [r.doc_id for r in got].count(None) == 1


def test_main_path_runs_no_python(spark):
    plan = exact.exact_groups(spark.createDataFrame([(1, "a", None, None, 1, None, None)], SCHEMA))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
