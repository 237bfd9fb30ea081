from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import functions as F

from rankloom.llm.linetemplates import LINE, _constants, drop_lines, line_templates
from tests.llm.samples import no_documents, odd_documents


def brute(rows, least=5, depth=3, constant=0.5, identical=False):
    lines, every = [], defaultdict(set)
    for text in {t or "" for _, t in rows}:
        for place, line in enumerate(text.split("\n")):
            tokens = ["<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^ \t\r]+", line)]
            if tokens:
                every[tuple(re.findall(r"[^ \t\r]+", line))].add((text, place))
                lines.append((text, place, (len(tokens), *tokens[:depth]), tuple(tokens)))
    texts = defaultdict(set)
    for text, _, leaf, _ in lines:
        texts[leaf].add(text)
    lines = [x for x in lines if len(texts[x[2]]) >= least]
    held, seen = defaultdict(int), defaultdict(set)
    for text, _, leaf, tokens in lines:
        seen[leaf, tokens].add(text)
    for (leaf, tokens), where in seen.items():
        for at, token in enumerate(tokens):
            held[leaf, at, token] += len(where)
    def template(leaf, tokens):
        parts = [t if held[leaf, i, t] >= least else "<*>" for i, t in enumerate(tokens)]
        return tuple(parts) if sum(p != "<*>" for p in parts) / len(parts) >= constant else None
    met = defaultdict(set)
    for text, _, leaf, tokens in lines:
        met[leaf, template(leaf, tokens)].add(text)
    gone = {(text, place) for text, place, leaf, tokens in lines
            if template(leaf, tokens) and len(met[leaf, template(leaf, tokens)]) >= least}
    if identical:
        gone |= {x for where in every.values() if len({t for t, _ in where}) > 1 for x in where}
    out = []
    for doc_id, text in rows:
        split = (text or "").split("\n")
        kept = [s for i, s in enumerate(split) if (text or "", i) not in gone]
        out.append((doc_id, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


LOGS = [
    (3000 + i, f"User {'alice bob carol dave'.split()[i % 4]} logged in from host{i}\n\nUnique words number{i} only here {'x' * i}\n"
     f"All rights reserved\t{1990 + i}\n" + ("common tail line" if i % 3 else f"tail {i} varies a b c d e"), "en", "s", 1, None, None)
    for i in range(40)
]


def test_equals_brute_force(spark):
    docs = odd_documents(spark, LOGS)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for least, identical in ((2, False), (5, True), (12, True), (12, False)):
        got = sorted(map(tuple, drop_lines(docs, least, identical=identical).collect()), key=str)
        assert got == brute(rows, least, identical=identical)


def test_fields_are_generalised_and_copies_count_once(spark):
    got = {r.template for r in line_templates(odd_documents(spark, LOGS)).collect()}
    assert got == {"User alice logged in from <*>", "User bob logged in from <*>", "User carol logged in from <*>",
                   "User dave logged in from <*>", "All rights reserved <*>", "common tail line",
                   "tail <*> varies a b c d e", "Unique words <*> only here <*>"}
    late = [(i, f"Error in module {'abcdefgh'[i % 8]}{'xyz'[i % 3]} while reading the block", "en", "s", 1, None, None) for i in range(24)]
    found = line_templates(odd_documents(spark, late)).collect()
    assert {r.template for r in found} == {"Error in module <*> while reading the block"}
    same = [(i, "the very same text", "en", "s", 1, None, None) for i in range(50)]
    assert line_templates(odd_documents(spark, same)).count() == 0


def test_no_rows_and_no_python(spark):
    assert drop_lines(no_documents(spark)).count() == 0
    plan = drop_lines(odd_documents(spark), identical=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_identical_lines_go_from_two_texts_on(spark):
    long, dates = " ".join(f"token{'abcdefgh'[i % 8]}" for i in range(60)), "2024-01-02 10:00 555-0100"
    rows = [(1, f"only one\n{long}\n{dates}"), (2, f"{dates}\nonly two\n{long}"), (3, "only three\n2024-01-03 11:00 555-0101"),
            (4, "twice in one\ntwice in one"), (5, "twice in one\ntwice in one")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, None, None) for i, t in rows], no_documents(spark).schema)
    got = {r.doc_id: (r.n_dropped, r.kept_text) for r in drop_lines(docs, identical=True).collect()}
    assert got == {1: (2, "only one"), 2: (2, "only two"), 3: (0, rows[2][1]), 4: (0, rows[3][1]), 5: (0, rows[4][1])}
    assert all(r.n_dropped == 0 for r in drop_lines(docs).collect())
    assert drop_lines(no_documents(spark), identical=True).count() == 0


def test_rows_of_tokens_hold_no_lines(spark):
    # Lines of n tokens have n rows of tokens: were they to carry the line, shuffles would grow with its square.
    rows = [("a b c d1 e f", 3), ("a b c x e g", 4)]
    kinds = spark.createDataFrame(rows, "masked string, n long").withColumns({c: F.xxhash64(F.lit(c), "masked") for c in LINE})
    made = _constants(kinds, 5, 3)
    assert [t for _, t in made.dtypes] == ["bigint", "bigint", "array<int>"]
    assert [r.constants for r in made.collect()] == [[4], [4]]
    plan = made._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert moved and not any("masked" in line or "token" in line for line in moved)
