from __future__ import annotations

import sentencepiece

import corpus_pipeline
from rankloom.llm import toxicity
from rankloom.llm.decontam import MATCH, Items, align
from tests.llm.samples import no_documents, odd_documents
from tests.llm.test_simhash import reach
from tests.llm.test_similar import near

DATA = "/root/testdata/sf0.001"
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = text.translate(_AZ).encode().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, machine, items):
    """The pipeline's documents by plain loops: what each stage keeps."""
    kept = [(i, t) for i, t in rows if machine.score(toxicity.terms(t)) < 0.5]
    last = {}
    for i, t in kept:
        last[t.translate(_AZ)] = max(i, last.get(t.translate(_AZ), i))
    kept = [(i, t) for i, t in kept if last[t.translate(_AZ)] == i]
    sets = {i: shingles(t) for i, t in kept}
    labels = reach(set(sets), lambda a, b: near(sets[a], sets[b]))
    kept = [(i, t) for i, t in kept if labels[i] == i]
    every = Items([([i], t) for i, t in items], 3)
    def clean(text):
        numbers = every.hits(text)[0]
        return all(align(numbers, item)[0] < 0.5 * MATCH * len(item) for item in every.items)
    return [(i, t) for i, t in kept if clean(t)]


def test_pipeline_equals_brute_force(spark):
    docs, labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    machine = toxicity.train(docs, labels)
    want = brute([(r.doc_id, r.text or "") for r in docs.collect()], machine, [(r.item_id, r.text) for r in bench.collect()])
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECES)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == {i for i, _ in want} and 0 < len(got) < docs.count()
    assert all(got[i].ids == library.encode(t) and got[i].decodes_exactly for i, t in want)


def test_stages_take_odd_rows_and_keep_columns(spark):
    for docs in (odd_documents(spark), no_documents(spark)):
        total = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, DATA)
            if name != "sentencepiece":
                assert made.columns == docs.columns
            assert made.count() == total - {"exact_dedup": 3, "simhash_near_dedup": 4}.get(name, 0) * (total > 0)
