from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from rankloom.llm.pieces import BPE, MARK, NORMAL, UNIGRAM, UNKNOWN, Model, Segmenter, decode_pieces, encode_pieces, round_trip
from tests.llm.samples import no_documents, odd_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "   ", "a  b", "a\n b \n c", "  x", "x  ", "it's 12 3,4 ² ½", "<s>", "<0x41>", "▁a", "a ▁ b", "é  b  c", "\x1c a",
    "a\t b　 c", " " * 50 + "the end", "x" * 3000, "日本語 テキスト 🙂", "aaaa" * 20, "the theatre thereof then there", "\n\n\n", " \n \n x",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids_of(segmenter, texts):
    return [np.frombuffer(c, "<i4").tolist() for c in segmenter.encode_block(texts)]


def test_same_ids_as_the_library(spark, library):
    texts = ODD + [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert ids_of(Segmenter(Model.read(PATH)), texts) == library.encode(texts)
    assert ids_of(Segmenter(Model.read(PATH), remembered=50), texts) == library.encode(texts)


def test_decoding_gives_the_text_back(library):
    segmenter = Segmenter(Model.read(PATH))
    for text, ids in zip(ODD, ids_of(segmenter, ODD)):
        assert segmenter.decode(ids) == text.replace(MARK, " ") == library.decode(ids)


def merges(word, scores):
    """Plain merging: the best pair of neighbours, of equals the first, until none is left."""
    parts = list(word)
    while True:
        pairs = [(scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores]
        if not pairs:
            return parts
        i = -max(pairs)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def best_sum(word, scores, low):
    """The best segmentation among all, by trying every cut."""
    if not word:
        return 0.0, []
    ways = []
    for i in range(1, len(word) + 1):
        head = word[:i]
        if head in scores or i == 1:
            rest, parts = best_sum(word[i:], scores, low)
            ways.append((scores.get(head, low) + rest, [head, *parts]))
    return max(ways, key=lambda w: w[0])


@pytest.mark.parametrize("kind", [BPE, UNIGRAM])
def test_forward_pass_equals_brute_force(kind):
    rng = random.Random(kind)
    for _ in range(30):
        made, parts = {c: 0.0 for c in "abcd"}, ["a", "b", "c", "d"]
        for rank in range(1, 25):
            piece = rng.choice(parts) + rng.choice(parts)
            if piece not in made:
                parts.append(piece)
                made[piece] = -rank - rng.random()
        if kind == UNIGRAM:
            made = {p: -rng.random() * 9 - 1 for p in made}
        pieces = (("<unk>", 0.0, UNKNOWN), *((p, s, NORMAL) for p, s in made.items()))
        segmenter = Segmenter(Model(kind, pieces, True))
        words = sorted({"".join(rng.choice("abcdz") for _ in range(rng.randint(1, 9))) for _ in range(60)})
        for word, got in zip(words, segmenter.forward(words)):
            if kind == BPE:
                assert got == merges(word, made)
            else:
                score = sum(made.get(p, segmenter.low) for p in got)
                assert "".join(got) == word and score == pytest.approx(best_sum(word, made, segmenter.low)[0])


def test_long_runs_use_the_same_merges():
    segmenter = Segmenter(Model.read(PATH))
    for word in ["the" * 30, MARK * 70 + "word", "abcab" * 25]:
        assert segmenter.merged(word) == segmenter._merged_short(word)


def test_tables(spark, library):
    docs, model = odd_documents(spark), Model.read(PATH)
    coded = encode_pieces(docs, model)
    want = sorted(((r.doc_id, library.encode(r.text or "")) for r in docs.collect()), key=str)
    assert sorted(((r.doc_id, r.ids) for r in coded.collect()), key=str) == want
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    assert sorted(map(tuple, decode_pieces(coded, model).collect()), key=str) == texts
    made = round_trip(docs, model).collect()
    assert sorted(((r.doc_id, r.ids) for r in made), key=str) == want and all(r.exact for r in made)
    for empty in (encode_pieces(no_documents(spark), model), round_trip(no_documents(spark), model)):
        assert empty.count() == 0


def test_models_that_change_texts_are_refused():
    with pytest.raises(ValueError):
        Segmenter(Model(BPE, (("a▁b", 0.0, NORMAL),)))
    with pytest.raises(ValueError):
        Segmenter(Model(3, (("a", 0.0, NORMAL),)))


def test_borders_are_told_without_merging_their_letters(monkeypatch):
    segmenter, again = Segmenter(Model.read(PATH)), []
    merged = Segmenter.merged
    monkeypatch.setattr(Segmenter, "merged", lambda self, word: again.append(word) or merged(self, word))
    rng = random.Random(7)
    pieces = [p for p in segmenter.ids if MARK not in p]
    for _ in range(3000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        assert segmenter._apart(a, b) == (merged(segmenter, a + b) == [a, b])
    assert not again


@pytest.mark.parametrize("seed", range(30))
def test_borders_of_any_model(seed):
    # Scores in any order, and pieces of one score, whose merges may not follow the order of pieces.
    rng = random.Random(seed)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(2, 5))) for _ in range(25)}
    found = [(w, -float(rng.randint(0, 30)) if seed % 2 else -float(len(w)), NORMAL) for w in sorted(words)]
    segmenter = Segmenter(Model(BPE, (("<unk>", 0.0, UNKNOWN), ("a", -99.0, NORMAL), ("b", -99.0, NORMAL), *found)))
    for a in ["", *segmenter.ids]:
        for b in segmenter.ids:
            assert segmenter._apart(a, b) == (segmenter.merged(a + b) == ([a, b] if a else [b])), (a, b)
