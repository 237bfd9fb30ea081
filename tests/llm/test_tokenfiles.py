from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rankloom.llm.common import run_folder
from rankloom.llm.encoders import LibraryEncoder, RankEncoder
from rankloom.llm.tokencounts import document_order, separator_scan
from rankloom.llm.tokenfiles import manifest_of, read_tokens, token_digests, write_tokens
from tests.llm.samples import SCHEMA, no_documents, odd_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    "a  b", "a\n b \n c", "  x", "x  ", "x ", " ", "", " \n a", "it's it 's 12 3,4 ² ½ x²", "a<|endoftext|> b", "é  b  c",
    "\x1c a \x1cb", "a\t b　 c", "z" * 5000, "\x85 a", "don't  'tis",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def numbered(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(texts)], SCHEMA)


def test_chunks_give_the_ids_of_the_whole_text(spark, library):
    texts = ODD + [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for encoder in (LibraryEncoder.read(PATH), LibraryEncoder.read(PATH, remembered=40)):
        coded = encoder._build()(texts)
        assert [np.frombuffer(c, "<u2").tolist() for c in coded] == [plain(library, t) for t in texts]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    coded = LibraryEncoder.read(path)._build()(["Some  Text, here", ""])
    assert [np.frombuffer(c, "<u2").tolist() for c in coded] == [own.encode(t, add_special_tokens=False).ids for t in ["Some  Text, here", ""]]


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_files_read_back(spark, library, dtype):
    docs = odd_documents(spark, [(500 - i, t, None, None, None, None, None) for i, t in enumerate(ODD)]).repartition(5)
    folder = run_folder(spark, "test")
    write_tokens(docs, folder, LibraryEncoder.read(PATH, dtype=dtype))
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for doc_id, text in rows:
        ids = [*plain(library, text), 0]
        want.append((doc_id, start, len(ids), ids))
        start += len(ids)
    got = sorted(map(tuple, read_tokens(spark, folder, dtype).collect()), key=lambda r: r[1])
    assert got == want
    digests = sorted(map(tuple, token_digests(spark, folder, dtype).collect()), key=lambda r: r[1])
    assert digests == [(d, s, n, zlib.crc32(np.array(i, "<u4").tobytes())) for d, s, n, i in want]


def test_no_rows(spark):
    folder = run_folder(spark, "test")
    assert write_tokens(no_documents(spark), folder, LibraryEncoder.read(PATH)).count() == 0
    assert read_tokens(spark, folder).count() == token_digests(spark, folder).count() == 0
    assert separator_scan(spark, folder, 50256).count() == 0


@pytest.mark.parametrize("block_ids", [1, 3, 64, 1 << 20])
def test_separator_scan_stitches_blocks(spark, library, block_ids):
    texts = ["one two three", "", "", "a longer text " * 9, None, "<|endoftext|>", "end"] + ODD[:8]
    folder = run_folder(spark, "test")
    write_tokens(numbered(spark, texts).coalesce(2), folder, RankEncoder.read(RANKS), 50256, ordered=False, offsets=False)
    counts = separator_scan(spark, folder, 50256, block_ids=block_ids).join(document_order(spark, folder), ["part", "place"])
    encode = RankEncoder.read(RANKS)._build()
    want = {i: len(encode([t or ""])[0]) // 2 for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in counts.collect()} == want
    assert counts.where("NOT closed").count() == 0


def test_ids_after_the_last_end_are_an_open_document(spark):
    folder = run_folder(spark, "test")
    write_tokens(numbered(spark, ["one two", "three"]).coalesce(1), folder, RankEncoder.read(RANKS), 50256, offsets=False)
    row = manifest_of(spark, folder).collect()[0]
    path = f"{folder}/{row.file}.ids".removeprefix("file:")
    ids = np.fromfile(path, "<u2")
    ids[:-1].tofile(path)
    spark.createDataFrame([(row.part, row.file, row.n_docs, row.n_ids - 1, 0)], "part int, file string, n_docs long, n_ids long, base long") \
        .write.parquet(f"{folder}-cut/manifest")
    (lambda source, target: __import__("shutil").copy(source, target))(path, f"{folder}-cut/{row.file}.ids".removeprefix("file:"))
    got = separator_scan(spark, f"{folder}-cut", 50256, block_ids=2).orderBy("place").collect()
    assert [(r.place, r.closed) for r in got] == [(0, True), (1, False)]


def test_letters_alone_are_not_looked_at_for_cuts():
    """Before, every new chunk was tested for the places where it can be cut."""
    from rankloom.llm.encoders import Chunks

    seen = []

    def parts(chunk):
        seen.append(chunk)
        return [chunk[:-1], "."] if chunk.endswith(".") else [chunk]

    chunks = Chunks(lambda some: [c.encode() for c in some], 100, parts)
    chunks.learn({"word", "Äpfel", "end.", "2nd", "."[:0] + "a"})
    assert sorted(seen) == ["2nd", "end."]
    assert {c: chunks.known[c] for c in ("word", "Äpfel", "end.", "2nd", "a")} == {
        c: c.encode() for c in ("word", "Äpfel", "end.", "2nd", "a")}
