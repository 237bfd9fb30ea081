"""Encoders that tasks build for themselves from the content of a vocabulary file.

Each is a small picklable description; ``start()`` gives a function from a list of texts to
one bytes object of little-endian ids per text. The vocabulary (a few MB) travels with the
description, so executors need no path that the driver has.
"""

from __future__ import annotations

import base64
import itertools
import os
import re
from array import array
from dataclasses import dataclass
from pathlib import Path

import numpy as np

from rankloom.llm.common import pieces_of

# What a task has built stays for the later tasks of its Python worker.
_started: dict = {}

# Fixed value: the pattern that splits a text before the merges of the byte-level vocabulary.
BYTE_LEVEL_PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)

# Fixed value: the pattern by which the word-level vocabulary finds words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


def _once(key, build):
    if key not in _started:
        _started[key] = build()
    return _started[key]


@dataclass(frozen=True)
class LibraryEncoder:
    """The tokenizers library over a tokenizer.json, without special tokens added.

    A byte-level tokenizer splits at every space that a visible character follows, whatever
    stands around it, at a line feed between visible characters and between a letter and a
    mark. Texts are cut there and each distinct chunk is encoded by the library once per worker,
    up to ``remembered`` chunks at a time. Any other tokenizer, and a text that may hold an
    added token, gets the whole text.
    """

    content: str
    dtype: str = "<u2"
    remembered: int = 1_200_000

    @classmethod
    def read(cls, path: str, **options) -> LibraryEncoder:
        return cls(Path(path).read_text(), **options)

    def start(self):
        return _once(("library", hash(self.content), self.dtype), self._build)

    def _build(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        tokenizer, spec = Tokenizer.from_str(self.content), json.loads(self.content)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        dtype, limit = self.dtype, self.remembered

        library = _library(tokenizer, dtype)
        first = spec.get("pre_tokenizer") or {}
        byte_level = (
            first.get("type") == "ByteLevel" and first.get("use_regex", True)
            and not first.get("add_prefix_space") and not spec.get("normalizer")
        )
        if not byte_level:
            return library
        added = [t["content"] for t in spec.get("added_tokens", [])]
        marker = re.compile("|".join(map(re.escape, added))) if added else None
        cut, doubtful = re.compile(r" (?=\S)"), re.compile(r" (?:\s|$)")
        inner = re.compile(r"\s")
        opening = Chunks(library, limit, lambda chunk: _parts(chunk, inner))
        led = Chunks(lambda chunks: library([" " + c for c in chunks]), limit, lambda chunk: _parts(chunk, inner), opening)

        def block(texts):
            return [ids for part in pieces_of(texts) for ids in encode_part(part)]

        def encode_part(texts):
            whole = [bool(marker and marker.search(t)) for t in texts]
            split = [cut.split(t) if doubtful.search(t) else t.split(" ") for t, w in zip(texts, whole) if not w]
            # The second may forget what it learned for the first, so its own chunks come last.
            heads = [chunks.pop(0) for chunks in split]
            led.learn(set().union(*split))
            opening.learn(set(heads))
            first, later, rest = opening.known, led.known.__getitem__, zip(heads, split)
            out = []
            for text, w in zip(texts, whole):
                if w:
                    out.extend(library([text]))
                else:
                    head, chunks = next(rest)
                    out.append(first[head] + b"".join(map(later, chunks)))
            return out

        return block


def _library(tokenizer, dtype: str):
    """A function from texts to the library's ids as bytes."""
    kind = np.dtype(dtype).char

    def library(texts):
        return [array(kind, e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return library


def _parts(chunk: str, space) -> list[str]:
    """A chunk cut where its tokenizer always cuts: around a line feed, and before a last mark after a letter."""
    if "\n" in chunk and len(space.findall(chunk)) == chunk.count("\n"):
        lines = chunk.split("\n")
        if all(lines):
            out = _parts(lines[0], space)
            for line in lines[1:]:
                out += ["\n", *_parts(line, space)]
            return out
    if len(chunk) > 1 and chunk[-1] in ".,;:!?" and chunk[-2].isascii() and chunk[-2].isalpha():
        return [chunk[:-1], chunk[-1]]
    return [chunk]


class Chunks:
    """Ids of chunks of text. A chunk that can be cut is put together; the library encodes the others.

    What follows the first part is looked up in ``later``. When ``limit`` is passed, the chunks that came first
    stay, which are the frequent ones, and the other half goes.
    """

    def __init__(self, library, limit: int, parts, later: Chunks | None = None):
        self.library, self.limit, self.parts, self.later, self.known = library, limit, parts, later or self, {}

    def learn(self, chunks: set) -> None:
        fresh = chunks.difference(self.known)
        if len(self.known) + len(fresh) > self.limit:
            self.known = dict(itertools.islice(self.known.items(), self.limit // 2))
            fresh = chunks.difference(self.known)
        # Letters alone are never cut.
        heads = {c for c in fresh if c.isalpha()}
        plans = {c: self.parts(c) for c in fresh.difference(heads)}
        heads.update(p[0] for p in plans.values())
        tails = {x for p in plans.values() for x in p[1:]}
        if self.later is self:
            self._encode(heads | tails)
        else:
            self.later.learn(tails)
            self._encode(heads)
        own, later = self.known, self.later.known
        own.update((c, b"".join([own[p[0]], *(later[x] for x in p[1:])])) for c, p in plans.items() if len(p) > 1)

    def _encode(self, chunks: set) -> None:
        fresh = list(chunks.difference(self.known))
        for i in range(0, len(fresh), 4096):
            part = fresh[i:i + 4096]
            self.known.update(zip(part, self.library(part)))


@dataclass(frozen=True)
class RankEncoder:
    """tiktoken over a rank file; special tokens in a text are ordinary text."""

    content: bytes
    pattern: str = BYTE_LEVEL_PATTERN
    dtype: str = "<u2"

    @classmethod
    def read(cls, path: str, **options) -> RankEncoder:
        return cls(Path(path).read_bytes(), **options)

    def start(self):
        return _once(("ranks", hash(self.content), self.pattern, self.dtype), self._build)

    def _build(self):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.content.splitlines())}
        encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [np.array(encoding.encode_ordinary(t), self.dtype).tobytes() for t in texts]


@dataclass(frozen=True)
class WordEncoder:
    """The tokenizers library over a tokenizer.json that drops white space and lower-cases, without special tokens added.

    No piece of such a tokenizer crosses white space, nor the border between a letter and
    punctuation. Texts are lower-cased in A-Z, as the tokenizer does itself, and cut there;
    each distinct chunk is encoded once per worker, up to ``remembered`` chunks at a time. Texts
    that may hold an added token, and texts for any other kind of tokenizer, go to the library whole.
    """

    content: str
    dtype: str = "<u2"
    remembered: int = 1_200_000

    @classmethod
    def read(cls, path: str, **options) -> WordEncoder:
        return cls(Path(path).read_text(), **options)

    def start(self):
        return _once(("words", hash(self.content), self.dtype), self._build)

    def _build(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        tokenizer, spec = Tokenizer.from_str(self.content), json.loads(self.content)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        dtype, limit = self.dtype, self.remembered

        library = _library(tokenizer, dtype)
        if not _by_words(spec):
            return library
        added = [t["content"].encode().lower() for t in spec.get("added_tokens", [])]
        marker = re.compile(b"|".join(map(re.escape, added))) if added else None
        marks = b".,;:!?"

        def parts(chunk):
            apart = len(chunk) > 1 and chunk[-1] in marks and 97 <= chunk[-2] <= 122
            return [chunk[:-1], chunk[-1:]] if apart else [chunk]

        chunks = Chunks(lambda some: library([c.decode() for c in some]), limit, parts)

        def encode_part(texts):
            # Only ASCII white space is cut at; any other stays inside a chunk.
            lowered = [t.encode().lower() for t in texts]
            split = [None if marker and marker.search(d) else d.split() for d in lowered]
            chunks.learn({c for own in split if own for c in own})
            known = chunks.known.__getitem__
            return [library([t])[0] if own is None else b"".join(map(known, own)) for t, own in zip(texts, split)]

        return lambda texts: [ids for part in pieces_of(texts) for ids in encode_part(part)]


def _by_words(spec: dict) -> bool:
    """Whether a tokenizer.json lower-cases, and splits at white space that it drops and at classes of letters."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1].get("pattern") == {"Regex": "\\s+"} and steps[1].get("content") == " "
        and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        and first.get("pattern") == {"Regex": WORD_PATTERN}
    )
