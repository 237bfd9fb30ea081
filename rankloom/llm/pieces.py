"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is cut before every run of spaces into marked words. The distinct words of a block
are sorted, which is the depth-first order of their trie: each word keeps the forward table
of the prefix it shares with the word before, and only its own letters are added. The table
holds, for every prefix of a word, the last piece of its segmentation, so the pieces of a
word are read off backwards.

* In a unigram model the last piece is that of the best sum of scores (Viterbi).
* In a BPE model sums of scores mean nothing: the segmentation is what the merges leave.
  There the last piece of a prefix is the one that stands after the prefix before it with
  no merge across their border; one piece always does, and the rest of the pass is the same.

A piece may hold the mark of a space only in front, which is checked: then no piece lies
across two words, and words can be encoded one by one.
"""

from __future__ import annotations

import heapq
import itertools
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import pieces_of, whole_text

MARK = "▁"
# The kinds of models and pieces in a SentencePiece file.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
# Fixed value: how far below the lowest score an unknown letter is.
UNKNOWN_PENALTY = 10.0
# Marked words and borders that a worker remembers at a time, some 30 MB of each. Half of them stays when there
# are more: words that were met again, and those that came first.
REMEMBERED = 150_000
_WORD = re.compile(r" +[^ ]*")


@dataclass(frozen=True)
class Model:
    """What a SentencePiece file says: pieces in the order of their ids."""

    kind: int
    pieces: tuple[tuple[str, float, int], ...]
    prefixed: bool = True

    @classmethod
    def read(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as source:
            proto.ParseFromString(source.read())
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models that leave the text as it is can be used")
        pieces = tuple((p.piece, p.score, p.type) for p in proto.pieces)
        return cls(proto.trainer_spec.model_type, pieces, rules.add_dummy_prefix)


class Segmenter:
    """Encodes and decodes with a model; remembers words."""

    def __init__(self, model: Model, remembered: int = REMEMBERED):
        if model.kind not in (UNIGRAM, BPE) or any(t == USER_DEFINED for _, _, t in model.pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces can be used")
        self.model, self.limit = model, remembered
        self.ids = {p: i for i, (p, _, t) in enumerate(model.pieces) if t == NORMAL}
        self.scores = {p: s for p, s, t in model.pieces if t == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds the mark of a space inside")
        self.closing = self._closing()
        # Places in the order of merges; a letter was never merged.
        order = {v: i for i, v in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.ranks = {p: order[v] if len(p) > 1 else -1 for p, v in self.scores.items()}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.low = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(model.pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(model.pieces) if t == UNKNOWN), 0)
        self.words: dict[str, bytes] = {}
        self.borders: dict[str, bool] = {}
        self.table = [self._spelled(p, t) for p, _, t in model.pieces]

    def _closing(self) -> dict[str, tuple[str, ...]]:
        """For every beginning of a piece, the pieces that it ends with, longest first.

        A word is followed letter by letter through its longest ending that is such a beginning.
        """
        closing: dict[str, tuple[str, ...]] = {"": ()}
        for state in sorted({p[:i] for p in self.ids for i in range(1, len(p) + 1)}, key=len):
            rest = state[1:]
            while rest not in closing:
                rest = rest[1:]
            closing[state] = (state, *closing[rest]) if state in self.ids else closing[rest]
        return closing

    @staticmethod
    def _spelled(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def merged(self, word: str) -> list[str]:
        """Segment by merges alone: best score first, of equals the leftmost."""
        if len(word) <= 40:
            return self._merged_short(word)
        parts, after = list(word), list(range(1, len(word) + 1))
        before = list(range(-1, len(word) - 1))
        queue = []

        def offer(i):
            j = after[i]
            if j < len(parts):
                score = self.scores.get(parts[i] + parts[j])
                if score is not None:
                    heapq.heappush(queue, (-score, i, j, parts[i] + parts[j]))

        for i in range(len(word) - 1):
            offer(i)
        while queue:
            _, i, j, whole = heapq.heappop(queue)
            if parts[i] is None or after[i] != j or parts[j] is None or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j], after[i] = whole, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def _merged_short(self, word: str, least: int = 1) -> list[str]:
        """The same for a few letters, without a queue; stops when ``least`` parts are left."""
        parts, score = list(word), self.scores.get
        offers = [score(a + b) for a, b in zip(parts, parts[1:])]
        while len(parts) > least:
            best, at = None, -1
            for i, offer in enumerate(offers):
                if offer is not None and (best is None or offer > best):
                    best, at = offer, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del offers[at]
            if at < len(offers):
                offers[at] = score(parts[at] + parts[at + 1])
            if at:
                offers[at - 1] = score(parts[at - 1] + parts[at])
        return parts

    def _border(self, key: str, left: str, right: str) -> bool:
        """Whether two pieces stand side by side without a merge across; remembered under the key."""
        if len(self.borders) >= min(self.limit, REMEMBERED):
            kept = list(itertools.islice(self.borders.items(), len(self.borders) // 2))
            self.borders.clear()
            self.borders.update(kept)
        known = self.borders[key] = self._apart(left, right)
        return known

    def _halved(self, piece: str) -> tuple[str, str] | None:
        """What the last merge of a piece joins, if every merge in it comes later than those it needs."""
        if piece not in self.halves:
            parts = self._merged_short(piece, 2) if len(piece) <= 40 else ()
            ordered = len(parts) == 2 and all(
                len(p) == 1 or (self._halved(p) and self.ranks[p] < self.ranks[piece]) for p in parts)
            self.halves[piece] = (parts[0], parts[1]) if ordered else None
        return self.halves[piece]

    def _apart(self, left: str, right: str) -> bool:
        """Whether merging two pieces' letters leaves the two.

        Merges are undone from the last one on; what then stands beside the border must not have
        been merged before. Pieces whose merges are out of order are merged again instead.
        """
        whole, ranks, limit = (left, right), self.ranks, len(self.scores)
        if not left or any(len(p) > 1 and not self._halved(p) for p in whole):
            return self.merged(left + right) == ([left, right] if left else [right])
        while ranks.get(left + right, limit) >= limit:
            first, second = ranks.get(left, -1), ranks.get(right, -1)
            if first > second:
                left, limit = self.halves[left][1], first
            elif second >= 0:
                right, limit = self.halves[right][0], second + 1
            else:
                return True
        return False

    def forward(self, words: list[str]):
        """The segmentation of every one of sorted words, as a list of pieces each."""
        scores, closing, known, bpe = self.scores, self.closing, self.borders.get, self.model.kind == BPE
        last, best, states, earlier = [""], [0.0], [""], ""
        for word in words:
            if bpe and MARK + MARK in word:
                # Runs of marks have pieces of one score, where borders do not tell enough.
                yield self.merged(word)
                continue
            shared, most = 0, min(len(earlier), len(word))
            while shared < most and earlier[shared] == word[shared]:
                shared += 1
            del last[shared + 1:], best[shared + 1:], states[shared + 1:]
            state = states[shared]
            for end in range(shared + 1, len(word) + 1):
                piece = word[end - 1]
                state += piece
                while (found := closing.get(state)) is None:
                    state = state[1:]
                states.append(state)
                if bpe:
                    for part in found:
                        if len(part) == 1:
                            break
                        key = f"{(left := last[end - len(part)])}\n{part}"
                        if (stands := known(key)) is None:
                            stands = self._border(key, left, part)
                        if stands:
                            piece = part
                            break
                else:
                    # A letter that is no piece may still stand for itself, at a low score.
                    top = float("-inf") if piece in scores else best[end - 1] + self.low
                    for part in found:
                        start = end - len(part)
                        if best[start] + scores[part] > top:
                            piece, top = part, best[start] + scores[part]
                    best.append(top)
                last.append(piece)
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            yield pieces[::-1]
            earlier = word

    def _numbered(self, pieces: list[str]) -> bytes:
        out = list(map(self.ids.get, pieces))
        if None in out:
            out = []
            for piece in pieces:
                known = self.ids.get(piece)
                if known is not None:
                    out.append(known)
                elif self.bytes:
                    out.extend(self.bytes[b] for b in piece.encode())
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
        return array("i", out).tobytes()

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        return [ids for part in pieces_of(texts) for ids in self._encode_part(part)]

    def _encode_part(self, texts: list[str]) -> list[bytes]:
        split = []
        for text in texts:
            marked = text.replace(MARK, " ")
            if not text:
                split.append([])
            elif self.model.prefixed and "  " not in marked and marked[0] != " " and marked[-1] != " ":
                split.append(marked.split(" "))
            else:
                # Written with their spaces; a first word without one has its own key.
                marked = " " + marked if self.model.prefixed else marked
                opening = marked[:len(marked) - len(marked.lstrip(" "))] or marked.split(" ", 1)[0]
                rest = marked[len(opening):] if opening.strip(" ") else marked
                words = [w[1:] if w[1:2] not in (" ", "") else w for w in _WORD.findall(rest)]
                split.append([f" \n{opening}", *words] if opening.strip(" ") else words)
        used = set().union(*split)
        fresh = used.difference(self.words)
        if len(self.words) + len(fresh) > self.limit:
            # Words met again come first, in their order, so the frequent ones stay.
            again = [w for w in self.words if w in used]
            rest = (w for w in self.words if w not in used)
            kept = itertools.islice(itertools.chain(again, rest), self.limit // 2)
            self.words = {w: self.words[w] for w in kept}
            fresh = used.difference(self.words)
        keys = {self._marked(k): k for k in fresh}
        order = sorted(keys)
        for word, pieces in zip(order, self.forward(order)):
            self.words[keys[word]] = self._numbered(pieces)
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]

    @staticmethod
    def _marked(key: str) -> str:
        """The marked word behind a key: a plain key has one mark in front."""
        if key.startswith(" \n"):
            return key[2:]
        return key.replace(" ", MARK) if key.startswith(" ") else MARK + key

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.table.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.model.prefixed and text.startswith(" ") else text


_segmenters: dict[int, Segmenter] = {}


def _segmenter(model: Model, remembered: int = REMEMBERED) -> Segmenter:
    key = hash((model, remembered))
    if key not in _segmenters:
        _segmenters.clear()
        _segmenters[key] = Segmenter(model, remembered)
    return _segmenters[key]


def encode_pieces(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every whole text, in place: nothing is shuffled.

    Null and empty texts have no ids; a null doc_id stays null; rows that repeat are all
    returned; no rows give no rows; other columns are not read. U+2581 counts as a space.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches):
        for batch in batches:
            coded = _segmenter(shared.value).encode_block(batch.column(1).to_pylist())
            sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(coded), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids array<int>")


def decode_pieces(coded: DataFrame, model: Model) -> DataFrame:
    """doc_id and text of every row of doc_id and ids; null ids decode to an empty text."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def decode(batches):
        for batch in batches:
            segmenter = _segmenter(shared.value)
            texts = [segmenter.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED,
) -> DataFrame:
    """Encode and decode every whole text in one pass: doc_id, ids, exact.

    ``exact`` is whether the decoded text is the one given (null: empty, U+2581: a space).
    ``remembered`` words are kept by a worker, some 200 bytes each; the result is the same.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def both(batches):
        for batch in batches:
            segmenter, texts = _segmenter(shared.value, remembered), batch.column(1).to_pylist()
            coded = [np.frombuffer(c, "<i4") for c in segmenter.encode_block(texts)]
            exact = [segmenter.decode(c.tolist()) == t.replace(MARK, " ") for c, t in zip(coded, texts)]
            ends = np.concatenate([[0], np.cumsum([len(c) for c in coded], dtype=np.int64)]).astype(np.int32)
            values = pa.array(np.concatenate([*coded, np.empty(0, "<i4")]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(exact, pa.bool_())],
                names=["doc_id", "ids", "exact"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(both, "doc_id long, ids array<int>, exact boolean")
