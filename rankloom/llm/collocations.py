"""Phrase collocations from sorted streams of counts.

Phrases are counted in streams: tasks number the words of a bounded buffer, sort the codes of
its phrases and hand on each distinct one with its count; Spark adds the counts up. A phrase
that is frequent has frequent parts only, so words are counted first, then pairs of frequent
words, then phrases of three and four whose pairs are frequent. What a task asks about frequent
words and pairs is a table of bits of fixed size. A bit that is set in error lets a phrase be
counted that the exact counts drop again, so the size decides about speed only.

The counts are then one stream that is read in two orders. In prefix order, sorted by the part
before a cut, it runs beside the counts of the parts: a merge of sorted streams. In suffix
order, sorted by the part after the cut, it does so again. The streams of phrases without their
last and without their first word give the counts of extensions in the same way. Spark brings
equal keys to one task and splits frequent ones; within a task both sides are merged in order.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import pieces_of, run_folder, stored, whole_text

LEAST = 30
LONGEST = 4
TOP = 2000
KEPT = 80
# Bits of the tables of frequent words and pairs: 4 MB each.
BITS = 1 << 25
# Words of a task's buffer of one language (of all: twice as many), and different words in it.
BUFFER = 1 << 21
WORDS = 1 << 19
SALTS = 64
# What ends a piece, and what separates words beside the blank.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_BREAKS + b"\t", b"\n" * len(_BREAKS) + b" ")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def _hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang))


def _pair(left, right):
    """Hashes of pairs from the hashes of their words."""
    mixed = left * _ODD + right
    return (mixed ^ (mixed >> np.uint64(29))) * _MIX


def _cell(hashes, bits: int):
    return (hashes >> np.uint64(11)) & np.uint64(bits - 1)


class _Buffer:
    """Words of one language as numbers in order; 0 ends a piece."""

    def __init__(self, lang: str):
        self.lang, self.size, self.parts = lang, 0, []
        self.numbers: defaultdict = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[b"\n"], self.numbers[b""]

    def add(self, texts: list[str]) -> None:
        # The list of a part's words is many times the size of its text.
        for part in pieces_of(texts, 1 << 19):
            data = "\n".join(part).encode("utf-8", "surrogatepass").lower().translate(_TABLE)
            words = data.replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
            self.parts += [ids[ids != 1], np.zeros(1, np.int32)]
            self.size += len(ids)

    def full(self) -> bool:
        return self.size >= BUFFER or len(self.numbers) >= WORDS

    def ids(self) -> np.ndarray:
        return np.concatenate(self.parts)

    def words(self) -> pa.Array:
        return pa.array(list(self.numbers), pa.binary())

    def hashes(self) -> np.ndarray:
        return np.fromiter((_hash(self.lang, w) for w in self.numbers), np.uint64, len(self.numbers))


def _in_buffers(batches, emit):
    """Gather texts by language and hand every buffer that is full to ``emit``."""
    held: dict[str, _Buffer] = {}
    for batch in batches:
        by_lang = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang[lang].append(text)
        for lang, texts in by_lang.items():
            buffer = held.setdefault(lang, _Buffer(lang))
            buffer.add(texts)
            if buffer.full():
                yield from emit(held.pop(lang))
        if sum(b.size for b in held.values()) >= 2 * BUFFER:
            for lang in list(held):
                yield from emit(held.pop(lang))
    for buffer in held.values():
        yield from emit(buffer)


def _rows(lang: str, order: int, terms: pa.Array, columns: list[np.ndarray], counts: np.ndarray):
    """Phrases as text, in batches; ``columns`` number their words in ``terms``."""
    for at in range(0, len(counts), 1 << 15):
        own = [terms.take(pa.array(c[at:at + (1 << 15)])) for c in columns]
        phrase = own[0] if len(own) == 1 else pc.binary_join_element_wise(*own, pa.scalar(b" ", pa.binary()))
        n = len(phrase)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * n), pa.array(np.full(n, order, np.int32)), phrase.cast(pa.string()),
             pa.array(counts[at:at + n].astype(np.int64))], names=["lang", "size", "phrase", "f"])


_COUNTS = "lang string, size int, phrase string, f long"


def _words(batches):
    def emit(buffer):
        counts = np.bincount(buffer.ids(), minlength=len(buffer.numbers))[2:]
        yield from _rows(buffer.lang, 1, buffer.words(), [np.arange(2, 2 + len(counts))], counts)
    return _in_buffers(batches, emit)


def _frequent(buffer: _Buffer, words: np.ndarray):
    """The buffer's numbers with 0 for words that are not frequent, and the words' hashes."""
    hashes = buffer.hashes()
    held = _held(words, hashes)
    held[:2] = False
    return np.where(held, np.arange(len(hashes)), 0)[buffer.ids()], hashes


def _held(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cells = _cell(hashes, 8 * len(table))
    return (table[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _pairs_of(words):
    def run(batches):
        def emit(buffer):
            ids, _ = _frequent(buffer, words.value)
            left, right = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
            met = (left > 0) & (right > 0)
            codes, counts = np.unique(left[met] << 32 | right[met], return_counts=True)
            yield from _rows(buffer.lang, 2, buffer.words(), [codes >> 32, codes & 0xFFFFFFFF], counts)
        return _in_buffers(batches, emit)
    return run


def _longer_of(words, pairs, longest: int):
    def run(batches):
        def emit(buffer):
            ids, hashes = _frequent(buffer, words.value)
            terms, here = buffer.words(), hashes[ids]
            good = (ids[:-1] > 0) & (ids[1:] > 0)
            good[good] = _held(pairs.value, _pair(here[:-1][good], here[1:][good]))
            # Numbers of the runs so far, first of pairs; each step takes one word more.
            starts = np.flatnonzero(good)
            _, numbers = np.unique(ids[starts].astype(np.int64) << 32 | ids[starts + 1], return_inverse=True)
            for size in range(3, longest + 1):
                at = starts + size - 2
                on = (at < len(good)) & good[np.minimum(at, len(good) - 1)]
                starts, numbers = starts[on], numbers[on]
                if not len(starts):
                    return
                codes, first, numbers, counts = np.unique(
                    numbers.astype(np.int64) << 32 | ids[starts + size - 1], return_index=True, return_inverse=True,
                    return_counts=True)
                yield from _rows(buffer.lang, size, terms, [ids[starts[first] + i] for i in range(size)], counts)
        return _in_buffers(batches, emit)
    return run


def _bits(frequent: DataFrame, size: int, bits: int) -> np.ndarray:
    """A table of ``bits`` bits that has those of all frequent phrases of this size set."""
    def cells(batches):
        for batch in batches:
            langs, phrases = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts = [np.fromiter((_hash(lang, p.encode("utf-8", "surrogatepass").split(b" ")[i]) for lang, p in zip(langs, phrases)),
                                 np.uint64, len(langs)) for i in range(size)]
            cell = _cell(parts[0] if size == 1 else _pair(*parts), bits)
            yield pa.RecordBatch.from_arrays([pa.array((cell >> np.uint64(3)).astype(np.int32)),
                                              pa.array((1 << (cell & np.uint64(7))).astype(np.int32))], names=["byte", "bit"])

    own = frequent.where(F.col("size") == size).select("lang", "phrase").mapInArrow(cells, "byte int, bit int")
    made = own.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 8, np.uint8)
    table[made.column("byte").to_numpy()] = made.column("bits").to_numpy()
    return table


def phrase_counts(
    docs: DataFrame, folder: str, least: int = LEAST, longest: int = LONGEST, bits: int = BITS,
    lang_col: str = "lang", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(counts, totals): lang, size, phrase, f of all phrases with f >= ``least``; and lang, n."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))

    def counted(run, name: str, kept: bool = True) -> DataFrame:
        counts = rows.mapInArrow(run, _COUNTS).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
        return stored(counts.where(F.col("f") >= least) if kept else counts, f"{folder}/{name}")

    every = counted(_words, "words", kept=False)
    totals = stored(every.groupBy("lang").agg(F.sum("f").alias("n")), f"{folder}/totals")
    counts = stored(every.where(F.col("f") >= least), f"{folder}/frequent")
    words = spark.sparkContext.broadcast(_bits(counts, 1, bits))
    counts = counts.unionByName(counted(_pairs_of(words), "pairs"))
    if longest > 2:
        pairs = spark.sparkContext.broadcast(_bits(counts, 2, bits))
        counts = counts.unionByName(counted(_longer_of(words, pairs, longest), "longer"))
    return counts, totals


def _words_of(phrase: str, begin, length) -> Column:
    return F.array_join(F.slice(F.split(phrase, " ", -1), begin, length), " ")


def _big(column) -> Column:
    return F.col(column).cast("decimal(19,0)") if isinstance(column, str) else column.cast("decimal(19,0)")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, kept: int = KEPT, bits: int = BITS,
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``longest`` words.

    Texts are lower-cased in A-Z and cut at punctuation and line ends; words end at blanks and
    tabs. ``a`` counts a phrase, ``l`` and ``r`` its two parts at the cut with the lowest score
    floor(2000000 a / (l + r)), ties to the earliest; ``n`` counts all words. Phrases of fewer
    than ``least`` occurrences are left out, and so is one that stands in a longer phrase with
    at least ``kept`` per cent of its count. Ranks go by score, then count, then the phrase's bytes.

    A null language is ``und``, a null text is empty, rows that repeat count each time; a
    language without candidates has no rows. No rows give no rows; other columns are not read.
    """
    folder = run_folder(docs.sparkSession, "phrases")
    counts, totals = phrase_counts(docs, folder, least, longest, bits, lang_col, text_col)
    counts = stored(counts, f"{folder}/counts")

    size = F.col("size")
    phrases = counts.where(size > 1).select("lang", "size", "phrase", F.col("f").alias("a"))
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cut = cut.withColumns({"before": _words_of("phrase", F.lit(1), F.col("k")), "after": _words_of("phrase", F.col("k") + 1, size - F.col("k"))})
    # Sorted by what stands before the cut, then by what stands after it.
    prefix = counts.select("lang", F.col("phrase").alias("before"), F.col("f").alias("l"))
    suffix = counts.select("lang", F.col("phrase").alias("after"), F.col("f").alias("r"))
    cut = cut.join(prefix.hint("merge"), ["lang", "before"]).join(suffix.hint("merge"), ["lang", "after"])
    score = F.expr("cast(cast(a as decimal(19,0)) * cast(2000000 as decimal(7,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)")
    scored = cut.groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low"))

    # A part of a longer phrase is a part of one that is a word longer, which is as frequent at least.
    wider = counts.where(size > 2).select("lang", "f", F.explode(F.array(
        _words_of("phrase", F.lit(1), size - 1), _words_of("phrase", F.lit(2), size - 1))).alias("phrase"))
    wider = wider.groupBy("lang", "phrase").agg(F.max("f").alias("extended"))
    met = scored.join(wider.hint("merge"), ["lang", "phrase"], "left")
    alone = F.coalesce(_big("extended") * F.lit(100) < _big("a") * F.lit(kept), F.lit(True))
    left = met.where(alone).select("lang", "phrase", "a", "low.score", "low.l", "low.r")

    # The first of every part hold the first of all.
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best)))
    ranked = salted.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
    ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
