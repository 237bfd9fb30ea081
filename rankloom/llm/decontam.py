"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items come in blocks of bounded size, and each block goes over all documents:

1. *Background.* For every word n-gram of an item, count the documents in which it stands
   alone, that is, without another n-gram of the item. Copies of an item do not count, as
   they hold many of them, so a test item that leaked often does not become common.
2. *Seeds.* An n-gram seeds if its background is rare, or if it is in the rarer half of its
   item; so no item is without seeds.
3. *Alignment.* Passages around the seeds are aligned with their item, word by word. Edited
   words, insertions and gaps cost a little each, so a reworded copy still scores high.

A document is contaminated by an item from ``threshold`` of the score of a full copy. An item of
fewer words than an n-gram has no seed: its words must stand in a row, and an item of one word
must be the whole document, as a word alone is no copy of anything.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import run_folder, stored, whole_text

WORDS = 3
THRESHOLD = 0.5
# An n-gram is rare if it stands alone in no more than this share of the documents.
RARE_SHARE = 1e-4
# Bytes of item text in a block, which is what tasks hold at a time.
BLOCK_BYTES = 16 << 20
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
_WORD = re.compile(r"\w+")
# Letters of scripts that put no spaces between words: Thai to Tibetan, Burmese, Khmer, Han and kana.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_LETTER, _EITHER = re.compile(f"[{_UNSPACED}]"), re.compile(f"[{_UNSPACED}]|[^\\W{_UNSPACED}]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased; of unspaced scripts every letter."""
    text = text.lower()
    return (_EITHER if _LETTER.search(text) else _WORD).findall(text)


def align(passage: np.ndarray, item: np.ndarray) -> tuple[float, int]:
    """Best local alignment score of two sequences of words, and where it ends in the passage."""
    steps = GAP * np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1), 0.0, 0
    for word in item:
        fresh = np.maximum(row + GAP, 0)
        fresh[1:] = np.maximum(fresh[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        # Skipped words of the passage are a run along the row.
        row = np.maximum.accumulate(fresh - steps) + steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = float(row[at]), at
    return best, end


class Items:
    """A block of test items as numbers, with their n-grams."""

    def __init__(self, rows: list[tuple[list[int], str]], words: int):
        self.words = words
        self.vocabulary: dict[str, int] = {}
        self.ids, self.items = [], []
        for ids, text in rows:
            found = words_of(text)
            self.ids.append(ids)
            self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found], np.int64))
        self.base = max(2, len(self.vocabulary))
        if self.base ** words >= 2**62:
            raise ValueError("fewer words per n-gram, or smaller blocks, are needed")
        self.holders: dict[int, list[int]] = defaultdict(list)
        for i, item in enumerate(self.items):
            for code in np.unique(self.grams(item)[0]).tolist():
                self.holders[code].append(i)
        self.short: dict[tuple, list[int]] = defaultdict(list)
        for i, item in enumerate(self.items):
            if 0 < len(item) < words:
                self.short[tuple(item.tolist())].append(i)
        self.use(self.holders)

    def use(self, codes) -> None:
        """Look for these n-grams from now on."""
        self.codes = np.array(sorted(codes), np.int64)

    def grams(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and places of the n-grams whose words all are in some item."""
        n = self.words
        if len(numbers) < n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        inside = numbers >= 0
        whole = np.logical_and.reduce([inside[i:len(numbers) - n + 1 + i] for i in range(n)])
        at = np.flatnonzero(whole)
        code = np.zeros(len(at), np.int64)
        for i in range(n):
            code = code * self.base + numbers[at + i]
        return code, at

    def hits(self, text: str):
        """The numbers of a text's words, and its n-grams that are looked for, with places."""
        found = words_of(text)
        numbers = np.fromiter(map(self.vocabulary.get, found, itertools.repeat(-1)), np.int64, len(found))
        code, at = self.grams(numbers)
        if not len(code) or not len(self.codes):
            return numbers, code[:0], at[:0]
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        met = self.codes[place] == code
        return numbers, code[met], at[met]

    def alone(self, text: str) -> list[int]:
        """The n-grams of the text that are the only one of each of their items."""
        codes = np.unique(self.hits(text)[1]).tolist()
        per_item = Counter(i for c in codes for i in self.holders[c])
        return [c for c in codes if any(per_item[i] == 1 for i in self.holders[c])]

    def matches(self, text: str, threshold: float):
        """(item, score, end word) of every item that the text holds a copy of."""
        numbers, codes, at = self.hits(text)
        yield from self._whole(numbers)
        places = defaultdict(list)
        for code, place in zip(codes.tolist(), at.tolist()):
            for i in self.holders[code]:
                places[i].append(place)
        for i, where in places.items():
            item = self.items[i]
            full, reach, best = MATCH * len(item), 2 * len(item), (0.0, 0)
            # Seeds whose passages overlap are aligned once.
            where = sorted(where)
            first = where[0]
            for place, following in zip(where, [*where[1:], None]):
                if following is None or following - place > 2 * reach:
                    begin = max(0, first - reach)
                    score, end = align(numbers[begin:place + self.words + reach], item)
                    best = max(best, (score, begin + end))
                    first = following
            if best[0] >= threshold * full:
                yield i, best[0] / full, best[1]

    def _whole(self, numbers: np.ndarray):
        """The same for items shorter than an n-gram: their words in a row, or the only word of the text."""
        met, row = {}, numbers.tolist()
        for n in {len(item) for item in self.short}:
            if n > 1 or len(row) == 1:
                for at in range(len(row) - n + 1):
                    for i in self.short.get(tuple(row[at:at + n]), ()):
                        met.setdefault(i, at + n)
        return [(i, 1.0, end) for i, end in met.items()]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """Equal items as one, in blocks of at most ``block_bytes`` of text (or one item)."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.lower(whole_text(text_col)).alias("text"))
    items = items.groupBy("text").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    size = F.octet_length("text") + 64
    cells = stored(items.withColumn("size", size.cast("long")), run_folder(benchmark.sparkSession, "items"))
    total, largest = cells.agg(F.coalesce(F.sum("size"), F.lit(0)), F.max("size")).collect()[0]
    count = max(1, -(-2 * total // block_bytes))
    for block in range(count):
        rows = cells.where(F.pmod(F.xxhash64("text"), F.lit(count)) == block)
        yield [(r.ids, r.text) for r in rows.select("ids", "text").toLocalIterator()]


def leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, words: int = WORDS,
    rare_share: float = RARE_SHARE, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Copies of test items in documents: doc_id, item_id, score (1: a full copy), end_word.

    Words are runs of letters, digits and underscores, lower-cased; letters of scripts without
    spaces are words of their own. Null and empty texts have none, and items without words are
    not found; equal items are found together; null item ids are left out. Rows that repeat an id are searched each. No
    documents or no items give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    total, found = docs.count(), None
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        items = Items(block, words)
        seeds = _rare(rows, items, rare_share * total)
        items.use(seeds)
        shared = spark.sparkContext.broadcast(items)

        def search(batches, shared=shared):
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                out = {"doc_id": [], "item_id": [], "score": [], "end_word": []}
                for doc_id, text in zip(ids, texts):
                    for i, score, end in shared.value.matches(text.as_py(), threshold):
                        for item_id in shared.value.ids[i]:
                            for name, value in zip(out, (doc_id, item_id, score, end)):
                                out[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["doc_id"], pa.int64()), pa.array(out["item_id"], pa.int64()),
                     pa.array(out["score"], pa.float64()), pa.array(out["end_word"], pa.int64())], names=list(out))

        made = rows.mapInArrow(search, "doc_id long, item_id long, score double, end_word long")
        found = made if found is None else found.unionByName(made)
    return found


def _rare(rows: DataFrame, items: Items, limit: float) -> list[int]:
    """The n-grams that seed: rare in the background, or in the rarer half of an item.

    At most one number per n-gram of the block comes to the driver.
    """
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def count(batches):
        counts = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(shared.value.alone(text.as_py()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["code", "n"])

    counted = rows.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    background = Counter({r["code"]: r.n for r in counted.toLocalIterator()})
    seeds = {c for c in items.holders if background[c] <= limit}
    for item in items.items:
        codes = sorted(np.unique(items.grams(item)[0]).tolist(), key=lambda c: background[c])
        if codes:
            middle = background[codes[(len(codes) - 1) // 2]]
            seeds.update(c for c in codes if background[c] <= middle)
    return sorted(seeds)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, item_ids (sorted), best_score.

    Rows that share an id are one document and get the same answer.
    """
    hits = leaks(docs, benchmark, id_col=id_col, **options)
    per = hits.groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("score").alias("best_score"))
    per = per.withColumnRenamed("doc_id", "_doc")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    joined = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return joined.select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), "best_score")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no copy of a test item, with all their columns."""
    hits = leaks(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("_gone")).distinct()
    gone = stored(hits, run_folder(docs.sparkSession, "leaks"))
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_gone")), "left_anti")
