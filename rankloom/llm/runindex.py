"""Long repeats by a run-length index: bytes that a repeated string of ``length`` covers go.

*Meeting.* Every window of ``length`` bytes picks the smallest hash of its ``GRAM``-byte
grams, so equal windows pick the same one, its anchor. Anchors are counted over all texts;
only those met twice can have equal windows. Windows in a row with one anchor are a stretch,
and the stretches of an anchor are brought together, with their bytes.

*Index.* The distinct stretches of some anchors are joined to one text, whose
Burrows-Wheeler transform is kept as runs. Where a run starts or ends, the text position and
the length it shares with its neighbour in sorted order are sampled. Inside a run that
length falls by one from each position to the next, so the samples are streamed over the
text and give at every position the longest match elsewhere: its matching statistic. A
window starting where it reaches ``length`` is repeated. Equal stretches are one with a
count, and repeated throughout.

An anchor of more than ``HOT`` stretches is not held by one task: its distinct stretches are
taken apart into windows, which are counted by a 128-bit hash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import run_folder, stored, whole_text

LENGTH = 200
GRAM = 40
# Stretches of one anchor that a task may hold, some 280 bytes each.
HOT = 32_768
# Bytes of stretches that a task gathers, over whole anchors, before it builds an index.
CHUNK = 4 << 20

_BYTE_HASH = np.random.default_rng(20).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_STEP, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` values in a row, by doubling."""
    size = 1
    while 2 * size <= width:
        values, size = pick(values[:-size], values[size:]), 2 * size
    rest = width - size
    return pick(values[:len(values) - rest], values[rest:]) if rest else values


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from every position."""
    whole, part, size, step, covered = None, _BYTE_HASH[data], 1, _STEP, 0
    while True:
        if gram & size:
            if whole is None:
                whole = part
            else:
                # The bytes taken so far, then the next ones.
                n = len(data) - covered - size + 1
                whole = whole[:n] * np.uint64(step) + part[covered:covered + n]
            covered += size
        if 2 * size > gram:
            break
        part = part[:-size] * np.uint64(step) + part[size:]
        size, step = 2 * size, step * step % 2**64
    whole = whole ^ whole >> np.uint64(32)
    whole = whole * _MIX
    return whole ^ whole >> np.uint64(29)


def window_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams' hashes, and the anchor of every window of a text of ``length`` bytes or more."""
    hashes = gram_hashes(data, gram)
    return hashes, _slide(hashes, length - gram + 1, np.minimum)


def anchor_counts(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a text and at how many positions each stands."""
    hashes, smallest = window_anchors(data, length, gram)
    width = length - gram + 1
    padded = np.concatenate([np.zeros(width - 1, np.uint64), smallest, np.zeros(width - 1, np.uint64)])
    # A gram is an anchor if the largest minimum of the windows around it is its own hash.
    at = hashes == _slide(padded, width, np.maximum)
    return np.unique(hashes[at], return_counts=True)


def stretches(data: np.ndarray, wanted: np.ndarray, length: int, gram: int):
    """(anchor, start, end) of the windows in a row that share one of the wanted anchors."""
    _, smallest = window_anchors(data, length, gram)
    cuts = np.flatnonzero(smallest[1:] != smallest[:-1]) + 1
    starts = np.concatenate([[0], cuts])
    ends = np.concatenate([cuts, [len(smallest)]]) + length - 1
    keep = np.isin(smallest[starts], wanted)
    return smallest[starts[keep]], starts[keep], ends[keep]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; the text ends with its smallest symbol, 0."""
    n = len(symbols)
    key = _packed(symbols)
    order = np.argsort(key, kind="stable")
    ranks = np.empty(n, np.int64)
    spots, depth, found = np.arange(n), 7, key[order]
    suffixes = order
    while True:
        # A suffix ranks as the first place of those it is not yet told from.
        heads = np.concatenate([[True], found[1:] != found[:-1]])
        ranks[suffixes[spots]] = spots[np.maximum.accumulate(np.where(heads, np.arange(len(spots)), 0))]
        open_ = ~(heads & np.concatenate([heads[1:], [True]]))
        spots = spots[open_]
        if not len(spots):
            return suffixes
        some = suffixes[spots]
        after = some + depth
        following = np.where(after < n, ranks[np.minimum(after, n - 1)] + 1, 0)
        key = ranks[some] * (n + 1) + following
        order = np.argsort(key, kind="stable")
        suffixes[spots], found = some[order], key[order]
        depth *= 2


def _packed(symbols: np.ndarray) -> np.ndarray:
    """Seven symbols of nine bits from every position, as one number."""
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(6, np.int64)])
    key = np.zeros(len(symbols), np.int64)
    for i in range(7):
        key = key << 9 | padded[i:i + len(symbols)]
    return key


def _shared(symbols: np.ndarray, packed: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` share."""
    n, found = len(symbols), np.zeros(len(a), np.int64)
    for keys, step in ((packed, 7), (symbols, 1)):
        live = np.arange(len(a))
        while len(live):
            x, y = a[live] + found[live], b[live] + found[live]
            inside = np.maximum(x, y) + step <= n
            live, x, y = live[inside], x[inside], y[inside]
            live = live[keys[x] == keys[y]]
            found[live] += step
    return found


class RunIndex:
    """A text's Burrows-Wheeler transform as runs, with samples where they start and end."""

    def __init__(self, symbols: np.ndarray):
        suffixes = suffix_order(symbols)
        transform = symbols.astype(np.int64)[suffixes - 1]
        transform[suffixes == 0] = -1
        change = transform[1:] != transform[:-1]
        packed, self.size, self.runs = _packed(symbols), len(symbols), int(change.sum()) + 1
        first, last = np.flatnonzero(change) + 1, np.flatnonzero(change)
        self.starts = self._samples(suffixes[first], _shared(symbols, packed, suffixes[first - 1], suffixes[first]), suffixes[0])
        self.ends = self._samples(suffixes[last], _shared(symbols, packed, suffixes[last], suffixes[last + 1]), suffixes[-1])

    @staticmethod
    def _samples(positions, lengths, alone):
        positions, lengths = np.append(positions, alone), np.append(lengths, 0)
        order = np.argsort(positions)
        return positions[order], lengths[order]

    def matching_statistics(self) -> np.ndarray:
        """The length of the longest match elsewhere in the text, from every position."""
        best, places = np.zeros(self.size, np.int64), np.arange(self.size)
        for positions, lengths in (self.starts, self.ends):
            sample = np.searchsorted(positions, places, "right") - 1
            reach = lengths[sample] - (places - positions[sample])
            best = np.maximum(best, np.where(sample >= 0, reach, 0))
        return best


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """In each of different texts, where windows start that also start anywhere else in them."""
    sizes = np.array([len(t) for t in texts])
    firsts = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int(sizes.sum()) + len(texts), np.uint16)
    # Texts end with 0, and their bytes count from 1: a match of bytes stays in its text.
    symbols[:] = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    inside = np.ones(len(symbols), bool)
    inside[firsts + sizes] = False
    symbols[inside] += 1
    statistics = RunIndex(symbols).matching_statistics()
    return [np.flatnonzero(statistics[a:a + n - length + 1] >= length) for a, n in zip(firsts, sizes)]


def _spans(starts: np.ndarray, length: int):
    """The intervals that windows at sorted starts cover."""
    if not len(starts):
        return
    cuts = np.flatnonzero(np.diff(starts) > length)
    for a, b in zip(starts[np.concatenate([[0], cuts + 1])], starts[np.concatenate([cuts, [len(starts) - 1]])]):
        yield int(a), int(b) + length


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, body (64 bits), digest (128 bits) and the compressed bytes of every text."""
    def pack(batches):
        squeeze = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            data = [t.encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([_body(t) for t in data], pa.int64()),
                pa.array([hashlib.md5(t).digest() for t in data], pa.binary()), pa.array(map(squeeze, data), pa.binary()),
            ], names=["doc_id", "body", "digest", "packed"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(pack, f"doc_id {kind}, body long, digest binary, packed binary")


def _body(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - 2**63


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _anchors(docs: DataFrame, text_col: str, length: int, gram: int) -> DataFrame:
    def count(batches):
        for batch in batches:
            found, met, bodies, sizes = [], [], [], []
            for text in batch.column(0):
                data = text.as_py().encode()
                if len(data) >= length:
                    anchors, counts = anchor_counts(np.frombuffer(data, np.uint8), length, gram)
                    found.append(_signed(anchors))
                    met.append(counts)
                    bodies.append(_body(data))
                    sizes.append(len(anchors))
            none = np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([none, *found])), pa.array(np.concatenate([none, *met]).astype(np.int32)),
                pa.array(np.repeat(np.array(bodies, np.int64), sizes))], names=["anchor", "n", "body"])

    return docs.select(whole_text(text_col).alias("text")).mapInArrow(count, "anchor long, n int, body long")


def _stretches(texts: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes of the stretches of the wanted (body, anchors): anchor, digest, start, bytes."""
    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out, held = ([], [], [], []), 0
            for digest, packed, anchors in zip(*(c.to_pylist() for c in batch.columns)):
                data = unpack(packed)
                want = np.array(anchors, np.int64).view(np.uint64)
                found = stretches(np.frombuffer(data, np.uint8), want, length, gram)
                for anchor, a, b in zip(_signed(found[0]).tolist(), found[1].tolist(), found[2].tolist()):
                    for column, value in zip(out, (anchor, digest, a, data[a:b])):
                        column.append(value)
                    held += b - a
                if held > CHUNK:
                    yield _batch(out)
                    out, held = ([], [], [], []), 0
            yield _batch(out)

    def _batch(out):
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds)], names=["anchor", "digest", "start", "bytes"])

    joined = texts.join(wanted, "body").select("digest", "packed", "anchors")
    return joined.mapInArrow(cut, "anchor long, digest binary, start int, bytes binary")


def _index(length: int):
    """A task's pass over stretches sorted by anchor: the repeated spans of each."""
    def spans(members, out):
        """members: anchor -> bytes -> [(digest, start)]."""
        single = []
        for group in members.values():
            for data, where in group.items():
                if len(where) > 1:
                    for digest, start in where:
                        out.append((digest, start, start + len(data)))
            if any(len(where) == 1 for where in group.values()):
                single.extend(group.items())
        if single:
            starts = repeated_starts([data for data, _ in single], length)
            for (_, where), found in zip(single, starts):
                if len(where) == 1:
                    digest, start = where[0]
                    out.extend((digest, start + a, start + b) for a, b in _spans(found, length))

    def scan(batches):
        members, held, last = defaultdict(lambda: defaultdict(list)), 0, None
        for batch in batches:
            out = []
            for anchor, digest, start, data in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor != last and held >= CHUNK:
                    spans(members, out)
                    members.clear()
                    held = 0
                last, held = anchor, held + len(data)
                members[anchor][data].append((digest, start))
            yield _batch(out)
        out = []
        spans(members, out)
        yield _batch(out)

    def _batch(out):
        columns = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())],
            names=["digest", "begin", "end"])

    return scan


def _by_windows(found: DataFrame, length: int, folder: str) -> DataFrame:
    """The repeated spans of hot anchors, by counting the windows of their distinct stretches."""
    def windows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, n = row["bytes"], len(row["bytes"]) - length + 1
                hashes = [hashlib.blake2b(data[i:i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes, pa.binary()), pa.array([min(row["n"], 2)] * n, pa.int32()),
                    pa.array([row["digest"]] * n, pa.binary()), pa.array(np.arange(n, dtype=np.int32) + row["start"]),
                ], names=["window", "n", "digest", "begin"])

    found = stored(found, f"{folder}/hot")
    key = F.md5("bytes").alias("key")
    distinct = found.groupBy("anchor", key).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("bytes", "digest", "start")).alias("one"))
    distinct = stored(distinct.select("anchor", "key", "n", "one.*"), f"{folder}/distinct")
    copies = found.select("anchor", key, "digest", F.col("start").alias("begin"), (F.col("start") + F.length("bytes")).alias("end"))
    copies = copies.join(distinct.where("n > 1").select("anchor", "key"), ["anchor", "key"]).select("digest", "begin", "end")
    each = stored(distinct.select("bytes", "n", "digest", "start").mapInArrow(
        windows, "window binary, n int, digest binary, begin int"), f"{folder}/windows")
    repeated = each.groupBy("window").agg(F.sum("n").alias("met")).where("met > 1").select("window")
    own = each.where("n = 1").join(repeated, "window", "left_semi").select(
        "digest", "begin", (F.col("begin") + length).alias("end"))
    return copies.unionByName(own)


def drop_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Remove every byte that a repeated ``length``-byte string covers.

    Strings are judged on the texts given: one that starts at two positions, in one text or
    in two, is repeated in both, overlaps included; none crosses texts. Returns one row per
    row: doc_id, n_bytes, kept (the bytes that are left), spans (array of [begin, end) of
    removed bytes). A null text is empty; texts shorter than ``length`` stay; equal rows
    repeat each other; a null id stays null; no rows give no rows; other columns are not read.
    """
    folder = run_folder(docs.sparkSession, "repeats")
    anchors = stored(_anchors(docs, text_col, length, gram), f"{folder}/anchors")
    counts = anchors.groupBy("anchor").agg(F.sum("n").alias("met")).where("met > 1")
    wanted = anchors.select("anchor", "body").join(counts, "anchor").groupBy("body").agg(
        F.collect_set(F.when(F.col("met") <= hot, F.col("anchor"))).alias("anchors"),
        F.collect_set(F.when(F.col("met") > hot, F.col("anchor"))).alias("hot"))
    wanted = stored(wanted, f"{folder}/wanted")
    texts = _texts(docs, id_col, text_col)

    usual = wanted.where(F.size("anchors") > 0).select("body", "anchors")
    near = _stretches(texts, usual, length, gram).repartition("anchor").sortWithinPartitions("anchor")
    spans = near.mapInArrow(_index(length), "digest binary, begin int, end int")
    often = wanted.where(F.size("hot") > 0).select("body", F.col("hot").alias("anchors"))
    if not often.isEmpty():
        spans = spans.unionByName(_by_windows(_stretches(texts, often, length, gram), length, folder))
    per_text = spans.groupBy("digest").agg(F.collect_set(F.struct("begin", "end")).alias("found"))
    per_text = stored(per_text, f"{folder}/spans")

    def remove(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = {"n_bytes": [], "kept": [], "spans": []}
            for packed, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, merged = unpack(packed), []
                for begin, end in sorted((s["begin"], s["end"]) for s in found or ()):
                    if merged and begin <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([begin, end])
                edges = [0, *(x for s in merged for x in s), len(data)]
                out["n_bytes"].append(len(data))
                out["kept"].append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                out["spans"].append([{"begin": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(out["n_bytes"], pa.int64()), pa.array(out["kept"], pa.binary()),
                pa.array(out["spans"], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", *out])

    joined = texts.join(per_text, "digest", "left").select("doc_id", "packed", "found")
    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(
        remove, f"doc_id {kind}, n_bytes long, kept binary, spans array<struct<begin: int, end: int>>")
