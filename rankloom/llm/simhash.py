"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits are cut into segments on a ring. If two fingerprints differ in at
most ``distance`` bits, some segment starts a chain in which the first j segments together
differ in at most j * distance / segments bits, for every j. The leading segments whose
budget rounds down to 0 are equal and make the join key; the growing budgets of the longer
prefixes prune the candidates before the whole Hamming distance is taken.

Fingerprints that are equal are one node, so copies never become pairs. A key that many
different fingerprints share is not joined pairwise: each fingerprint is hashed with every
choice of ``distance`` erased bits outside the key, and those that agree are linked to the
smallest of them. That is exact too, and linear in the size of the bucket.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import run_folder, stored, whole_text
from rankloom.llm.components import components

SEED = 42
# A bucket of more fingerprints than this is linked through erased bits.
BUCKET = 4096
_CHUNK = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i:i + _CHUNK].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str | None, width: int = 3) -> int:
    """Fingerprint of a text: ASCII-lower-cased words, shingles of ``width`` words, XXH64."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(itertools.islice(words, i, None) for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), np.uint64))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the 64 bits as a signed long, for every row; a null text has no words."""
    def encode(batches):
        for batch in batches:
            made = [simhash(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, fp long")


def _ring(segments: int) -> list[int]:
    """Where each segment starts, from the top bit; the widths differ by one at most."""
    return [64 * i // segments for i in range(segments)]


def _rotated(fp, bits: int):
    """``fp`` turned left, so that the segment at ``bits`` is on top."""
    if bits == 0:
        return fp
    return F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def _top(bits: int) -> int:
    """A mask of the upper ``bits`` bits, as a signed long."""
    return ((1 << bits) - 1 << 64 - bits) - (1 << 64) if bits else 0


def ring_links(distinct: DataFrame, distance: int = 2, segments: int = 5, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` at ``distance`` differing bits or fewer.

    Every pair in a bucket of at most ``bucket`` fingerprints is linked itself; in a larger
    one the linked fingerprints share a neighbour, each link being within ``distance``.
    """
    starts = _ring(segments)
    chains = []
    for i in range(segments):
        # Bits from the start of segment i to the end of the j-th one after it.
        ends = [(starts[(i + j) % segments] - starts[i]) % 64 or 64 for j in range(1, segments + 1)]
        budgets = [j * distance // segments for j in range(1, segments + 1)]
        key_bits = max(e for e, b in zip(ends, budgets) if b == 0) if budgets[0] == 0 else 0
        chains.append((starts[i], key_bits, list(zip(ends, budgets))))

    turns = F.array(*(
        F.struct(F.lit(i).alias("turn"), _rotated(F.col("fp"), start).alias("turned"),
                 _rotated(F.col("fp"), start).bitwiseAND(F.lit(_top(bits))).alias("key"))
        for i, (start, bits, _) in enumerate(chains)))
    turned = distinct.select("fp", F.explode(turns).alias("t")).select("fp", "t.*")
    counts = turned.groupBy("turn", "key").agg(F.count(F.lit(1)).alias("n"))
    folder = run_folder(distinct.sparkSession, "ring")
    # A key of one fingerprint has no pair.
    shared = stored(turned.join(counts.where("n > 1"), ["turn", "key"]), folder)

    small = shared.where(F.col("n") <= bucket)
    left = small.select("turn", "key", F.col("turned").alias("x"), F.col("fp").alias("a"))
    right = small.select("turn", "key", F.col("turned").alias("y"), F.col("fp").alias("b"))
    apart = F.col("x").bitwiseXOR(F.col("y"))
    viable = F.lit(False)
    for i, (_, bits, prefixes) in enumerate(chains):
        chain = F.col("turn") == i
        for end, budget in prefixes:
            if end > bits:
                chain &= F.bit_count(apart.bitwiseAND(F.lit(_top(end))) if end < 64 else apart) <= budget
        viable |= chain
    pairs = left.join(right, ["turn", "key"]).where((F.col("a") < F.col("b")) & viable).select("a", "b")

    large = shared.where(F.col("n") > bucket)
    if large.isEmpty():
        return pairs
    stars = None
    for i, (_, bits, _) in enumerate(chains):
        erased = [sum(1 << b for b in pick) for pick in itertools.combinations(range(64 - bits), distance)]
        masks = F.explode(F.array(*(F.lit(~m) for m in erased)))
        nodes = large.where(F.col("turn") == i).select("fp", "turned", masks.alias("mask"))
        nodes = nodes.select("fp", "mask", F.col("turned").bitwiseAND(F.col("mask")).alias("rest"))
        centre = nodes.groupBy("mask", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("z"))
        links = nodes.join(centre.where("a < z"), ["mask", "rest"]).where("fp <> a").select("a", F.col("fp").alias("b"))
        stars = links if stars is None else stars.unionByName(links)
    return pairs.unionByName(stars)


def near_groups(
    docs: DataFrame, width: int = 3, distance: int = 2, segments: int = 5, bucket: int = BUCKET,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Group documents whose fingerprints are linked: doc_id, fingerprint, component_id.

    ``component_id`` is the smallest id that can be reached. Texts without words (null,
    empty, blank) have the fingerprint zero and are linked like any other. Rows that repeat
    are all returned; a null id is in a group but never names one. No rows give no rows;
    other columns are not read.
    """
    folder = run_folder(docs.sparkSession, "simhash")
    marked = stored(fingerprints(docs, width, id_col, text_col), f"{folder}/fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), f"{folder}/distinct")
    labels = components(ring_links(distinct.select("fp"), distance, segments, bucket))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("label", F.coalesce("label", "fp"))
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    names = stored(named.join(lowest, "label").select("fp", "component_id"), f"{folder}/names")
    return marked.join(names, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id names their group, with all their columns.

    Rows that repeat the id that stays are cut to one; a null id stays only in a group that
    has no other.
    """
    return drop_unnamed(docs, near_groups(docs, id_col=id_col, text_col=text_col, **options), id_col)


def drop_unnamed(docs: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id names their group (doc_id, component_id); a repeated id is cut to one row."""
    gone = stored(
        groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone")).distinct(),
        run_folder(docs.sparkSession, "near"))
    left = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_gone")), "left_anti")
    repeated = left.groupBy(id_col).count().where("count > 1")
    return left if repeated.isEmpty() else left.dropDuplicates([id_col])
