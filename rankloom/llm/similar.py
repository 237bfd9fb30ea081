"""Near copies by exact similarity: texts whose sets of word shingles have Jaccard >= 0.8.

If two sets have this similarity, they share an element among the first n - ceil(0.8 n) + 1
of each, in any order that all sets follow. These prefixes are the join keys, so no pair is
lost. Elements that are common in a sample of the texts come last in the order, which keeps
the keys rare; the sample decides about speed only.

Equal sets are one node. Nodes whose SimHash fingerprints differ in two bits at most are
compared first, and under each key every node with one pivot, the one where the key stands
earliest: it has the fewest elements of its own, so most of a large group is like it, and the
group is joined in as many rows as it has nodes. Only nodes that are then still in different
components are compared in pairs, and a pair that shares many keys is made under the first.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import run_folder, stored, whole_text
from rankloom.llm.components import components
from rankloom.llm.simhash import SEED, majority, ring_links

WIDTH = 5
SIMILAR = 0.8
# The share of texts that is looked at for common shingles, and how many of these are kept.
SAMPLE = 1 / 8
COMMON = 1_000_000
# Orders in which pivots are chosen among nodes where a key stands equally early.
PIVOTS = 4
# Fingerprints under a ring key from which erased bits cost less rows than pairs do.
RING = 1024
# Earlier keys of a node that a row of a key carries: a pair that shares one of them was met there.
EARLIER = 16


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` ASCII-lower-cased words; a shorter text is one run."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) <= width:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(itertools.islice(words, i, None) for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(r, SEED) for r in runs), np.uint64).view(np.int64))


def _name(members: np.ndarray) -> bytes:
    """The node of a set: 128 bits."""
    return xxhash.xxh3_128_digest(members.tobytes(), SEED)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def common_shingles(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several sampled texts hold, and how many do."""
    def encode(batches):
        for batch in batches:
            made = [shingle_set(t, width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *made]))], names=["h"])

    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(SAMPLE * (1 << 20)))
    counts = drawn.select("text").mapInArrow(encode, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.where("n > 2"), run_folder(rows.sparkSession, "common"))
    most = counts.orderBy(F.desc("n"), "h").limit(COMMON) if counts.count() > COMMON else counts
    table = most.toArrow()
    hashes, held = (table.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    order = np.argsort(hashes)
    return hashes[order], held[order]


def prefix(members: np.ndarray, common: tuple[np.ndarray, np.ndarray], similar: float) -> np.ndarray:
    """The elements of which a set of this similarity shares at least one."""
    n, (hashes, held) = len(members), common
    if not n:
        return members
    size = n - math.ceil(round(similar * n, 9)) + 1
    if not len(hashes):
        return members[:size]
    at = np.minimum(np.searchsorted(hashes, members), len(hashes) - 1)
    weight = np.where(hashes[at] == members, held[at], 0)
    return members[np.lexsort((members, weight))[:size]]


def sketch(members: np.ndarray) -> np.ndarray:
    """Parities of the counts of a set's last bits, about one for each element.

    Every bit in which two sketches differ is an element that one of the sets lacks.
    """
    size = max(64, 1 << max(len(members) - 1, 0).bit_length())
    odd = np.bincount(members & (size - 1), minlength=size).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def _bodies(text) -> list:
    """128 bits of a text, as two numbers."""
    return [F.xxhash64(text).alias("body"), F.xxhash64(F.lit(1), text).alias("body2")]


def _marked(rows: DataFrame, width: int, similar: float) -> DataFrame:
    """doc_id, body and body2 (a name of the text), node, n (size of the set), fp (its fingerprint), keys (its prefix) and bits (its sketch) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, width))

    def encode(batches):
        for batch in batches:
            nodes, sizes, prints, keys, bits = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                members = shingle_set(text, width)
                nodes.append(_name(members))
                sizes.append(len(members))
                prints.append(majority(members.view(np.uint64)))
                keys.append(prefix(members, shared.value, similar))
                bits.append(sketch(members))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()),
                 pa.array(np.array(prints, np.uint64).view(np.int64)), _lists(keys), _lists(bits)],
                names=["doc_id", "body", "body2", "node", "n", "fp", "keys", "bits"])

    return rows.mapInArrow(
        encode, "doc_id long, body long, body2 long, node binary, n int, fp long, keys array<long>, bits array<long>")


def _folded(bits, size):
    """A sketch at ``size``: itself, or its upper half laid over the lower one."""
    low, high = F.slice(bits, F.lit(1), size), F.slice(bits, size + 1, size)
    return F.when(F.size(bits) == size, bits).otherwise(F.zip_with(low, high, lambda p, q: p.bitwiseXOR(q)))


def _likely(pairs: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """The pairs without those whose sketches show that too many elements are not shared."""
    met = pairs.join(nodes.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("n").alias("nx")), "a")
    met = met.join(nodes.select(F.col("node").alias("b"), F.col("bits").alias("y"), F.col("n").alias("ny")), "b")
    size = F.least(F.size("x"), F.size("y"))
    apart = F.zip_with(_folded(F.col("x"), size), _folded(F.col("y"), size), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    most = (F.col("nx") + F.col("ny")) * ((1 - similar) / (1 + similar)) + 1e-6
    return met.where(F.aggregate(apart, F.lit(0), lambda x, y: x + y) <= most).select("a", "b")


def _confirmed(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, width: int, similar: float, folder: str) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar; the sets are made again for their texts only."""
    def encode(batches):
        for batch in batches:
            made = [shingle_set(t, width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_name(m) for m in made], pa.binary()), _lists(made)], names=["node", "members"])

    pairs = stored(_likely(pairs, nodes, similar), f"{folder}/likely")
    asked = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{folder}/asked")
    ids = nodes.join(asked, "node", "left_semi").select(F.col("first").alias("_id")).distinct()
    texts = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    sets = texts.mapInArrow(encode, "node binary, members array<long>").join(asked, "node", "left_semi")
    sets = stored(sets.groupBy("node").agg(F.first("members").alias("members")), f"{folder}/sets")
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    met = met.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return stored(
        met.where(both >= similar * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b"), f"{folder}/links")


def _pairs(met: DataFrame, similar: float) -> DataFrame:
    """Different pairs of nodes (x, y) that can be similar by their sizes and by the places of the key.

    The first element that two sets share has no shared one before it in either, so the rest of
    the smaller remainder bounds what they share. ``nx`` and ``px`` are a set's size and the key's
    place in it.
    """
    fit = F.least("nx", "ny") >= similar * F.greatest("nx", "ny") - 1e-9
    left = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    fit &= left >= similar / (1 + similar) * (F.col("nx") + F.col("ny")) - 1e-6
    return met.where((F.col("x") != F.col("y")) & fit).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _keys(nodes: DataFrame, folder: str) -> DataFrame:
    """key, node, n and place (of the key in the node's order) of the keys that several nodes hold.

    Shingles of one passage that the same nodes hold, known by two sums of their hashes, would
    only repeat its pairs: they are one key, at its first place in every node.
    """
    keys = nodes.select("node", "n", F.posexplode("keys").alias("place", "key"))
    keys = keys.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("key")))
    keys = stored(keys.where("held > 1").select("key", "node", "n", "place"), f"{folder}/shared")
    marks = [F.count(F.lit(1)).alias("held"), *(
        F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(20,0)")).alias(f"mark{i}") for i in (1, 2))]
    lists = stored(keys.groupBy("key").agg(*marks), f"{folder}/lists")
    same = ["held", "mark1", "mark2"]
    names = lists.join(lists.groupBy(*same).agg(F.min("key").alias("name")), same).select("key", "name")
    keys = keys.join(names, "key").groupBy("name", "node").agg(F.min("place").alias("place"), F.first("n").alias("n"))
    return stored(keys.select(F.col("name").alias("key"), "node", "n", "place"), f"{folder}/keys")


def _close(nodes: DataFrame, similar: float, folder: str) -> DataFrame:
    """Pairs (a, b) of nodes that can be similar by their sizes and have fingerprints at two differing bits or fewer.

    The smallest node of a fingerprint stands for it and is paired with its others.
    """
    named = stored(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("p")), f"{folder}/prints")

    def side(fp: str, x: str) -> DataFrame:
        return named.select(F.col("fp").alias(fp), F.col("p.node").alias(x), F.col("p.n").alias(f"n{x}"))

    apart = ring_links(named.select("fp"), bucket=RING).select(F.col("a").alias("fa"), F.col("b").alias("fb")).distinct()
    apart = apart.join(side("fa", "x"), "fa").join(side("fb", "y"), "fb")
    alike = nodes.select("fp", F.col("node").alias("x"), F.col("n").alias("nx")).join(side("fp", "y"), "fp")
    met = apart.select("x", "nx", "y", "ny").unionByName(alike.select("x", "nx", "y", "ny"))
    # Every element may be the first that is shared.
    return _pairs(met.withColumns({"px": F.lit(0), "py": F.lit(0)}), similar)


def _links(nodes: DataFrame, rows: DataFrame, width: int, similar: float, folder: str) -> DataFrame:
    """Links (a, b) of similar nodes that connect every two similar ones."""
    keys = _keys(nodes, folder)

    # One of a few orders for every key: the keys of a large group have few pivots, but more than one.
    early, order = F.col("place") / F.col("n"), F.xxhash64(F.pmod(F.xxhash64("key"), F.lit(PIVOTS)), "node")
    pivots = keys.groupBy("key").agg(F.min(F.struct(early.alias("e"), order.alias("o"), "node", "n", "place")).alias("p"))
    met = keys.join(pivots, "key").select(
        F.col("node").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"),
        F.col("p.node").alias("y"), F.col("p.n").alias("ny"), F.col("p.place").alias("py"))
    tested = stored(_pairs(met, similar).unionByName(_close(nodes, similar, folder)).distinct(), f"{folder}/tested")
    near = _confirmed(tested, rows, nodes, width, similar, f"{folder}/pivots")

    labelled = keys.join(components(near), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stored(labelled, f"{folder}/labelled")
    sizes = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
    split = labelled.join(largest.where("labels > 1").select("key", F.col("top.label").alias("most")), "key")
    # Nodes of different components meet under every key they share, so an earlier one has met them too.
    earlier = F.collect_list("key").over(Window.partitionBy("node").orderBy("place").rowsBetween(-EARLIER, -1))
    split = stored(split.withColumn("earlier", earlier), f"{folder}/split")

    def side(x: str) -> list:
        return [F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("place").alias(f"p{x}"), F.col("label").alias(f"l{x}"),
                F.col("earlier").alias(f"e{x}")]

    left = split.where("label <> most").select("key", *side("x"))
    right = split.select("key", *side("y"), "most")
    met = left.join(right, "key").where("lx <> ly AND (ly = most OR x < y) AND NOT arrays_overlap(ex, ey)")
    others = stored(_pairs(met, similar).join(tested, ["a", "b"], "left_anti"), f"{folder}/others")
    return near.unionByName(_confirmed(others, rows, nodes, width, similar, f"{folder}/rest"))


def _grouped(docs: DataFrame, width: int, similar: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, body, body2, node and label (what all nodes of a group share) of every row, stored."""
    folder = run_folder(docs.sparkSession, "similar")
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *_bodies(text))
    marked = stored(_marked(rows, width, similar), f"{folder}/marked")
    nodes = stored(
        marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"),
            F.first("keys").alias("keys"), F.first("bits").alias("bits")),
        f"{folder}/nodes")
    labels = components(_links(nodes, rows, width, similar, folder))
    named = marked.select("doc_id", "body", "body2", "node").join(labels, "node", "left")
    return stored(named.withColumn("label", F.coalesce("label", "node")), f"{folder}/grouped")


def similar_groups(
    docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Group documents that similar ones link: doc_id, component_id (the smallest id that can be reached).

    Texts without words are equal. Rows that repeat are all returned; a null id is in a group
    but never names one. No rows give no rows; other columns are not read.
    """
    grouped = _grouped(docs, width, similar, id_col, text_col)
    lowest = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(lowest, "label").select("doc_id", "component_id")


def drop_similar(
    docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row of every group of similar texts, with all its columns.

    The row with the smallest id stays, of several texts under this id the one whose hash is
    smallest; null ids come last, and rows with a null id are told apart by their texts. Rows
    that repeat id and text are cut to one. Groups, empty texts and empty tables as in
    ``similar_groups``.
    """
    folder = run_folder(docs.sparkSession, "kept")
    grouped = _grouped(docs, width, similar, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "body", "body2")
    met = grouped.join(grouped.groupBy("label").agg(F.min(order).alias("kept")), "label")
    names = [F.col("doc_id").alias("_id"), F.col("body").alias("_body"), F.col("body2").alias("_body2")]
    gone = stored(met.where(order != F.col("kept")).select(*names).distinct(), f"{folder}/gone")
    first, second = _bodies(whole_text(text_col))
    named = docs.withColumns({"_first": first, "_second": second})
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.col("_first") == F.col("_body")) & (F.col("_second") == F.col("_body2"))
    left = named.join(gone, same, "left_anti")
    repeated = met.where(order == F.col("kept")).groupBy("doc_id", "body", "body2").count().where("count > 1")
    if not repeated.isEmpty():
        left = left.dropDuplicates([id_col, "_first", "_second"])
    return left.select(*docs.columns)
