"""Full-text search: words of documents, words of queries, and the best matches.

Searches scan documents in place (`rankloom.operators.wordscan`). Where posting lists are given,
stored ones or such as are made of the corpus itself, these are searched
(`rankloom.operators.postings`). Either way searches beyond broadcast size go in groups.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scores import MAX_CANDIDATES
from rankloom.functions.text import query_slots, tokens
from rankloom.operators.postings import Postings, listed_matches
from rankloom.operators.topk import top_per_query
from rankloom.operators.wordscan import word_scan

# Prefixes up to this length are exact join keys; longer ones are verified.
PREFIX_KEY = 12
FILTER_BITS = "filter_bits"
# The corpus column that each kind of filter reads.
FILTERS = {"filter_bit": FILTER_BITS, "filter": "metadata"}


def slots_of(searches: DataFrame) -> DataFrame:
    """``query_id, tenant, slot, key, is_prefix, n_slots`` per search word."""
    kept = ["query_id", "tenant", "candidates"]
    kept += [c for c in ("filter_bit",) if c in searches.columns]
    return searches.select(
        *kept, F.size("slots").alias("n_slots"), F.posexplode("slots")
    ).select(
        *kept,
        "n_slots",
        F.col("pos").alias("slot"),
        F.col("col.term").alias("key"),
        F.col("col.is_prefix").alias("is_prefix"),
    )


def corpus_tokens(corpus: DataFrame) -> DataFrame:
    """``tenant, id, pos, term`` for every word; uses stored tokens if present."""
    words = F.col("tokens") if "tokens" in corpus.columns else tokens(F.col("content"))
    return corpus.select("tenant", "id", F.posexplode(words).alias("pos", "term"))


def _keyed(terms: DataFrame, lengths: list[int]) -> DataFrame:
    """Join keys of each term: itself, and its prefix of each asked length."""
    keys = F.array(
        F.struct(F.col("term").alias("key"), F.lit(0).alias("width")),
        *[
            F.struct(F.left(F.col("term"), F.lit(n)).alias("key"), F.lit(n).alias("width"))
            for n in lengths
        ],
    )
    exploded = terms.withColumn("k", F.explode(keys)).where(
        (F.col("k.width") == 0) | (F.length("term") >= F.col("k.width"))
    )
    return exploded.withColumn("key_part", F.col("k.key")).withColumn("width", F.col("k.width")).drop("k")


def _wanted(slots: DataFrame) -> DataFrame:
    """Distinct keys per tenant, with the part of the key that is joined on."""
    short = F.left(F.col("key"), F.lit(PREFIX_KEY))
    part = F.when(F.col("is_prefix"), short).otherwise(F.col("key"))
    width = F.when(F.col("is_prefix"), F.length(short)).otherwise(F.lit(0))
    return (
        slots.select("tenant", "key", "is_prefix")
        .distinct()
        .withColumn("key_part", part)
        .withColumn("width", width)
    )


def _token_rows(corpus: DataFrame, asked: list[str]) -> DataFrame:
    """One row per document for the scan; documents without words drop out."""
    words = F.col("tokens") if "tokens" in corpus.columns else tokens(F.col("content"))
    carried = [column for name, column in FILTERS.items() if name in asked]
    rows = corpus.where(F.col("content").isNotNull()) if "content" in corpus.columns else corpus
    return rows.select("tenant", "id", *carried, words.alias("tokens"))


def distinct_texts(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collapse queries that ask the same words of the same tenant and filter.

    Returns the distinct searches, each under its lowest ``query_id`` and its
    deepest ``candidates``, and the rows ``query_id, leader, candidates`` that
    lead every query to its search.
    """
    extra = [c for c in ("filter_bit", "filter") if c in queries.columns]
    asked = queries.select("query_id", "tenant", "candidates", *extra, "slots")
    asked = asked.where((F.size("slots") > 0) & F.col("tenant").isNotNull())
    same = ["tenant", "slots", *extra]
    searches = asked.groupBy(*same).agg(
        F.min("query_id").alias("leader"), F.max("candidates").alias("deepest")
    )
    null_safe = [asked[c].eqNullSafe(searches[c]) for c in same]
    members = asked.join(searches, null_safe).select("query_id", "leader", asked["candidates"])
    searches = searches.select(
        F.col("leader").alias("query_id"), F.col("deepest").alias("candidates"), *same
    )
    return searches, members


def distinct_rows(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """`distinct_texts` for query rows that are at hand."""
    extra = [c for c in ("filter_bit", "filter") if c in table.column_names]
    rows = table.select(["query_id", "tenant", "candidates", "slots", *extra]).to_pylist()
    leaders: dict = {}
    members = []
    for row in sorted(rows, key=lambda r: r["query_id"]):
        if not row["slots"] or row["tenant"] is None:
            continue
        words = tuple((s["term"], s["is_prefix"]) for s in row["slots"])
        same = (row["tenant"], words, *[row[c] for c in extra])
        leader = leaders.setdefault(same, dict(row))
        leader["candidates"] = max(leader["candidates"], row["candidates"])
        members.append((row["query_id"], leader["query_id"], row["candidates"]))
    schema = table.select(["query_id", "tenant", "candidates", "slots", *extra]).schema
    names = ["query_id", "leader", "candidates"]
    lead = pa.table({n: pa.array([m[i] for m in members], pa.int64()) for i, n in enumerate(names)})
    return pa.Table.from_pylist(list(leaders.values()), schema=schema), lead


def text_candidates(
    corpus: DataFrame,
    queries: DataFrame,
    small: bool,
    widths: list[int],
    terms: DataFrame | Postings | None = None,
    cap: int = MAX_CANDIDATES,
    table: pa.Table | None = None,
) -> DataFrame:
    """``query_id, id, rank, trank``: the best matching documents per query.

    ``terms`` may be words or stored posting lists. Metadata filters (``filter_bit`` or
    ``filter``) are applied to the matches before the cut.
    ``table`` holds the rows of ``queries`` if the caller already has them.
    """
    if "slots" not in queries.columns:
        queries = queries.withColumn("slots", query_slots(F.col("text")))
    spark = corpus.sparkSession
    if small and table is not None:
        searches, lead = distinct_rows(table)
        asked, members = spark.createDataFrame(searches), spark.createDataFrame(lead)
    else:
        asked, members = distinct_texts(queries)
        # Beyond broadcast size searches stay a plan.
        searches = asked.toArrow() if small else asked
        asked = spark.createDataFrame(searches, schema=asked.schema) if small else asked
    if terms is None:
        ranked = word_scan(_token_rows(corpus, asked.columns), searches)
    else:
        index = terms if isinstance(terms, Postings) else Postings.of_words(terms)
        filters = [column for name, column in FILTERS.items() if name in asked.columns]
        docs = corpus.select("tenant", "id", *filters) if filters else None
        if filters:
            # A filtered hit counts as often as the search was asked under this id.
            own = members.where(F.col("query_id") == F.col("leader")).groupBy("leader").agg(F.count(F.lit(1)).alias("times"))
            if small:
                own = own.toArrow()
                asked_times = dict(zip(own.column("leader").to_pylist(), own.column("times").to_pylist()))
                times = [asked_times[q] for q in searches.column("query_id").to_pylist()]
                searches = searches.append_column("times", pa.array(times, pa.int64()))
            else:
                searches = searches.join(own, searches["query_id"] == own["leader"]).drop("leader")
        ranked = listed_matches(index, slots_of(asked), searches, widths, _keyed, _wanted, docs)
    best = top_per_query(ranked, [F.col("cost"), F.col("id")], "trank", "candidates", cap)
    best = best.select(
        F.col("query_id").alias("leader"), "id", (-F.col("cost")).alias("rank"), "trank"
    )
    return (
        best.join(F.broadcast(members) if small else members, "leader")
        .where(F.col("trank") <= F.col("candidates"))
        .select("query_id", "id", "rank", "trank")
    )


def prefix_width(slots: Column) -> Column:
    """Length of the part of the prefix slot that is used as a join key."""
    last = F.try_element_at(slots, F.lit(-1))
    return F.least(F.length(last["term"]), F.lit(PREFIX_KEY))
