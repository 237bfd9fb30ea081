"""Vector, text and hybrid search over a table of queries.

Every function takes ``queries`` with ``query_id, tenant`` and the columns its
mode needs (``text``, ``vector``, optional ``filter``, ``page``, ``limit``) and
ranks all of them in one job.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import scores
from rankloom.functions.cleaning import decode_base64, image_fits
from rankloom.functions.metadata import active_filter
from rankloom.functions.text import is_hybrid, query_slots
from rankloom.operators.fulltext import PREFIX_KEY, prefix_width, text_candidates
from rankloom.operators.knn import BROADCAST_BYTES, BROADCAST_QUERIES, knn
from rankloom.operators.postings import Postings
from rankloom.operators.scan import STATED_TENANTS, of_tenants
from rankloom.operators.topk import page
from rankloom.plans.filters import bind_filters, distinct_filters
from rankloom.session import broadcastable

# Rows that a lookup by id shows.
LOOKUP_ROWS = 5

RESULT = ["query_id", "rank", "vector_id", "content", "metadata", "score", "score_pct"]


def prepare(queries: DataFrame) -> DataFrame:
    """Fill in paging defaults, the candidate depth, the search mode and the words."""
    defaults = {"page": "int", "limit": "int", "text": "string", "vector": "array<float>"}
    for name, kind in defaults.items():
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    offset = scores.page_offset(F.col("page"), F.col("limit"))
    added = {
        "offset": offset,
        "limit": scores.page_limit(F.col("limit")),
        "candidates": scores.candidates(scores.page_limit(F.col("limit")), offset),
        "hybrid": is_hybrid(F.col("text")),
        "slots": query_slots(F.col("text")),
    }
    if "filter" in queries.columns:
        added["filter"] = active_filter(F.col("filter"))
    return queries.withColumns(added).drop("page", "text")


@dataclass
class Asked:
    """A prepared query table, with its rows at hand when there are few.

    Only tables within the broadcast bounds (rows and bytes, both checked) pass
    through the driver, once; anything larger stays a plan and planning needs
    no more than a few numbers about it.
    """

    df: DataFrame
    head: pa.Table | None
    small: bool  # its rows may be broadcast
    few_words: bool  # its words may be broadcast
    few_winners: bool  # so may all rows its pages can hold
    widths: list[int]  # lengths of its prefix keys, at most PREFIX_KEY of them
    tenants: list[str] | None = None  # whom it asks for, if they can be stated

    @classmethod
    def of(cls, queries: DataFrame) -> Asked:
        prepared = prepare(queries)
        head, tenants = prepared.limit(BROADCAST_QUERIES + 1).toArrow(), None
        if head.num_rows > BROADCAST_QUERIES or head.nbytes > BROADCAST_BYTES:
            head = None
        else:
            prepared = prepared.sparkSession.createDataFrame(head, schema=prepared.schema)
        if head is None:
            rows, winners, words, widths, name, term = prepared.agg(
                F.count(F.lit(1)),
                F.coalesce(F.sum("limit"), F.lit(0)),
                F.coalesce(F.sum(F.size("slots")), F.lit(0)),
                F.collect_set(prefix_width(F.col("slots"))),
                F.coalesce(F.max(F.length("tenant")), F.lit(0)),
                F.coalesce(F.max(F.array_max(F.transform("slots", lambda s: F.length(s["term"])))), F.lit(0)),
            ).first()
        else:
            slots = head.column("slots").to_pylist()
            rows, words = head.num_rows, sum(map(len, slots))
            winners = pc.sum(head.column("limit")).as_py() or 0
            widths = {min(len(s[-1]["term"]), PREFIX_KEY) for s in slots if s}
            term = max((len(x["term"]) for s in slots for x in s or ()), default=0)
            name = pc.max(pc.utf8_length(head.column("tenant"))).as_py() or 0
            named = sorted(t for t in pc.unique(head.column("tenant")).to_pylist() if t is not None)
            tenants = named if len(named) <= STATED_TENANTS else None
        return cls(
            prepared,
            head,
            small=broadcastable(rows, name),
            few_words=broadcastable(words, name + term),
            few_winners=broadcastable(winners, name),
            widths=sorted(widths),
            tenants=tenants,
        )

    def narrowed(self, corpus: DataFrame) -> DataFrame:
        """The part of the corpus that the queries can meet, for every scan of it."""
        return corpus if self.tenants is None else of_tenants(corpus, self.tenants)

    def filtered(self, corpus: DataFrame) -> tuple[DataFrame, Asked]:
        """Corpus and queries with matching filter columns (see `bind_filters`)."""
        if "filter" not in self.df.columns:
            return corpus, self
        if self.head is None:
            texts = distinct_filters(self.df)
        else:
            texts = sorted(t for t in pc.unique(self.head.column("filter")).to_pylist() if t is not None)
        bound, df = bind_filters(corpus, self.df, texts)
        head = self.head
        if head is not None and "filter" not in df.columns:
            numbers = {t: n for n, t in enumerate(texts)}
            bits = [numbers.get(t, -1) for t in head.column("filter").to_pylist()]
            head = head.drop_columns(["filter"])
            if "filter_bit" in df.columns:
                head = head.append_column("filter_bit", pa.array(bits, pa.int64()))
        return bound, replace(self, df=df, head=head)


def _paged(corpus: DataFrame, found: DataFrame, asked: Asked, order) -> DataFrame:
    """Cut each query's page and fetch document columns for the winners only."""
    small = asked.small
    bounds = asked.df.select("query_id", "tenant", "offset", "limit")
    winners = page(found.join(F.broadcast(bounds) if small else bounds, "query_id"), order)
    # The pages' limits bound the winners: few of them go to the corpus, which is
    # then read in place; otherwise both sides meet by tenant and id.
    winners = F.broadcast(winners) if asked.few_winners else winners
    documents = corpus.select("tenant", "id", "vector_id", "content", "metadata")
    return (
        documents.join(winners, ["tenant", "id"])
        .withColumn("score_pct", scores.percent(F.col("score")))
        .select(*RESULT)
    )


def vector_search(
    corpus: DataFrame,
    queries: DataFrame,
    threshold: float | None = scores.DISTANCE_THRESHOLD,
    strategy: str = "auto",
) -> DataFrame:
    """Nearest documents of each query's tenant, filtered, thresholded and paged."""
    asked = Asked.of(queries)
    corpus = asked.narrowed(corpus)
    bound, narrowed = asked.filtered(corpus)
    hits = knn(bound, narrowed.df, threshold, strategy=strategy, table=narrowed.head)
    hits = hits.withColumn("score", scores.vector_score(F.col("dist")))
    return _paged(corpus, hits, asked, [F.col("dist"), F.col("id")])


def _text_leg(bound: DataFrame, asked: Asked, terms: DataFrame | Postings | None) -> DataFrame:
    return text_candidates(bound, asked.df, asked.few_words, asked.widths, terms, table=asked.head)


def text_search(
    corpus: DataFrame, queries: DataFrame, terms: DataFrame | Postings | None = None
) -> DataFrame:
    """``query_id, id, rank, trank``: the text leg alone, to its candidate depth.

    With ``terms`` (stored posting lists, or `corpus_tokens`) lists are intersected;
    without, documents are scanned in place.
    """
    asked = Asked.of(queries)
    corpus = asked.narrowed(corpus)
    bound, asked = asked.filtered(corpus)
    return _text_leg(bound, asked, terms)


def fuse(vector_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    """Full outer join of both legs with the reciprocal-rank score."""
    both = vector_hits.join(text_hits, ["query_id", "id"], "full_outer")
    return both.withColumn("rrf", scores.rrf(F.col("vrank")) + scores.rrf(F.col("trank")))


def search(
    corpus: DataFrame,
    queries: DataFrame,
    threshold: float | None = scores.DISTANCE_THRESHOLD,
    terms: DataFrame | Postings | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """Each query in its own mode: hybrid when it has text, by vector otherwise."""
    asked = Asked.of(queries)
    corpus = asked.narrowed(corpus)
    bound, narrowed = asked.filtered(corpus)
    by_vector = knn(bound, narrowed.df, threshold, strategy=strategy, table=narrowed.head)
    by_text = _text_leg(bound, narrowed, terms)
    modes = asked.df.select("query_id", "hybrid")
    fused = fuse(by_vector, by_text).join(F.broadcast(modes) if asked.small else modes, "query_id")
    score = F.when(F.col("hybrid"), scores.hybrid_score(F.col("rrf"))).otherwise(
        scores.vector_score(F.col("dist"))
    )
    found = fused.withColumn("score", score).withColumn(
        "sort_key", F.when(F.col("hybrid"), -F.col("rrf")).otherwise(F.col("dist"))
    )
    return _paged(corpus, found.drop("hybrid"), asked, [F.col("sort_key"), F.col("id")])


def hybrid_search(corpus: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """Rank fusion for the queries that have text (the flagship)."""
    return search(corpus, queries.where(is_hybrid(F.col("text"))), **options)


def route(
    requests: DataFrame, embed_text, embed_cross_modal, embed_image
) -> tuple[DataFrame, DataFrame]:
    """(queries, rejected) for search requests that still carry text or an image.

    ``requests``: ``query_id, tenant, db_type, text, image`` (base64) plus the
    optional filter and paging columns. An image decides the vector; otherwise
    an image database embeds the text cross-modally and a text database
    multilingually. The text, if any, always drives the text leg. A request
    with neither is rejected, and so is an image that is too large or not
    base64.
    """
    usable = image_fits(F.col("image")) & decode_base64(F.col("image")).isNotNull()
    reason = F.when(
        F.col("image").isNull() & F.col("text").isNull(), F.lit("MissingData")
    ).when(F.col("image").isNotNull() & ~usable, F.lit("ImageProcessing"))
    marked = requests.withColumn("reject_reason", reason)
    good = marked.where("reject_reason IS NULL").drop("reject_reason")
    by_image = F.col("image").isNotNull()
    by_cross = ~by_image & F.coalesce(F.col("db_type") == "image", F.lit(False))
    # Each embedder sees only its own rows; the rest are NULL and cost nothing.
    vector = F.coalesce(
        embed_image(F.when(by_image, decode_base64(F.col("image")))),
        embed_cross_modal(F.when(by_cross, F.col("text"))),
        embed_text(F.when(~by_image & ~by_cross, F.col("text"))),
    )
    queries = good.withColumn("vector", vector).drop("image", "db_type")
    return queries, marked.where("reject_reason IS NOT NULL")


def dashboard_route(
    requests: DataFrame, embed_text, embed_cross_modal, embed_image
) -> tuple[DataFrame, DataFrame]:
    """(requests, rejected) for dashboard lookups that still carry text or an image.

    ``requests``: ``query_id, tenant, db_type, search_type, data``. Text is embedded by the
    kind of its database, an image (base64) by the image model; a lookup by id needs no
    vector. Other search types and kinds of databases are rejected, and so is a bad image.
    """
    kind, db = F.col("search_type"), F.col("db_type")
    image = decode_base64(F.when(kind == "image", F.col("data")))
    known = F.coalesce(kind.isin("id", "image") | ((kind == "text") & db.isin("text", "image")), F.lit(False))
    usable = image_fits(F.col("data")) & image.isNotNull()
    reason = F.when(~known, F.lit("UnknownSearch")).when((kind == "image") & ~F.coalesce(usable, F.lit(False)), F.lit("ImageProcessing"))
    marked = requests.withColumn("reject_reason", reason)
    good = marked.where("reject_reason IS NULL").drop("reject_reason")
    text = F.when(kind == "text", F.col("data"))
    vector = F.coalesce(
        embed_image(image), embed_cross_modal(F.when(db == "image", text)), embed_text(F.when(db == "text", text)))
    return good.withColumn("vector", vector).drop("db_type"), marked.where("reject_reason IS NOT NULL")


def dashboard_search(corpus: DataFrame, requests: DataFrame, **options) -> DataFrame:
    """Dashboard lookups: by id, by text (three results) or by image vector (ten).

    ``requests``: ``query_id, tenant, search_type, data, vector`` where ``data``
    is the document id or the text. A lookup by id has no score.
    """
    by_id = requests.where(F.col("search_type") == "id").select(
        "query_id", "tenant", F.col("data").alias("vector_id")
    )
    # Ids are cut first: a lookup shows five rows at most.
    met = corpus.select("tenant", "vector_id", "id").join(by_id, ["tenant", "vector_id"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    kept = met.withColumn("rank", place).where(F.col("rank") <= LOOKUP_ROWS).drop("vector_id")
    slim = corpus.select("tenant", "id", "vector_id", "content", "metadata")
    found = slim.join(kept, ["tenant", "id"]).select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "vector_id",
        "content",
        "metadata",
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("string").alias("score_pct"),
    )
    is_text = F.col("search_type") == "text"
    searched = requests.where(F.col("search_type").isin("text", "image")).select(
        "query_id",
        "tenant",
        F.when(is_text, F.col("data")).alias("text"),
        "vector",
        F.when(is_text, F.lit(3)).alias("limit"),
    )
    return search(corpus, searched, **options).unionByName(found)
