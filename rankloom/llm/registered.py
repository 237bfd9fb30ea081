"""The registered queries of this folder, and the SQL twins of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from rankloom.llm import (
    collocations, decontam, exact, linetemplates, negatives, packing, pieces, runindex, sharding, simhash, tokencounts,
    tokenfiles, toxicity,
)
from rankloom.llm.common import documents, run_folder
from rankloom.llm.encoders import LibraryEncoder, RankEncoder, WordEncoder

# The byte-level vocabulary leaves this id free: it ends documents in files to be counted.
END_OF_DOCUMENT = 50256


def _sentencepiece(spark, d):
    model = pieces.Model.read(public_tokenizers.path("piece_bpe_32k.model"))
    made = pieces.round_trip(documents(spark, d), model, remembered=400_000)
    return made.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), F.col("exact").alias("decodes_exactly"))


def _token_files(spark, d):
    folder = run_folder(spark, "tokens")
    encoder = LibraryEncoder.read(public_tokenizers.path("byte_bpe_50k.json"))
    tokenfiles.write_tokens(documents(spark, d), folder, encoder, end_id=0)
    return tokenfiles.token_digests(spark, folder)


def _toxicity(spark, d):
    return toxicity.toxicity(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


def _repeats(spark, d):
    left = runindex.drop_repeats(documents(spark, d), length=200)
    return left.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _simhash(spark, d):
    return simhash.near_groups(documents(spark, d))


def _token_counts(spark, d):
    folder = run_folder(spark, "flat")
    encoder = RankEncoder.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokenfiles.write_tokens(documents(spark, d), folder, encoder, END_OF_DOCUMENT, ordered=False, offsets=False)
    counted = tokencounts.separator_scan(spark, folder, END_OF_DOCUMENT)
    # Both sides have a row per document, though they are made from a few rows of a manifest.
    order = tokencounts.document_order(spark, folder).hint("merge")
    return counted.join(order, ["part", "place"]).select("doc_id", "n_tokens")


def _exact_dedup(spark, d):
    return exact.exact_groups(documents(spark, d)).drop("keep_locator")


def _sharding(spark, d):
    dealt = sharding.stratified_shards(documents(spark, d), shards=24)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def _decontamination(spark, d):
    return decontam.contamination(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


def _line_dedup(spark, d):
    return linetemplates.drop_lines(documents(spark, d), identical=True)


def _hard_negatives(spark, d):
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(spark.read.parquet(f"{d}/embeddings.parquet"), label=noisy)


def _packing(spark, d):
    encoder = WordEncoder.read(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_documents(documents(spark, d), encoder, end_id=2).drop("ids")


def _collocations(spark, d):
    return collocations.collocations(documents(spark, d))


def queries():
    return {
        "op1_sentencepiece": _sentencepiece,
        "op2_token_files": _token_files,
        "op3_toxicity": _toxicity,
        "op4_exact_dedup": _exact_dedup,
        "op5_repeats": _repeats,
        "op6_simhash": _simhash,
        "op7_decontamination": _decontamination,
        "op8_token_counts": _token_counts,
        "op9_line_dedup": _line_dedup,
        "op10_sharding": _sharding,
        "op11_hard_negatives": _hard_negatives,
        "op12_packing": _packing,
        "op13_collocations": _collocations,
        "pipeline": corpus_pipeline.run,
    }


_EXACT = """
WITH rows AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
    FROM documents
), groups AS (
    SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY body
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM rows JOIN groups USING (body)
"""


_LINES = r"""
WITH rows AS (
    SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS body FROM documents
), lines AS (
    SELECT DISTINCT body, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
    FROM rows
), parsed AS (
    SELECT body, place, list_transform(
        regexp_extract_all(line, '[^ \t\r]+'),
        lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
    FROM lines
), leafed AS (
    SELECT body, place, tokens, array_to_string(tokens, ' ') AS masked,
        len(tokens) || ' ' || array_to_string(tokens[1:3], ' ') AS leaf
    FROM parsed WHERE len(tokens) > 0
), recurring AS (
    SELECT * FROM leafed WHERE leaf IN (SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT body) >= 5)
), kinds AS (
    SELECT leaf, masked, any_value(tokens) AS tokens, count(DISTINCT body) AS n FROM recurring GROUP BY leaf, masked
), spread AS (
    SELECT leaf, masked, n, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS spot FROM kinds
), shared AS (
    SELECT leaf, spot, token, sum(n) AS held FROM spread GROUP BY leaf, spot, token HAVING sum(n) >= 5
), marked AS (
    SELECT s.leaf, s.masked, s.spot, CASE WHEN h.held IS NULL THEN '<*>' ELSE s.token END AS token
    FROM spread s LEFT JOIN shared h ON s.leaf = h.leaf AND s.spot = h.spot AND s.token = h.token
), templates AS (
    SELECT leaf, masked, string_agg(token, ' ' ORDER BY spot) AS template FROM marked
    GROUP BY leaf, masked HAVING avg(CASE WHEN token = '<*>' THEN 0.0 ELSE 1.0 END) >= 0.5
), named AS (
    SELECT body, place, leaf, template FROM recurring JOIN templates USING (leaf, masked)
), dropped AS (
    SELECT DISTINCT body, place FROM named JOIN (
        SELECT leaf, template FROM named GROUP BY leaf, template HAVING count(DISTINCT body) >= 5
    ) USING (leaf, template)
), same AS (
    SELECT DISTINCT body, place, array_to_string(regexp_extract_all(line, '[^ \t\r]+'), ' ') AS line FROM lines
    WHERE len(regexp_extract_all(line, '[^ \t\r]+')) > 0
), repeated AS (
    SELECT body, place FROM same WHERE line IN (SELECT line FROM same GROUP BY line HAVING count(DISTINCT body) >= 2)
), places AS (
    SELECT body, list(place) AS places FROM (SELECT body, place FROM dropped UNION SELECT body, place FROM repeated) GROUP BY body
)
SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, coalesce(len(places), 0) AS n_dropped,
    CASE WHEN places IS NULL THEN text ELSE array_to_string(list_transform(
        list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(places, i)),
        lambda i: string_split(text, chr(10))[i]), chr(10)) END AS kept_text
FROM rows LEFT JOIN places USING (body)
"""


_NEGATIVES = """
WITH sound AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), anchors AS (
    SELECT row_number() OVER () AS a, * FROM sound WHERE vec_id % 100 = 0
), scored AS (
    SELECT a, anchors.vec_id AS anchor_id, sound.vec_id, anchors.label = sound.label AS same,
        list_inner_product(anchors.q, sound.q)::BIGINT AS score
    FROM anchors JOIN sound ON len(anchors.q) = len(sound.q)
), positives AS (
    SELECT a, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND vec_id <> anchor_id
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5
), ranked AS (
    SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
        row_number() OVER (PARTITION BY a, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
    FROM positives JOIN scored USING (a)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


_PHRASES = r"""
WITH pieces AS (
    SELECT doc_id, lang, row_number() OVER () AS piece, list_filter(string_split_regex(part, '[ \t]+'), lambda w: w <> '') AS words
    FROM (
        SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]')) AS part
        FROM documents
    )
), grams AS (
    SELECT lang, size, array_to_string(words[pos:pos + size - 1], ' ') AS phrase
    FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM pieces, range(1, 5) AS sizes(size))
), counts AS (
    SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 30
), totals AS (
    SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang
), candidates AS (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE size > 1
), cuts AS (
    SELECT c.lang, c.size, c.phrase, a, k, p.f AS l, s.f AS r, (2000000::HUGEINT * a // (p.f + s.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
    JOIN counts p ON p.lang = c.lang AND p.phrase = array_to_string(words[1:k], ' ')
    JOIN counts s ON s.lang = c.lang AND s.phrase = array_to_string(words[k + 1:], ' ')
), scored AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), parts AS (
    SELECT DISTINCT lang, a AS longer, array_to_string(words[pos:pos + part - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, size - part + 2)) AS pos FROM (SELECT *, unnest(range(2, size)) AS part FROM candidates WHERE size > 2))
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score
FROM scored s JOIN totals USING (lang)
WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.lang = s.lang AND p.phrase = s.phrase AND 100 * p.longer::HUGEINT >= 80 * a::HUGEINT)
QUALIFY rank <= 2000
"""


def oracle_sql():
    return {
        "op4_exact_dedup": _EXACT, "op9_line_dedup": _LINES, "op11_hard_negatives": _NEGATIVES,
        "op13_collocations": _PHRASES,
    }
