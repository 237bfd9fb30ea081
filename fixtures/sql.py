"""The fixture views and every registered query again, as DuckDB SQL."""

from __future__ import annotations

_REGION = "CASE {0} % 3 WHEN 0 THEN 'us-east' WHEN 1 THEN 'us-west' ELSE 'eu' END"

VIEWS = {
    "vectors": f"""
    SELECT d.doc_id AS id, (1000 + d.doc_id % 2) || '-docs' AS tenant, 'd' || d.doc_id AS vector_id,
           e.embedding AS embedding, d.text AS content,
           '{{"lang":"' || d.lang || '","source":"' || d.source || '","size":{{"chars":' || d.n_chars || '}}}}' AS metadata,
           TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS created_at,
           {_REGION.format('(1000 + d.doc_id % 2)')} AS region
    FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
    UNION ALL
    SELECT 1000000 + vec_id, (1000 + vec_id % 2) || '-images', 'i' || vec_id, embedding, NULL,
           '{{"label":' || label || '}}', TIMESTAMP '2024-01-01' + to_minutes(vec_id),
           {_REGION.format('(1000 + vec_id % 2)')}
    FROM embeddings""",
    "own_words": r"""
    SELECT e.vec_id, e.label, e.embedding,
           list_filter(string_split_regex(lower(coalesce(d.text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id""",
    "raw_queries": """
    SELECT vec_id AS query_id, (1000 + vec_id % 2) || '-docs' AS tenant,
           CASE label WHEN 3 THEN '  ' WHEN 5 THEN '?! --' WHEN 7 THEN 'zzzqx nohit' WHEN 8 THEN 'the and th'
                ELSE concat_ws(' ', w[1], w[2], left(w[3], 2)) END AS text,
           embedding AS vector,
           CASE label WHEN 0 THEN '{"lang":"en"}' WHEN 1 THEN '{"size":{}}' WHEN 2 THEN '{"source":"src3"}'
                WHEN 4 THEN '{"lang":"fr","source":"src0"}' WHEN 8 THEN '{"lang":5}' END AS wanted,
           CASE label WHEN 4 THEN 2 WHEN 6 THEN 3 ELSE 1 END AS page,
           least(CASE label WHEN 4 THEN 2 WHEN 6 THEN 1 WHEN 8 THEN 500 ELSE 10 END, 100) AS lim
    FROM own_words
    UNION ALL
    SELECT 1000000 + vec_id, (1000 + vec_id % 2) || '-images', '', embedding,
           CASE WHEN label < 5 THEN '{"label":' || label || '}' END, 1, 10
    FROM embeddings""",
    "q": """
    SELECT *, (page - 1) * lim AS off, least(greatest((lim + (page - 1) * lim) * 8, 150), 800) AS cand,
           trim(text) <> '' AS hybrid
    FROM raw_queries""",
    "pairs": """
    SELECT q.query_id, v.id, q.cand, round(1 - greatest(least(
               list_cosine_similarity(v.embedding::DOUBLE[], q.vector::DOUBLE[]), 1), -1), 12) AS dist
    FROM q JOIN vectors v ON v.tenant = q.tenant
    WHERE v.embedding IS NOT NULL{filter}""",
    "vleg": """
    SELECT * FROM (
        SELECT query_id, id, dist, cand, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS vrank
        FROM pairs) WHERE vrank <= cand AND dist < 0.7""",
    "words": r"""
    SELECT id, tenant, metadata, unnest(w) AS term, unnest(range(len(w))) AS pos
    FROM (SELECT id, tenant, metadata,
                 list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
          FROM vectors WHERE content IS NOT NULL)""",
    "qwords": r"""
    SELECT query_id, tenant, wanted, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM q WHERE hybrid""",
    "slots": """
    SELECT query_id, tenant, wanted, s.key AS key, s.p AS p, k.i AS slot, len(ss) AS n FROM (
        SELECT *, list_concat(list_transform(list_distinct(w[1:len(w)-1]), lambda x: {'key': x, 'p': false}),
                              [{'key': w[len(w)], 'p': true}]) AS ss
        FROM qwords WHERE len(w) > 0) t, unnest(range(len(ss))) k(i), unnest([ss[k.i + 1]]) u(s)""",
    "hits": """
    SELECT s.query_id, v.id, s.slot, s.n, v.pos FROM slots s JOIN words v ON v.tenant = s.tenant AND v.term = s.key
    WHERE NOT s.p{filter}
    UNION ALL
    SELECT s.query_id, v.id, s.slot, s.n, v.pos FROM slots s
    JOIN words v ON v.tenant = s.tenant AND left(v.term, 1) = left(s.key, 1) AND starts_with(v.term, s.key)
    WHERE s.p{filter}""",
    "full_hits": """
    SELECT h.* FROM hits h JOIN (SELECT query_id, id FROM hits GROUP BY ALL
                                 HAVING count(DISTINCT slot) = any_value(n)) m USING (query_id, id)""",
    "by_pos": """
    SELECT query_id, id, pos, any_value(n) AS n, bool_or(slot = 0) AS h0, bool_or(slot = 1) AS h1,
           bool_or(slot = 2) AS h2, row_number() OVER (PARTITION BY query_id, id ORDER BY pos) AS rn
    FROM full_hits GROUP BY query_id, id, pos""",
    "next_hit": """
    SELECT query_id, id, pos, rn, n,
           min(CASE WHEN h0 THEN pos END) OVER f AS e0, min(CASE WHEN h0 THEN rn END) OVER f AS r0,
           CASE WHEN n > 1 THEN min(CASE WHEN h1 THEN pos END) OVER f ELSE pos END AS e1,
           CASE WHEN n > 1 THEN min(CASE WHEN h1 THEN rn END) OVER f ELSE rn END AS r1,
           CASE WHEN n > 2 THEN min(CASE WHEN h2 THEN pos END) OVER f ELSE pos END AS e2,
           CASE WHEN n > 2 THEN min(CASE WHEN h2 THEN rn END) OVER f ELSE rn END AS r2
    FROM by_pos
    WINDOW f AS (PARTITION BY query_id, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "covers": """
    SELECT query_id, id, greatest(e0, e1, e2) AS q, greatest(r0, r1, r2) AS q_rn, max(pos) AS p, max(rn) AS p_rn
    FROM next_hit WHERE e0 IS NOT NULL AND e1 IS NOT NULL AND e2 IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "tleg": """
    SELECT query_id, id, rank, trank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, id) AS trank FROM (
            SELECT query_id, id, round(sum(0.1::DOUBLE / (1 + (q - p) - (q_rn - p_rn))), 9) AS rank
            FROM covers GROUP BY ALL) r JOIN (SELECT query_id, cand FROM q) USING (query_id))
    WHERE trank <= cand""",
}

_FILTER = """ AND CASE {q}.wanted
    WHEN '{{"lang":"en"}}' THEN json_extract_string({v}.metadata, '$.lang') = 'en'
    WHEN '{{"size":{{}}}}' THEN json_type({v}.metadata, '$.size') = 'OBJECT'
    WHEN '{{"source":"src3"}}' THEN json_extract_string({v}.metadata, '$.source') = 'src3'
    WHEN '{{"lang":"fr","source":"src0"}}' THEN json_extract_string({v}.metadata, '$.lang') = 'fr'
        AND json_extract_string({v}.metadata, '$.source') = 'src0'
    WHEN '{{"lang":5}}' THEN false
    ELSE {q}.wanted IS NULL OR {q}.wanted = '{{"label":' || json_extract_string({v}.metadata, '$.label') || '}}' END"""

_VECTOR_VIEWS = ["vectors", "own_words", "raw_queries", "q", "pairs", "vleg"]
_TEXT_VIEWS = ["words", "qwords", "slots", "hits", "full_hits", "by_pos", "next_hit", "covers", "tleg"]


def _with(names: list[str], body: str, filtered: bool = False, **replaced: str) -> str:
    parts = []
    for name in names:
        text = replaced.get(name, VIEWS[name] if name in VIEWS else "")
        side = "s" if name == "hits" else "q"
        text = text.replace("{filter}", _FILTER.format(q=side, v="v") if filtered else "")
        parts.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(parts) + "\n" + body


_VECTOR_ALL = """
SELECT query_id, rank, vector_id, content, metadata, round(score, 6) AS score FROM (
    SELECT l.query_id, l.id, row_number() OVER (PARTITION BY l.query_id ORDER BY dist, l.id) AS rank,
           least(greatest((1 - dist) * 100, 0), 100) AS score, off, lim
    FROM vleg l JOIN q USING (query_id)) r JOIN vectors v USING (id)
WHERE rank > off AND rank <= off + lim"""

_SEARCH = """
SELECT query_id, rank, vector_id, content, metadata, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sort_key, id) AS rank FROM (
        SELECT query_id, id, off, lim,
               CASE WHEN hybrid THEN least(rrf / (2.0::DOUBLE / 61) * 100, 100)
                    ELSE least(greatest((1 - dist) * 100, 0), 100) END AS score,
               CASE WHEN hybrid THEN -rrf ELSE dist END AS sort_key
        FROM (SELECT query_id, id, dist,
                     coalesce(1.0::DOUBLE / (60 + vrank), 0) + coalesce(1.0::DOUBLE / (60 + trank), 0) AS rrf
              FROM vleg FULL OUTER JOIN tleg USING (query_id, id)) f JOIN q USING (query_id)
        WHERE {keep})) r JOIN vectors v USING (id)
WHERE rank > off AND rank <= off + lim"""

_SEARCH_VIEWS = _VECTOR_VIEWS + _TEXT_VIEWS

CONTROL = {
    "users": """
    SELECT (1000 + c_custkey)::INT AS id, c_name AS email, greatest(0, trunc(c_acctbal)::INT) AS credits,
           TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS created_at, c_nationkey AS nation FROM customer""",
    "databases": f"""
    SELECT u.id AS owner_id, k.name AS name, k.db_type AS db_type, {_REGION.format('u.id')} AS region, created_at
    FROM users u, (VALUES ('docs', 'text'), ('images', 'image')) k(name, db_type)""",
    "api_keys": "SELECT sha256('key-' || id) AS key, 'main' AS name, id AS owner_id, created_at FROM users WHERE nation <> 7",
    "ev": "SELECT *, (1000 + user_id)::INT AS owner FROM events",
    "requests": """
    SELECT event_id AS request_id, CASE WHEN event_id % 11 = 0 THEN 'stolen' ELSE 'key-' || owner END AS api_key,
           CASE WHEN event_id % 7 = 0 THEN 'nothing' WHEN event_type IN ('click', 'view') THEN 'docs' ELSE 'images' END AS database
    FROM ev""",
    "pay": """
    SELECT *, CASE WHEN event_id % 23 <> 0 THEN try_cast(CASE WHEN event_id % 17 = 0 THEN '12x' ELSE (trunc(value)::INT)::VARCHAR END AS INT) END AS credits_purchased,
           trunc(value * 100)::INT AS amount_paid,
           'txn-' || (event_id // 3) AS transaction_id,
           CASE WHEN event_id % 13 = 0 THEN 999999999 WHEN event_id % 31 = 0 THEN NULL ELSE owner END AS uid,
           CASE WHEN event_id % 4 <> 0 AND event_id % 19 <> 0 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS billed_at
    FROM ev WHERE event_type IN ('purchase', 'error')""",
    "checked": """
    SELECT p.*, CASE WHEN event_id % 29 = 0 THEN 'MissingPayment' WHEN event_id % 23 = 0 THEN 'MissingField'
        WHEN uid IS NULL THEN 'InvalidUserId' WHEN credits_purchased IS NULL THEN 'InvalidCredits'
        WHEN event_id % 4 <> 0 AND event_id % 19 = 0 THEN 'InvalidBilledAt'
        WHEN u.id IS NULL OR m.email IS NULL THEN 'UnknownUser' END AS reason1
    FROM pay p LEFT JOIN users u ON u.id = p.uid
         LEFT JOIN users m ON m.email = 'Customer#' || lpad(p.user_id::VARCHAR, 9, '0')""",
    "settled": """
    SELECT *, CASE WHEN reason1 IS NOT NULL THEN reason1
        WHEN row_number() OVER (PARTITION BY transaction_id, reason1 IS NULL ORDER BY event_id) > 1
        THEN 'DuplicateTransaction' END AS reject_reason FROM checked""",
    "le": """
    SELECT owner AS user_id, event_id, ts,
           CASE WHEN event_type = 'purchase' THEN 1 + event_id % 5 ELSE -1 END AS delta, id % 4 AS opening, event_type
    FROM ev JOIN users ON id = owner""",
    "running": """
    SELECT *, opening + sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM le""",
    "lowest": """
    SELECT *, least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS m,
           least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS before
    FROM running""",
    "ledger": """
    SELECT user_id, event_id, ts, delta::BIGINT AS delta, (s - m)::BIGINT AS balance,
           delta < 0 AND s < coalesce(before, 0) AS denied, event_type FROM lowest""",
    "daily": """
    SELECT owner AS user_id, ts::DATE AS usage_date,
           (1 + sum(1 + event_id % 3) - arg_min(1 + event_id % 3, (ts, event_id)))::BIGINT AS opened,
           sum(1 + event_id % 3)::BIGINT AS total
    FROM ev GROUP BY ALL""",
    "prior_usage": "SELECT id AS user_id, DATE '2024-01-01' + (id % 40)::INT AS usage_date, 100 AS credits_used FROM users",
    "upserted": """
    SELECT user_id, usage_date, (CASE WHEN p.credits_used IS NULL THEN d.opened
           ELSE p.credits_used + coalesce(d.total, 0) END)::BIGINT AS credits_used
    FROM daily d FULL OUTER JOIN prior_usage p USING (user_id, usage_date)""",
    "mlabels": """
    SELECT doc_id AS item_id, 'Violence' AS label, 91.25::DOUBLE AS confidence FROM labels WHERE toxic = 1
    UNION ALL SELECT doc_id, 'Suggestive', 55.5 FROM labels WHERE quality = 0
    UNION ALL SELECT doc_id, 'Unknown', 0 FROM labels WHERE toxic = 1 AND quality = 0""",
    "codes": "SELECT owner::VARCHAR AS email, (1000 + event_id % 2)::SMALLINT AS code, ts AS issued_at FROM ev WHERE event_type = 'signup'",
    "attempts": "SELECT event_id AS attempt_id, owner::VARCHAR AS email, (1000 + event_id % 2)::SMALLINT AS code, ts AS tried_at FROM ev WHERE event_type = 'click'",
    "tried": "SELECT *, lag(tried_at) OVER (PARTITION BY email, code ORDER BY tried_at, attempt_id) AS previous FROM attempts",
    "vectors": VIEWS["vectors"],
    "deletes": "SELECT event_id AS request_id, (1000 + user_id % 2) || '-docs' AS tenant, CASE event_type WHEN 'error' THEN 'gone' ELSE 'd' END || user_id AS vector_id FROM events",
    "db_requests": f"""
    SELECT event_id AS request_id, owner AS owner_id, ts,
           lower(CASE event_type WHEN 'view' THEN 'DOCS' WHEN 'click' THEN 'Clicks' WHEN 'signup' THEN '' ELSE 'Db' || event_id % 5 END) AS name,
           CASE WHEN event_id % 4 = 3 THEN 'mars' ELSE {_REGION.format('event_id')} END AS region FROM ev""",
    "key_requests": "SELECT event_id AS request_id, owner AS owner_id, 'new-' || event_id AS api_key, event_type AS name, ts FROM ev WHERE event_type <> 'error'",
    "user_requests": """
    SELECT event_id AS request_id, 'Customer#' || lpad((event_id * 2 % 3001)::VARCHAR, 9, '0') AS email, ts
    FROM ev WHERE event_type <> 'error'""",
    "inserts": f"""
    SELECT doc_id AS request_id, (1000 + doc_id % 2) || '-docs' AS tenant, text,
           CASE WHEN doc_id % 9 = 0 THEN 'mars' ELSE {_REGION.format('(1000 + doc_id % 2)')} END AS region,
           CASE WHEN doc_id % 5 = 3 THEN '{{"lang":"' || lang || '"}}' ELSE '{{}}' END AS metadata
    FROM documents""",
    "lat": """
    SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
           count(*) OVER (PARTITION BY event_type) AS n, ts FROM events WHERE value IS NOT NULL""",
}


def _control(names: str, body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({CONTROL[n]})" for n in names.split()) + "\n" + body


_PAYMENTS = "users ev pay checked settled"
_LEDGER = "users ev le running lowest ledger"

_TRANSACTION = """uid::INT AS user_id, 'Customer#' || lpad(user_id::VARCHAR, 9, '0') AS user_email, transaction_id,
    'ctm-' || user_id AS customer_id, 'pri-' || event_id % 3 AS price_id, 'Plan' AS plan_name,
    'Credits' AS plan_description, credits_purchased, amount_paid,
    CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, billed_at,
    'inv-' || event_id AS invoice_id, NULL::VARCHAR AS invoice_number, 'card' AS payment_method"""


def _quantile(parts: int, i: int) -> str:
    low = f"least(greatest(any_value(n + 1) * {i} // {parts}, 1), any_value(n) - 1)"
    at = "min(CASE WHEN rn = {0} THEN value END)"
    low_rank = f"least(greatest((n + 1) * {i} // {parts}, 1), n - 1)"
    delta = f"(any_value(n + 1) * {i} - {low} * {parts})"
    return (
        f"({at.format(low_rank)} * ({parts} - {delta}) + {at.format(f'{low_rank} + 1')} * {delta}) / {parts}"
    )


# A vector is in the cell of the centre with the largest inner product; queries probe four.
_CELLS = {
    "centres": """
    SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell,
           list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS c
    FROM embeddings WHERE vec_id % 31 = 0""",
    "placed": """
    SELECT v.id, c.cell, acos(greatest(-1, least(1, list_inner_product(v.u, c.c)))) AS angle
    FROM (SELECT id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u
          FROM vectors WHERE embedding IS NOT NULL) v, centres c
    QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY list_inner_product(v.u, c.c) DESC, c.cell) = 1""",
    "cells": "SELECT cell, count(*) AS n, min(angle) AS nearest, max(angle) AS farthest, any_value(c.c) AS c FROM placed JOIN centres c USING (cell) GROUP BY cell",
    "apart": """
    SELECT query_id, n, greatest(angle - farthest, nearest - angle) AS least FROM (
        SELECT query_id, cells.*, acos(greatest(-1, least(1, list_inner_product(list_transform(vector::DOUBLE[],
            lambda x: x / sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[]))), cells.c)))) AS angle FROM q, cells)""",
}

_NEAR = "SELECT query_id, id, round(dist, 6) AS dist, vrank FROM vleg"

_DASHBOARD_QUERIES = """
    SELECT vec_id AS query_id, (1000 + vec_id % 2) || '-docs' AS tenant, NULL AS wanted, label % 3 AS kind,
           CASE WHEN label % 3 <> 1 THEN '' ELSE CASE label WHEN 3 THEN '  ' WHEN 5 THEN '?! --'
                WHEN 7 THEN 'zzzqx nohit' WHEN 8 THEN 'the and th'
                ELSE concat_ws(' ', w[1], w[2], left(w[3], 2)) END END AS text,
           embedding AS vector, 1 AS page, CASE WHEN label % 3 = 1 THEN 3 ELSE 10 END AS lim
    FROM own_words WHERE label % 3 <> 0"""

_GRAMS = r"""
    SELECT DISTINCT k, ('  ' || w || ' ')[i:i+2] AS g FROM (
        SELECT k, w, unnest(range(1, len(w) + 2)) AS i FROM (
            SELECT {0} AS k, unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS w FROM {1}))"""

_BULK = """
    SELECT owner AS user_id, any_value(id % 4)::BIGINT AS opening,
           list(CASE WHEN event_type = 'purchase' THEN 1 + event_id % 5 ELSE -(1 + event_id % 3) END ORDER BY ts, event_id) AS deltas
    FROM ev JOIN users ON id = owner GROUP BY owner"""


# Unit vectors of signed hashes of the pieces of each row of a table with a list of pieces.
_EMBEDDED = """
    SELECT *, list_transform(sums, lambda t: (t::FLOAT::DOUBLE / greatest(sqrt(list_sum(list_transform(sums, lambda u: u * u))), 1e-30)::FLOAT::DOUBLE)::FLOAT) AS vector
    FROM (SELECT *, list_transform(range(64), lambda i: coalesce(list_sum(list_transform(list_filter(hashes, lambda h: h % 64 = i),
            lambda h: CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)), 0)) AS sums
        FROM (SELECT *, list_transform(pieces, lambda p: ('0x' || left(p, 8))::UBIGINT) AS hashes FROM ({0})))"""

# MD5 sums of blocks of 64 bytes of a text, and of its words.
_BLOCKS = "list_transform(range((length(hex(encode({0}))) + 127) // 128), lambda i: md5(unhex(substr(hex(encode({0})), 128 * i + 1, 128))))"
_HASHED_WORDS = r"list_transform(list_filter(string_split_regex(lower({0}), '\s+'), lambda w: w <> ''), lambda w: md5({1} || w))"

_ROUTED = """
    SELECT query_id, tenant, text, vector, NULL AS wanted, 1 AS page, 10 AS lim FROM (""" + _EMBEDDED.format("""
        SELECT query_id, tenant, text, CASE WHEN query_id % 3 = 0 THEN """ + _BLOCKS.format("given") + """
            WHEN query_id % 2 = 0 THEN """ + _HASHED_WORDS.format("text", "'cross-modal:'") + """
            ELSE """ + _HASHED_WORDS.format("text", "'multilingual:'") + """ END AS pieces
        FROM (SELECT vec_id AS query_id, (1000 + vec_id % 2) || CASE WHEN vec_id % 2 = 0 THEN '-images' ELSE '-docs' END AS tenant,
                CASE WHEN vec_id % 5 <> 0 THEN given END AS text, given
            FROM (SELECT vec_id, CASE label WHEN 3 THEN '  ' WHEN 5 THEN '?! --' WHEN 7 THEN 'zzzqx nohit' WHEN 8 THEN 'the and th'
                    ELSE concat_ws(' ', w[1], w[2], left(w[3], 2)) END AS given FROM own_words))
        WHERE query_id % 3 = 0 OR query_id % 5 <> 0""") + """)"""


def oracle() -> dict[str, str]:
    made = _oracle()
    # The same results by another physical route.
    made["vector_topk_blocks"] = made["vector_topk"]
    made["text_rank_shuffled"] = made["text_rank"]
    made["stored_hybrid"] = made["hybrid_rrf"]
    made["promoted_topk_filtered"] = made["vector_topk_filtered"]
    made["text_rank_index"] = made["text_rank"]
    made["text_rank_filtered_index"] = made["text_rank_filtered"]
    made["stream_payments"] = made["payments_etl"]
    made["stream_ingest"] = made["ingest_rows"]
    made["stream_usage"] = made["usage_daily"]
    made["stream_ledger"] = made["credit_ledger"]
    made["stream_ledger_ordered"] = made["credit_ledger"]
    made["stream_verification"] = made["verification_outcomes"]
    return made


def _oracle() -> dict[str, str]:
    return {
        "dashboard_search": _with(
            _SEARCH_VIEWS,
            _SEARCH.format(keep="true") + """
            UNION ALL SELECT e.vec_id, 1, v.vector_id, v.content, v.metadata, NULL FROM embeddings e
            JOIN vectors v ON v.tenant = (1000 + e.vec_id % 2) || '-docs' AND v.vector_id = 'd' || e.vec_id WHERE e.label % 3 = 0""",
            raw_queries=_DASHBOARD_QUERIES,
        ),
        "substring_lookup": _control(
            "vectors",
            """SELECT query_id, v.id FROM (
                SELECT doc_id AS query_id, (1000 + doc_id // 20 % 2) || '-docs' AS tenant,
                    lower(upper(text[7:6 + [2, 5, 9, 14][(doc_id // 20 % 4) + 1]])) AS needle
                FROM documents WHERE doc_id % 20 = 0) p
            JOIN vectors v USING (tenant) WHERE needle <> '' AND contains(lower(v.content), needle)"""),
        "trigram_similarity": f"""WITH d AS ({_GRAMS.format('doc_id', 'documents')}), b AS ({_GRAMS.format('item_id', 'benchmark')}),
            dn AS (SELECT k, count(*) AS n FROM d GROUP BY k), bn AS (SELECT k, count(*) AS n FROM b GROUP BY k)
            SELECT query_id, id, round(similarity, 6) AS similarity FROM (
                SELECT b.k AS query_id, d.k AS id,
                       count(*) / (any_value(bn.n) + any_value(dn.n) - count(*)) AS similarity
                FROM b JOIN d ON b.g = d.g JOIN dn ON dn.k = d.k JOIN bn ON bn.k = b.k GROUP BY ALL)
            WHERE similarity >= 0.3""",
        "bulk_closing_balances": _control(
            "users ev",
            f"""SELECT user_id, list_reduce(list_prepend(opening, deltas),
                lambda b, d: CASE WHEN d < 0 AND b + d < 0 THEN b ELSE b + d END)::BIGINT AS balance FROM ({_BULK})""",
        ),
        "transactions_listing": _control(
            "ev", """SELECT 'txn-' || event_id AS transaction_id, owner AS user_id, ts AS created_at
            FROM ev WHERE event_type = 'purchase'""",
        ),
        "image_ingest": f"""SELECT (1000 + page_id % 2) || '-images' AS tenant, page_id AS request_id, NULL::VARCHAR AS content,
            '{{"url":' || to_json(url) || '}}' AS metadata, array_to_string(list_transform(vector, lambda x: format('{{:.5f}}', x::DOUBLE)), ' ') AS embedding
            FROM ({_EMBEDDED.format('SELECT page_id, url, ' + _BLOCKS.format('html') + ' AS pieces FROM pages WHERE page_id % 7 <> 0 AND length(base64(encode(html))) <= 4000')})""",
        "image_rejected": """SELECT page_id AS request_id, 'ImageProcessing' AS reject_reason FROM pages
            WHERE page_id % 7 = 0 OR length(base64(encode(html))) > 4000""",
        "moderation_detected": """
            SELECT page_id AS request_id, len(list_filter(found, lambda x: x.name = 'Violence')) > 0 AS nsfw,
                array_to_string(list_transform(found, lambda x: x.name || ':' || x.confidence), ',') AS labels
            FROM (SELECT page_id, list_transform(range(h[1] % 4), lambda i: {
                    'name': ['Violence', 'Suggestive', 'Unknown'][h[2 + 2 * i] % 3 + 1], 'confidence': (h[3 + 2 * i] % 200 / 2)::VARCHAR || '%'}) AS found
                FROM (SELECT page_id, list_transform(range(8), lambda i: ('0x' || md5(html)[2 * i + 1:2 * i + 2])::INT) AS h
                    FROM pages WHERE page_id % 7 <> 0))""",
        "search_router": _with(
            _SEARCH_VIEWS, _SEARCH.format(keep="true"), raw_queries=_ROUTED, vleg=VIEWS["vleg"].replace(" AND dist < 0.7", ""),
            pairs=VIEWS["pairs"].replace("WHERE ", "WHERE list_sum(list_transform(q.vector, lambda x: abs(x))) > 0 AND ")),
        "payments_replayed": _control(
            _PAYMENTS, """SELECT event_id, coalesce(reject_reason, '') AS reject_reason FROM settled
            UNION ALL SELECT event_id, coalesce(reject_reason, 'DuplicateTransaction') FROM settled""",
        ),
        "dashboard_rejected": """SELECT * FROM (
            SELECT vec_id AS query_id, CASE WHEN vec_id % 7 = 0 THEN 'audio' ELSE (['id', 'text', 'image'])[label % 3 + 1] END AS search_type,
                CASE WHEN vec_id % 11 = 0 THEN 'sound' WHEN vec_id % 2 = 0 THEN 'image' ELSE 'text' END AS db_type FROM embeddings)
            WHERE search_type = 'audio' OR (search_type = 'text' AND db_type = 'sound')""",
        "stream_search": _with(_SEARCH_VIEWS, _SEARCH.format(keep="query_id < 1000000")),
        "approximate_topk": _with(_VECTOR_VIEWS, _NEAR),
        "cells_read": _with(
            _VECTOR_VIEWS[:4] + ["centres", "placed", "cells", "apart"],
            """SELECT query_id, count(*) AS cells, sum(n)::BIGINT AS rows FROM apart WHERE 1 - cos(greatest(least, 0)) <= 0.3 GROUP BY query_id
            UNION ALL SELECT query_id, 0, 0 FROM q WHERE query_id NOT IN (
                SELECT query_id FROM apart WHERE 1 - cos(greatest(least, 0)) <= 0.3)""", **_CELLS),
        "approximate_all_cells": _with(_VECTOR_VIEWS, _NEAR),
        "document_lookup": _control(
            "vectors deletes",
            """SELECT request_id, v.vector_id, md5(v.content) AS content, v.metadata FROM deletes d
            JOIN vectors v ON d.tenant = v.tenant AND d.vector_id = v.vector_id""",
        ),
        "promoted_fields": "SELECT doc_id AS id, lang, n_chars::VARCHAR AS chars FROM documents WHERE lang = 'de'",
        "array_filters": """SELECT doc_id AS id, 0 AS filter FROM documents WHERE lang = 'en'
            UNION ALL SELECT doc_id, 1 FROM documents WHERE lang = 'de' AND doc_id % 4 = 1
            UNION ALL SELECT doc_id, 2 FROM documents WHERE lang = 'fr' AND doc_id % 2 = 0
            UNION ALL SELECT doc_id, 3 FROM documents""",
        "coerced_embeddings": """SELECT vec_id, array_to_string(list_transform(range(len(embedding)),
            lambda i: format('{:.5f}', CASE WHEN i = label THEN 0.0 ELSE embedding[i + 1]::DOUBLE END)), ' ') AS embedding FROM embeddings""",
        "api_keys_listing": _control("users api_keys", "SELECT owner_id, name, created_at FROM api_keys"),
        "usage_listing": _control(
            "users prior_usage", "SELECT user_id, usage_date::VARCHAR AS usage_date, credits_used::BIGINT AS credits_used FROM prior_usage"),
        "user_credits": _control("users", "SELECT id, credits FROM users"),
        "ingest_embedded": _control(
            "inserts",
            r"""SELECT tenant, sha256(tenant || text) AS vector_id, array_to_string(list_transform(range(64), lambda i:
                format('{:.5f}', (coalesce(list_sum(list_filter(parts, lambda p: p.i = i).list_transform(lambda p: p.s)), 0)::FLOAT::DOUBLE
                    / greatest(size, 1e-30)::FLOAT::DOUBLE)::FLOAT::DOUBLE)), ' ') AS embedding
            FROM (SELECT *, sqrt(coalesce((SELECT sum(t * t) FROM (SELECT sum(u.p.s) AS t FROM unnest(parts) u(p) GROUP BY u.p.i)), 0)) AS size
                FROM (SELECT tenant, text, list_transform(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> ''),
                    lambda w: {'i': (('0x' || left(md5('multilingual:' || w), 8))::UBIGINT % 64)::INT,
                               's': CASE WHEN ('0x' || left(md5('multilingual:' || w), 8))::UBIGINT >= 2147483648 THEN 1 ELSE -1 END}) AS parts
                    FROM inserts WHERE region <> 'mars'))""",
        ),
        "vector_topk": _with(_VECTOR_VIEWS, _VECTOR_ALL),
        "vector_topk_filtered": _with(_VECTOR_VIEWS, _VECTOR_ALL, filtered=True),
        "text_rank": _with(
            ["vectors", "own_words", "raw_queries", "q", *_TEXT_VIEWS],
            "SELECT query_id, id, round(rank, 6) AS rank, trank FROM tleg",
        ),
        "text_rank_filtered": _with(
            ["vectors", "own_words", "raw_queries", "q", *_TEXT_VIEWS],
            "SELECT query_id, id, round(rank, 6) AS rank, trank FROM tleg",
            filtered=True,
        ),
        "hybrid_rrf": _with(_SEARCH_VIEWS, _SEARCH.format(keep="hybrid")),
        "hybrid_rrf_filtered": _with(_SEARCH_VIEWS, _SEARCH.format(keep="hybrid"), filtered=True),
        "search_all_modes": _with(_SEARCH_VIEWS, _SEARCH.format(keep="true"), filtered=True),
        "tenant_counts": _control("vectors", "SELECT tenant, count(*) AS record_count FROM vectors GROUP BY ALL"),
        "database_inventory": _control(
            "users databases vectors",
            """SELECT d.owner_id, d.name, d.db_type, d.region, 0 AS requests, d.created_at, count(v.id) AS record_count
            FROM databases d LEFT JOIN vectors v ON v.tenant = d.owner_id || '-' || d.name GROUP BY ALL""",
        ),
        "document_pages": _control(
            "vectors",
            """SELECT tenant, vector_id, content, metadata, created_at, position FROM (
            SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY created_at DESC, id) AS position FROM vectors)
            WHERE position > 3 AND position <= 8""",
        ),
        "delete_documents": _control(
            "vectors deletes",
            """SELECT id, tenant, vector_id FROM vectors v
            WHERE NOT EXISTS (SELECT 1 FROM deletes d WHERE d.tenant = v.tenant AND d.vector_id = v.vector_id)""",
        ),
        "delete_misses": _control(
            "vectors deletes",
            """SELECT request_id, tenant, vector_id FROM deletes d
            WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE d.tenant = v.tenant AND d.vector_id = v.vector_id)""",
        ),
        "delete_api_keys": _control(
            "users api_keys ev",
            """SELECT owner_id, name, created_at FROM api_keys k
            WHERE NOT EXISTS (SELECT 1 FROM ev WHERE owner = owner_id AND event_type = 'error')""",
        ),
        "authorize_requests": _control(
            "users databases api_keys ev requests",
            """SELECT request_id, r.api_key, r.database, k.owner_id::VARCHAR AS user_id, d.region, d.db_type,
            CASE WHEN k.owner_id IS NULL THEN 'InvalidApiKey' WHEN d.owner_id IS NULL THEN 'DatabaseNotFound'
                 WHEN u.credits > 0 THEN 'ok' ELSE 'NotEnoughCredits' END AS outcome
            FROM requests r LEFT JOIN api_keys k ON k.key = sha256(r.api_key)
            LEFT JOIN databases d ON d.owner_id = k.owner_id AND d.name = r.database
            LEFT JOIN users u ON u.id = k.owner_id""",
        ),
        "resolve_owner": _control(
            "users databases api_keys ev requests",
            """SELECT request_id, k.owner_id AS user_id, r.database, d.region FROM requests r
            JOIN api_keys k ON k.key = sha256(r.api_key)
            JOIN databases d ON d.owner_id = k.owner_id AND d.name = r.database""",
        ),
        "registry_append": _control(
            "users databases ev db_requests",
            """SELECT request_id, owner_id, name, region FROM (
            SELECT *, row_number() OVER (PARTITION BY owner_id, name ORDER BY ts, request_id) AS n
            FROM db_requests WHERE name <> '' AND region <> 'mars') r WHERE n = 1
            AND NOT EXISTS (SELECT 1 FROM databases d WHERE d.owner_id = r.owner_id AND d.name = r.name)""",
        ),
        "user_append": _control(
            "users ev user_requests",
            """SELECT request_id, email, 25 AS credits FROM (
            SELECT *, row_number() OVER (PARTITION BY email ORDER BY ts, request_id) AS n FROM user_requests) r
            WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM users u WHERE u.email = r.email)""",
        ),
        "api_key_cap": _control(
            "users api_keys ev key_requests",
            """SELECT request_id, owner_id, name, key FROM (
            SELECT *, sha256(api_key) AS key, row_number() OVER (PARTITION BY owner_id ORDER BY ts, request_id) AS n
            FROM key_requests) r LEFT JOIN (SELECT owner_id AS o, count(*) AS held FROM api_keys GROUP BY ALL) ON o = owner_id
            WHERE n <= 10 - coalesce(held, 0)""",
        ),
        "payments_etl": _control(_PAYMENTS, f"SELECT {_TRANSACTION} FROM settled WHERE reject_reason IS NULL"),
        "payments_quarantine": _control(
            _PAYMENTS, "SELECT event_id, reject_reason FROM settled WHERE reject_reason IS NOT NULL"
        ),
        "credit_grants": _control(
            _PAYMENTS,
            """SELECT uid::INT AS user_id, sum(credits_purchased)::BIGINT AS granted FROM settled
            WHERE reject_reason IS NULL AND event_type = 'purchase' GROUP BY ALL""",
        ),
        "users_after_grants": _control(
            _PAYMENTS,
            """SELECT id, (credits + coalesce(granted, 0))::INT AS credits FROM users LEFT JOIN (
            SELECT uid, sum(credits_purchased) AS granted FROM settled
            WHERE reject_reason IS NULL AND event_type = 'purchase' GROUP BY ALL) ON uid = id""",
        ),
        "customer_ids": _control(
            _PAYMENTS,
            """SELECT 'Customer#' || lpad(user_id::VARCHAR, 9, '0') AS user_email, arg_min('ctm-' || user_id, event_id) AS customer_id
            FROM settled WHERE reject_reason IS NULL GROUP BY ALL""",
        ),
        "credit_ledger": _control(_LEDGER, "SELECT user_id, event_id, ts, delta, balance, denied FROM ledger"),
        "closing_balances": _control(
            _LEDGER,
            """SELECT user_id, arg_max(balance, (ts, event_id)) AS balance, sum(denied::INT)::BIGINT AS denied
            FROM ledger GROUP BY ALL""",
        ),
        "database_request_counts": _control(
            _LEDGER.replace("users ev", "users databases ev"),
            """SELECT d.owner_id, d.name, count(c.event_id) AS requests FROM databases d LEFT JOIN (
            SELECT event_id, user_id, CASE WHEN event_type IN ('click', 'view') THEN 'docs'
                WHEN event_type = 'signup' THEN 'images' ELSE 'nothing' END AS name
            FROM ledger WHERE delta < 0 AND NOT denied) c ON c.user_id = d.owner_id AND c.name = d.name GROUP BY ALL""",
        ),
        "usage_daily": _control("ev daily", "SELECT user_id, usage_date::VARCHAR AS usage_date, opened AS credits_used FROM daily"),
        "usage_upserted": _control("users ev daily prior_usage upserted", "SELECT user_id, usage_date::VARCHAR AS usage_date, credits_used FROM upserted"),
        "usage_retained": _control(
            "users ev daily prior_usage upserted",
            "SELECT user_id, usage_date::VARCHAR AS usage_date, credits_used FROM upserted WHERE usage_date >= DATE '2024-01-31' - 7",
        ),
        "moderation_report": _control(
            "mlabels",
            """SELECT doc_id AS item_id, coalesce(nsfw, false) AS nsfw, coalesce(n, 0) AS n_labels, labels FROM documents
            LEFT JOIN (SELECT item_id, bool_or(label = 'Violence') AS nsfw, count(*) AS n,
                       string_agg(label || ':' || confidence, ',' ORDER BY label, confidence) AS labels
                       FROM mlabels GROUP BY ALL) ON item_id = doc_id""",
        ),
        "verification_outcomes": _control(
            "ev codes attempts tried",
            """SELECT attempt_id, t.email, t.code, CASE WHEN max(issued_at) IS NULL THEN 'InvalidCode'
                 WHEN t.tried_at > max(issued_at) + INTERVAL 720 MINUTE THEN 'CodeExpired' ELSE 'ok' END AS outcome
            FROM tried t LEFT JOIN codes c ON c.email = t.email AND c.code = t.code AND c.issued_at <= t.tried_at
                 AND (t.previous IS NULL OR c.issued_at > t.previous)
            GROUP BY attempt_id, t.email, t.code, t.tried_at""",
        ),
        "remaining_codes": _control(
            "ev codes attempts",
            """SELECT email, code, issued_at FROM codes c WHERE NOT EXISTS (
            SELECT 1 FROM attempts a WHERE a.email = c.email AND a.code = c.code AND a.tried_at >= c.issued_at)""",
        ),
        "latency_summary": _control(
            "lat",
            f"""SELECT event_type, any_value(n) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
            round(CASE WHEN any_value(n) > 20 THEN {_quantile(20, 19)} ELSE max(value) END, 6) AS p95,
            round(CASE WHEN any_value(n) > 100 THEN {_quantile(100, 99)} ELSE max(value) END, 6) AS p99,
            min(value) AS min, max(value) AS max,
            round(any_value(n) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 6) AS rate
            FROM lat GROUP BY event_type""",
        ),
        "ingest_rows": _control(
            "inserts",
            """SELECT tenant, sha256(tenant || text) AS vector_id, replace(text, chr(10), ' ') AS content, metadata, region
            FROM inserts WHERE region <> 'mars'""",
        ),
        "ingest_rejected": _control(
            "inserts", "SELECT request_id, 'UnknownRegion' AS reject_reason FROM inserts WHERE region = 'mars'"
        ),
    }
