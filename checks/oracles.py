"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from checks.queries import K, MESSAGE_KINDS, OTHER_B, OTHER_K1, SINGLE_QUERY, WORSE

# Python's str.split() whitespace, spelt for DuckDB.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def terms(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '[a-z0-9]+')"


def words(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({column}), '{WS}'), lambda w: w <> '')"


def cut(column: str) -> str:
    prefixes = ", ".join(f"try(decode(encode({column})[1:{n}]))" for n in (512, 511, 510, 509))
    return f"coalesce({prefixes})"


# Corpora: the current pages, and all events that count for the statistics.
DOCUMENT_PAGES = """
page AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS id, source AS url, '' AS title, text AS body
         FROM documents),
event AS (SELECT * FROM page)
"""
LATEST_PAGES = """
page AS MATERIALIZED (SELECT CAST(conv_id AS VARCHAR) AS id, '' AS url, role AS title, text AS body
         FROM conversations
         QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
event AS (SELECT * FROM page)
"""
CUMULATIVE_PAGES = LATEST_PAGES.replace(
    "event AS (SELECT * FROM page)",
    "event AS (SELECT CAST(conv_id AS VARCHAR) AS id, '' AS url, role AS title, text AS body"
    " FROM conversations)",
)

INDEX = f"""
tokenised AS MATERIALIZED (SELECT id, {terms("title || ' ' || body")} AS ts FROM page),
event_terms AS MATERIALIZED (SELECT id, {terms("title || ' ' || body")} AS ts FROM event),
counted AS (SELECT id, term, count(*) AS tf
            FROM (SELECT id, unnest(ts) AS term FROM tokenised) GROUP BY id, term),
reachable AS (SELECT DISTINCT id, term FROM (SELECT id, unnest(ts) AS term FROM event_terms)),
post AS MATERIALIZED (
    SELECT r.id, r.term, coalesce(c.tf, 0) AS tf, CAST(len(t.ts) AS BIGINT) AS dl
    FROM reachable r JOIN tokenised t ON t.id = r.id
    LEFT JOIN counted c ON c.id = r.id AND c.term = r.term),
freq AS MATERIALIZED (
    SELECT term, count(*) AS df
    FROM (SELECT unnest(list_distinct(ts)) AS term FROM event_terms) GROUP BY term),
stats AS MATERIALIZED (
    SELECT (SELECT count(*) FROM page) AS n,
           CAST(sum(len(ts)) AS BIGINT) AS total_len,
           CAST(sum(len(ts)) AS DOUBLE) / (SELECT count(*) FROM page) AS avgdl
    FROM event_terms)
"""


def asked(k: str = str(K)) -> str:
    return f"""
asked AS MATERIALIZED (
    SELECT CAST(item_id AS VARCHAR) AS qid, text AS query, CAST({k} AS INTEGER) AS k
    FROM benchmark)
"""


ANY_K = "item_id % 35 - 2"

ASKED_ONCE = f"""
asked AS MATERIALIZED (SELECT '0' AS qid, '{SINGLE_QUERY}' AS query, {K} AS k)
"""

SCORES = f"""
asked_terms AS (
    SELECT qid, term, count(*) AS qtf
    FROM (SELECT qid, unnest({terms("query")}) AS term FROM asked WHERE k > 0)
    GROUP BY qid, term),
scored AS MATERIALIZED (
    SELECT qid, id,
           sum(qtf * ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * (tf * 2.2e0)
               / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score
    FROM asked_terms JOIN post USING (term) JOIN freq USING (term), stats
    GROUP BY qid, id),
ranked AS MATERIALIZED (
    SELECT qid, id, score,
           row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS bm25_rank
    FROM scored),
pool AS MATERIALIZED (
    SELECT r.qid, query, k, r.id, url, title, body, score, bm25_rank
    FROM ranked r JOIN asked a ON a.qid = r.qid JOIN page p ON p.id = r.id
    WHERE bm25_rank <= greatest(20, k))
"""


def vectors(name: str, source: str, key: str, text: str) -> str:
    return f"""
{name}_count AS (
    SELECT {key}, token, count(*) AS c
    FROM (SELECT {key}, unnest({words(text)}) AS token FROM {source}) GROUP BY ALL),
{name} AS MATERIALIZED (
    SELECT {key}, token, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS weight
    FROM {name}_count)
"""


COSINES = f"""
pooled AS (SELECT DISTINCT id, title, body FROM pool),
{vectors("doc_vector", "pooled", "id", "title || ' ' || body")},
{vectors("query_vector", "asked", "qid", "query")},
cosines AS MATERIALIZED (
    SELECT p.qid, p.id, p.bm25_rank, coalesce(sum(q.weight * d.weight), 0) AS cosine
    FROM pool p LEFT JOIN query_vector q ON q.qid = p.qid
    LEFT JOIN doc_vector d ON d.id = p.id AND d.token = q.token
    GROUP BY p.qid, p.id, p.bm25_rank),
orders AS (
    SELECT qid, id, row_number() OVER (
        PARTITION BY qid ORDER BY round(cosine, 9) DESC, bm25_rank) - 1 AS pos
    FROM cosines)
"""

RESULT = f"""
SELECT qid, CAST(rank AS INTEGER) AS rank, id, url, title, {cut("body")} AS body,
       round(score, 6) AS score
FROM final WHERE rank <= k
"""
RESULT_KEYS = """
SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score
FROM final WHERE rank <= k
"""
BM25_FINAL = "final AS (SELECT *, bm25_rank AS rank FROM pool)"
COSINE_FINAL = "final AS (SELECT *, pos + 1 AS rank FROM pool JOIN orders USING (qid, id))"

# Points as the ranking defines them: n - i for position i of n, 0 if unlisted.
EXTERNAL_FINAL = f"""
labelled AS (
    SELECT qid, s.id, toxic, (1 - quality) * {WORSE} + doc_id % {WORSE} AS pos
    FROM scored s JOIN labels l ON CAST(l.doc_id AS VARCHAR) = s.id
    WHERE CAST(qid AS INTEGER) % 5 <> 0),
listed AS (
    SELECT qid, id, pos FROM labelled
    UNION ALL SELECT qid, id, pos + {2 * WORSE} FROM labelled WHERE toxic = 1),
points AS (
    SELECT qid, id, (max(max(pos)) OVER (PARTITION BY qid)) + 1 - max(pos) AS points
    FROM listed GROUP BY qid, id),
final AS (
    SELECT s.qid, k, s.id, url, title, body, score,
           row_number() OVER (PARTITION BY s.qid ORDER BY coalesce(points, 0) DESC,
                              round(score, 9) DESC, s.id) AS rank
    FROM scored s JOIN asked USING (qid) JOIN page USING (id)
    LEFT JOIN points p ON p.qid = s.qid AND p.id = s.id)
"""
OVERLAP_FINAL = f"""
shared AS (
    SELECT qid, id, bm25_rank,
           len(list_intersect({words("query")}, {words("title || ' ' || body")})) AS shared
    FROM pool),
final AS (
    SELECT pool.*, row_number() OVER (
        PARTITION BY pool.qid ORDER BY shared DESC, pool.bm25_rank) AS rank
    FROM pool JOIN shared USING (qid, id))
"""

OTHER_SCORES = (
    SCORES.replace("2.2e0", f"({OTHER_K1 + 1}e0)")
    .replace("1.2e0", f"{OTHER_K1}e0")
    .replace("0.25e0 + 0.75e0", f"{1 - OTHER_B}e0 + {OTHER_B}e0")
)
FALLBACK_FINAL = """
listed AS (
    SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY CAST(id AS BIGINT) DESC) AS pos
    FROM pool WHERE CAST(qid AS BIGINT) % 3 <> 0 AND CAST(id AS BIGINT) % 2 = 0),
final AS (
    SELECT pool.*, row_number() OVER (
        PARTITION BY pool.qid ORDER BY pos NULLS LAST, pool.bm25_rank) AS rank
    FROM pool LEFT JOIN listed USING (qid, id))
"""
BEYOND_FINAL = """
final AS (
    SELECT s.qid, k, s.id, url, title, body, score,
           row_number() OVER (PARTITION BY s.qid ORDER BY
               CAST(s.id AS BIGINT) NULLS LAST, round(score, 9) DESC, s.id) AS rank
    FROM scored s JOIN asked USING (qid) JOIN page USING (id))
"""
# Documents whose bodies were all replaced.
REPLACED_PAGES = """
page AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS id, source AS url, '' AS title,
         reverse(source) || ' ' || text AS body FROM documents),
event AS (SELECT * FROM page)
"""
# Documents, and conversations under ids of their own.
BOTH_PAGES = """
page AS MATERIALIZED (
    SELECT CAST(doc_id AS VARCHAR) AS id, source AS url, '' AS title, text AS body FROM documents
    UNION ALL
    SELECT * FROM (SELECT 'c' || conv_id AS id, '' AS url, role AS title, text AS body
                   FROM conversations
                   QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)),
event AS (SELECT * FROM page)
"""


def with_(*parts: str) -> str:
    *tables, select = parts
    return f"WITH {','.join(tables)} {select}"


WITH_STATS = "SELECT term, df, n, total_len FROM freq, stats"
ALL_POSTINGS = "SELECT id, term, tf, dl FROM post"
WEB_PAGES = "CAST(page_id AS VARCHAR) AS id, url"

# What becomes of each kind of message: (id, url, title, body), or nothing.
DECODED = f"""
SELECT doc_id,
       CASE WHEN kind IN (2, 5, 10) THEN '' ELSE CAST(doc_id AS VARCHAR) END AS id,
       CASE WHEN kind = 0 THEN source ELSE '' END AS url,
       '' AS title,
       CASE WHEN kind IN (0, 1, 2, 3) THEN text ELSE '' END AS body
FROM (SELECT *, doc_id % {MESSAGE_KINDS} AS kind FROM documents)
WHERE kind IN (0, 1, 2, 3, 4, 5, 10)
"""

ORACLES: dict[str, str] = {
    "text_normalize": "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
    " AS normalized FROM documents",
    "text_tokens": f"""SELECT doc_id, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS pos,
        unnest(ts) AS token FROM (SELECT doc_id, {terms("text")} AS ts FROM documents)""",
    "indexed_text": "SELECT CAST(conv_id AS VARCHAR) AS id, turn AS seq,"
    " role || ' ' || text AS indexed FROM conversations",
    "body_truncate": f"SELECT doc_id, {cut('text')} AS body FROM documents",
    "whitespace_tokens": f"""SELECT doc_id, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS pos,
        unnest(ws) AS word FROM (SELECT doc_id, {words("text")} AS ws FROM documents)""",
    "pool_bounds": with_(
        asked(ANY_K),
        "SELECT qid, k, greatest(20, k) AS pool, least(k, 20) AS least FROM asked",
    ),
    "doc_length": with_(
        DOCUMENT_PAGES, INDEX, "SELECT id, CAST(len(ts) AS BIGINT) AS dl FROM tokenised"
    ),
    "postings": with_(DOCUMENT_PAGES, INDEX, ALL_POSTINGS),
    "doc_frequency": with_(DOCUMENT_PAGES, INDEX, "SELECT term, df FROM freq"),
    "corpus_stats": with_(
        DOCUMENT_PAGES, INDEX, "SELECT n, total_len, round(avgdl, 6) AS avgdl FROM stats"
    ),
    "index_snapshot": with_(
        DOCUMENT_PAGES, INDEX, "SELECT term, df, n, round(avgdl, 6) AS avgdl FROM freq, stats"
    ),
    "term_idf": with_(
        DOCUMENT_PAGES,
        INDEX,
        f"""named AS (
            SELECT unnest({terms("text")}) AS term FROM benchmark
            UNION SELECT unnest({terms("text")}) FROM conversations)""",
        """SELECT term, coalesce(df, 1) AS df,
               round(ln((n - coalesce(df, 1) + 0.5e0) / (coalesce(df, 1) + 0.5e0) + 1e0), 6) AS idf
        FROM named LEFT JOIN freq USING (term), stats""",
    ),
    "candidates": with_(
        DOCUMENT_PAGES, INDEX, asked(), SCORES,
        "SELECT DISTINCT qid, id FROM asked_terms JOIN post USING (term)",
    ),
    "bm25_scores": with_(
        DOCUMENT_PAGES, INDEX, asked(), SCORES, "SELECT qid, id, round(score, 6) AS score FROM scored"
    ),
    "bm25_topk": with_(DOCUMENT_PAGES, INDEX, asked(), SCORES, BM25_FINAL, RESULT_KEYS),
    "rerank_pool": with_(
        DOCUMENT_PAGES, INDEX, asked(ANY_K), SCORES,
        "SELECT qid, id, CAST(bm25_rank AS INTEGER) AS bm25_rank, round(score, 6) AS score FROM pool",
    ),
    "bm25_pruned": with_(
        DOCUMENT_PAGES, INDEX, asked(ANY_K), SCORES,
        "SELECT qid, id, CAST(bm25_rank AS INTEGER) AS bm25_rank, round(score, 6) AS score FROM pool",
    ),
    "vector_norms": f"""SELECT doc_id, round(sqrt(sum(c * c)), 6) AS norm FROM (
        SELECT doc_id, w, count(*) AS c
        FROM (SELECT doc_id, unnest({words("text")}) AS w FROM documents) GROUP BY ALL)
        GROUP BY doc_id""",
    "bow_vectors": with_(
        vectors("v", "documents", "doc_id", "text"),
        "SELECT doc_id, token, round(weight, 6) AS weight FROM v",
    ),
    "cosine_scores": with_(
        DOCUMENT_PAGES, INDEX, asked(), SCORES, COSINES,
        "SELECT qid, id, round(cosine, 6) AS cosine FROM cosines",
    ),
    "rerank_order": with_(
        DOCUMENT_PAGES, INDEX, asked(), SCORES, COSINES,
        "SELECT qid, id, CAST(pos AS INTEGER) AS pos FROM orders",
    ),
    "search_batch": with_(
        DOCUMENT_PAGES, INDEX, asked(), SCORES, COSINES, COSINE_FINAL, RESULT
    ),
    "search_any_k": with_(
        DOCUMENT_PAGES, INDEX, asked(ANY_K), SCORES, COSINES, COSINE_FINAL, RESULT_KEYS
    ),
    "search_single": with_(
        DOCUMENT_PAGES, INDEX, ASKED_ONCE, SCORES, COSINES, COSINE_FINAL,
        f"SELECT * EXCLUDE (qid) FROM ({RESULT})",
    ),
    "search_stored_vectors": with_(
        DOCUMENT_PAGES, INDEX, asked(), SCORES, COSINES, COSINE_FINAL, RESULT
    ),
    "search_by_term": with_(
        DOCUMENT_PAGES, INDEX, ASKED_ONCE, SCORES, COSINES, COSINE_FINAL,
        f"SELECT * EXCLUDE (qid) FROM ({RESULT})",
    ),
    "search_unstored": with_(
        LATEST_PAGES, INDEX, asked(), SCORES, COSINES, COSINE_FINAL, RESULT
    ),
    "search_fallback": with_(DOCUMENT_PAGES, INDEX, asked(), SCORES, FALLBACK_FINAL, RESULT),
    "search_other_parameters": with_(
        DOCUMENT_PAGES, INDEX, asked(), OTHER_SCORES, COSINES, COSINE_FINAL, RESULT
    ),
    "reranker_beyond_pool": with_(DOCUMENT_PAGES, INDEX, asked(), SCORES, BEYOND_FINAL, RESULT),
    "external_order": with_(DOCUMENT_PAGES, INDEX, asked(), SCORES, EXTERNAL_FINAL, RESULT),
    "pluggable_reranker": with_(DOCUMENT_PAGES, INDEX, asked(), SCORES, OVERLAP_FINAL, RESULT),
    "upsert_latest": with_(LATEST_PAGES, INDEX, ALL_POSTINGS),
    "upsert_latest_stats": with_(LATEST_PAGES, INDEX, WITH_STATS),
    "upsert_extended": with_(LATEST_PAGES, INDEX, WITH_STATS),
    "upsert_documents": with_(
        LATEST_PAGES,
        INDEX,
        """SELECT id, url, title, body, CAST(len(ts) AS BIGINT) AS dl
        FROM page JOIN tokenised USING (id)""",
    ),
    "extend_unordered": with_(
        REPLACED_PAGES,
        INDEX,
        "SELECT id, url, title, body, CAST(len(ts) AS BIGINT) AS dl"
        " FROM page JOIN tokenised USING (id)",
    ),
    "extend_cumulative": with_(CUMULATIVE_PAGES, INDEX, WITH_STATS),
    "extend_cumulative_postings": with_(CUMULATIVE_PAGES, INDEX, ALL_POSTINGS),
    "publish_read_back": f"SELECT {WEB_PAGES}, '' AS title, html AS body FROM pages",
    "stream_onto_index": with_(BOTH_PAGES, INDEX, WITH_STATS),
    "stream_counters": with_(CUMULATIVE_PAGES, INDEX, WITH_STATS),
    "publish_streamed": f"SELECT {WEB_PAGES}, '' AS title, html AS body FROM pages",
    "two_writers": with_(BOTH_PAGES, INDEX, WITH_STATS),
    "stream_restarted": with_(
        LATEST_PAGES, INDEX, f"SELECT *, 2 AS failures FROM ({WITH_STATS})"
    ),
    "stream_cumulative": with_(CUMULATIVE_PAGES, INDEX, WITH_STATS),
    "upsert_cumulative": with_(CUMULATIVE_PAGES, INDEX, ALL_POSTINGS),
    "upsert_cumulative_stats": with_(CUMULATIVE_PAGES, INDEX, WITH_STATS),
    "upsert_cumulative_search": with_(
        CUMULATIVE_PAGES, INDEX, asked(), SCORES, COSINES, COSINE_FINAL, RESULT_KEYS
    ),
    "encode_decode_roundtrip": f"SELECT {WEB_PAGES}, '' AS title, html AS body FROM pages",
    "message_keys": f"SELECT {WEB_PAGES}, CAST(page_id AS VARCHAR) AS key,"
    " 'id,url,title,body' AS fields FROM pages",
    "decode_bad_rows": DECODED,
    "stream_index": with_(LATEST_PAGES, INDEX, ALL_POSTINGS),
    "stream_search": with_(LATEST_PAGES, INDEX, asked(), SCORES, COSINES, COSINE_FINAL, RESULT),
    "stream_rejects": "SELECT '{bad ' || text AS value FROM conversations",
}
