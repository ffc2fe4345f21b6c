"""DuckDB SQL of the training-data queries, where SQL can express them."""

from pagelode.llm.licenses import NOTICES, PHRASES

ORACLES: dict[str, str] = {}

ORACLES["op4_mix_sources"] = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), drawn AS (
  SELECT *, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || size) AS draw FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([3, 1, 2])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE
           AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT 0 AS round, 0.0::DOUBLE AS level
  UNION ALL
  SELECT round + 1,
         (SELECT (1.5 * sum(source_size)
                  - coalesce(sum(2.0 * source_size) FILTER (weight * level > 2.0 * source_size), 0))
                 / nullif(sum(weight) FILTER (weight * level <= 2.0 * source_size), 0)
          FROM sources)
  FROM filled WHERE round < 60 AND level IS NOT NULL
), targets AS (
  SELECT source, source_size, least(2.0 * source_size, weight * level) AS target
  FROM sources, (SELECT max(level) AS level FROM filled)
), parts AS (
  SELECT *, round(target)::BIGINT AS aim,
         CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole
  FROM targets
), placed AS (
  SELECT doc_id, size, d.source, source_size, target, whole, aim - whole * source_size AS part,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM drawn d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source, source_size, target,
       (whole * size + greatest(0, least(size, part - before)))::BIGINT AS taken
FROM placed
"""

ORACLES["op2_chat_windows"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS n,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens
  FROM turns
), marked AS (
  SELECT *, n = 1 AND role = 'system' AS is_system,
         coalesce(max(CASE WHEN n = 1 AND role = 'system' THEN tokens END)
                    OVER (PARTITION BY conv_id), 0) AS system_tokens
  FROM numbered
), summed AS (
  SELECT *, greatest(384 - system_tokens, 128) // 2 AS block,
         CASE WHEN is_system THEN 0 ELSE tokens END AS own,
         sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY n) AS "end"
  FROM marked
), placed AS (
  SELECT *, "end" - own AS start,
         CASE WHEN NOT is_system THEN
           ceil("end" / block)::BIGINT || CASE WHEN tokens > block THEN '!' ELSE '' END END AS place
  FROM summed
), opened AS (
  SELECT *, CASE WHEN place IS NOT NULL
                  AND place IS DISTINCT FROM lag(place) OVER (PARTITION BY conv_id ORDER BY n)
                 THEN 1 ELSE 0 END AS opens
  FROM placed
), spanned AS (
  SELECT *, greatest(1, sum(opens) OVER (PARTITION BY conv_id ORDER BY n)) AS span FROM opened
), spans AS (
  SELECT conv_id, span, min(n) AS n, min(start) AS start FROM spanned GROUP BY conv_id, span
), uses AS (
  SELECT conv_id, n, role, text, tokens, span AS "window" FROM spanned
  UNION ALL
  SELECT t.conv_id, t.n, role, text, tokens, s.span
  FROM spanned t JOIN spans s ON t.conv_id = s.conv_id AND s.span > t.span
  WHERE is_system OR (s.n - t.n <= 2 AND s.start - t.start <= 128)
), rendered AS (
  SELECT conv_id, "window", sum(tokens) AS tokens,
         sum(length('<s>' || regexp_replace(replace(role, '\', '\\'),
               '([<\[])(/?s>|/?INST\])', '\1\\\2', 'g') || '[INST]'
             || regexp_replace(replace(text, '\', '\\'),
               '([<\[])(/?s>|/?INST\])', '\1\\\2', 'g') || '[/INST]</s>')) AS chars
  FROM uses GROUP BY conv_id, "window"
), sizes AS (
  SELECT conv_id, sum(chars)::BIGINT AS formatted_chars, count(*) AS n_windows,
         max(tokens)::BIGINT AS most_tokens
  FROM rendered GROUP BY conv_id
), digests AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), ''))
           AS loss_sha256
  FROM numbered GROUP BY conv_id
)
SELECT d.*, formatted_chars, n_windows, most_tokens
FROM digests d JOIN sizes s ON d.conv_id IS NOT DISTINCT FROM s.conv_id
"""

ORACLES["op8_benchmark_leaks"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), items AS (
  SELECT DISTINCT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), item_grams AS (
  SELECT DISTINCT item_id, words, least(5, len(words)) AS size,
         array_to_string(words[i : i + least(5, len(words)) - 1], ' ') AS gram
  FROM items, unnest(range(1, greatest(1, len(words) - least(5, len(words)) + 2))) AS t(i)
  WHERE len(words) > 0
), sizes AS (SELECT DISTINCT size FROM item_grams),
doc_grams AS (
  SELECT DISTINCT row, doc_id, size, array_to_string(words[i : i + size - 1], ' ') AS gram
  FROM docs, sizes, unnest(range(1, greatest(1, len(words) - size + 2))) AS t(i)
  WHERE len(words) >= size
), counted AS (
  SELECT item_id, words, size, count(*) AS item_shingles FROM item_grams GROUP BY ALL
)
SELECT doc_id, c.item_id, count(*)::BIGINT AS shared, item_shingles::BIGINT AS item_shingles,
       count(*)::DOUBLE / item_shingles AS containment
FROM doc_grams d JOIN item_grams g ON d.size = g.size AND d.gram = g.gram
  JOIN counted c ON c.item_id IS NOT DISTINCT FROM g.item_id AND c.words = g.words
GROUP BY row, doc_id, c.item_id, c.words, item_shingles
HAVING count(*) >= 0.8 * item_shingles - 1e-9
"""

ORACLES["op5_vector_top_k"] = r"""
WITH vectors AS (
  SELECT row_number() OVER () AS row, vec_id, [floor(64.0 * x::DOUBLE) FOR x IN embedding] AS vector
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.row, q.vec_id AS query_id, v.vec_id,
         list_dot_product(q.vector, v.vector)::BIGINT AS score
  FROM vectors q JOIN vectors v ON v.row <> q.row AND len(v.vector) = len(q.vector)
  WHERE q.vec_id % 20 = 0
)
SELECT query_id,
       (row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank,
       vec_id, score
FROM scored
QUALIFY rank <= 20
"""

TEMPLATES = ",\n    ".join(
    f"({number}, '{label}', {exact}, '{text.replace(chr(39), chr(39) * 2)}')"
    for number, (exact, label, text) in enumerate(
        [(True, *phrase) for phrase in PHRASES] + [(False, *notice) for notice in NOTICES]
    )
)
WORDS_OF = (
    r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLES["op6_license_scan"] = rf"""
WITH given(template, label, exact, text) AS (VALUES
    {TEMPLATES}
), told AS (
  SELECT template, label, exact, {WORDS_OF.format("text")} AS words FROM given
), templates AS (
  SELECT template, label, exact, len(words) - 2 AS grams, i - 1 AS pos,
         words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM told, unnest(range(1, len(words) - 1)) AS t(i)
), docs AS (
  SELECT row_number() OVER () AS row, doc_id, {WORDS_OF.format("coalesce(text, '')")} AS words
  FROM documents
), doc_grams AS (
  SELECT row, i - 1 AS place, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM docs, unnest(range(1, greatest(1, len(words) - 1))) AS t(i)
), met AS MATERIALIZED (
  SELECT row, template, label, exact, grams, place, pos, place - pos AS diagonal
  FROM doc_grams JOIN templates USING (gram)
), votes AS (
  SELECT row, template, label, exact, grams, diagonal, count(*) AS votes FROM met GROUP BY ALL
), opened AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= 3 THEN 0 ELSE 1 END AS opens
  FROM votes WHERE NOT exact WINDOW w AS (PARTITION BY row, template ORDER BY diagonal)
), numbered AS (
  SELECT row, template, diagonal,
         sum(opens) OVER (PARTITION BY row, template ORDER BY diagonal) AS alignment
  FROM opened
), aligned AS (
  SELECT row, label, grams, min(place) AS start, max(place) + 3 AS "end",
         count(DISTINCT pos)::DOUBLE / grams AS coverage
  FROM met JOIN numbered USING (row, template, diagonal)
  GROUP BY row, template, label, grams, alignment
), found AS (
  SELECT row, label, diagonal AS start, 1.0::DOUBLE AS coverage, true AS exact
  FROM votes WHERE exact AND votes = grams
  UNION ALL
  SELECT row, label, start, coverage, false FROM aligned
  WHERE coverage >= 0.6 AND 2 * ("end" - start) <= 3 * (grams + 2)
), gathered AS (
  SELECT row, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word,
         max(start) FILTER (exact) AS last_word,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact), '') AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM found GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN gathered USING (row)
"""


NAMED = (
    "MAP {'lt': '<', 'gt': '>', 'quot': chr(34), 'apos': chr(39), 'nbsp': chr(32), 'copy': chr(169),"
    " 'reg': chr(174), 'middot': chr(183), 'ndash': chr(8211), 'mdash': chr(8212),"
    " 'hellip': chr(8230), 'laquo': chr(171), 'raquo': chr(187), 'amp': '&'}"
)
REFERENCE = (
    "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|lt|gt|quot|apos|nbsp|copy|reg|middot|ndash|mdash|hellip|"
    "laquo|raquo|amp);"
)


def decoded(text: str) -> str:
    """The pieces between references, each followed by what the reference behind it stands for."""
    point = """CASE WHEN r[3] IN ('x', 'X')
        THEN list_reduce(list_transform(string_split(lower(r[4:-2]), ''),
               lambda d: instr('0123456789abcdef', d) - 1), lambda a, b: a * 16 + b)
        ELSE try_cast(r[3:-2] AS BIGINT) END"""
    shown = f"""CASE WHEN r[2] <> '#' THEN {NAMED}[r[2:-2]]
        WHEN {point} BETWEEN 1 AND 55295 OR {point} BETWEEN 57344 AND 1114111 THEN chr(({point})::INTEGER)
        ELSE r END"""
    found = f"list_transform(regexp_extract_all({text}, '{REFERENCE}'), lambda r: {shown})"
    pieces = f"regexp_split_to_array({text}, '{REFERENCE}')"
    return f"""(CASE WHEN contains({text}, '&') THEN array_to_string(list_transform(
      list_zip({pieces}, {found}), lambda z: z[1] || coalesce(z[2], '')), '') ELSE {text} END)"""


def squeezed(text: str) -> str:
    blanks = rf"regexp_replace({text}, '[ \t\r\f\x0B\x{{00A0}}]+', ' ', 'g')"
    return rf"trim(regexp_replace({blanks}, ' ?\n[ \n]*', chr(10), 'g'), chr(10) || ' ')"


def urn(content: str) -> str:
    return (
        rf"regexp_replace(md5({content}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', "
        r"'<urn:uuid:\1-\2-\3-\4-\5>')"
    )


NL, CRLF = "chr(10)", "chr(13) || chr(10)"
UNSEEN = (
    r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)"
    r"|head\b.*?</head\s*>|noscript\b.*?</noscript\s*>|template\b.*?</template\s*>)"
)
BREAKS = (
    r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|nav|header|footer|main"
    r"|aside|blockquote|pre|form|figure|title|body|html)\b[^>]*>"
)
SHOWN = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{UNSEEN}', ' ', 'g'),
       '\s+', ' ', 'g'), '{BREAKS}', chr(10), 'g'), '</?[a-zA-Z!?][^>]*>', '', 'g')"""
TITLE = r"regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '\s+', ' ', 'g')"
QUOTED = r"""("[^"]*"|\x27[^\x27]*\x27|[^\s"\x27>]+)"""
LANGUAGE = rf"regexp_extract(html, '(?is)<html\b[^>]*?\slang\s*=\s*{QUOTED}', 1)"
LINKS = rf"regexp_extract_all(html, '(?is)<a\b[^>]*?\shref\s*=\s*{QUOTED}', 1)"


def unquoted(value: str) -> str:
    return rf"""regexp_replace({value}, '^["\x27]|["\x27]$', '', 'g')"""


OUTLINK = decoded(rf"regexp_replace({unquoted('link')}, '\s+', ' ', 'g')")

ORACLES["op7_warc_derivatives"] = rf"""
WITH sources AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html,
         {urn(f"concat_ws({NL}, 'response', page_id, coalesce(url, ''), coalesce(html, ''))")}
           AS refers_to
  FROM pages
), fields AS (
  SELECT *, 'Content-Length: ' || strlen(html) AS length_header,
         list_transform({LINKS}, lambda link: 'outlink: ' || {OUTLINK} || {CRLF}) AS links
  FROM sources
), made AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
         'status: 200' || {CRLF}
         || 'source-header: Content-Type: text/html; charset=utf-8' || {CRLF}
         || 'source-header: ' || length_header || {CRLF}
         || 'title: ' || {squeezed(decoded(TITLE))} || {CRLF}
         || 'language: ' || {unquoted(LANGUAGE)} || {CRLF}
         || array_to_string(links, '') AS block
  FROM fields
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', {squeezed(decoded(SHOWN))} FROM fields
)
SELECT page_id, record_type, {urn(f"concat_ws({NL}, record_type, refers_to, block)")} AS record_id,
       refers_to, target_uri, '2000-01-01T00:00:00Z' AS refers_to_date, content_type,
       'sha256:' || sha256(html) AS payload_digest, true AS digest_matches,
       'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length,
       'Content-Type: text/html; charset=utf-8' || chr(10) || length_header AS source_headers, block
FROM made
"""


def _lloyd(rounds: int = 4) -> str:
    """Assignments and codebooks of each round as tables of their own."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
near{i} AS MATERIALIZED (
  SELECT n, p, min([CAST(list_sum(list_transform(list_zip(part, entry),
                     lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), e]) AS best
  FROM pieces JOIN book{i} USING (p) GROUP BY n, p)""")
        if i < rounds:
            steps.append(f"""
mean{i} AS (
  SELECT p, e, list(m ORDER BY i) AS entry FROM (
    SELECT p, e, i, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS m
    FROM (SELECT p, best[2] AS e, unnest(part) AS x, generate_subscripts(part, 1) AS i
          FROM pieces JOIN near{i} USING (n, p))
    GROUP BY p, e, i)
  GROUP BY p, e),
book{i + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.entry, b.entry) AS entry FROM book{i} b LEFT JOIN mean{i} m USING (p, e))""")
    return ",".join(steps)


ORACLES["op12_vector_codes"] = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, v, row_number() OVER (ORDER BY vec_id, v) AS n
  FROM (SELECT vec_id, label,
               list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), pieces AS MATERIALIZED (
  SELECT n, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS part
  FROM kept, (SELECT unnest([0, 1, 2, 3]) AS p)
), book0 AS MATERIALIZED (
  SELECT p, n - 1 AS e, part AS entry FROM pieces WHERE n <= 256
), {_lloyd()},
coded AS (
  SELECT n, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code,
         CAST(sum(best[1]) AS BIGINT) AS error
  FROM near4 GROUP BY n
), numbers AS (
  SELECT string_agg(x::VARCHAR, ',' ORDER BY p, e, i) AS all_numbers
  FROM (SELECT p, e, unnest(entry) AS x, generate_subscripts(entry, 1) AS i FROM book4)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       sha256(all_numbers) AS codebooks_sha256
FROM kept JOIN coded USING (n), numbers
"""

_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op13_ranked_search"] = f"""
WITH told AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         {_TERMS.format(_ASCII_LOWER.format("coalesce(text, '')"))} AS ts
  FROM documents
), sizes AS (
  SELECT r, doc_id, len(ts)::BIGINT AS n FROM told WHERE len(ts) > 0
), whole AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes
), asked AS MATERIALIZED (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest({_TERMS.format(_ASCII_LOWER.format("coalesce(text, '')"))}) AS term
        FROM benchmark)
  GROUP BY item_id, term
), post AS MATERIALIZED (
  SELECT r, term, count(*)::BIGINT AS tf
  FROM (SELECT r, unnest(ts) AS term FROM told) WHERE term IN (SELECT term FROM asked)
  GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM post, whole GROUP BY term, docs
), scored AS (
  SELECT item_id, r, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT)
           AS score
  FROM asked JOIN weights USING (term) JOIN post USING (term) JOIN sizes USING (r), whole
  GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM scored WHERE score > 0)
WHERE rank <= 20
"""
