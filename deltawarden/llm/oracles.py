"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# A text of white space alone is empty; of equal texts the longest original stays, then the smallest doc_id.
ORACLES["op6_polynomial_fingerprints"] = r"""
WITH texts AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_chars,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
    FROM documents
), ranked AS (
    SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
           first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id
    FROM texts
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM ranked
"""

_MIX = r"""
WITH thin AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5('42:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS hash
    FROM documents
), sizes AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INTEGER + 1] AS weight
    FROM thin GROUP BY source
), ordered AS (
    SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place FROM sizes
), levels AS (
    SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM ordered WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), common AS (
    SELECT arg_min(level, place) AS level FROM levels WHERE level * weight <= 3 * source_size
), goals AS (
    SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce((SELECT level FROM common), 'inf'::DOUBLE)
           * weight) AS target FROM sizes
), rates AS (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM goals
), hashed AS (
    SELECT doc_id, thin.source, size, source_size, target, least(floor(rate), 3)::BIGINT AS base,
           rate - floor(rate) AS fraction,
           ('0x' || substr(hash, 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
    FROM thin JOIN rates ON thin.source IS NOT DISTINCT FROM rates.source
), arcs AS (
    SELECT source, arc, abs(any_value(base * source_size) + sum(CASE
               WHEN (u - arc / 64.0::DOUBLE) - floor(u - arc / 64.0::DOUBLE) < fraction THEN size ELSE 0 END)
           - any_value(target)) AS miss
    FROM hashed, (SELECT unnest(range(64))::DOUBLE AS arc) GROUP BY source, arc
), chosen AS (
    SELECT source, arg_min(arc, (miss, arc)) AS arc FROM arcs GROUP BY source
), drawn AS (
    SELECT doc_id, hashed.source, size, source_size, target, base + CASE
        WHEN (u - arc / 64.0::DOUBLE) - floor(u - arc / 64.0::DOUBLE) < fraction THEN 1 ELSE 0 END AS copies
    FROM hashed JOIN chosen ON hashed.source IS NOT DISTINCT FROM chosen.source
)
"""
ORACLES["op7_target_weights"] = _MIX + "SELECT doc_id, size, source_size, target, size * copies AS taken FROM drawn"

ORACLES["op9_preference_pairs"] = r"""
WITH turns AS (
    SELECT conv_id AS pair_id, turn, role, text FROM conversations
), spoiled AS (
    SELECT pair_id, CASE WHEN pair_id % 3 = 1 THEN min(turn) FILTER (role = 'assistant')
                         ELSE max(turn) FILTER (role = 'assistant') END AS spoiled
    FROM turns GROUP BY pair_id
), rejected AS (
    SELECT turns.pair_id, turn, role, CASE WHEN turn = spoiled AND role = 'assistant'
        THEN array_to_string(list_reverse(string_split(text, ' ')), ' ') ELSE text END AS text
    FROM turns JOIN spoiled ON turns.pair_id IS NOT DISTINCT FROM spoiled.pair_id
), sides AS (
    SELECT *, 'chosen' AS side FROM turns UNION ALL SELECT *, 'rejected' FROM rejected
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST,
                                 text NULLS FIRST) AS place,
           row_number() OVER (PARTITION BY pair_id, side, turn, role, text) - 1 AS copy
    FROM sides
), matched AS (
    SELECT c.pair_id, c.place FROM placed c JOIN placed r
    ON c.pair_id IS NOT DISTINCT FROM r.pair_id AND c.place = r.place AND c.side = 'chosen' AND r.side = 'rejected'
    AND c.turn IS NOT DISTINCT FROM r.turn AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY place) AS run FROM matched
), prompts AS (
    SELECT pair_id, count(*) AS length FROM numbered WHERE run = place GROUP BY pair_id
), parts AS (
    SELECT placed.*, CASE WHEN place <= coalesce(length, 0) THEN 'prompt' ELSE side END AS part,
           '<|im_start|>' || coalesce(role, 'user') || chr(10) AS head
    FROM placed LEFT JOIN prompts ON placed.pair_id IS NOT DISTINCT FROM prompts.pair_id
    WHERE side = 'chosen' OR place > coalesce(length, 0)
)
SELECT pair_id, part, turn, role, copy, head || coalesce(text, '') || '<|im_end|>' || chr(10) AS segment,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(head) ELSE 0 END AS train_start,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(head) + length(coalesce(text, '')) + 10 ELSE 0
       END AS train_end
FROM parts
"""

ORACLES["op1_revisit_resolution"] = r"""
WITH base AS (
    SELECT page_id, url, coalesce(html, '') AS html, 1700000000 + ((page_id * 7919) % 365) * 86400 + page_id % 86400 AS secs,
           'day ' || ((page_id * 7919) % 365) AS changed, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag
    FROM pages
), records AS (
    SELECT page_id, 0 AS asks, url, secs, tag AS etag, changed AS modified,
           ['Content-Type: text/html', 'ETag: ' || tag, 'Last-Modified: ' || changed, 'Content-Length: ' || length(html),
            'Cache-Control: no-store'] AS headers FROM base
    UNION ALL
    SELECT page_id, 1, regexp_replace(url, '^https?://', 'HTTPS://www.') || CASE WHEN contains(url, '#') THEN '' ELSE '#again' END,
           secs + (page_id % 11 - 2) * 86400,
           CASE page_id % 5 WHEN 0 THEN tag WHEN 1 THEN tag WHEN 3 THEN '"other"' END,
           CASE page_id % 5 WHEN 1 THEN changed WHEN 4 THEN changed END,
           CASE page_id % 5 WHEN 0 THEN ['etag: ' || tag] WHEN 1 THEN ['ETag: W/' || tag, 'Last-Modified: ' || changed]
                WHEN 2 THEN ['X-Cache: hit'] WHEN 3 THEN ['ETag: "other"'] ELSE ['Last-Modified: ' || changed] END
           || ['Content-Length: 0', 'cache-control: max-age=60', 'Connection: X-Hop, close', 'X-Hop: 1']
    FROM base
), plain AS (
    SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS p FROM records
), keyed AS (
    SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(p, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '')
           || regexp_replace(regexp_extract(p, '^[^/?]*([^?]*)', 1), '/+$', '') AS page_key,
           list_sort(list_filter(string_split(regexp_extract(p, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT
               regexp_matches(lower(q), '^(utm_[a-z]+|jsessionid|phpsessid|sid|sessionid)(=|$)'))) AS query
    FROM plain
), urls AS (
    SELECT *, page_key || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS url_key FROM keyed
), found AS (
    SELECT *, last_value(CASE WHEN asks = 0 THEN {'id': page_id, 'etag': etag, 'modified': modified, 'headers': headers} END
                         IGNORE NULLS) OVER (PARTITION BY url_key ORDER BY secs, asks, page_id) AS f FROM urls
), judged AS (
    SELECT *, CASE WHEN url_key IS NULL THEN 'invalid' WHEN f IS NULL THEN 'no_base'
                   WHEN etag <> f.etag OR modified <> f.modified THEN 'mismatch'
                   WHEN etag = f.etag OR modified = f.modified THEN 'resolved' ELSE 'unverified' END AS status
    FROM found WHERE asks = 1
), allowed AS (
    SELECT *, list_filter(headers, lambda h: NOT regexp_matches(h, '^(Content-Length|Connection|X-Hop):')) AS sent FROM judged
)
SELECT page_id, url_key, status, f.id AS base_page_id, array_to_string(CASE WHEN status IN ('resolved', 'unverified') THEN
    list_filter(f.headers, lambda h: NOT list_contains(list_transform(sent, lambda s: lower(split_part(s, ':', 1))),
                                                       lower(split_part(h, ':', 1)))) || sent
    ELSE headers END, chr(10)) AS headers
FROM allowed
"""

# Every anchor against every row; rows without a label, a vector or a finite component take no part.
ORACLES["op11_range_tree_negatives"] = r"""
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
           list_inner_product(a.v, b.v)::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER place AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW place AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY rank <= 3
"""

# All n-grams of up to three words; a piece ends at punctuation and line ends.
ORACLES["op12_misra_gries_phrases"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sized AS (
    SELECT lang, w, unnest(range(1, 4)) AS n FROM lists
), grams AS (
    SELECT lang, n, unnest(list_transform(range(1, len(w) - n + 2),
                                          lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase
    FROM sized WHERE len(w) >= n
), counts AS (
    SELECT lang, n, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE n = 1 GROUP BY lang
), cuts AS (
    SELECT lang, n, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
           array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, n)) AS k FROM counts WHERE n > 1 AND f >= 10)
), scored AS (
    SELECT cuts.*, h.f AS l, t.f AS r,
           ((1000000::HUGEINT * a * a) // (h.f::HUGEINT * t.f))::BIGINT AS score
    FROM cuts JOIN counts h ON h.lang = cuts.lang AND h.phrase = head JOIN counts t ON t.lang = cuts.lang
        AND t.phrase = rest
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
    SELECT lang, part, max(a) AS longer FROM (
        SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '),
                                array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS part
        FROM lowest WHERE n = 3) GROUP BY ALL
)
SELECT lowest.lang, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a, l, r, totals.n AS n, score
FROM lowest JOIN totals ON totals.lang = lowest.lang
    LEFT JOIN inner_parts ON inner_parts.lang = lowest.lang AND part = phrase AND lowest.n = 2
WHERE longer IS NULL OR 100 * longer < 50 * a
QUALIFY rank <= 2000
"""
