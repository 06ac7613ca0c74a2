"""SQL for DuckDB of the corpus queries that SQL can express, in the plainest form: every pair of rows, every window."""

from __future__ import annotations

OP12_HARD_NEGATIVES = """
WITH known AS (
    SELECT vec_id,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM known a JOIN known b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score
    FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p
JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


OP6_SUFFIX_DEDUP = """
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS bytes FROM documents
),
windows AS (
    SELECT r, low, md5(substr(bytes, 2 * low + 1, 400)) AS digest
    FROM (SELECT r, bytes, unnest(range(0, len(bytes) // 2 - 199)) AS low FROM docs)
),
often AS (SELECT digest FROM windows GROUP BY digest HAVING count(*) > 1),
covered AS (SELECT r, low FROM windows SEMI JOIN often USING (digest)),
marked AS (
    SELECT r, low, coalesce(low > lag(low) OVER (PARTITION BY r ORDER BY low) + 200, true) AS opens FROM covered
),
numbered AS (
    SELECT r, low, sum(opens::INT) OVER (PARTITION BY r ORDER BY low ROWS UNBOUNDED PRECEDING) AS run FROM marked
),
runs AS (SELECT r, min(low) AS low, max(low) + 200 AS high FROM numbered GROUP BY r, run),
pieces AS (
    SELECT d.r, p.low, substr(d.bytes, 2 * p.after + 1, 2 * (p.low - p.after)) AS piece
    FROM (SELECT r, low, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS after FROM runs) p JOIN docs d USING (r)
    UNION ALL
    SELECT d.r, 1e15::BIGINT, substr(d.bytes, 2 * coalesce(e.high, 0) + 1)
    FROM docs d LEFT JOIN (SELECT r, max(high) AS high FROM runs GROUP BY r) e USING (r)
),
kept AS (SELECT r, string_agg(piece, '' ORDER BY low) AS bytes FROM pieces GROUP BY r),
removed AS (SELECT r, count(*) AS n_spans, sum(high - low) AS n_removed FROM runs GROUP BY r)
SELECT d.doc_id, CAST(len(d.bytes) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.bytes)) AS kept_sha256
FROM docs d JOIN kept USING (r) LEFT JOIN removed USING (r)
"""

OP8_MULTI_INDEX = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF x <> 0]) > 0
      AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
),
reached AS (
    SELECT vec_id, vec_id AS other FROM embeddings WHERE vec_id IS NOT NULL
    UNION
    SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a
),
components AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM components
"""


# Of two lines of 16 characters or more within one edit the first or the last seven characters are equal. Their
# distance is looked at behind what they have in common at the start, by characters.
OP9_LINE_DEDUP = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
places AS (
    SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no
    FROM docs
),
lines AS (
    SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, r, no) AS pos, length(line) AS n,
           length(line) >= 16 OR regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') AS compared
    FROM places
),
firsts AS (SELECT line, n, min(pos) AS pos FROM lines WHERE compared GROUP BY ALL),
long AS (SELECT line, n, pos FROM firsts WHERE n >= 16),
pairs AS (
    SELECT a.line AS a, b.line AS b, a.pos FROM long a JOIN long b
    ON left(a.line, 7) = left(b.line, 7) AND b.pos < a.pos AND abs(a.n - b.n) <= 1
    UNION
    SELECT a.line, b.line, a.pos FROM long a JOIN long b
    ON right(a.line, 7) = right(b.line, 7) AND b.pos < a.pos AND abs(a.n - b.n) <= 1
),
common AS (
    SELECT *, coalesce(list_max([i FOR i IN range(1, least(length(a), length(b)) + 1) IF left(a, i) = left(b, i)]), 0) AS same
    FROM pairs
),
near AS (
    SELECT DISTINCT pos FROM common
    WHERE substr(a, same + 2) = substr(b, same + 2) OR substr(a, same + 1) = substr(b, same + 2)
       OR substr(a, same + 2) = substr(b, same + 1)
),
stay AS (
    SELECT r, no, line FROM lines
    WHERE NOT compared OR (pos IN (SELECT pos FROM firsts) AND pos NOT IN (SELECT pos FROM near))
),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY no) AS body FROM stay GROUP BY r),
whole AS (
    SELECT doc_id, text, CASE WHEN text IS NOT NULL THEN coalesce(body, '') END AS body FROM docs LEFT JOIN kept USING (r)
)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(length(body) AS BIGINT) AS kept_chars, sha256(body) AS kept_sha256
FROM whole
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_suffix_dedup": OP6_SUFFIX_DEDUP,
        "op8_multi_index": OP8_MULTI_INDEX,
        "op9_line_dedup": OP9_LINE_DEDUP,
        "op12_hard_negatives": OP12_HARD_NEGATIVES,
    }
