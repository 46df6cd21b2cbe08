"""DuckDB SQL of the queries that SQL can express over whole tables."""

ORACLE: dict[str, str] = {}

ORACLE["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (
    SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY sha1(html)) AS most FROM p
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM most THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM most THEN most END AS refers_to
FROM r
"""

ORACLE["op3_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
"""


def _repeats(units: str, length: int, separator: str, name: str) -> str:
    """Units covered by ``length`` of them that also start earlier."""
    return rf"""
WITH d AS (SELECT doc_id, {units} AS u FROM documents),
w AS (
    SELECT doc_id, s, md5(array_to_string(u[s : s + {length - 1}], chr(0))) AS h
    FROM (SELECT doc_id, u, unnest(range(1, len(u) - {length - 2})) AS s FROM d WHERE len(u) >= {length})
),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {length})) AS at FROM again),
kept AS (
    SELECT d.doc_id, coalesce(string_agg(x.unit, {separator} ORDER BY x.at) FILTER (WHERE gone.at IS NULL), '') AS text, count(gone.at) AS n_removed
    FROM d CROSS JOIN LATERAL (SELECT unnest(d.u) AS unit, unnest(range(1, len(d.u) + 1)) AS at) x
    LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.at = x.at GROUP BY d.doc_id
)
SELECT d.doc_id, len(d.u) AS {name}, coalesce(kept.n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


ORACLE["op2_line_dedup"] = _repeats(
    r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]'))", 3, "chr(10)", "n_lines"
)
ORACLE["op7_substring_dedup"] = _repeats(r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')", 20, "' '", "n_words")

ORACLE["op11_hard_negatives"] = """
WITH v AS (
    SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.id AS anchor_id, o.id, o.label = a.label AS same, CAST(list_dot_product(a.v, o.v) AS BIGINT) AS score
    FROM v a JOIN v o ON o.id <> a.id WHERE a.id % 100 = 0
),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank,
    id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

ORACLE["op12_conversation_repair"] = r"""
WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
),
kinds AS (  -- CRC-32, bit by bit
    SELECT *, xor(list_reduce(
        list_concat([4294967295::UBIGINT], list_transform(string_split(key, ''), lambda c: ascii(c)::UBIGINT)),
        lambda crc, byte: list_reduce(
            list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
            lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))
    ), 4294967295::UBIGINT) % 20 AS kind FROM raw
),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM kinds WHERE kind <> 0)
),
rows_ AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i
    FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
            regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS ink
        FROM damaged
    )
),
judged AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
            WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
        left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair, i > 1 AS later
    FROM rows_
),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
        count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE later AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
    FROM judged GROUP BY conv_id
),
next_role AS (FROM (VALUES ('', 'user', 'u'), ('s', 'user', 'u'), ('u', 'assistant', 'p'), ('p', 'user', 'u')) t(q, role, q2)),
steps AS (  -- before a row at most one insert; two of them never pay
    SELECT q, '' AS letter, 0 AS price, CAST([] AS VARCHAR[]) AS put, q AS q2 FROM next_role
    UNION ALL SELECT q, 'I', 5, [role || ':'], q2 FROM next_role
),
paths AS (
    SELECT conv_id, 0 AS i, '' AS q, {'cost': 0, 'audit': '', 'put': CAST([] AS VARCHAR[])} AS best FROM counts
    UNION ALL
    SELECT conv_id, i, q, min(way) AS best FROM (
        SELECT p.conv_id, r.i, CASE e.letter WHEN 'D' THEN s.q2 ELSE e.q2 END AS q,
            {'cost': p.best.cost + s.price + e.price + CASE WHEN r.fault = 'truncated' AND e.letter <> 'D' THEN 5 ELSE 0 END,
             'audit': p.best.audit || s.letter || e.letter,
             'put': list_concat(list_concat(p.best.put, s.put),
                CASE e.letter WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [r.role || ':' || r.text] ELSE [e.role || ':' || r.text] END)} AS way
        FROM paths p JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
        JOIN steps s ON s.q = p.q
        JOIN (
            SELECT q, 'D' AS letter, 2 AS price, '' AS role, q AS q2, '' AS initial FROM next_role
            UNION ALL SELECT q, 'R', 1, role, q2, '' FROM next_role
            UNION ALL SELECT q, 'K', 0, '', q2, left(role, 1) FROM next_role
            UNION ALL SELECT '', 'K', 0, '', 's', 's'
        ) e ON e.q = s.q2 AND (e.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (e.letter <> 'K' OR e.initial = left(r.role, 1))
    ) GROUP BY conv_id, i, q
),
ends AS (
    SELECT conv_id, min(CASE q WHEN 'u' THEN {'cost': best.cost + 5, 'audit': best.audit || 'I', 'put': list_append(best.put, 'assistant:')}
        ELSE best END) AS best
    FROM paths JOIN counts USING (conv_id) WHERE i = n AND q <> 's' GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
    sha256(coalesce(array_to_string(best.put, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLE["op13_minhash"] = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
s AS (
    SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON y.h = x.h AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)
),
reach AS (
    SELECT doc_id, doc_id AS other FROM d
    UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.least AS component_id, d.doc_id = c.least AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""
