"""The registered queries as DuckDB SQL over the same tables, written independently of the operators."""

from __future__ import annotations

from passagemill.functions import constants as K

ORACLE: dict[str, str] = {}


def quoted(words) -> str:
    return ", ".join(f"'{word}'" for word in words)


def with_parts(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


# Expressions.

WORDS = r"regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}._-]+')"
TERMS = (
    "list_filter(list_transform(" + WORDS + r", lambda w: regexp_replace(w, '^[-._]+|[-._]+$', '', 'g')), "
    "lambda w: w <> '' AND w NOT IN (" + quoted(K.OPERATOR_WORDS) + "))"
)
LEXEMES = "list_filter(" + TERMS + ", lambda w: w NOT IN (" + quoted(K.ENGLISH_STOP_WORDS) + "))"
DISTINCT_WORDS = "list_distinct(list_filter(" + WORDS + ", lambda w: length(w) > 2))"
CONTENT_WORDS = "list_filter(" + DISTINCT_WORDS + ", lambda w: w NOT IN (" + quoted(K.ANSWER_STOP_WORDS) + "))"
TOKENS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"
EMBEDDED_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
FNV = (
    "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), "
    "lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
)
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

# Shared inputs.

CORPUS = (
    "corpus AS (SELECT doc_id, source, concat(source, '/', doc_id, '.md') AS source_path, text AS content, "
    "sha256(text) AS content_hash FROM documents)"
)
LABELLED = "labelled AS (SELECT c.*, l.quality, l.toxic FROM corpus c LEFT JOIN labels l USING (doc_id))"
EARLIER = """earlier AS (
  SELECT source_path, CASE WHEN quality = 0 THEN content || ' (draft)' ELSE content END AS content
  FROM labelled WHERE quality IS NOT NULL
  UNION ALL SELECT concat('pages/', page_id, '.md'), url FROM pages)"""
CHANGES = """changes AS (
  SELECT coalesce(c.source_path, e.source_path) AS source_path,
    CASE WHEN e.source_path IS NULL THEN 'added' WHEN c.source_path IS NULL THEN 'removed'
         WHEN c.content_hash = sha256(e.content) THEN 'unchanged' ELSE 'updated' END AS change
  FROM corpus c FULL JOIN earlier e ON c.source_path = e.source_path)"""
LIBRARY = """library AS (SELECT *, sha256(content) AS content_hash FROM (SELECT doc_id, source, lang, n_chars, text AS content,
  CASE lang
    WHEN 'en' THEN concat(source, '-reports/2025-', lpad((1 + n_chars % 12)::VARCHAR, 2, '0'), '-item-', doc_id, '.md')
    WHEN 'fr' THEN concat('guides/', source, '/note-', doc_id, '-v', 1 + n_chars % 9, '.markdown')
    WHEN 'de' THEN concat(source, '-', doc_id, '-4.', n_chars % 10, '.md')
    ELSE concat('meeting-notes/2025-', lpad((1 + n_chars % 12)::VARCHAR, 2, '0'), '-',
                lpad((1 + n_chars % 28)::VARCHAR, 2, '0'), '_', doc_id, '.md') END AS source_path
  FROM documents))"""
NAMED = r"""named AS (
  SELECT *, CASE WHEN date_text IS NULL THEN base
                 WHEN length(base) = length(date_text) THEN base
                 ELSE coalesce(nullif(regexp_replace(base[length(date_text) + 1:], '^[-_]', ''), ''), base) END AS subject
  FROM (SELECT *, nullif(regexp_extract(base, '^(\d{4}-\d{2}(?:-\d{2})?)(?:[-_]|$)', 1), '') AS date_text
    FROM (SELECT *, regexp_replace(string_split(source_path, '/')[-1], '\.[^.]+$', '') AS base,
            CASE WHEN contains(source_path, '/') THEN regexp_replace(string_split(source_path, '/')[-2], 's$', '') END AS doc_type
          FROM library)))"""
WHOLE = """whole AS (
  SELECT *, sha256(source_path) AS document_id, sha256(source_path || '#0') AS chunk_id,
    breadcrumb || chr(10) || chr(10) || content AS embedded_text
  FROM (SELECT *, subject || ' [' || concat_ws(' · ', doc_type, date_text, subject) || ']' AS breadcrumb FROM named))"""
QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS question FROM benchmark)"
POSTINGS = f"""postings AS (
  SELECT chunk_id, document_id, doc_type, lexeme, count(*)::INT AS tf,
    {K.LEXEME_WEIGHT} * list_sum(list_transform(range(1, count(*) + 1), lambda j: 1.0::DOUBLE / (j * j))) / {K.INVERSE_SQUARE_LIMIT} AS weight
  FROM (SELECT chunk_id, document_id, doc_type, unnest({LEXEMES.format("breadcrumb || ' ' || content")}) AS lexeme FROM whole)
  GROUP BY ALL)"""
COUNTS = f"""asked_terms AS (SELECT DISTINCT query_id, unnest({LEXEMES.format("question")}) AS term FROM questions),
frequencies AS (SELECT lexeme, count(DISTINCT document_id) AS documents FROM postings GROUP BY lexeme),
counts AS (SELECT query_id, term, coalesce(documents, 0) AS documents, (SELECT count(*) FROM library) AS total_documents
  FROM asked_terms LEFT JOIN frequencies ON term = lexeme)"""
FIRST_TERM = TERMS.format(r"regexp_extract(p, '^[^\p{{L}}\p{{N}}]*(.*?)[^\p{{L}}\p{{N}}]*$', 1)".replace("{{", "{").replace("}}", "}")) + "[1]"
REWRITE = rf"""common AS (
  SELECT query_id, list_sort(list(term)) AS terms FROM counts WHERE documents > total_documents * 0.5 GROUP BY query_id),
judged AS (
  SELECT q.query_id, question,
    CASE WHEN len(list_filter({TERMS.format("question")}, lambda w: NOT list_contains(coalesce(terms, []), w))) > 0
         THEN coalesce(terms, []) ELSE [] END AS dropped
  FROM questions q LEFT JOIN common USING (query_id)),
rewritten AS (
  SELECT query_id, question, dropped, CASE WHEN len(dropped) = 0 THEN question ELSE
    {TRIM.format(r"regexp_replace(regexp_replace(array_to_string(list_transform(regexp_extract_all(question, '\s+|\S+'), lambda p: CASE WHEN list_contains(dropped, " + FIRST_TERM + r") THEN regexp_replace(p, '^([^\p{L}\p{N}]*).*?([^\p{L}\p{N}]*)$', '\1\2') ELSE p END), ''), '\s{2,}', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g')")}
    END AS vector_text FROM judged)"""


def hashed(name: str, table: str, key: str, column: str, dimensions: int = 64) -> str:
    """CTEs with the sparse hashed words and their length: ``name(key, place, w)`` and ``name_norm``."""
    return f"""{name}_tokens AS (
  SELECT {key}, token, count(*) AS n FROM (SELECT {key}, unnest({EMBEDDED_TOKENS.format(column)}) AS token FROM {table}) GROUP BY ALL),
{name}_codes AS (SELECT token, {FNV.format("token")} AS h FROM (SELECT DISTINCT token FROM {name}_tokens)),
{name} AS (
  SELECT {key}, (h % {dimensions})::INT AS place, sum(CASE WHEN (h >> 16) % 2 = 0 THEN n ELSE -n END)::DOUBLE AS w
  FROM {name}_tokens JOIN {name}_codes USING (token) GROUP BY ALL),
{name}_norm AS (SELECT {key}, sqrt(sum(w * w)) AS norm FROM {name} GROUP BY ALL HAVING sum(w * w) > 0)"""


def vector_arm(questions: str, column: str, filtered: bool = False) -> str:
    kind = "AND k.doc_type = a.doc_type" if filtered else ""
    return (
        hashed("cv", "whole", "chunk_id", "embedded_text") + ",\n" + hashed("qv", questions, "query_id", column) + f""",
dots AS (SELECT query_id, chunk_id, sum(c.w * q.w) AS dot FROM cv c JOIN qv q USING (place) GROUP BY ALL),
vector_hits AS (
  SELECT * FROM (
    SELECT query_id, chunk_id, raw_score, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, chunk_id) AS rank
    FROM (SELECT a.query_id, k.chunk_id, round(coalesce(dot, 0) / qn.norm / cn.norm, 9) AS raw_score
      FROM {questions} a JOIN qv_norm qn USING (query_id) CROSS JOIN whole k JOIN cv_norm cn USING (chunk_id)
      LEFT JOIN dots d ON d.query_id = a.query_id AND d.chunk_id = k.chunk_id
      WHERE true {kind})) WHERE rank <= 20)"""
    )


def keyword_arm(filtered: bool = False) -> str:
    kind = "AND p.doc_type = q.doc_type" if filtered else ""
    return f"""wanted AS (
  SELECT * EXCLUDE lexemes, len(lexemes) AS n, unnest(lexemes) AS lexeme
  FROM (SELECT * EXCLUDE question, list_distinct({LEXEMES.format("question")}) AS lexemes FROM asked)),
keyword_hits AS (
  SELECT * FROM (
    SELECT query_id, chunk_id, raw_score, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, chunk_id) AS rank
    FROM (SELECT query_id, chunk_id, round(sum(weight / n), 9) AS raw_score
      FROM postings p JOIN wanted q USING (lexeme) WHERE true {kind} GROUP BY ALL) WHERE raw_score > 0) WHERE rank <= 20)"""


ASKED = "asked AS (SELECT * FROM questions)"
FUSED = f"""joined_arms AS (
  SELECT query_id, chunk_id, v.rank AS vector_rank, k.rank AS keyword_rank,
    coalesce(1.0::DOUBLE / (v.rank + {K.RRF_K}), 0) + coalesce(1.0::DOUBLE / (k.rank + {K.RRF_K}), 0) AS score
  FROM vector_hits v FULL JOIN keyword_hits k USING (query_id, chunk_id)),
fused AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST, chunk_id) AS pos
  FROM joined_arms)"""
LIBRARY_CHUNKS = (LIBRARY, NAMED, WHOLE)
RETRIEVAL = (
    *LIBRARY_CHUNKS, QUESTIONS, POSTINGS, COUNTS, REWRITE, vector_arm("rewritten", "vector_text"), ASKED, keyword_arm(), FUSED,
)
PASSAGES = "passages AS MATERIALIZED (SELECT f.*, w.* EXCLUDE (chunk_id, base) FROM fused f JOIN whole w USING (chunk_id))"


def suppressed(limit: int | None = None, questions: str = "") -> str:
    """Keep-first suppression in rank order: CTE ``sources`` with ``source_no``."""
    bound = f"WHERE pos <= {limit}" if limit else ""
    return f"""worded AS MATERIALIZED (SELECT query_id, pos, chunk_id, {DISTINCT_WORDS.format("content")} AS words FROM passages {bound} {questions}),
word_items AS (SELECT query_id, pos, len(words) AS n, unnest(words) AS word FROM worded),
repeats AS MATERIALIZED (
  SELECT a.query_id, a.pos AS earlier, b.pos AS later FROM word_items a
  JOIN word_items b ON a.query_id = b.query_id AND a.word = b.word AND a.pos < b.pos
  GROUP BY a.query_id, a.pos, b.pos, a.n, b.n HAVING count(*) / least(a.n, b.n)::DOUBLE >= {K.DUPLICATE_OVERLAP}),
keeping AS (
  SELECT query_id, 0::BIGINT AS pos, []::BIGINT[] AS kept FROM (SELECT DISTINCT query_id FROM worded)
  UNION ALL
  SELECT k.query_id, w.pos, CASE WHEN EXISTS (
      SELECT 1 FROM repeats r WHERE r.query_id = w.query_id AND r.later = w.pos AND list_contains(k.kept, r.earlier))
    THEN k.kept ELSE list_append(k.kept, w.pos) END
  FROM keeping k JOIN worded w ON w.query_id = k.query_id AND w.pos = k.pos + 1),
kept_lists AS (SELECT query_id, arg_max(kept, pos) AS kept FROM keeping GROUP BY query_id),
sources AS MATERIALIZED (
  SELECT p.*, list_position(kept, p.pos)::INT AS source_no FROM passages p JOIN kept_lists USING (query_id)
  WHERE list_contains(kept, p.pos))"""


def extracted(questions: str = "questions") -> str:
    return rf"""lines AS (
  SELECT query_id, source_no, generate_subscripts(parts, 1) AS part, unnest(parts) AS line
  FROM (SELECT query_id, source_no, regexp_split_to_array(
    regexp_replace(content, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') AS parts FROM sources)),
candidate_sentences AS (
  SELECT query_id, source_no, part, {TRIM.format(r"regexp_replace(line, '^[-*]\s*', '')")} AS sentence FROM lines),
keywords AS (SELECT query_id, {CONTENT_WORDS.format("question")} AS words FROM {questions}),
scored AS (
  SELECT * FROM (SELECT c.*, len(list_intersect({CONTENT_WORDS.format("sentence")}, words)) AS score,
    regexp_replace(lower(sentence), '[^A-Za-z0-9_]+', '', 'g') AS sentence_key
    FROM candidate_sentences c JOIN keywords USING (query_id) WHERE length(sentence) > {K.MIN_SENTENCE_CHARS})
  WHERE score >= {K.MIN_SENTENCE_OVERLAP}),
firsts AS (SELECT * FROM scored QUALIFY row_number() OVER (
  PARTITION BY query_id, sentence_key ORDER BY score DESC, source_no, part) = 1),
chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_no, part) AS choice FROM firsts
  QUALIFY choice <= {K.MAX_SENTENCES}),
extracts AS (SELECT query_id, string_agg(concat(sentence, ' [', source_no, ']'), ' ' ORDER BY source_no, choice) AS answer
  FROM chosen GROUP BY query_id),
drafts AS (SELECT query_id, question, coalesce(answer, '{K.NO_ANSWER}') AS answer FROM {questions} LEFT JOIN extracts USING (query_id))"""


# Sources and sinks.

ORACLE["scan_corpus"] = "SELECT doc_id, sha256(text || chr(10)) AS content_hash, length(text) + 1 AS n FROM documents"
ORACLE["table_corpus"] = with_parts(CORPUS) + "SELECT source_path, content_hash FROM corpus"
SUITE = """expected AS (
  SELECT query_id, list_sort(list(DISTINCT source_path)) AS paths FROM questions JOIN library ON contains(content, question) GROUP BY query_id),
suite AS (SELECT query_id, CASE WHEN paths IS NULL THEN 'unanswerable' ELSE 'answerable' END AS type, question,
  coalesce(paths, []) AS expected FROM questions LEFT JOIN expected USING (query_id))"""
ORACLE["load_eval_suite"] = with_parts(LIBRARY, QUESTIONS, SUITE) + (
    "SELECT query_id::VARCHAR AS query_id, type, question, array_to_string(expected, '|') AS expected FROM suite"
)
RUN_STATE = f"""touched AS (
  SELECT change, c.* FROM changes JOIN corpus c USING (source_path) WHERE change IN ('added', 'updated')),
first_run AS (SELECT source_path, sha256(content) AS content_hash FROM earlier WHERE {TOKENS.format("content")} > 0)"""
SNAPSHOT = r"""SELECT source_path, content_hash, 'INDEXED' AS status,
  regexp_replace(string_split(source_path, '/')[-1], '\.[^.]+$', '') AS subject, layer, true AS tokens_agree
FROM (
  SELECT source_path, content_hash, 'run-2' AS layer FROM touched
  UNION ALL SELECT source_path, f.content_hash, 'run-1' FROM first_run f JOIN changes USING (source_path) WHERE change = 'unchanged')"""
ORACLE["write_index"] = with_parts(CORPUS, LABELLED, EARLIER, CHANGES, RUN_STATE) + SNAPSHOT
ORACLE["append_run_log"] = with_parts(CORPUS, LABELLED, EARLIER, CHANGES) + """
SELECT 'run-1' AS run_id, 'COMPLETED' AS status, count(*) AS documents_discovered, count(*) AS documents_added,
  0::BIGINT AS documents_updated, 0::BIGINT AS documents_unchanged, 0::BIGINT AS documents_removed, 0::BIGINT AS documents_failed
FROM earlier
UNION ALL
SELECT 'run-2', 'COMPLETED', count(*) FILTER (change <> 'removed'), count(*) FILTER (change = 'added'),
  count(*) FILTER (change = 'updated'), count(*) FILTER (change = 'unchanged'), count(*) FILTER (change = 'removed'), 0::BIGINT
FROM changes"""
ORACLE["append_events"] = with_parts(CORPUS, LABELLED, EARLIER, CHANGES) + """
SELECT 'run-1' AS run_id, NULL AS source_path, 'DISCOVER' AS phase, 'INFO' AS level,
  concat('discovered ', count(*), ' documents in ') AS message FROM earlier
UNION ALL SELECT 'run-1', source_path, 'PERSIST', 'INFO', 'added' FROM earlier
UNION ALL SELECT 'run-2', NULL, 'DISCOVER', 'INFO', concat('discovered ', count(*), ' documents in ') FROM corpus
UNION ALL SELECT 'run-2', NULL, 'PERSIST', 'INFO', concat('removed ', count(*), ' documents no longer in the corpus')
  FROM changes WHERE change = 'removed' HAVING count(*) > 0
UNION ALL SELECT 'run-2', source_path, 'PERSIST', 'INFO', change FROM changes WHERE change IN ('added', 'updated')"""
ORACLE["append_query_log"] = with_parts(*RETRIEVAL) + """
SELECT query_id, question AS query_text, 'search' AS endpoint, count(chunk_id)::INT AS result_count,
  round(max(score)::FLOAT::DOUBLE, 6) AS top_score, true AS answered,
  coalesce(string_agg(chunk_id, '|' ORDER BY pos), '') AS chunk_ids
FROM questions LEFT JOIN (SELECT * FROM fused WHERE pos <= 6) USING (query_id) GROUP BY ALL"""

# Change detection.

ORACLE["classify_changes"] = with_parts(CORPUS, LABELLED, EARLIER, CHANGES) + "SELECT source_path, change FROM changes"
ORACLE["classify_changes_forced"] = with_parts(CORPUS, LABELLED, EARLIER, CHANGES) + (
    "SELECT CASE change WHEN 'unchanged' THEN 'updated' ELSE change END AS change, count(*) AS documents FROM changes GROUP BY 1"
)
ORACLE["removed_documents"] = with_parts(CORPUS, LABELLED, EARLIER) + (
    "SELECT source_path, source_path NOT IN (SELECT source_path FROM corpus) AS gone FROM earlier"
)
ORACLE["ingestion_summary"] = with_parts(CORPUS, LABELLED, EARLIER, CHANGES) + f"""
, outcomes AS (SELECT CASE WHEN change IN ('added', 'updated') AND toxic = 1 THEN 'failed'
    WHEN change IN ('added', 'updated') AND {TOKENS.format("content")} = 0 THEN 'empty' ELSE change END AS outcome
  FROM changes LEFT JOIN labelled USING (source_path))
SELECT count(*) FILTER (outcome <> 'removed') AS documents_discovered, count(*) FILTER (outcome = 'added') AS documents_added,
  count(*) FILTER (outcome = 'updated') AS documents_updated, count(*) FILTER (outcome IN ('unchanged', 'empty')) AS documents_unchanged,
  count(*) FILTER (outcome = 'removed') AS documents_removed, count(*) FILTER (outcome = 'failed') AS documents_failed,
  count(*) FILTER (outcome IN ('added', 'updated')) AS chunks_written FROM outcomes"""
ORACLE["quarantine_failures"] = with_parts(CORPUS, LABELLED) + f"""
SELECT source_path, CASE WHEN unreadable THEN 'PARSE' WHEN broken THEN 'CHUNK' WHEN tokens > 400 THEN 'EMBED' END AS phase,
  CASE WHEN unreadable THEN 'document has no readable text' WHEN broken THEN 'section without end'
       WHEN tokens > 400 THEN concat('input has ', tokens, ' tokens, over the limit of 400') END AS error
FROM (SELECT source_path, coalesce(toxic, 0) <> 0 AS unreadable, doc_id % 5 = 0 AS broken, {TOKENS.format("content")} AS tokens FROM labelled)"""
ORACLE["empty_document_events"] = with_parts(CORPUS, LABELLED) + f"""
SELECT source_path, 'CHUNK' AS phase, 'WARN' AS level, 'document produced no chunks and was skipped' AS message
FROM labelled WHERE toxic = 1 OR {TOKENS.format("content")} = 0"""

# Corpus preparation.

ORACLE["token_budget_batches"] = f"""
WITH RECURSIVE sized AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS i, tokens FROM (SELECT doc_id, {TOKENS.format("text")} AS tokens FROM documents) WHERE tokens <= 4000),
cut AS (
  SELECT i, 0 AS request_id, 1 AS filled, tokens AS used, tokens FROM sized WHERE i = 1
  UNION ALL
  SELECT s.i, CASE WHEN closes THEN request_id + 1 ELSE request_id END, CASE WHEN closes THEN 1 ELSE filled + 1 END,
    CASE WHEN closes THEN s.tokens ELSE used + s.tokens END, s.tokens
  FROM (SELECT cut.*, n.tokens AS coming, filled >= 32 OR used + n.tokens > 6000 AS closes FROM cut JOIN sized n ON n.i = cut.i + 1) c
  JOIN sized s ON s.i = c.i + 1)
SELECT CAST(request_id AS BIGINT) AS request_id, count(*) AS texts, CAST(sum(tokens) AS BIGINT) AS tokens FROM cut GROUP BY request_id"""

ORACLE["path_metadata"] = with_parts(LIBRARY, NAMED) + "SELECT source_path, doc_type, date_text, subject FROM named"
MARKDOWN = r"""md AS (SELECT *, chr(10) AS nl,
    CASE WHEN lang = 'fr' THEN concat('---\nowner: "', source, '"\nlang: ', lang, '\nlang: ''', lang, '''\n# note\n\n  nested: x\nno pair\n---\n') ELSE '' END AS header,
    CASE WHEN lang = 'es' THEN '' ELSE concat('# Text ', doc_id, ' #\n\nStatus: ', CASE lang WHEN 'de' THEN 'Superseded' ELSE 'open' END, '\n\n## Body\n\n') END AS top,
    CASE WHEN lang = 'de' THEN '\n```sh\n# not a heading\n```\n' ELSE '' END AS fence,
    concat('\n\n### Detail\n\nLength ', n_chars, '\n\n## Sign-off\n\nDone.\n') AS ending
  FROM named),
bodies AS (SELECT *, replace(top, '\n', nl) || replace(content, nl, nl || nl) || replace(fence, '\n', nl) || replace(ending, '\n', nl) AS body FROM md)"""
ORACLE["document_attributes"] = with_parts(LIBRARY, NAMED, MARKDOWN) + r"""
SELECT source_path,
  coalesce(nullif(regexp_extract(subject, '-(\d+(?:\.\d+)+)$', 1), ''), nullif(regexp_extract(subject, '(?i)-v(\d+)$', 1), '')) AS version,
  CASE WHEN contains(opening, 'deprecated') OR contains(opening, 'superseded') THEN 'deprecated'
       WHEN contains(opening, 'current') THEN 'current' END AS lifecycle
FROM (SELECT *, lower(array_to_string(list_filter(string_split(body, nl), lambda l: trim(l) <> '')[1:3], ' ')) AS opening FROM bodies)"""
ORACLE["doc_date"] = with_parts(LIBRARY, NAMED) + r"""
SELECT source_path, TRY_CAST(CASE WHEN length(date_text) = 7 THEN date_text || '-01' ELSE date_text END AS DATE)::VARCHAR AS doc_date FROM named"""
ORACLE["front_matter"] = with_parts(LIBRARY, NAMED, MARKDOWN) + r"""
SELECT doc_id, CASE WHEN lang = 'fr' THEN source END AS owner, CASE WHEN lang = 'fr' THEN lang END AS lang,
  CASE WHEN lang = 'fr' THEN 2 ELSE 0 END AS entries, CASE WHEN lang = 'fr' THEN '  nested: x|no pair' ELSE '' END AS unsupported,
  sha256(body) AS body_hash FROM bodies"""
EDGES = r"regexp_replace({0}, '^(?:[ \t\r\f\v]*\n)+|(?:\n[ \t\r\f\v]*)+$', '', 'g')"
SECTIONS = rf"""parts AS (
  SELECT doc_id, title, place, heading_path, {EDGES.format("content")} AS content FROM (
    SELECT doc_id, CASE WHEN lang = 'es' THEN subject ELSE concat('Text ', doc_id) END AS title, lang, unnest([
      struct_pack(place := 1, heading_path := '', content := CASE lang WHEN 'es' THEN replace(content, nl, nl || nl)
        WHEN 'de' THEN 'Status: Superseded' ELSE 'Status: open' END),
      struct_pack(place := 2, heading_path := 'Body', content := CASE lang WHEN 'es' THEN '' ELSE
        replace(content, nl, nl || nl) || replace(fence, '\n', nl) END),
      struct_pack(place := 3, heading_path := CASE lang WHEN 'es' THEN 'Detail' ELSE 'Body > Detail' END, content := concat('Length ', n_chars)),
      struct_pack(place := 4, heading_path := 'Sign-off', content := 'Done.')], recursive := true)
    FROM bodies)),
sections AS (SELECT doc_id, title, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INT AS section_no, heading_path, content
  FROM parts WHERE trim(content, chr(10) || chr(9) || chr(13) || ' ') <> '')"""
ORACLE["sections"] = with_parts(LIBRARY, NAMED, MARKDOWN, SECTIONS) + (
    "SELECT doc_id, title, section_no, heading_path, sha256(content) AS content_hash FROM sections"
)
ORACLE["section_profile"] = with_parts(LIBRARY, NAMED, MARKDOWN, SECTIONS) + f"""
SELECT depth, count(*) AS sections, min(tokens)::INT AS min_tokens, quantile_cont(tokens, 0.5)::DOUBLE AS p50_tokens, max(tokens)::INT AS max_tokens
FROM (SELECT CASE WHEN heading_path = '' THEN 0 ELSE len(string_split(heading_path, ' > ')) END::INT AS depth, {TOKENS.format("content")} AS tokens
  FROM sections) GROUP BY depth"""
ORACLE["corpus_profile"] = with_parts(LIBRARY, NAMED, MARKDOWN) + rf"""
SELECT doc_type, count(*) AS documents, min(tokens)::INT AS min_tokens, quantile_cont(tokens, 0.5)::DOUBLE AS p50_tokens,
  quantile_cont(tokens, 0.9)::DOUBLE AS p90_tokens, max(tokens)::INT AS max_tokens, round(avg(tokens), 6) AS mean_tokens,
  sum(headings)::BIGINT AS headings, sum(second)::BIGINT AS second_level_headings, sum(fences)::BIGINT AS fence_lines,
  count(*) FILTER (lang = 'fr') AS with_front_matter
FROM (SELECT *, {TOKENS.format("body")} AS tokens, len(regexp_extract_all(body, '(?m)^#{{1,6}}\s+\S')) AS headings,
  len(regexp_extract_all(body, '(?m)^#{{2}}\s+\S')) AS second,
  len(regexp_extract_all(body, '(?m)^\s*(`{{3,}}|~{{3,}})')) AS fences FROM bodies) GROUP BY doc_type"""
# A group ends after at most as many units as the budget has tokens, so the first unit beyond it is near.
CHUNKS = rf"""heads AS (
  SELECT source_path, head, {TOKENS.format("head")} AS head_tokens, greatest({K.CHUNK_BUDGET} - {TOKENS.format("head")}, {K.CHUNK_BUDGET // 4}) AS budget,
    {EDGES.format("content")} AS content
  FROM (SELECT *, subject || ' [' || concat_ws(' · ', doc_type, date_text, subject) || ']' AS head FROM named)),
texts AS (SELECT *, {TOKENS.format("content")} AS tokens FROM heads),
units AS MATERIALIZED (
  SELECT source_path, i, unit, size, budget, sum(size) OVER (PARTITION BY source_path ORDER BY i)::BIGINT AS total FROM (
    SELECT source_path, budget, unnest(list) AS unit, generate_subscripts(list, 1) AS i, {TOKENS.format("unnest(list)")} AS size FROM (
      SELECT source_path, budget, CASE WHEN tokens <= budget THEN [content] ELSE list_filter(list_transform(string_split(
        regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda u: {TRIM.format("u")}), lambda u: u <> '') END AS list
      FROM texts WHERE tokens > 0))),
unit_next AS MATERIALIZED (
  SELECT a.source_path, a.i, greatest(a.i + 1, coalesce(min(b.i), a.last + 1)) AS next, a.last
  FROM (SELECT *, max(i) OVER (PARTITION BY source_path) AS last FROM units) a
  LEFT JOIN units b ON b.source_path = a.source_path AND b.total > a.total - a.size + a.budget AND b.i > a.i AND b.i <= a.i + {K.CHUNK_BUDGET + 1}
  GROUP BY a.source_path, a.i, a.last),
group_starts AS (
  SELECT source_path, 1::BIGINT AS g, 1::BIGINT AS s FROM unit_next WHERE i = 1
  UNION ALL SELECT r.source_path, g + 1, n.next FROM group_starts r JOIN unit_next n ON n.source_path = r.source_path AND n.i = r.s WHERE n.next <= n.last),
group_ranges AS (SELECT r.source_path, g, s, next - 1 AS e FROM group_starts r JOIN unit_next n ON n.source_path = r.source_path AND n.i = r.s),
group_texts AS (
  SELECT source_path, g, string_agg(unit, chr(10) || chr(10) ORDER BY i) AS body,
    string_agg(unit, ' ' ORDER BY i) FILTER (end_total - total + size <= {K.CHUNK_OVERLAP}) AS tail
  FROM (SELECT r.source_path, r.g, u.*, max(total) OVER (PARTITION BY r.source_path, r.g) AS end_total
    FROM group_ranges r JOIN units u ON u.source_path = r.source_path AND u.i BETWEEN s AND e) GROUP BY ALL),
pieces AS MATERIALIZED (
  SELECT source_path, g AS i, text, size, sum(size) OVER (PARTITION BY source_path ORDER BY g)::BIGINT AS total, max(g) OVER (PARTITION BY source_path) AS last
  FROM (SELECT t.source_path, t.g, CASE WHEN p.tail IS NULL THEN t.body ELSE p.tail || chr(10) || chr(10) || t.body END AS text,
      {TOKENS.format("CASE WHEN p.tail IS NULL THEN t.body ELSE p.tail || ' ' || t.body END")} AS size
    FROM group_texts t LEFT JOIN group_texts p ON p.source_path = t.source_path AND p.g = t.g - 1)),
piece_next AS MATERIALIZED (
  SELECT a.source_path, a.i, greatest(a.i + 1, coalesce(min(b.i), a.last + 1)) AS next, a.last
  FROM pieces a JOIN heads h USING (source_path)
  LEFT JOIN pieces b ON b.source_path = a.source_path AND b.total > a.total - a.size + h.budget AND b.i > a.i
  GROUP BY a.source_path, a.i, a.last),
merge_starts AS (
  SELECT source_path, 1::BIGINT AS g, 1::BIGINT AS s FROM piece_next WHERE i = 1
  UNION ALL SELECT r.source_path, g + 1, n.next FROM merge_starts r JOIN piece_next n ON n.source_path = r.source_path AND n.i = r.s WHERE n.next <= n.last),
merged AS (
  SELECT r.source_path, r.g, string_agg(text, chr(10) || chr(10) ORDER BY p.i) AS text, sum(size) AS size
  FROM merge_starts r JOIN piece_next n ON n.source_path = r.source_path AND n.i = r.s
  JOIN pieces p ON p.source_path = r.source_path AND p.i BETWEEN r.s AND n.next - 1 GROUP BY ALL),
runs AS (SELECT *, sum(CASE WHEN g = 1 OR size >= {K.CHUNK_MINIMUM} THEN 1 ELSE 0 END) OVER (PARTITION BY source_path ORDER BY g)::BIGINT AS run FROM merged),
absorbed AS (SELECT source_path, run, string_agg(text, chr(10) || chr(10) ORDER BY g) AS text, sum(size) AS size FROM runs GROUP BY ALL),
final_runs AS (SELECT *, CASE WHEN run = 2 AND first_value(size) OVER (PARTITION BY source_path ORDER BY run) < {K.CHUNK_MINIMUM} THEN 1 ELSE run END AS chunk FROM absorbed),
chunks AS (SELECT source_path, (row_number() OVER (PARTITION BY source_path ORDER BY chunk) - 1)::INT AS ordinal,
    string_agg(text, chr(10) || chr(10) ORDER BY run) AS content, sum(size) AS size FROM final_runs GROUP BY source_path, chunk)"""
ORACLE["chunk_corpus"] = with_parts(LIBRARY, NAMED, CHUNKS) + """
SELECT source_path, ordinal, (head_tokens + size)::INT AS token_count, sha256(c.content) AS content_hash FROM chunks c JOIN heads USING (source_path)"""
ORACLE["chunk_coverage"] = with_parts(LIBRARY, NAMED, MARKDOWN, SECTIONS) + f"""
SELECT source_path, true AS dense, count(DISTINCT word) AS distinct_words
FROM (SELECT doc_id, unnest({WORDS.format("title || ' ' || heading_path || ' ' || content")}) AS word FROM sections) JOIN bodies USING (doc_id)
WHERE word <> '' GROUP BY source_path"""
ORACLE["breadcrumbs"] = with_parts(*LIBRARY_CHUNKS) + "SELECT source_path, breadcrumb, sha256(embedded_text) AS embedded_hash FROM whole"
ORACLE["token_counts"] = with_parts(*LIBRARY_CHUNKS) + f"""
SELECT source_path, 1::BIGINT AS chunks, {TOKENS.format("embedded_text")}::BIGINT AS token_count FROM whole"""
SECRETS = """secrets AS (
  SELECT source_path, source, content || CASE WHEN toxic = 1 THEN ' key sk-' || sha256(source_path) ELSE '' END
    || CASE WHEN quality = 0 THEN ' bearer ' || sha256(content) ELSE '' END AS content FROM labelled)"""
KEYS = r"\b(?:sk|pk|rk)-[A-Za-z0-9._*-]{8,}"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._*-]{8,}"
HITS = f"len(regexp_extract_all(content, '{KEYS}')) + len(regexp_extract_all(content, '{BEARER}'))"
ORACLE["redact_secrets"] = with_parts(CORPUS, LABELLED, SECRETS) + rf"""
SELECT source_path, ({HITS})::BIGINT AS secrets, sha256(regexp_replace(regexp_replace(content,
  '\b(sk|pk|rk)-[A-Za-z0-9._*-]{{8,}}', '\1-<redacted>', 'g'), '{BEARER}', 'Bearer <redacted>', 'g')) AS content_hash FROM secrets"""
ORACLE["secret_hits"] = with_parts(CORPUS, LABELLED, SECRETS) + f"""
SELECT source, count(*) AS documents, count(*) FILTER (hits > 0) AS documents_with_secrets, sum(hits)::BIGINT AS secrets
FROM (SELECT source, {HITS} AS hits FROM secrets) GROUP BY source"""
LINES = """lines AS (SELECT source, line, count(*) AS n FROM (
  SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY ALL)"""
ORACLE["line_duplication"] = with_parts(LINES) + (
    "SELECT source, sum(n)::BIGINT AS total_lines, count(*) AS distinct_lines, max(n) AS top_repeats FROM lines GROUP BY source"
)
ORACLE["repeated_lines"] = with_parts(LINES) + (
    "SELECT line, sum(n)::BIGINT AS n FROM lines GROUP BY line ORDER BY n DESC, line LIMIT 20"
)

# Embeddings.

ORACLE["hash_embedding"] = with_parts(hashed("dv", "documents", "doc_id", "text")) + """
SELECT doc_id, place::INT AS place, round(coalesce(w / norm, 0), 6) AS value
FROM (SELECT doc_id, unnest(range(64)) AS place FROM documents) LEFT JOIN dv USING (doc_id, place) LEFT JOIN dv_norm USING (doc_id)"""
ORACLE["embed_with_provider"] = with_parts(*LIBRARY_CHUNKS, hashed("dv", "whole", "source_path", "embedded_text", 16)) + """
SELECT source_path, 16 AS width, place::INT AS place, round(coalesce(w / norm, 0), 6) AS value
FROM whole CROSS JOIN (SELECT unnest(range(16)) AS place) LEFT JOIN dv USING (source_path, place) LEFT JOIN dv_norm USING (source_path)"""
ORACLE["l2_normalise"] = """
SELECT vec_id, (place - 1)::INT AS place, round(CASE WHEN norm = 0 THEN value ELSE value / norm END, 6) AS value
FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) AS place,
  sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS norm FROM embeddings)"""
ORACLE["missing_embeddings"] = """
SELECT count(*) AS chunks, count(*) FILTER (vec_id IS NULL) AS chunks_missing_embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id"""

# Retrieval.

ORACLE["split_terms"] = f"""
SELECT concat(conv_id, '-', turn) AS query_id, array_to_string({TERMS.format("text")}, '|') AS terms FROM conversations"""
ORACLE["keyword_query"] = f"""
SELECT item_id AS query_id, array_to_string({TERMS.format("text")}, ' or ') AS keyword_query FROM benchmark"""
ORACLE["vector_topk"] = """
SELECT query_id, chunk_id, round(raw_score, 6) AS raw_score, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, chunk_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
      round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS raw_score
    FROM embeddings q CROSS JOIN embeddings c)) WHERE rank <= 20"""
CELLS = """centres AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY place, vec_id) - 1 AS cell, v, sqrt(list_inner_product(v, v)) AS norm FROM (
    SELECT vec_id, embedding::DOUBLE[] AS v, (vec_id * 7919) % 104729 AS place FROM embeddings
    WHERE list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 ORDER BY place, vec_id LIMIT 32)),
near AS MATERIALIZED (
  SELECT vec_id, cell, row_number() OVER (
    PARTITION BY vec_id ORDER BY round(list_inner_product(embedding::DOUBLE[], v) / norm, 9) DESC, cell) AS place
  FROM embeddings CROSS JOIN centres),
probed AS MATERIALIZED (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id FROM near q JOIN near c ON q.cell = c.cell AND q.place <= 24 AND c.place = 1),
approximate AS MATERIALIZED (SELECT query_id, chunk_id, round(raw_score, 6) AS raw_score, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS raw_score
    FROM probed JOIN embeddings q ON q.vec_id = query_id JOIN embeddings c ON c.vec_id = chunk_id)) WHERE rank <= 20)"""
ORACLE["vector_topk_ann"] = with_parts(CELLS) + "SELECT * FROM approximate"
ORACLE["vector_ann_recall"] = with_parts(CELLS, f"exact AS ({ORACLE['vector_topk']})") + """
SELECT count(*) AS exact_hits, count(a.chunk_id) AS found_hits, round(count(a.chunk_id) / count(*), 6) AS recall
FROM exact LEFT JOIN approximate a USING (query_id, chunk_id)"""
ORACLE["vector_topk_grid"] = ORACLE["vector_topk"]
ORACLE["build_postings"] = with_parts(*LIBRARY_CHUNKS, POSTINGS) + (
    "SELECT lexeme, chunk_id, document_id, tf, round(weight, 6) AS weight FROM postings"
)
ORACLE["keyword_topk"] = with_parts(*LIBRARY_CHUNKS, QUESTIONS, POSTINGS, ASKED, keyword_arm()) + (
    "SELECT query_id, chunk_id, round(raw_score, 6) AS raw_score, rank::INT AS rank FROM keyword_hits"
)
ORACLE["keyword_topk_joined"] = ORACLE["keyword_topk"]
ORACLE["keyword_topk_stored"] = ORACLE["keyword_topk"]
TYPED = "typed AS (SELECT *, concat('src', query_id % 20, '-report') AS doc_type FROM questions), asked AS (SELECT * FROM typed)"
ORACLE["doc_type_filter"] = with_parts(
    *LIBRARY_CHUNKS, QUESTIONS, POSTINGS, TYPED, vector_arm("typed", "question", True), keyword_arm(True)
) + """SELECT 'vector' AS arm, query_id, chunk_id, rank::INT AS rank FROM vector_hits
UNION ALL SELECT 'keyword', query_id, chunk_id, rank::INT FROM keyword_hits"""
ORACLE["term_document_counts"] = with_parts(*LIBRARY_CHUNKS, QUESTIONS, POSTINGS, COUNTS) + "SELECT * FROM counts"
ORACLE["rewrite_query"] = with_parts(*LIBRARY_CHUNKS, QUESTIONS, POSTINGS, COUNTS, REWRITE) + (
    "SELECT query_id, vector_text, array_to_string(dropped, '|') AS dropped_terms FROM rewritten"
)
ORACLE["rrf_fusion"] = with_parts(*RETRIEVAL) + """
SELECT query_id, chunk_id, pos::INT AS pos, vector_rank::INT AS vector_rank, keyword_rank::INT AS keyword_rank, round(score, 6) AS score FROM fused"""
ORACLE["hybrid_search"] = with_parts(*RETRIEVAL, PASSAGES) + """
SELECT query_id, pos::INT AS pos, source_path, doc_type, breadcrumb, vector_rank::INT AS vector_rank, keyword_rank::INT AS keyword_rank,
  round(score, 6) AS score FROM passages WHERE pos <= 6"""
ORACLE["hybrid_search_stored"] = ORACLE["hybrid_search"]
ORACLE["passage_join"] = with_parts(*RETRIEVAL, PASSAGES) + """
SELECT query_id, pos::INT AS pos, chunk_id, document_id, subject AS title, source_path, doc_type, 0 AS ordinal, content_hash FROM passages"""
# Separators are doubled, so that neighbouring matches do not share one; each match then takes one on either side.
ORACLE["explain_matches"] = with_parts(*RETRIEVAL, PASSAGES, rf"""
ordered AS (SELECT query_id, string_agg(regexp_replace(term, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g') || '{K.INFLECTIONS}', '|'
  ORDER BY -length(term), term) AS body FROM (SELECT DISTINCT query_id, unnest(list_filter({TERMS.format("question")},
  lambda t: length(t) >= {K.MIN_HIGHLIGHT_CHARS})) AS term FROM questions) GROUP BY query_id),
marked AS (SELECT query_id, chunk_id, content, CASE WHEN body IS NULL THEN 0 ELSE len(regexp_extract_all(
  regexp_replace(content, '([^\p{{L}}\p{{N}}])', '\1\1', 'g'),
  '(?i)(?:^|[^\p{{L}}\p{{N}}])(' || body || ')(?:[^\p{{L}}\p{{N}}]|$)', 1)) END AS marks
  FROM passages LEFT JOIN ordered USING (query_id))""") + """
SELECT query_id, chunk_id, marks::INT AS marks, marks = 0 AS semantic_only, (length(content) + 13 * marks)::INT AS marked_chars FROM marked"""
ORACLE["top_k_bounds"] = """
SELECT conv_id, turn, top_k, length(question)::INT AS chars,
  CASE WHEN length(question) < 1 THEN 'question is empty' WHEN length(question) > 500 THEN 'question is longer than 500 characters'
       WHEN top_k NOT BETWEEN 1 AND 20 THEN 'top_k is not within 1..20' END AS problem
FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS question, (turn * 5 + conv_id % 3)::INT AS top_k FROM conversations)"""

# Answers.

FLOOR = 1 / (K.RRF_K + 1) + 1 / (K.RRF_K + K.CANDIDATES)
ORACLE["score_floor"] = with_parts(*RETRIEVAL) + f"""
SELECT query_id, round(max(score), 6) AS top_score, CASE WHEN coalesce(max(score), 0) < {FLOOR!r} THEN 'NO_RELEVANT_CONTEXT' END AS abstain_reason
FROM questions LEFT JOIN fused USING (query_id) GROUP BY query_id"""
ORACLE["near_duplicate_suppression"] = with_parts(*RETRIEVAL, PASSAGES, suppressed()) + (
    "SELECT query_id, chunk_id, pos::INT AS pos, source_no FROM sources"
)
ORACLE["corpus_near_duplicates"] = with_parts(LIBRARY) + f"""
, sets AS (SELECT sha256(source_path) AS document_id, {DISTINCT_WORDS.format("content")} AS words FROM library),
items AS (SELECT document_id, len(words) AS n, unnest(words) AS word FROM sets),
pairs AS (SELECT a.document_id AS earlier, b.document_id AS later FROM items a JOIN items b ON a.word = b.word AND a.document_id < b.document_id
  GROUP BY a.document_id, b.document_id, a.n, b.n HAVING count(*) / least(a.n, b.n)::DOUBLE >= {K.DUPLICATE_OVERLAP})
SELECT document_id, min(earlier) AS repeat_of FROM sets LEFT JOIN pairs ON later = document_id GROUP BY document_id"""
ORACLE["prompt_table"] = with_parts(*RETRIEVAL, PASSAGES, suppressed()) + """
, prompts AS (SELECT query_id, 'SOURCES' || chr(10) || coalesce(string_agg(concat('[', source_no, '] ', breadcrumb, chr(10), content),
    chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY source_no), '') || chr(10) || chr(10) || 'QUESTION' || chr(10) || question AS user_prompt
  FROM questions LEFT JOIN sources USING (query_id) GROUP BY query_id, question)
SELECT query_id, sha256(user_prompt) AS prompt_hash, length(user_prompt)::INT AS chars FROM prompts"""
ORACLE["extractive_answers"] = with_parts(*RETRIEVAL, PASSAGES, suppressed(), extracted()) + "SELECT query_id, answer FROM drafts"
MARKED = """marked AS (SELECT conv_id * 1000 + turn AS query_id, CASE conv_id % 6
    WHEN 0 THEN text || ' [1] , [7] and [1][2].  ' WHEN 1 THEN '[0] ' || text || ' [01] [123]  '
    WHEN 2 THEN '```text' || chr(10) || '**NO_ANSWER**.' || chr(10) || '```' WHEN 3 THEN 'NO_ANSWER since ' || text
    WHEN 4 THEN text || ' [2]  [x] [1234]  ' ELSE ' no answer ' END AS answer FROM conversations)"""
ABSTAINS = r"upper(regexp_replace(regexp_replace({0}, '(?i)^```[a-z]*\s*|\s*```$', '', 'g'), '[.*_`\s]', '', 'g')) = 'NOANSWER'"
ORACLE["detect_abstention"] = with_parts(MARKED) + f"SELECT query_id, {ABSTAINS.format(TRIM.format('answer'))} AS declined FROM marked"
ORACLE["validate_citations"] = with_parts(MARKED) + r"""
, marks AS (SELECT query_id, marker, min(place) AS place FROM (
    SELECT query_id, unnest(found)::INT AS marker, generate_subscripts(found, 1) AS place
    FROM (SELECT query_id, regexp_extract_all(answer, '\[(\d{1,3})\]', 1) AS found FROM marked)) GROUP BY ALL),
known AS (SELECT query_id, string_agg(concat(marker, ':', marker - 1, ':', query_id, '-', marker), '|' ORDER BY place) AS citations
  FROM marks WHERE marker IN (1, 2) GROUP BY query_id),
unknown AS (SELECT query_id, string_agg(marker::VARCHAR, '|' ORDER BY marker) AS dropped FROM marks WHERE marker NOT IN (1, 2) GROUP BY query_id)
SELECT query_id, coalesce(citations, '') AS citations, coalesce(dropped, '') AS dropped_markers,
  CASE WHEN dropped IS NULL THEN answer ELSE regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(answer, '\[0{0,2}(?:' || dropped || ')\]', '', 'g'), '[ \t]+([.,;:!?])', '\1', 'g'), '[ \t]{2,}', ' ', 'g'), '\s+$', '') END AS text
FROM marked LEFT JOIN known USING (query_id) LEFT JOIN unknown USING (query_id)"""
ANSWERABLE = f"""floored AS (SELECT q.query_id, question, max(score) AS top_score FROM questions q LEFT JOIN passages p ON p.query_id = q.query_id AND pos <= 6
  GROUP BY ALL), open_questions AS (SELECT query_id, question FROM floored WHERE top_score >= {FLOOR!r})"""
ANSWERS = (
    *RETRIEVAL, PASSAGES, ANSWERABLE,
    suppressed(6, "AND query_id IN (SELECT query_id FROM open_questions)"), extracted("open_questions"),
    rf"""raw_marks AS (SELECT query_id, regexp_extract_all(answer, '\[(\d{{1,3}})\]', 1) AS found FROM drafts),
marks AS (SELECT query_id, marker, min(place) AS place FROM (
  SELECT query_id, unnest(found)::INT AS marker, generate_subscripts(found, 1) AS place FROM raw_marks) GROUP BY ALL),
cited AS (SELECT query_id, string_agg(concat(marker, ':', chunk_id), '|' ORDER BY place) AS citations
  FROM marks m JOIN sources s USING (query_id) WHERE s.source_no = m.marker GROUP BY query_id),
listed AS (SELECT query_id, string_agg(chunk_id, '|' ORDER BY place) AS sources FROM (
  SELECT query_id, chunk_id, source_no AS place FROM sources
  UNION ALL SELECT query_id, chunk_id, pos FROM passages WHERE pos <= 6 AND query_id NOT IN (SELECT query_id FROM open_questions)) GROUP BY query_id),
answers AS (SELECT f.query_id, coalesce(answer <> '{K.NO_ANSWER}', false) AS answered,
  CASE WHEN answer <> '{K.NO_ANSWER}' THEN answer ELSE '{K.ABSTENTION_TEXT}' END AS text,
  CASE WHEN answer IS NULL THEN 'NO_RELEVANT_CONTEXT' WHEN answer = '{K.NO_ANSWER}' THEN 'MODEL_DECLINED' END AS abstain_reason
  FROM floored f LEFT JOIN drafts d ON d.query_id = f.query_id)""",
)
ORACLE["answer_batch"] = with_parts(*ANSWERS) + """
SELECT query_id, answered, text, coalesce(citations, '') AS citations, sources, abstain_reason
FROM answers LEFT JOIN cited USING (query_id) LEFT JOIN listed USING (query_id)"""

WRITTEN = """written AS (
  SELECT 'search' AS endpoint, query_id, true AS answered, count(chunk_id) AS result_count, query_id % 40 AS embed_ms,
    query_id % 90 AS retrieve_ms, NULL::BIGINT AS generate_ms
  FROM questions LEFT JOIN (SELECT * FROM fused WHERE pos <= 6) USING (query_id) GROUP BY ALL
  UNION ALL
  SELECT 'answer', query_id, answered, CASE WHEN coalesce(sources, '') = '' THEN 0 ELSE 1 END, query_id % 40, query_id % 90,
    CASE WHEN answered THEN query_id % 700 END
  FROM answers LEFT JOIN listed USING (query_id)),
timed AS (SELECT *, embed_ms + retrieve_ms + coalesce(generate_ms, 0) AS total_ms FROM written)"""
ORACLE["append_answer_log"] = with_parts(*ANSWERS) + """
SELECT query_id, question AS query_text, answered, coalesce(sources, '') AS chunk_ids, (query_id % 40)::INT AS embed_ms, (query_id % 90)::INT AS retrieve_ms,
  CASE WHEN answered THEN query_id % 700 END::INT AS generate_ms,
  (query_id % 40 + query_id % 90 + CASE WHEN answered THEN query_id % 700 ELSE 0 END)::INT AS total_ms
FROM answers JOIN questions USING (query_id) LEFT JOIN listed USING (query_id)"""
ORACLE["written_log_stats"] = with_parts(*ANSWERS, WRITTEN) + """
SELECT count(*) AS total, count(*) FILTER (endpoint = 'search') AS searches, count(*) FILTER (endpoint = 'answer') AS answers,
  round_even(quantile_cont(total_ms, 0.5), 0)::INT AS p50_total_ms, round_even(quantile_cont(total_ms, 0.95), 0)::INT AS p95_total_ms,
  count(*) FILTER (result_count = 0) AS zero_result_count,
  round(count(*) FILTER (endpoint = 'answer' AND NOT answered) / nullif(count(*) FILTER (endpoint = 'answer'), 0)::DOUBLE, 6) AS abstain_rate
FROM timed"""
ORACLE["written_log_latency"] = with_parts(*ANSWERS, WRITTEN) + "SELECT endpoint, " + ", ".join(
    f"round(quantile_cont({stage}_ms, {share}), 6) AS {stage}_p{int(share * 100)}"
    for stage in ("embed", "retrieve", "generate", "total") for share in (0.5, 0.95)
) + " FROM timed GROUP BY endpoint"

# Evaluation.

OUTCOMES = """hits AS (
  SELECT mode, query_id, source_path, min(pos) AS pos FROM (
    SELECT 'hybrid' AS mode, query_id, chunk_id, pos FROM fused
    UNION ALL SELECT 'vector', query_id, chunk_id, rank FROM vector_hits
    UNION ALL SELECT 'keyword', query_id, chunk_id, rank FROM keyword_hits) JOIN whole USING (chunk_id) WHERE pos <= 6 GROUP BY ALL),
outcomes AS (
  SELECT mode, s.query_id, len(expected) AS expected, count(source_path) AS found, min(pos) AS first_rank
  FROM suite s CROSS JOIN (SELECT unnest(['hybrid', 'vector', 'keyword']) AS mode)
  LEFT JOIN hits h ON h.query_id = s.query_id AND h.mode = mode AND list_contains(expected, source_path)
  WHERE type = 'answerable' GROUP BY ALL)""".replace("h.mode = mode", "h.mode = m.mode").replace("AS mode)\n  LEFT", "AS mode) m\n  LEFT").replace("SELECT mode, s.query_id", "SELECT m.mode, s.query_id")
EVALUATION = (*RETRIEVAL, SUITE, OUTCOMES)
ORACLE["recall_at_k"] = with_parts(*EVALUATION) + (
    "SELECT mode, round(sum(found) / nullif(sum(expected), 0)::DOUBLE, 6) AS recall FROM outcomes GROUP BY mode"
)
ORACLE["first_expected_rank"] = with_parts(*EVALUATION) + "SELECT mode, query_id, first_rank::INT AS first_rank FROM outcomes"
ORACLE["mean_reciprocal_rank"] = with_parts(*EVALUATION) + (
    "SELECT mode, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr FROM outcomes GROUP BY mode"
)
ORACLE["full_hit_rate"] = with_parts(*EVALUATION) + (
    "SELECT mode, round(avg(CASE WHEN found = expected THEN 1.0 ELSE 0.0 END), 6) AS full_hit_rate FROM outcomes GROUP BY mode"
)
ORACLE["compare_modes"] = with_parts(*EVALUATION) + """
SELECT mode, round(sum(found) / nullif(sum(expected), 0)::DOUBLE, 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr,
  round(avg(CASE WHEN found = expected THEN 1.0 ELSE 0.0 END), 6) AS full_hit_rate, count(*) AS queries FROM outcomes GROUP BY mode"""
ORACLE["abstention_accuracy"] = with_parts(*ANSWERS, SUITE) + """
SELECT count(*) FILTER (type = 'unanswerable' AND NOT answered) AS correct_refusals, count(*) FILTER (type = 'unanswerable') AS unanswerable,
  count(*) FILTER (type = 'answerable' AND NOT answered) AS false_refusals, count(*) FILTER (type = 'answerable') AS answerable,
  count(*) FILTER (type = 'unanswerable' AND answered) AS answered_anyway
FROM suite JOIN answers USING (query_id)"""

# Statistics.

LOG = """log AS (
  SELECT *, CASE WHEN answer AND NOT floored THEN total_ms - embed_ms - retrieve_ms END AS generate_ms FROM (
    SELECT *, least(total_ms - embed_ms, 50) AS retrieve_ms FROM (
      SELECT event_id AS query_id, props AS query_text, event_type IN ('purchase', 'error') AS answer,
        CASE WHEN event_type IN ('purchase', 'error') THEN 'answer' ELSE 'search' END AS endpoint,
        trunc(value * 10)::INT AS total_ms, least(trunc(value * 10)::INT, 200) AS embed_ms,
        event_type IN ('purchase', 'error') AND event_id % 5 = 0 AS floored,
        CASE WHEN event_id % 17 = 0 THEN 0 ELSE 6 END AS result_count,
        CASE WHEN event_id % 17 <> 0 THEN round(value / 10000, 6) END AS top_score,
        CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS dropped, ts AS created_at FROM events)))"""
WINDOW = "created_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY"
STATUS = """docs AS (
  SELECT n.doc_id, sha256(source_path) AS document_id, source_path, subject AS title, doc_type, content,
    CASE WHEN toxic = 1 THEN 'FAILED' ELSE 'INDEXED' END AS status,
    CASE WHEN coalesce(toxic, 0) <> 1 THEN TIMESTAMP '2024-01-01' + to_seconds(n_chars) END AS indexed_at
  FROM named n LEFT JOIN labels USING (doc_id))"""
STATS = f"""totals AS (
  SELECT count(*) AS documents, count(*) FILTER (status = 'INDEXED') AS documents_indexed, count(*) FILTER (status = 'FAILED') AS documents_failed,
    count(*) AS chunks, count(*) FILTER (vec_id IS NULL) AS chunks_missing_embedding, coalesce(sum({TOKENS.format("content")}), 0)::BIGINT AS total_tokens,
    strftime(max(indexed_at), '%Y-%m-%d %H:%M:%S') AS last_indexed_at FROM docs LEFT JOIN embeddings ON vec_id = doc_id)"""
ORACLE["corpus_stats"] = with_parts(LIBRARY, NAMED, STATUS, STATS) + "SELECT * FROM totals"
ORACLE["index_health"] = with_parts(LIBRARY, NAMED, STATUS, STATS) + (
    "SELECT documents_failed, chunks_missing_embedding, documents_failed = 0 AND chunks_missing_embedding = 0 AS healthy FROM totals"
)
ORACLE["query_stats"] = with_parts(LOG) + f"""
SELECT count(*) AS total, count(*) FILTER (NOT answer) AS searches, count(*) FILTER (answer) AS answers,
  round_even(quantile_cont(total_ms, 0.5), 0)::INT AS p50_total_ms, round_even(quantile_cont(total_ms, 0.95), 0)::INT AS p95_total_ms,
  count(*) FILTER (result_count = 0) AS zero_result_count,
  round(count(*) FILTER (floored) / nullif(count(*) FILTER (answer), 0)::DOUBLE, 6) AS abstain_rate FROM log WHERE {WINDOW}"""
ORACLE["top_queries"] = with_parts(LOG) + f"""
SELECT query_text, count(*) AS count, round(avg(top_score), 6) AS average_top_score FROM log WHERE {WINDOW}
GROUP BY query_text ORDER BY count(*) DESC, query_text LIMIT 10"""
ORACLE["zero_result_queries"] = with_parts(LOG) + f"""
SELECT query_text, count(*) AS count FROM log WHERE result_count = 0 AND {WINDOW} GROUP BY query_text ORDER BY count(*) DESC, query_text LIMIT 10"""
DAYS = f"days AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS count FROM log WHERE {WINDOW} GROUP BY 1)"
ORACLE["volume_by_day"] = with_parts(LOG, DAYS) + "SELECT * FROM days"
ORACLE["volume_peak_share"] = with_parts(LOG, DAYS) + (
    "SELECT day, count, round(greatest(count * 100.0::DOUBLE / (SELECT max(count) FROM days), 2), 6) AS height_percent FROM days"
)
RUNS = """runs AS (
  SELECT *, CASE WHEN status <> 'RUNNING' THEN started_at + to_seconds(floor(o_totalprice / 100)::BIGINT - 10) END AS finished_at FROM (
    SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'P' THEN 'FAILED' ELSE 'COMPLETED' END AS status, o_totalprice,
      o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400) AS started_at, floor(o_totalprice / 1000)::BIGINT AS documents_added,
      floor(o_totalprice / 2000)::BIGINT AS documents_updated, floor(o_totalprice / 50000)::BIGINT AS documents_failed FROM orders))"""
TIMES = "strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at"
ORACLE["last_run"] = with_parts(RUNS) + f"""
SELECT run_id, status, {TIMES}, documents_added, documents_updated, documents_failed FROM runs ORDER BY runs.started_at DESC, run_id DESC LIMIT 1"""
ORACLE["run_durations"] = with_parts(RUNS) + """
SELECT run_id, status, CASE WHEN finished_at >= started_at THEN epoch_ms(finished_at) - epoch_ms(started_at) END AS duration_ms FROM runs"""
ORACLE["latency_split"] = with_parts(LOG) + "SELECT endpoint, " + ", ".join(
    f"round(quantile_cont({stage}_ms, {share}), 6)::DOUBLE AS {stage}_p{int(share * 100)}"
    for stage in ("embed", "retrieve", "generate", "total")
    for share in (0.5, 0.95)
) + " FROM log GROUP BY endpoint"
ORACLE["sketched_latency"] = with_parts(LOG) + (
    "SELECT endpoint, count(total_ms) AS requests, true AS p50_within, true AS p95_within FROM log WHERE total_ms IS NOT NULL GROUP BY endpoint"
)
ORACLE["dropped_marker_rate"] = with_parts(LOG) + (
    "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS requests, sum(dropped)::BIGINT AS dropped_markers FROM log GROUP BY 1"
)

# Listings.

ORACLE["list_documents"] = with_parts(LIBRARY, NAMED, STATUS) + r"""
, found AS (SELECT * FROM docs WHERE title ILIKE '%ITEM-1%' OR source_path ILIKE '%ITEM-1%')
SELECT source_path, title, status, strftime(indexed_at, '%Y-%m-%d %H:%M:%S') AS indexed_at, 1::BIGINT AS chunk_count,
  (SELECT count(*) FROM found) AS total FROM found ORDER BY found.indexed_at DESC NULLS FIRST, source_path LIMIT 15 OFFSET 15"""
ORACLE["list_documents_by_status"] = with_parts(LIBRARY, NAMED, STATUS) + r"""
, found AS (SELECT * FROM docs WHERE (contains(title, '_') OR contains(source_path, '_')) AND status = 'INDEXED' AND doc_type = 'meeting-note')
SELECT source_path, title, 1::BIGINT AS chunk_count, (SELECT count(*) FROM found) AS total
FROM found ORDER BY indexed_at DESC NULLS FIRST, source_path LIMIT 100"""
ORACLE["get_document"] = with_parts(LIBRARY, NAMED, STATUS) + f"""
SELECT source_path, title, status, 1 AS chunk_count,
  CASE WHEN {TOKENS.format("content")} > {K.MAX_INPUT_TOKENS} - 20 THEN 0 ELSE 1 END AS embedded_chunks, sha256(content) AS text_hash
FROM docs WHERE status = 'FAILED'"""
ORACLE["list_runs"] = with_parts(RUNS) + f"""
SELECT run_id, status, {TIMES}, (SELECT count(*) FROM runs WHERE status = 'COMPLETED') AS total
FROM runs WHERE status = 'COMPLETED' ORDER BY runs.started_at DESC, run_id LIMIT 50 OFFSET 100"""
ORACLE["run_events"] = """
SELECT * FROM (SELECT user_id AS run_id, event_id, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, props AS message,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS position FROM events) WHERE position <= 5"""
ORACLE["failed_run_events"] = """
SELECT * FROM (SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS position
  FROM events WHERE event_type = 'error') WHERE position <= 500"""
ORACLE["page_window"] = """
SELECT total, 41::BIGINT AS first, least(60, total) AS last, greatest(1, ceil(total / 20.0))::BIGINT AS last_page
FROM (SELECT count(*) AS total FROM documents) WHERE total > 0"""

# Sessions, limiter and streams.

ORACLE["active_sessions"] = """
SELECT c_custkey AS user_id, c_name AS email, c_mktsegment AS role, EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F' AND o_orderdate > TIMESTAMP '1999-01-01') AS has_active_session
FROM customer WHERE c_name ILIKE '%#0000%' AND c_mktsegment = 'MACHINERY'"""
LIMITED = """calls AS (SELECT user_id AS caller, epoch_us(ts) // 1000 AS ts_ms, event_id FROM events),
openings AS (
  SELECT caller, min(ts_ms) AS opened FROM calls GROUP BY caller
  UNION ALL
  SELECT caller, opened FROM (SELECT o.caller, min(c.ts_ms) AS opened FROM openings o JOIN calls c ON c.caller = o.caller AND c.ts_ms >= o.opened + 86400000
    GROUP BY o.caller, o.opened)),
placed AS (SELECT c.*, o.opened FROM calls c ASOF JOIN (SELECT DISTINCT * FROM openings) o ON c.caller = o.caller AND c.ts_ms >= o.opened),
judged AS (SELECT *, row_number() OVER (PARTITION BY caller, opened ORDER BY ts_ms, event_id) <= 2 AS allowed FROM placed),
outcomes AS (SELECT *, CASE WHEN allowed THEN 0 ELSE greatest(1, ceil((opened + 86400000 - ts_ms) / 1000.0)) END::INT AS retry_after_s FROM judged)"""
ORACLE["rate_limit_audit"] = with_parts(LIMITED) + "SELECT caller, ts_ms, event_id, allowed, retry_after_s FROM outcomes"
ORACLE["stream_rate_limit"] = with_parts(LIMITED) + (
    "SELECT caller, event_id, CASE WHEN allowed THEN 'allowed' ELSE 'rejected' END AS outcome, retry_after_s FROM outcomes"
)
ORACLE["stream_rate_limit_sliced"] = ORACLE["stream_rate_limit"]
ORACLE["stream_volume_by_day"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS count FROM events GROUP BY 1"
ORACLE["stream_ingest"] = with_parts(CORPUS, LABELLED) + f"""
SELECT source_path, content_hash, 'INDEXED' AS status FROM labelled WHERE coalesce(toxic, 0) = 0 AND {TOKENS.format("content")} > 0
UNION ALL SELECT concat('pages/', page_id, '.md'), sha256(url || ' late'), 'INDEXED' FROM pages"""
ORACLE["scheduled_ingest"] = f"SELECT *, 1 AS runs FROM ({ORACLE['stream_ingest']})"
ORACLE["scheduled_folder"] = f"""
SELECT doc_id, CASE WHEN quality IS NULL THEN 'back' ELSE 'kept' END AS folder, sha256(text || chr(10)) AS content_hash, 'INDEXED' AS status
FROM documents LEFT JOIN labels USING (doc_id)
WHERE (quality IS NOT NULL OR lang = 'fr') AND {TOKENS.format("text")} > 0"""
ORACLE["stream_removals"] = with_parts(CORPUS, LABELLED) + (
    f"SELECT source_path FROM labelled WHERE quality IS NOT NULL AND {TOKENS.format('content')} > 0"
)
