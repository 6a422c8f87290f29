"""DuckDB SQL for the registered queries that SQL can express.

The other queries need XXH64, a tokenizer, a trained model or an alignment;
tests hold them against brute force.
"""

from habitnet.llm import quality_rules as q

_WORD = "'[^\\x20\\x09-\\x0D]+'"


def _quality_rules() -> str:
    symbols = "'[#*$%&|<>]'"
    low = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {_WORD}) AS ws FROM d),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {q.WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {q.WINDOW - 1})) AS i FROM w)
),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, unnest(generate_series(0, {q.WINDOW - 1})) AS k FROM repeated) GROUP BY doc_id
),
split AS (
  SELECT doc_id, u.line AS line, u.pos AS pos FROM (
    SELECT doc_id, unnest(list_transform(generate_series(1, len(ls)), lambda i: {{'line': ls[i], 'pos': i}})) AS u
    FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d))
),
lines AS (
  SELECT doc_id, line, pos, regexp_extract_all(line, {_WORD}) AS ws, len(regexp_extract_all(line, {_WORD})) AS n,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS copy
  FROM split WHERE regexp_matches(line, {_WORD})
),
judged AS (
  SELECT doc_id, n, copy,
    100 * len(regexp_extract_all(line, {symbols})) > {q.MAX_SYMBOL_PERCENT} * n
    OR 100 * len(regexp_extract_all(line, '{q.SEPARATOR_PATTERN}')) > {q.MAX_SEPARATOR_PERCENT} * n
    OR 100 * len(regexp_extract_all(line, '{q.SHOUT_PATTERN}')) > {q.MAX_SHOUT_PERCENT} * n
    OR (n >= {q.STUTTER_FROM_WORDS}
        AND 100 * len(list_filter(generate_series(1, n - 1), lambda i: ws[i] = ws[i + 1])) > {q.MAX_STUTTER_PERCENT} * n)
    OR regexp_matches({low}, '{q.BOILERPLATE_PATTERN}')
    OR (n <= {q.MENU_MAX_WORDS} AND len(regexp_extract_all({low}, '{q.MENU_PATTERN}')) >= {q.MENU_MIN_ENTRIES}) AS fails
  FROM lines
),
per_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE copy > 1) AS n_dup_lines,
    count(*) FILTER (WHERE fails) AS n_bad_lines, coalesce(sum(n) FILTER (WHERE fails), 0) AS n_lost_words
  FROM judged GROUP BY doc_id
),
measured AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, {symbols})) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_bad_lines, 0) AS n_bad_lines, CAST(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words
  FROM w LEFT JOIN per_doc USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT *, (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words)
  AND 100 * n_lost_words <= {q.MAX_LOST_PERCENT} * n_words AS kept
FROM measured
"""


_LINE_DEDUP = f"""
WITH split AS (
  SELECT doc_id, u.line AS line, u.pos AS line_no FROM (
    SELECT doc_id, unnest(list_transform(generate_series(0, len(ls) - 1), lambda i: {{'line': ls[i + 1], 'pos': i}})) AS u
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
),
lines AS (SELECT * FROM split WHERE regexp_matches(line, {_WORD})),
placed AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS copy FROM lines),
firsts AS (
  SELECT row_number() OVER (ORDER BY doc_id, line_no) AS id, doc_id, line_no,
    list_distinct(regexp_extract_all(line, {_WORD})) AS ws
  FROM placed WHERE copy = 1
),
tokens AS (SELECT id, len(ws) AS n, unnest(ws) AS w FROM firsts),
ranked AS (
  SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY f, w) AS pos
  FROM (SELECT id, n, w, count(*) OVER (PARTITION BY w) AS f FROM tokens)
),
prefix AS (SELECT id, n, w FROM ranked WHERE pos <= n - CAST(ceil(0.8 * n - 0.000001) AS BIGINT) + 1),
pairs AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.w = b.w AND b.id < a.id
  WHERE 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
),
shared AS (
  SELECT a, x.doc_id, x.line_no, len(list_intersect(x.ws, y.ws)) AS s, len(x.ws) + len(y.ws) AS total
  FROM pairs JOIN firsts x ON x.id = a JOIN firsts y ON y.id = b
),
matched AS (SELECT DISTINCT doc_id, line_no FROM shared WHERE 100 * s >= 80 * (total - s)),
gone AS (
  SELECT doc_id, line_no FROM placed WHERE copy > 1 UNION SELECT doc_id, line_no FROM matched
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines
FROM (SELECT DISTINCT doc_id FROM documents) d
LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id) USING (doc_id)
LEFT JOIN (
  SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed_lines
  FROM gone GROUP BY doc_id
) USING (doc_id)
"""


def _base32(digest: str) -> str:
    parts = [f"upper(lpad(to_base(CAST('0x' || substr({digest}, {10 * i + 1}, 10) AS BIGINT), 32, 8), 8, '0'))" for i in range(4)]
    return f"translate({' || '.join(parts)}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"


_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_base32('digest')} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

SQL: dict[str, str] = {
    "op3_quality_rules": _quality_rules(),
    "op7_line_dedup": _LINE_DEDUP,
    "op8_warc": _WARC,
    "op12_top_k": _TOP_K,
}
