"""SQL for those queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations


def _canon(x: str) -> str:
    """Letters and digits of a text in lower case."""
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


_P1 = """
SELECT DISTINCT run_id, item_no FROM (
  SELECT run_id, 0::BIGINT AS item_no, extracted_text AS t, coalesce(chunking_config.max_chars, 1000) AS m FROM ingestion_state
  UNION ALL
  SELECT run_id, CAST(generate_subscripts(chunks, 1) AS BIGINT), unnest(chunks).content, coalesce(chunking_config.max_chars, 1000) FROM ingestion_state)
WHERE length(t) > m"""

_P3 = """
WITH v AS (
  SELECT 'chunks' AS collection, chunk_id AS id, CAST(any_value(embedding_vector) AS DOUBLE[]) AS x FROM chunks WHERE len(embedding_vector) = 64 GROUP BY chunk_id
  UNION ALL SELECT 'conversations', turn_id, CAST(any_value(combined_embedding) AS DOUBLE[]) FROM conversations WHERE len(combined_embedding) = 64 GROUP BY turn_id),
u AS (SELECT * FROM v WHERE len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND list_inner_product(x, x) > 0),
p AS (SELECT a.collection, a.id, b.id AS other, list_cosine_similarity(a.x, b.x) AS c FROM u a JOIN u b ON a.collection = b.collection AND a.id <> b.id),
t AS (SELECT * FROM p WHERE c >= 0.9 QUALIFY row_number() OVER (PARTITION BY collection, id ORDER BY c DESC, other) <= 5)
SELECT DISTINCT collection, least(id, other) AS id_a, greatest(id, other) AS id_b FROM t"""

_P5 = f"""
WITH c AS (SELECT DISTINCT chunk_id, content FROM chunks WHERE content IS NOT NULL AND {_canon("content")} <> ''),
s AS (SELECT chunk_id, content, list_filter(CASE WHEN contains(trim(content, chr(10) || ' '), chr(10)) THEN string_split(content, chr(10)) WHEN contains(content, '|') THEN string_split(content, '|') ELSE string_split(content, ';') END, lambda x: {_canon("x")} <> '') AS items FROM c),
k AS (SELECT chunk_id, CASE
  WHEN starts_with(ltrim(content), '{{') AND json_valid(content) THEN 'F' || array_to_string(list_sort(list_transform(json_keys(content), lambda n: {_canon("n")} || chr(1) || {_canon("json_extract_string(content, '$.' || chr(34) || n || chr(34))")})), chr(2))
  WHEN len(items) > 1 AND len(list_filter(items, lambda x: NOT regexp_matches(x, '^[^\\p{{L}}\\p{{N}}]*\\p{{L}}[\\p{{L}}\\p{{N}} ]{{0,40}}\\s*:\\s'))) = 0
  THEN 'F' || array_to_string(list_sort(list_transform(items, lambda x: {_canon("string_split(x, ':')[1]")} || chr(1) || {_canon("substr(x, position(':' IN x) + 1)")})), chr(2))
  ELSE 'T' || {_canon("content")} END AS key FROM s),
g AS (SELECT key, min(chunk_id) AS keep_id, count(DISTINCT chunk_id) AS copies FROM k GROUP BY key)
"""

_P6 = f"""
WITH c AS (SELECT DISTINCT chunk_id AS id, content, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w FROM chunks WHERE content IS NOT NULL),
d AS (SELECT id, {_canon("content")} AS same, w FROM c WHERE len(w) >= 40),
s AS (SELECT DISTINCT id, same, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, same, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
n AS (SELECT id, any_value(same) AS same, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 2 * m >= x.n + y.n - m AND x.same <> y.same"""

_P8 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
e AS (SELECT id, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') AS w FROM (SELECT id, unnest([input, expected_output]) AS t FROM eval_cases) WHERE t IS NOT NULL),
h AS (SELECT DISTINCT id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
SELECT DISTINCT doc_id, id AS case_id FROM g JOIN h USING (g)"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p3_found": _P3, "p5_found": _P5 + "SELECT DISTINCT keep_id, chunk_id AS copy_id FROM k JOIN g USING (key) WHERE chunk_id <> keep_id", "p5_copies": _P5 + "SELECT keep_id, copies FROM g", "p6_found": _P6, "p8_found": _P8}
