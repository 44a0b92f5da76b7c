"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

_TURNS = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')"""

_ESCAPED = r"length(regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g'))"

#: Words of a text whose A-Z are lower-cased.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_chats": f"""{_TURNS}
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len("<|im_start|><|im_sep|><|im_end|>") + 1} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op5_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to FROM q""",
    "op6_decontamination": f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[j:j + least(13, len(w)) - 1], ' ') AS g
  FROM b, generate_series(1, len(w) - least(13, len(w)) + 1) t(j) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT doc_id, j, k, array_to_string(w[j:j + k - 1], ' ') AS g
  FROM d, (SELECT DISTINCT k FROM windows), generate_series(1, len(w) - k + 1) t(j)),
hits AS (SELECT doc_id, j, k, item FROM places JOIN windows USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(j, j + k - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_topk": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT doc_id, len(w) AS n FROM d),
tf AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL),
total AS (SELECT count(*) AS docs, avg(n) AS mean FROM sizes),
idf AS (SELECT w, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS i FROM tf, total GROUP BY w, docs),
scored AS (
  SELECT q.doc_id AS query_id, tf.doc_id, round(sum(i * tf.c * 2.2 / (tf.c + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS score
  FROM tf q JOIN tf USING (w) JOIN idf USING (w) JOIN sizes ON sizes.doc_id = tf.doc_id, total
  WHERE q.doc_id % 20 = 0 GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op11_negatives": """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    coalesce(CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT), 0) AS score
  FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
