"""SQL of the queries that SQL can express, for tables whose ids are known and unique.

The others can't be: fingerprints and components (4), a tokenizer (6), offsets of pattern matches (7), a trained model (9), and
passages in part alike (10). They are tested against brute force, the tokenizers library and held-out labels.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _alnum(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}')"


OP1 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents),
spot AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS g FROM spot),
f AS (SELECT g, min(doc_id) AS first_id FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, i + unnest(generate_series(0, 49)) AS k FROM (SELECT g.doc_id, g.i FROM g JOIN f ON f.g = g.g WHERE f.first_id < g.doc_id)),
p AS (SELECT doc_id, u.w, u.k FROM w, unnest(ws) WITH ORDINALITY AS u(w, k)),
m AS (SELECT p.doc_id, p.k, CASE WHEN r.k IS NULL THEN p.w END AS kept FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.k = p.k),
s AS (SELECT doc_id, count(*) AS n, count(*) - count(kept) AS gone, string_agg(kept, ' ' ORDER BY k) AS t FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN s ON s.doc_id = w.doc_id
"""

OP2 = rf"""
WITH d AS (SELECT doc_id, {_alnum("text")} AS ws FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_alnum("text")} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS g FROM (SELECT item, ws, least(len(ws), 13) AS n, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw), spot AS (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, sizes WHERE len(ws) >= n),
hit AS (SELECT doc_id, i, spot.n, item FROM spot JOIN bw ON bw.n = spot.n AND bw.g = array_to_string(ws[i : i + spot.n - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, i + unnest(generate_series(0, n - 1)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

OP3 = rf"""
WITH l AS (SELECT doc_id, u.k - 1 AS line, list_sort(list_distinct(regexp_extract_all(u.x, '{_SPACED}'))) AS ws FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(x, k)),
s AS (SELECT ws, len(ws) AS n, min((doc_id, line)) AS first_at, row_number() OVER () AS sid FROM l WHERE len(ws) > 0 GROUP BY ws),
t AS (SELECT sid, n, unnest(ws) AS w FROM s), df AS (SELECT w, count(*) AS df FROM t GROUP BY w),
p AS (SELECT sid, n, w FROM (SELECT t.*, row_number() OVER (PARTITION BY sid ORDER BY df, t.w) AS place FROM t JOIN df ON df.w = t.w) WHERE place <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.sid AS a, b.sid AS b FROM p a JOIN p b ON a.w = b.w AND a.sid < b.sid AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
ok AS (SELECT x.sid AS a, y.sid AS b, x.first_at AS fa, y.first_at AS fb FROM c JOIN s x ON x.sid = c.a JOIN s y ON y.sid = c.b WHERE 9 * len(list_intersect(x.ws, y.ws)) >= 4 * (x.n + y.n)),
late AS (SELECT DISTINCT CASE WHEN fa < fb THEN b ELSE a END AS sid FROM ok),
gone AS (SELECT l.doc_id, l.line FROM l JOIN s ON s.ws = l.ws LEFT JOIN late ON late.sid = s.sid WHERE late.sid IS NOT NULL OR (l.doc_id, l.line) > s.first_at)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(count(g.line) AS BIGINT) AS n_removed, coalesce(string_agg(CAST(g.line AS VARCHAR), ',' ORDER BY g.line), '') AS removed_lines
FROM documents d LEFT JOIN gone g ON g.doc_id = d.doc_id GROUP BY d.doc_id, d.text
"""

_ESCAPED = "length({0}) + length(regexp_replace({0}, '[^\\\\<\\[\\]]', '', 'g'))"
OP5 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, 9 + 2 * ({_ESCAPED.format("role")}) + {_ESCAPED.format("text")} AS chars FROM c),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS prefix FROM f)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(count(CASE WHEN role = 'assistant' THEN 1 END) AS BIGINT) AS n_examples, CAST(sum(CASE WHEN role = 'assistant' THEN prefix ELSE 0 END) AS BIGINT) AS example_chars FROM p GROUP BY conv_id
"""

OP8 = f"""
WITH d AS (SELECT doc_id, {_alnum("text")} AS ws FROM documents), size AS (SELECT doc_id, len(ws) AS n FROM d), total AS (SELECT count(*) AS docs, greatest(1.0, sum(n) / count(*)) AS average FROM size),
tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY doc_id, w), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
q AS (SELECT doc_id AS query_id, w FROM tf WHERE doc_id % 20 = 0),
s AS (SELECT query_id, tf.doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / average))), 6) AS score
  FROM q JOIN tf ON tf.w = q.w JOIN df ON df.w = q.w JOIN size ON size.doc_id = tf.doc_id, total GROUP BY query_id, tf.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLE_SQL = {"op1_substring_dedup": OP1, "op2_benchmark_decontamination": OP2, "op3_line_dedup": OP3, "op5_chat_formatting": OP5, "op8_topk_search": OP8}
