"""DuckDB SQL for the rows of the registered queries that SQL can express."""

from __future__ import annotations

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP7 = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
    row_number() OVER () AS row_id
  FROM documents),
g AS (SELECT row_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
h AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT row_id, count(DISTINCT j) AS n FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS j FROM h WHERE c >= 2) GROUP BY row_id),
f AS (
  SELECT doc_id, t, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (row_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND NOT 10 * n_symbols > n_words
  AND NOT (word_chars < 3 * n_words OR word_chars > 15 * n_words)
  AND NOT 100 * n_dup_lines > 40 * n_lines
  AND NOT 100 * (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g'))) > 30 * word_chars
  AND NOT 2 * (length(regexp_replace(t, '[\\p{L}\\p{M}]+', '', 'g')) - (length(t) - word_chars)) > word_chars AS kept
FROM b
"""

OP4 = f"""
WITH x AS (SELECT row_number() OVER () AS row_id, doc_id, source, text FROM documents),
t AS (SELECT text, min(doc_id) AS id, arg_min(source, doc_id) AS site FROM x WHERE text IS NOT NULL GROUP BY text),
l AS (SELECT DISTINCT text, id, site, trim(line, {_BLANK}) AS line FROM (SELECT text, id, site, unnest(string_split(text, chr(10))) AS line FROM t)),
b AS (SELECT line, min(id) AS first_id FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10),
p AS (SELECT row_id, doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS raw FROM (SELECT row_id, doc_id, string_split(text, chr(10)) AS s FROM x)),
k AS (
  SELECT row_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM (SELECT p.*, b.line IS NOT NULL AND b.first_id IS DISTINCT FROM p.doc_id AS gone
        FROM p LEFT JOIN b ON b.line = trim(p.raw, {_BLANK}))
  GROUP BY row_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN x.text IS NOT NULL THEN sha256(kept) END AS kept_sha256
FROM x LEFT JOIN k USING (row_id)
"""

OP2 = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""

OP6 = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda j: array_to_string(w[j:j + 9], ' '))) AS g FROM i WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM v),
p AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS j, w FROM d, k WHERE len(w) >= k),
m AS (SELECT doc_id, item_id, p.k, j FROM p JOIN v ON v.k = p.k AND v.g = array_to_string(w[j:j + p.k - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP10 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

OP3 = """
WITH RECURSIVE c AS (
  SELECT conv_id, conv_id || '-' || turn AS call_id, min(turn) AS turn, arg_min(role, (turn, role, text)) AS role, arg_min(text, (turn, role, text)) AS text
  FROM conversations WHERE role IN ('user', 'system') GROUP BY ALL),
r AS (
  SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, min(turn) AS result_turn, arg_min(text, (turn, text)) AS content
  FROM conversations WHERE role = 'assistant' GROUP BY ALL),
d AS (
  SELECT c.*, c.turn > 1 AND p.call_id IS NOT NULL AS has_before, c.turn > 0 AND z.call_id IS NOT NULL AS has_root
  FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2 LEFT JOIN c z ON z.conv_id = c.conv_id AND z.turn = 0),
v AS (
  SELECT conv_id, turn, has_root::INT AS level FROM d WHERE NOT has_before
  UNION ALL
  SELECT d.conv_id, d.turn, v.level + 1 FROM v JOIN d ON d.conv_id = v.conv_id AND d.turn = v.turn + 2 WHERE has_before),
j AS (
  SELECT coalesce(d.conv_id, r.conv_id) AS conv_id, coalesce(d.call_id, r.call_id) AS call_id, turn, result_turn, role, text, content, has_before, has_root,
    d.call_id IS NOT NULL AS called, r.call_id IS NOT NULL AS answered
  FROM d FULL JOIN r ON d.conv_id = r.conv_id AND d.call_id = r.call_id)
SELECT conv_id, call_id, turn, result_turn, level::INT AS level,
  CASE WHEN NOT called THEN 'no_call' WHEN answered THEN 'linked' ELSE 'no_result' END AS status,
  CASE WHEN called THEN text IS NOT NULL AND (turn = 0 OR (has_root AND (turn = 1 OR has_before) AND role = 'user')) AND (role <> 'system' OR length(text) <= 200) AND (role <> 'user' OR length(text) >= 20) END AS valid,
  sha256('{"arguments":' || CASE WHEN called THEN '{' || CASE WHEN turn > 0 THEN '"context":{' || CASE WHEN turn > 1 THEN '"before":{"$ref":"' || conv_id || '-' || (turn - 2) || '"},' ELSE '' END || '"root":{"$ref":"' || conv_id || '-0"}},' ELSE '' END
    || coalesce('"text":' || to_json(text) || ',', '') || '"turn":' || turn || '}' ELSE 'null' END
    || ',"call_id":"' || call_id || '","name":' || coalesce('"' || role || '"', 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}') AS json_sha256
FROM j LEFT JOIN v USING (conv_id, turn)
"""

OP11 = """
WITH RECURSIVE bits AS (SELECT unnest(range(256)) AS i),
crc AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM bits),
run AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{C0}-\\x{FF}]{6,}')) AS r FROM documents)
  GROUP BY ALL),
named AS (SELECT *, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || r, ''), lambda c: unicode(c)) AS points FROM run),
octets AS (SELECT r, n, flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END))::BIGINT[] AS b FROM named),
hashed AS (
  SELECT r, n, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1]::BIGINT)), 4294967295) AS h
  FROM octets, crc),
edited AS (SELECT CASE WHEN h % 199 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, n FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS near FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.less = w.word
  UNION SELECT w.word, d.word FROM d JOIN w ON d.less = w.word),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(w.word, (-w.n, w.word)) AS b, max(w.n) AS m
  FROM near JOIN w ON w.word = near.near GROUP BY near.word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN b END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
  FROM w LEFT JOIN best USING (word)),
up AS (
  SELECT word, word AS at FROM f
  UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN up USING (word) JOIN f l ON l.word = up.at AND l.form IS NULL
"""
