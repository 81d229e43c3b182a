"""DuckDB SQL for the queries that SQL can express. It follows the contracts, not the operators' methods."""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex || '0', 1 + (5 * i) // 4, 2))::INTEGER >> (3 - ((5 * i) % 4)::INTEGER)) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM h
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^ \t\n\r\f\p{L}\p{N}]')) + 2 AS tokens,
  length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h')) + length(role) - length(replace(role, ':', ''))
   + length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')) + 6 + 8 AS chars FROM c),
y AS (SELECT *, i = 1 AND role = 'system' AS sys FROM o),
s AS (SELECT *, greatest(1, floor((512 - 96 - max(CASE WHEN sys THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id)) / 2))::BIGINT AS stride,
  sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY i)::BIGINT AS p FROM y),
k AS (SELECT *, CASE WHEN sys THEN '-1' ELSE (p // stride)::VARCHAR || CASE WHEN tokens > stride THEN 'a' ELSE 'b' END END AS span FROM s),
n AS (SELECT *, CASE WHEN sys THEN 0 WHEN lag(sys) OVER w THEN 0 WHEN lag(span) OVER w <> span THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
v AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY i)::BIGINT AS win FROM n),
x AS (SELECT *, max(win) OVER (PARTITION BY conv_id) AS last_win, max(p) OVER (PARTITION BY conv_id, win) - p + tokens AS after FROM v)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars * (CASE WHEN sys THEN 1 + last_win WHEN after <= 96 AND win < last_win THEN 2 ELSE 1 END))::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""

SQL = {"op4_warc": WARC, "op9_chat_format": CHAT}

#: Documents with ASCII letters lower-cased and their words.
WORDS = r"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE {WORDS},
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS ss FROM w),
t AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM s),
h AS (SELECT doc_id, n, md5_number_lower(g) AS g FROM t),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS un, b.n AS vn, count(*) AS shared FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM o WHERE 100 * shared >= 75 * (un + vn - shared)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.id WHERE r.c < l.v)
SELECT s.doc_id, len(ss)::BIGINT AS n_shingles, least(s.doc_id, (SELECT min(c) FROM r WHERE r.id = s.doc_id)) AS component_id FROM s
"""

SUBSTRING = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, i, md5_number(array_to_string(ws[i:i + 49], ' ')) AS g FROM p),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) < doc_id AS hit FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM m WHERE hit),
k AS (SELECT doc_id, count(*) AS n_removed, list(i) AS gone FROM c GROUP BY doc_id),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
f AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept FROM e ANTI JOIN c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN f USING (doc_id)
"""

SQL |= {"op5_ngram_join": NGRAM_JOIN, "op6_substring_dedup": SUBSTRING}

EMBEDDINGS = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND list_sum(list_transform(embedding, lambda v: abs(v))) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.id WHERE r.c < l.v),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM l WHERE u = vec_id)::BIGINT AS n_links, least(c, vec_id) AS component_id, least(c, vec_id) = vec_id AS kept
FROM embeddings JOIN c ON id = vec_id
"""

SQL |= {"op7_embedding_dedup": EMBEDDINGS}


def _crc_table() -> str:
    """SQL for the 256 entries of the table of crc32: each entry is eight steps from its number."""
    return """(WITH RECURSIVE s AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM s WHERE k < 8)
  SELECT list(c ORDER BY i) AS crc FROM s WHERE k = 8)"""


def _crc32(text: str) -> str:
    """SQL for the crc32 of a text's UTF-8 bytes; it needs the column crc of the table."""
    step = "xor(c >> 8, crc[(xor(c, b) & 255)::INTEGER + 1])"
    return f"""xor(list_reduce(list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), (2 * i + 1)::INTEGER, 2))::BIGINT),
    lambda c, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"""


LOWER_AZ = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING = rf"""
WITH RECURSIVE tab AS {_crc_table()},
o AS (SELECT doc_id, unnest(regexp_extract_all({LOWER_AZ}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
d AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS n FROM o WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, {_crc32("named")} AS h FROM d, tab),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0
  THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
c AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
k AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM c),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM k a JOIN k b ON a.i = b.i AND a.cut = b.cut AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON w.word = k.cut
  UNION SELECT w.word, k.word, k.n FROM k JOIN w ON w.word = k.cut),
b AS (SELECT word, count(*)::BIGINT AS n_near, min(struct_pack(m := -other_n, f := other)) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 5 * w.n THEN best.f END AS form, CASE WHEN -best.m >= 5 * w.n THEN -best.m END AS form_n
  FROM w LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.next)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.root FROM f JOIN r ON r.word = f.word AND r.next IS NULL
"""

#: The words of a text: runs of digits, letters and characters beyond ASCII.
FEATURES = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

IMPORTANCE = rf"""
WITH tab AS {_crc_table()},
o AS (SELECT doc_id, unnest({FEATURES}) AS w FROM documents), t AS (SELECT unnest({FEATURES}) AS w FROM benchmark),
k AS (SELECT w, {_crc32("w")} % 10000 AS b FROM (SELECT w FROM o UNION SELECT w FROM t), tab),
os AS (SELECT b, count(*) AS s FROM o JOIN k USING (w) GROUP BY b), ts AS (SELECT b, count(*) AS t FROM t JOIN k USING (w) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM o) AS s_all, (SELECT count(*) FROM t) AS t_all),
g AS (SELECT k.w, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
  FROM k LEFT JOIN os USING (b) LEFT JOIN ts USING (b), n),
d AS (SELECT doc_id, count(*)::BIGINT AS n_features, sum(gain)::BIGINT AS total FROM o JOIN g USING (w) GROUP BY doc_id),
x AS (SELECT documents.doc_id, coalesce(n_features, 0) AS n_features,
  coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('2024:' || coalesce(documents.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents LEFT JOIN d ON d.doc_id = documents.doc_id),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS many FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * many // 100 THEN place END AS rank FROM r
"""

SQL |= {"op11_spelling_variants": SPELLING, "op13_importance_resample": IMPORTANCE}
