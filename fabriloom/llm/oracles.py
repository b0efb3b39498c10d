"""DuckDB SQL for the queries that SQL can express; it uses none of the operators' methods."""

from __future__ import annotations

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN = "regexp_extract_all(" + _LOW + r", '[^\x20\x09-\x0D]+')"

WARC = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT *, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, octet_length(payload) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(1 + 10 * (k // 8) AS BIGINT), 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31 AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce({_PLAIN.format("text")}, []) AS w FROM documents),
x AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
five AS (SELECT doc_id, i, n, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS l FROM x),
s AS (SELECT DISTINCT doc_id, l FROM five WHERE len(l) = 5 OR (i = 1 AND n < 5)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.l = b.l WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN c USING (doc_id)"""

SUFFIX = """WITH d AS (SELECT doc_id, row_number() OVER () AS rid, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT rid, i, md5(array_slice(t, i + 1, i + 200)) AS s FROM (SELECT rid, t, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
again AS (SELECT s FROM starts GROUP BY s HAVING count(*) > 1),
hit AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM starts WHERE s IN (SELECT s FROM again)),
runs AS (SELECT rid, run, min(i) AS a, max(i) + 200 AS z FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM hit) GROUP BY rid, run),
gaps AS (SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS a, a AS z FROM runs UNION ALL SELECT d.rid, coalesce(max(z), 0), n FROM d LEFT JOIN runs USING (rid) GROUP BY d.rid, n),
kept AS (SELECT d.rid, string_agg(hex(array_slice(t, a + 1, z)), '' ORDER BY a) AS k FROM gaps JOIN d USING (rid) WHERE z > a GROUP BY d.rid),
total AS (SELECT rid, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (rid) LEFT JOIN total USING (rid)"""

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
iw AS (SELECT item_id, {_WORDS.format("text")} AS w FROM (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, text FROM benchmark WHERE text IS NOT NULL)),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
ten AS (SELECT rid, i, list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM x),
occ AS (SELECT rid, i, p.size, item_id FROM (SELECT rid, i, size, array_to_string(l[1 : size], ' ') AS s FROM ten, sizes WHERE len(l) >= size) p JOIN win USING (s)),
hit AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT rid, i, size FROM occ)) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM occ) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)"""

LICENCE_PHRASES = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
phrases AS (SELECT * FROM (VALUES ('under the mit license', 'mit', 4), ('apache license version 2', 'apache-2', 4), ('cc by nc', 'cc-by-nc', 3)) AS v(phrase, label, k)),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
four AS (SELECT rid, i, list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS l FROM x),
occ AS (SELECT rid, i - 1 AS p, label FROM four JOIN phrases ON len(l) >= k AND array_to_string(l[1 : k], ' ') = phrase),
found AS (SELECT rid, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word FROM occ GROUP BY rid),
names AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT rid, label FROM occ) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN found USING (rid) LEFT JOIN names USING (rid)"""

EDITED_TEXTS = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id, text) AS k FROM documents),
e AS (SELECT *, coalesce(lead(t) OVER (ORDER BY k), first_value(t) OVER (ORDER BY k)) AS u FROM d)
SELECT doc_id, n AS n_chars, sha256(encode(substr(t, 1, n - n // 4) || substr(u, 1, n // 4))) AS edited_sha256 FROM e"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"
_CLAIM = _FIELD.format(_LOW.format("text"))

#: crc32 of a text by its bits: eight shifts for each byte.
_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(8 * CAST(octet_length(encode({0})) AS BIGINT)), lambda k: CAST(CASE WHEN k % 8 = 0 THEN 256 + ascii(substr({0}, k // 8 + 1, 1)) ELSE 0 END AS BIGINT))), lambda c, b: CASE WHEN xor(c, b & 255) & 1 = 1 THEN xor(xor(c, b & 255) >> 1, 3988292384) ELSE xor(c, b & 255) >> 1 END)"
CRC32 = f"xor({_CRC}, 4294967295)"

MERKLE = f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF.format(_FIELD.format("text"))} AS leaf, {_LEAF.format(_CLAIM)} AS claim, {CRC32.format("CAST(doc_id AS VARCHAR)")} % 5 = 0 AS touched FROM documents),
o AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS src, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
t AS (SELECT src, 0 AS lvl, idx, leaf AS h, count(*) OVER (PARTITION BY src) AS n FROM o
 UNION ALL SELECT src, lvl + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 15) // 16 FROM t WHERE n > 1 GROUP BY src, lvl, idx // 16),
subs AS (SELECT src, h, row_number() OVER (ORDER BY src) - 1 AS idx FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, idx, h, count(*) OVER () AS n FROM subs
 UNION ALL SELECT lvl + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 15) // 16 FROM u WHERE n > 1 GROUP BY lvl, idx // 16),
beside AS (SELECT a.src, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r FROM t a JOIN t b ON a.src = b.src AND a.lvl = b.lvl AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY a.src, a.lvl, a.idx
 UNION ALL SELECT 0, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), ''), coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') FROM u a JOIN u b ON a.lvl = b.lvl AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY a.lvl, a.idx),
steps AS (SELECT o.src, o.idx, b.lvl, l, r FROM o JOIN beside b ON b.src = o.src AND b.idx = o.idx >> (4 * b.lvl)
 UNION ALL SELECT o.src, o.idx, 100 + b.lvl, l, r FROM o JOIN subs s ON s.src = o.src JOIN beside b ON b.src = 0 AND b.idx = s.idx >> (4 * b.lvl)),
way AS (SELECT src, idx, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof, list({{'l': l, 'r': r}} ORDER BY lvl) AS path FROM steps GROUP BY src, idx),
fold AS (SELECT o.src, o.idx, 0 AS k, CASE WHEN touched THEN claim ELSE leaf END AS h, path FROM o LEFT JOIN way USING (src, idx)
 UNION ALL SELECT src, idx, k + 1, sha256(path[k + 1].l || h || path[k + 1].r), path FROM fold WHERE k < len(path)),
top AS (SELECT h AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, s.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified FROM o JOIN subs s USING (src) JOIN fold ON fold.src = o.src AND fold.idx = o.idx AND fold.k = coalesce(len(fold.path), 0) LEFT JOIN way ON way.src = o.src AND way.idx = o.idx CROSS JOIN top"""

EMBEDDING_DEVIATIONS = """WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) + 1000000) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
e AS (SELECT rid, vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v), s AS (SELECT i, sum(x) AS s, count(*) AS n FROM e GROUP BY i),
t AS (SELECT rid, vec_id, any_value(n) AS n, CAST(sum((n * x - s) * (n * x - s)) AS BIGINT) AS deviation FROM e JOIN s USING (i) GROUP BY rid, vec_id)
SELECT vec_id, CAST(i AS INTEGER) AS component, CAST(n AS BIGINT) AS n, deviation FROM t JOIN s USING (n) WHERE i <= 32"""

BASE_SCORES = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({CRC32.format("CAST(doc_id AS VARCHAR)")} % 7 = 2, true) AS held_out, list_append(coalesce({_PLAIN.format("text")}, []), ' ') AS w FROM documents),
x AS (SELECT rid, held_out, unnest(w) AS t FROM d), c AS (SELECT t, count(*) AS c FROM x WHERE NOT held_out GROUP BY t),
k AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c),
s AS (SELECT rid, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base_score FROM x LEFT JOIN c USING (t) CROSS JOIN k GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base_score, 6) AS base_score FROM d JOIN s USING (rid) CROSS JOIN k"""
