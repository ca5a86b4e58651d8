"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

#: All pairs that share an n-gram are counted, and links followed by recursion.
NGRAM_JOIN = r"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, len(g) AS n FROM s), e AS MATERIALIZED (SELECT doc_id, hash(unnest(g)) AS g FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, v.b FROM reach r JOIN both_ways v ON r.b = v.a)
SELECT n.doc_id, n.n AS n_shingles, min(reach.b) AS component_id FROM n JOIN reach ON reach.a = n.doc_id GROUP BY 1, 2"""

#: All pairs of vectors.
VECTORS = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1), c AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""

#: Base32 by groups of 20 bits of the hexadecimal digest.
WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, payload_bytes, list_reduce(list_prepend('', list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1))), lambda a, b: a || b) AS payload_digest,
CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM d"""

#: Cuts by code points; the rebuilt text is the text.
FILL_MIDDLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, i) AS a, substring(t, i + 1, j - i) AS m, substring(t, j + 1, n - j) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

#: The checksum byte by byte from a table of 256 remainders; near words meet under what is left of them without one code point.
SPELLING = r"""WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS MATERIALIZED (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
d AS MATERIALIZED (SELECT id, run, count(*) AS k FROM r GROUP BY 1, 2),
b AS (SELECT run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)) AS bytes FROM d),
c AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), 4294967295) AS h FROM b, tab),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, k FROM c),
w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM v GROUP BY 1 HAVING length(word) >= 5 AND sum(k) >= 3),
x AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w), y AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS less FROM x),
one AS MATERIALIZED (SELECT DISTINCT y.word AS a, w.word AS b FROM y JOIN w ON w.word = y.less),
p AS MATERIALIZED (SELECT a, b FROM one UNION SELECT b, a FROM one UNION SELECT l.word, q.word FROM y l JOIN y q ON l.i = q.i AND l.less = q.less AND l.word <> q.word),
m AS MATERIALIZED (SELECT p.a AS word, count(*) AS n_near, max(w.n) AS top, arg_min(w.word, struct_pack(k := -w.n, s := encode(w.word))) AS best FROM p JOIN w ON w.word = p.b GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.top >= 2 * w.n THEN m.best END AS form, CASE WHEN m.top >= 2 * w.n THEN m.top END AS form_n FROM w LEFT JOIN m USING (word)),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, chain.at AS root FROM f JOIN chain ON chain.word = f.word JOIN f AS e ON e.word = chain.at AND e.form IS NULL"""

ORACLES = {"op3_ngram_join": NGRAM_JOIN, "op7_warc": WARC, "op9_embedding_dedup": VECTORS, "op12_fill_middle": FILL_MIDDLE, "op13_spelling": SPELLING}
