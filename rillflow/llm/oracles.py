"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from rillflow.llm.quality_rules import STOP_WORDS

_LOWER = {w for words in STOP_WORDS.values() for w in words.split()}
_STOPS = ", ".join(f"'{w}'" for w in sorted(_LOWER | {w.capitalize() for w in _LOWER}))

OP2 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 4], ' ') AS g FROM i),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""

OP3 = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, unnest(range(len(w) - 2)) AS i, w FROM t WHERE len(w) >= 3),
h AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM h) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         len(list_filter(w, lambda x: x IN ({_STOPS}))) AS n_stop, coalesce(p.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN p ON p.doc_id IS NOT DISTINCT FROM t.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words <= 1000000
         AND word_chars::DOUBLE / greatest(n_words, 1) BETWEEN 2.0 AND 12.0 AND n_symbols::DOUBLE / greatest(n_words, 1) <= 0.25
         AND n_stop::DOUBLE / greatest(n_words, 1) >= 0.02 AND n_dup_lines::DOUBLE / greatest(n_lines, 1) <= 0.5 AS kept
FROM m
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, h, sha1(h) AS x, octet_length(encode(h)) AS n, min(page_id) OVER (PARTITION BY h) AS first FROM p),
d AS (SELECT *, list_transform(range(32), lambda i: ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::INTEGER >> (5 * (3 - i % 4))::INTEGER) & 31)) AS v FROM s)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(v, lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', c + 1, 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d
"""

OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i + 1:i + 10], ' ') AS k FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS k FROM di),
h AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, k)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items, sha256(coalesce(it.s, '')) AS items_sha256,
       coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i + 1:i + 50], ' ')) AS k FROM i),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM g) WHERE m < doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM r),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM u ANTI JOIN x ON u.doc_id = x.doc_id AND u.p = x.p GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

# Without a budget the exponent has a closed form: the ratio of extreme shares, raised to 1 - exponent, is the limit of 2 (or less, if it is so as it is).
OP9 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS s,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens,
         ('0x' || substr(md5('0/' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 1024 AS b
  FROM documents),
k AS (SELECT s, b, sum(n_tokens)::BIGINT AS size FROM d GROUP BY ALL),
v AS (SELECT s, sum(size)::BIGINT AS avail FROM k GROUP BY s),
x AS (SELECT greatest(0.0, 1 - ln(2.0) / nullif(ln(max(avail)::DOUBLE / min(avail)), 0)) AS a, sum(avail)::DOUBLE AS total FROM v WHERE avail > 0),
z AS (SELECT s, avail, pow(avail / total, coalesce(a, 1.0)) AS z FROM v, x WHERE avail > 0),
m AS (SELECT max(avail / z) AS m FROM z),
g AS (SELECT s, avail, round(z * m)::BIGINT AS goal FROM z, m),
f AS (SELECT s, goal // avail AS full_, goal % avail AS rest FROM g),
p0 AS (SELECT k.*, coalesce(full_, 1) AS full_, coalesce(rest, 0) AS rest FROM k LEFT JOIN f USING (s)),
p1 AS (SELECT *, ('0x' || substr(md5('0/' || full_ || '/' || s || '/' || b), 1, 8))::BIGINT AS r FROM p0),
p AS (SELECT s, b, size, full_, rest, rest - coalesce(sum(size) OVER (PARTITION BY s ORDER BY r, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM p1),
j AS (SELECT d.*, full_, left_, left_ >= size AND rest > 0 AS whole,
             sum(n_tokens) OVER (PARTITION BY s, b ORDER BY ('0x' || substr(md5('0/d/' || full_ || '/' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT, doc_id, md5(t)
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN p USING (s, b)),
c AS (SELECT *, full_ + CASE WHEN whole OR left_ > 0 AND upto <= left_ THEN 1 ELSE 0 END AS copies FROM j),
e AS (SELECT *, unnest(range(copies::BIGINT)) AS epoch FROM c)
SELECT doc_id, source, n_tokens, epoch::INTEGER AS epoch, ('0x' || substr(md5('0/' || epoch || '/' || s || '/' || b), 1, 8))::BIGINT AS block_rank FROM e
"""

OP11 = """
WITH v AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= 5
"""

OP12 = f"SELECT *, doc_id = component_id AS kept FROM ({OP2.replace('len(w) - 3', 'len(w) - 4').replace('[i + 1:i + 4]', '[i + 1:i + 5]')})"

OP13 = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, source, n_chars, text,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))) AS c
  FROM documents),
f AS (
  SELECT *, concat(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'), coalesce(octet_length(encode(lang)) || ':' || lang, '-'),
         coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')) AS head,
         CASE WHEN xor(c, 4294967295::BIGINT) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS low
  FROM d),
h AS (SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) AS bad FROM f),
l AS MATERIALIZED (SELECT *, coalesce(lang, '') AS g, lang IS NOT NULL AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM h),
u AS (SELECT k, g, 0 AS level, pos, n, leaf AS h FROM l
  UNION ALL SELECT k, g, level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY k, g, level, pos // 8),
um AS MATERIALIZED (SELECT * FROM u),
s AS MATERIALIZED (SELECT k, g, h AS subroot, level, row_number() OVER (ORDER BY k, encode(g)) - 1 AS rank, count(*) OVER () AS n FROM um WHERE n = 1),
t AS (SELECT 0 AS level, rank AS pos, n, subroot AS h FROM s
  UNION ALL SELECT level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY level, pos // 8),
tm AS MATERIALIZED (SELECT * FROM t),
a AS (SELECT k, g, level, pos, h FROM um WHERE n > 1 UNION ALL SELECT s.k, s.g, s.level + tm.level, tm.pos, tm.h FROM s, tm WHERE tm.n > 1),
w AS MATERIALIZED (SELECT k, g, level, pos // 8 AS up, list(h ORDER BY pos) AS run FROM a GROUP BY ALL),
c AS (SELECT k, g, pos AS leaf_pos, 0 AS level, pos, bad AS fold, '' AS proof FROM l
  UNION ALL
  SELECT c.k, c.g, c.leaf_pos, c.level + 1, CASE WHEN c.level + 1 = s.level THEN s.rank ELSE c.pos // 8 END,
         sha256(array_to_string(w.run[1:p], '') || c.fold || array_to_string(w.run[p + 2:], '')), c.proof || array_to_string(w.run[1:p], '') || array_to_string(w.run[p + 2:], '')
  FROM (SELECT c.*, x.level AS own, x.rank, CASE WHEN c.level = x.level THEN x.rank ELSE c.pos END AS q, q % 8 AS p FROM c JOIN s x ON x.k = c.k AND x.g = c.g) c
  JOIN s ON s.k = c.k AND s.g = c.g JOIN w ON w.k = c.k AND w.g = c.g AND w.level = c.level AND w.up = c.q // 8),
e AS (SELECT k, g, leaf_pos, max_by(fold, level) AS fold, max_by(proof, level) AS proof FROM c GROUP BY ALL),
r AS (SELECT h AS root FROM tm WHERE n = 1)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(e.proof) AS proof_sha256, e.fold AS folded_root, e.fold = r.root AS verified
FROM l JOIN e ON e.k = l.k AND e.g = l.g AND e.leaf_pos = l.pos JOIN s ON s.k = l.k AND s.g = l.g, r
"""

ORACLES: dict[str, str] = {"op2_ngram_join": OP2, "op3_quality_rules": OP3, "op7_warc_revisits": OP7, "op8_decontamination": OP8, "op9_source_mixing": OP9, "op10_passage_dedup": OP10, "op11_hard_negatives": OP11, "op12_minhash_dedup": OP12, "op13_merkle_manifest": OP13}
