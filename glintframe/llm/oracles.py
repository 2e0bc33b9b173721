"""DuckDB SQL that gives the same rows as the queries, where SQL can."""

WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {}

SQL["op4_sharding"] = """
WITH d AS (
  SELECT doc_id, source, text, CAST(coalesce(octet_length(encode(text)), 0) + 8 AS BIGINT) AS size,
         md5('shard|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
         CAST(CAST('0x' || substr(md5('shard offset|' || coalesce(source, 'null')), 1, 5) AS BIGINT) AS DOUBLE) / 1048576 AS off
  FROM documents),
f AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size) - 1 + off)
            / CAST(count(*) OVER (PARTITION BY source) AS DOUBLE) AS fraction FROM d),
p AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source IS NULL, source, h, doc_id, size) - 1 AS position, count(*) OVER () AS total FROM f),
s AS (SELECT *, (position * 24) // total AS shard FROM p),
nibbles AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, CAST(list_reduce(range(4), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)) AS BIGINT) AS v FROM range(16) r(i))),
u AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
x AS (SELECT text, lower(hex(encode(text))) AS hx FROM u),
b AS (SELECT text, list_transform(string_split(hx, ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT)) AS n FROM x),
c AS (
  SELECT text, CASE WHEN text = '' THEN 0 ELSE xor(list_reduce(range(len(n)), lambda a, i:
      xor(t[(xor(a, n[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) & 15) + 1], a >> 4), 4294967295), 4294967295) END AS crc
  FROM b, nibbles)
SELECT s.doc_id, s.size, CAST(c.crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(s.shard AS INTEGER) AS shard,
       CAST(s.position - (s.shard * s.total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s LEFT JOIN c ON s.text = c.text
"""

SQL["op8_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS "full" FROM z),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum("full") OVER (ORDER BY "full" / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY "full" / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
k AS (SELECT arg_min(level, "full" / weight) AS lambda_ FROM l WHERE level * weight <= "full"),
t AS (SELECT source, source_size, least(coalesce(lambda_ * weight, "full"), "full") AS target FROM l LEFT JOIN k ON true),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS e,
         CAST(CAST('0x' || substr(md5('mix offset|' || coalesce(d.source, 'null')), 1, 5) AS BIGINT) AS DOUBLE) / 1048576 AS off,
         row_number() OVER (PARTITION BY d.source ORDER BY CAST(floor(log2(d.size + 1.0::DOUBLE) * 8) AS INTEGER), h, d.doc_id, d.size) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(pos * e + off) - floor((pos - 1) * e + off)) AS BIGINT) AS taken FROM r
"""

SQL["op9_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n FROM d),
s AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 12], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, n - 11)) AS p FROM n)),
m AS (SELECT k, min(doc_id) AS least FROM s GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT s.doc_id, s.p FROM s JOIN m ON s.k = m.k WHERE s.doc_id > m.least),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM hit),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
o AS (
  SELECT n.doc_id, n.n, CASE WHEN gone IS NULL THEN w ELSE
    list_transform(list_filter(list_zip(w, range(1, n.n + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept
  FROM n LEFT JOIN g ON n.doc_id = g.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM o
"""

SQL["op1_ann"] = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, b.vec_id, list_distance(q.x, b.x) AS score
  FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

SQL["op7_pq_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93),
reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, l.b FROM reach JOIN l ON reach.r = l.a),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

SQL["op3_url_filter"] = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
f AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
t AS (
  SELECT page_id, list_distinct(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x) ||
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g')) ||
    list_transform(list_filter(string_split(coalesce(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), ''), '&'), lambda x: x <> ''), lambda x: 'q:' || split_part(x, '=', 1)) ||
    CASE WHEN regexp_extract(url, '://[^#]*(#)', 1) = '#' THEN ['f:#'] ELSE [] END) AS tokens FROM p),
u AS (SELECT page_id, unnest(tokens) AS tok FROM t),
n AS (SELECT count(*) AS n FROM f),
lu AS (SELECT u.page_id, u.tok, f.verdict FROM u JOIN f USING (page_id)),
sets(page_id, verdict, s) AS (
  SELECT page_id, verdict, [tok] FROM lu
  UNION ALL SELECT l.page_id, l.verdict, list_append(s, l.tok) FROM sets JOIN lu l ON l.page_id = sets.page_id AND l.tok > s[-1]),
agg AS (SELECT s, verdict, count(*) AS both_n FROM sets GROUP BY s, verdict),
ante AS (SELECT s, sum(both_n) AS all_n FROM agg GROUP BY s),
mined AS (
  SELECT agg.s, agg.verdict, both_n / CAST(all_n AS DOUBLE) AS conf, both_n,
         row_number() OVER (ORDER BY both_n / CAST(all_n AS DOUBLE) DESC, both_n DESC, len(agg.s), array_to_string(agg.s, ' ')) AS k
  FROM agg JOIN ante ON agg.s = ante.s, n WHERE both_n >= greatest(2, ceil(0.01 * n)) AND both_n / CAST(all_n AS DOUBLE) >= 0.6),
fire AS (
  SELECT t.page_id, arg_min(m.verdict, m.k) AS verdict FROM t JOIN mined m ON list_has_all(t.tokens, m.s) GROUP BY t.page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, fire.verdict, 'allow') AS verdict
FROM p LEFT JOIN f ON f.page_id = p.page_id LEFT JOIN fire ON fire.page_id = p.page_id
"""

SQL["op2_ngram_jaccard"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 90 * (x.n + y.n - o.o)),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, l.b FROM reach JOIN l ON reach.r = l.a),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLAIN_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PLAIN}')"

SQL["op12_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN_WORDS} AS w FROM benchmark),
x AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda p: array_to_string(w[p : p + 9], ' '))) AS k, least(len(w), 10) AS l FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT l FROM x),
s AS (SELECT doc_id, l, p, array_to_string(w[p : p + l - 1], ' ') AS k FROM (SELECT doc_id, l, w, unnest(range(1, len(w) - l + 2)) AS p FROM d, lens)),
hit AS (SELECT DISTINCT s.doc_id, s.p, s.l, x.item_id FROM s JOIN x ON s.k = x.k),
i AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id),
h AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + l)) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""

SQL["op13_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_PLAIN_WORDS} AS w FROM documents),
c AS (SELECT row, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
t AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM c),
q AS (SELECT DISTINCT item_id, unnest({_PLAIN_WORDS}) AS term FROM benchmark),
p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM c) WHERE term IN (SELECT term FROM q) GROUP BY row, term),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), t),
s AS (
  SELECT q.item_id, p.row, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p ON q.term = p.term JOIN f ON f.term = q.term JOIN c ON c.row = p.row, t GROUP BY q.item_id, p.row),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s JOIN c ON s.row = c.row WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""
