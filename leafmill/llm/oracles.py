"""SQL for the queries that SQL can express exactly, over the same tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Smallest id reachable over the symmetric pairs of a relation `links(a, b)`, from the nodes of `nodes(id)`.
_REACH = """reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS l FROM documents),
  words AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM w),
  windows AS (SELECT doc_id, i, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), ' ') AS k, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n FROM words),
  ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows WHERE n = 20),
  gone AS (SELECT DISTINCT doc_id, i + j AS i FROM ranked, range(0, 20) AS t(j) WHERE r > 1),
  kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(l)::BIGINT AS n_words, (len(l) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS l FROM documents),
  words AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM w WHERE len(l) >= 5),
  runs AS (SELECT doc_id, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ' ') AS k, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS n FROM words),
  shingles AS (SELECT DISTINCT doc_id, k FROM runs WHERE n = 5 UNION ALL SELECT doc_id, array_to_string(l, ' ') FROM w WHERE len(l) BETWEEN 1 AND 4),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
  shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
  nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT r.id AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reach r LEFT JOIN sizes ON sizes.doc_id = r.id GROUP BY r.id"""

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
  links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) >= 0.98::DOUBLE * x.n * y.n),
  nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT r.id AS vec_id, (SELECT count(*) FROM links WHERE a = r.id) AS n_links, min(other) AS component_id, min(other) = r.id AS kept FROM reach r GROUP BY r.id"""

_FAR = "list_sum(list_transform(list_zip(p, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_ASSIGN = "{out} AS (SELECT r, j, any_value(p) AS p, min({far} * 64 + k) AS z FROM parts JOIN {books} USING (j) GROUP BY r, j)"
_UPDATE = """{out} AS (SELECT {books}.j, {books}.k, coalesce(m, {books}.e) AS e FROM {books} LEFT JOIN (SELECT j, k, list(floor_mean ORDER BY i) AS m FROM (
    SELECT j, z % 64 AS k, i, (CASE WHEN sum(x) < 0 THEN -((count(*) - 1 - sum(x)) // count(*)) ELSE sum(x) // count(*) END)::BIGINT AS floor_mean FROM (SELECT j, z, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM {found}) GROUP BY ALL) GROUP BY ALL) means ON means.j = {books}.j AND means.k = {books}.k)"""
CODES = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  ranked AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS r, len(v) // 16 AS w FROM kept),
  parts AS MATERIALIZED (SELECT r, j, v[j * w + 1:(j + 1) * w] AS p FROM ranked, range(0, 16) AS t(j)),
  book0 AS MATERIALIZED (SELECT j, r - 1 AS k, p AS e FROM parts WHERE r <= 64),
  {_ASSIGN.format(out="found0", books="book0", far=_FAR)}, {_UPDATE.format(out="book1", books="book0", found="found0")},
  {_ASSIGN.format(out="found1", books="book1", far=_FAR)}, {_UPDATE.format(out="book2", books="book1", found="found1")},
  {_ASSIGN.format(out="found2", books="book2", far=_FAR)},
  codes AS (SELECT r, string_agg(format('{{:02x}}', z % 64), '' ORDER BY j) AS code, sum(z // 64)::BIGINT AS error FROM found2 GROUP BY r),
  flat AS (SELECT j, k, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM book2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY j, k, i)) FROM flat) AS codebooks_sha256
FROM ranked JOIN codes USING (r)"""

_SHARE = "(1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY {by}) + 2 * count(*) OVER (PARTITION BY {by})))::BIGINT"
DIVERGENCE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
  words AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
  vocab AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 10), groups AS (SELECT DISTINCT lang, source FROM docs),
  counts AS (SELECT lang, source, term, count(*) AS k FROM words SEMI JOIN vocab USING (lang, term) GROUP BY ALL),
  dense AS (SELECT lang, source, term, coalesce(k, 0) AS n FROM groups JOIN vocab USING (lang) LEFT JOIN counts USING (lang, source, term)),
  own AS (SELECT *, {_SHARE.format(by="lang, source")} AS p FROM dense), whole AS (SELECT lang, term, {_SHARE.format(by="lang")} AS q FROM (SELECT lang, term, sum(n) AS n FROM dense GROUP BY ALL)),
  pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN own x ON x.lang = a.lang AND x.source = a.source LEFT JOIN own y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
  terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
  ranked AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM ranked QUALIFY part = 'pair' OR rank <= 10"""
