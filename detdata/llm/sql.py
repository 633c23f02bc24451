"""DuckDB twins of those queries that SQL can express."""

LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x20\x09-\x0D]+'"

OP3 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce({LOWERED}, ''), {WORD}) AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 85 * (na.n + nb.n - x)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id FROM n JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)
"""

# lines with a word, normalised; a document's signature is its sorted distinct lines
OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
l AS (SELECT r, host, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORD})) AS l FROM d),
win AS (SELECT r, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS x FROM d),
pos AS (SELECT r, unnest(x) AS x, generate_subscripts(x, 1) AS p FROM win),
twice AS (SELECT r, p FROM pos JOIN (SELECT r, x FROM pos GROUP BY 1, 2 HAVING count(*) > 1) USING (r, x)),
cov AS (SELECT r, count(DISTINCT p + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
k AS (SELECT r, host, list_transform(l, lambda x: regexp_replace(lower(trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), '[0-9]+', '0', 'g')) AS k, list_transform(l, lambda x: len(regexp_extract_all(x, {WORD}))) AS n FROM l),
ln AS (SELECT r, host, array_to_string(list_sort(list_distinct(k)), chr(10)) AS sig, unnest(k) AS k, unnest(n) AS n FROM k),
cm AS (SELECT host, k FROM ln GROUP BY 1, 2 HAVING count(DISTINCT sig) > 20),
gone AS (SELECT r, sum(n)::BIGINT AS g FROM ln JOIN cm USING (host, k) GROUP BY 1),
base AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(g, 0)::BIGINT AS n_boilerplate_words FROM d JOIN l USING (r) LEFT JOIN cov USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_boilerplate_words >= n_words * 0.3::DOUBLE AS kept FROM base
"""

OP4 = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
c AS (SELECT k FROM k WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE c.k IS NOT NULL)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.k = c.k GROUP BY doc_id
"""


def _op2(steps: int = 8, damping: float = 0.85, threshold: float = 1e-6) -> str:
    walk = ""
    for i in range(1, steps + 1):
        before = "SELECT kind, host, p * (1 - {d}) AS score FROM st" if i == 1 else f"SELECT kind, host, sum(score) AS score FROM (SELECT * FROM m{i - 1} UNION ALL SELECT kind, host, p * (1 - {damping}) FROM st) GROUP BY 1, 2"
        walk += f", m{i} AS (SELECT r.kind, s.dst AS host, {damping} * sum(r.score * s.w) AS score FROM ({before.format(d=damping)}) r JOIN s USING (kind, host) GROUP BY 1, 2)"
    return rf"""
WITH d AS (SELECT page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM d),
g AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS says FROM f),
e AS (SELECT host AS src, translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst, count(*) AS n FROM (
  SELECT host, unnest(list_distinct(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1))) AS dst FROM g) WHERE host <> '' AND host <> translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') GROUP BY 1, 2),
s AS (SELECT 'trust' AS kind, src AS host, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM e UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM e),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE says = 'allow') AS a, count(*) FILTER (WHERE says = 'block') AS b FROM g WHERE host <> '' GROUP BY 1),
seed AS (SELECT 'trust' AS kind, host, a AS m FROM h WHERE 2 * a > n UNION ALL SELECT 'distrust', host, b FROM h WHERE 2 * b > n),
st AS (SELECT kind, host, m / sum(m) OVER (PARTITION BY kind) AS p FROM seed){walk},
t AS (SELECT host, sum(score) FILTER (WHERE kind = 'trust') AS trust, sum(score) FILTER (WHERE kind = 'distrust') AS distrust FROM m{steps} GROUP BY 1)
SELECT page_id, g.host, path, rule, coalesce(says, CASE WHEN coalesce(distrust, 0) > {threshold} AND coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0)::DOUBLE AS trust, coalesce(distrust, 0)::DOUBLE AS distrust FROM g LEFT JOIN t ON g.host = t.host
"""


OP2 = _op2()

# units before a place are a list's first ones
OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi FROM h),
p AS (SELECT *, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid, array_to_string(u[hi + 1:], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

# every group with every kept term
OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, unnest(list_concat([NULL], regexp_extract_all(coalesce({LOWERED}, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'))) AS t FROM documents),
k AS (SELECT lang, t, count(*) AS ln FROM d WHERE t IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, t, count(*) AS c FROM d JOIN k USING (lang, t) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v, sum(ln) AS ln FROM k GROUP BY 1),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.t, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(n.n, 0) + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.ln + 5)) // (v.ln + 5 * v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS s FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.s, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', t, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u) WHERE part = 'pair' OR rank <= 50
"""
