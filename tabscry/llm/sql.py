"""DuckDB SQL that must give the same rows as the registered queries."""

from tabscry.llm.urlrep import TWO_LABEL_SUFFIXES

TWO_LABELS = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _level(name: str, above: str) -> str:
    """CTEs for one level of the reputation: sums, strength of the prior, posterior."""
    return f"""
g_{name} AS (SELECT {name}, sum(n)::DOUBLE AS gn, sum(k)::DOUBLE AS gk, any_value(prior) AS m FROM {above} GROUP BY {name}),
s_{name} AS (SELECT 1 / least(greatest(coalesce(
    (sum(pow(gk - gn * m, 2)) - sum(gn * m * (1 - m))) / nullif(sum(gn * (gn - 1) * m * (1 - m)), 0), 0), 0.001), 0.5) - 1 AS s FROM g_{name}),
p_{name} AS (SELECT {name}, gn, gk, m, s, (gk + s * m) / (gn + s) AS post FROM g_{name}, s_{name}),"""


OP7 = f"""
WITH cutup AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cutup),
marks AS (SELECT doc_id AS page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM labels),
counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM parts LEFT JOIN marks USING (page_id) GROUP BY host),
named AS (SELECT *, string_split(host, '.') AS l FROM counted),
l0 AS (
  SELECT host, n, k, CASE WHEN array_to_string(l[-2:], '.') IN ({TWO_LABELS}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
         CASE WHEN array_to_string(l[-2:], '.') IN ({TWO_LABELS}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
         (SELECT (sum(k) + 1)::DOUBLE / (sum(n) + 2) FROM counted) AS prior
  FROM named),{_level("suffix", "l0")}
l1 AS (SELECT host, n, k, domain, post AS prior FROM l0 JOIN p_suffix USING (suffix)),{_level("domain", "l1")}
l2 AS (SELECT host, n, k, post AS prior FROM l1 JOIN p_domain USING (domain)),{_level("host", "l2")}
ab AS (SELECT host, post, gk + s * m AS a, gn - gk + s * (1 - m) AS b FROM p_host),
low AS (SELECT host, post - sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) AS low FROM ab),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN low >= 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN low USING (host)
"""

OP8 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p : p + 9], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM g),
dw AS (
  SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS gram
  FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT doc_id, dw.size, p, item_id FROM dw JOIN g USING (size, gram)),
nh AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM h) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)
"""

OP10 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - 48)) AS p FROM w WHERE len(w) >= 50)),
m AS (SELECT g, min(doc_id) AS m FROM g GROUP BY g),
x AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM g JOIN m USING (g) WHERE doc_id > m),
t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS q FROM w),
k AS (SELECT doc_id, string_agg(w[q], ' ' ORDER BY q) AS kept, count(*) AS n FROM t ANTI JOIN x USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

OP3 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
st AS (SELECT count(*) AS n, sum(len(w))::DOUBLE / count(*) AS mean FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (
  SELECT doc_id AS query_id, term, df FROM tf JOIN df USING (term) WHERE doc_id % 20 = 0),
s AS (
  SELECT query_id, tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))), 6) AS score
  FROM q JOIN tf USING (term) JOIN d ON d.doc_id = tf.doc_id, st GROUP BY query_id, tf.doc_id)
SELECT query_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""

OP11 = OP1.replace(">= 85 *", ">= 80 *").replace(""" AS component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) AS kept""", " AS component_id")

OP12 = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^.,;:!?\x0A-\x0D]+') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, size, w[pos : pos + size - 1] AS g, count(*) AS f
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM p, range(1, 6) AS s(size) WHERE len(w) >= size)
  GROUP BY ALL HAVING count(*) >= 100),
c AS (
  SELECT x.lang, x.size, x.g, x.f AS a, y.f AS l, z.f AS r, n, k,
         (1000::HUGEINT * x.f * n) // (y.f::HUGEINT * z.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM g WHERE size > 1) x
  JOIN g y ON y.lang = x.lang AND y.g = x.g[1 : k] JOIN g z ON z.lang = x.lang AND z.g = x.g[k + 1 : x.size] JOIN t ON t.lang = x.lang
  QUALIFY row_number() OVER (PARTITION BY x.lang, x.g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, g[i : j] AS g, max(f) AS most
  FROM (SELECT *, unnest(range(i + 1, size + 1)) AS j FROM (SELECT *, unnest(range(1, size)) AS i FROM g WHERE size > 2))
  WHERE j - i + 1 < size GROUP BY ALL),
kept AS (
  SELECT c.*, array_to_string(c.g, ' ') AS phrase FROM c LEFT JOIN inside ON inside.lang = c.lang AND inside.g = c.g WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""

OP13 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
st AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
m AS (SELECT doc_id, 100 - 25 + ((25 * len(w) * n) // l) AS m FROM d, st),
s AS (
  SELECT item_id, doc_id, sum(times * wt.w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN wt USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
