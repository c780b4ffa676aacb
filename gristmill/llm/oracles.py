"""DuckDB SQL for the queries of this folder that SQL can express, over whole tables."""

from __future__ import annotations

from .common import WORD
from .license_scan import TEMPLATES
from .quality_rules import RULES as QUALITY_RULES
from .quality_rules import tightening
from .url_filter import BASE, CANONICAL, HREF, PARTS, REFRESH, TARGET
from .url_filter import RULES as URL_RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TOP_K = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, max(list_dot_product(a.q, b.q)::BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0 GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

NEAR = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b USING (sh) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (SELECT u AS d, v AS r FROM e UNION SELECT reach.d, e.v FROM reach JOIN e ON e.u = reach.r),
c AS (SELECT d, min(r) AS c FROM reach GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(c.c, w.doc_id), w.doc_id) AS component_id,
  coalesce(least(c.c, w.doc_id), w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.d = w.doc_id
"""


def url_sql() -> str:
    rules = ", ".join(f"({quoted(r.split('/', 1)[0])}, {quoted('/' + r.split('/', 1)[1])}, {quoted(r)}, {quoted(v)})" for v, r in URL_RULES)
    part = lambda url, i: f"coalesce(regexp_extract({url}, {quoted(PARTS)}, {i}), '')"
    host = lambda url: f"translate({part(url, 1)}, '{UPPER}', '{LOWER}')"
    key = lambda url: f"CASE WHEN {part(url, 1)} <> '' THEN concat({host(url)}, chr(10), {part(url, 2)}, chr(10), {part(url, 3)}) END"
    dots = lambda p: f"""array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(regexp_replace({p}, '(/\\.\\.?)$', '\\1/'), '/'), lambda s: [s])),
      lambda a, x: CASE WHEN x = ['..'] THEN a[:greatest(len(a) - 1, 1)] WHEN x = ['.'] THEN a ELSE a || x END), '/')"""  # noqa: E731
    root = lambda base: f"regexp_extract({base}, '(?s)^(.*?://[^/?#]*)', 1)"
    path = lambda base: f"coalesce(nullif({part(base, 2)}, ''), '/')"
    absolute = lambda t, base: f"""CASE WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN contains({t}, '://') THEN {t} END
      WHEN starts_with({t}, '//') THEN regexp_extract({base}, '(?s)^(.*?):', 1) || ':' || {t} WHEN {t} = '' OR starts_with({t}, '#') THEN NULL
      WHEN starts_with({t}, '?') THEN {root(base)} || {path(base)} || {t}
      ELSE {root(base)} || {dots(f"CASE WHEN starts_with({t}, '/') THEN '' ELSE regexp_extract({path(base)}, '(?s)^(.*/)', 1) END || regexp_extract({t}, '(?s)^([^?#]*)', 1)")} || regexp_extract({t}, '(?s)([?#].*)$', 1) END"""  # noqa: E731
    href, target = quoted(HREF), quoted(TARGET)
    return f"""
WITH RECURSIVE rules(h, p, rule, verdict) AS (VALUES {rules}), links AS (
  SELECT url, regexp_extract(regexp_extract(html, {quoted(BASE)}), {href}, 1) AS told, unnest(list_concat(list_transform(regexp_extract_all(html, {quoted(CANONICAL)}), lambda t: regexp_extract(t, {href}, 1)),
    list_transform(regexp_extract_all(html, {quoted(REFRESH)}), lambda t: regexp_extract(t, {target}, 1)))) AS t
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL
), based AS (SELECT url, t, coalesce({absolute('told', 'url')}, url) AS base FROM links), made AS (
  SELECT url AS a, {absolute('t', 'base')} AS b FROM based
), ends AS (SELECT a, b, {key('a')} AS u, {key('b')} AS v FROM made WHERE contains(b, '://')),
edges AS (SELECT u, v FROM ends WHERE u <> v UNION SELECT v, u FROM ends WHERE u <> v),
reach AS (SELECT u AS x, v AS y FROM edges UNION SELECT reach.x, edges.v FROM reach JOIN edges ON edges.u = reach.y),
urls AS (SELECT DISTINCT url FROM (SELECT a AS url FROM ends WHERE u <> v UNION ALL SELECT b FROM ends WHERE u <> v UNION ALL SELECT url FROM pages)),
parts AS (SELECT url, {host('url')} AS host, {part('url', 2)} AS path, {key('url')} AS k FROM urls),
fit AS (
  SELECT url, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict FROM parts JOIN rules r
  ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY url
), per AS (
  SELECT x, bool_or(verdict = 'allow') AS good, bool_or(verdict = 'block') AS bad FROM (
    SELECT reach.x, fit.verdict FROM reach JOIN parts ON parts.k = reach.y JOIN fit USING (url)) GROUP BY x
)
SELECT pages.page_id, coalesce(parts.host, '') AS host, coalesce(parts.path, '') AS path, fit.rule,
  coalesce(fit.verdict, CASE WHEN per.good THEN 'allow' WHEN per.bad THEN 'block' END, 'allow') AS verdict
FROM pages LEFT JOIN parts ON parts.url = pages.url LEFT JOIN fit ON fit.url = pages.url LEFT JOIN per ON per.x = parts.k
"""


def rules_sql(risk: float = 0.05, delta: float = 0.05) -> str:
    path = tightening()
    rows = ", ".join(f"('{m}', {str(high).lower()}, {at[r]}::DOUBLE, {i})" for i, at in enumerate(path) for r, m, high, _ in QUALITY_RULES)
    return f"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS x FROM w WHERE len(w) >= 8
), twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(8) AS o(j) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT x) AS d FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '{WORD}') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, stratum, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines - d, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN lines USING (doc_id)
), s AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), v AS (
  SELECT doc_id, stratum, base_failed, unnest(['symbols_per_word', 'dup_line_share', 'repeat_share', 'chars_per_word']) AS measure,
    unnest([coalesce(n_symbols / nullif(n_words, 0), 0), coalesce(n_dup_lines / nullif(n_lines, 0), 0), coalesce(n_repeat_words / nullif(n_words, 0), 0), coalesce(word_chars / nullif(n_words, 0), 0)]) AS x FROM s
), tests(measure, high, cutoff, step) AS (VALUES {rows}),
rejected AS (SELECT doc_id, step FROM v JOIN tests USING (measure) GROUP BY doc_id, step HAVING bool_or(CASE WHEN high THEN x > cutoff ELSE x < cutoff END)),
good AS (SELECT s.doc_id, stratum FROM s JOIN labels USING (doc_id) WHERE NOT base_failed GROUP BY ALL HAVING min(quality) = 1),
n AS (SELECT stratum, count(*) AS n FROM good GROUP BY stratum),
k AS (SELECT stratum, any_value(n) AS n, step, count(rejected.doc_id) AS k FROM n JOIN good USING (stratum) CROSS JOIN range({len(path)}) AS steps(step) LEFT JOIN rejected USING (doc_id, step) GROUP BY stratum, step),
tail AS (
  SELECT *, CASE WHEN k >= n * {risk} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - (CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk})))) END AS tail
  FROM k
), ends AS (SELECT stratum, coalesce(min(step) FILTER (WHERE tail > {delta} / (SELECT count(*) FROM n)), {len(path)}) AS first_failure FROM tail GROUP BY stratum),
bad AS (SELECT doc_id FROM rejected JOIN s USING (doc_id) JOIN ends USING (stratum) WHERE step = first_failure - 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept, stratum
FROM s LEFT JOIN bad USING (doc_id)
"""


LINES = """
WITH blanks AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS b),
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL
), h AS (SELECT doc_id, i, trim(x, b) AS x FROM l, blanks WHERE trim(x, b) <> ''), w AS (
  SELECT doc_id, i AS st, lead(i, 2) OVER o AS en, x AS a, lead(x, 1) OVER o AS b, lead(x, 2) OVER o AS c FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), f AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, st) AS n FROM w WHERE en IS NOT NULL),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM f JOIN l ON l.doc_id = f.doc_id AND l.i BETWEEN f.st AND f.en WHERE f.n > 1),
per AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, string_agg(l.x, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS kept
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN n_removed > 0 THEN coalesce(kept, '') ELSE d.text END AS text
FROM documents d LEFT JOIN per USING (doc_id)
"""


def license_sql(threshold: float = 0.8) -> str:
    rows = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(TEMPLATES))
    pairs = lambda x: f"list_distinct(list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1]))"
    words = lambda x: f"regexp_extract_all(translate({x}, '{UPPER}', '{LOWER}'), '[a-z0-9]+')"
    return f"""
WITH t(ord, license, notice) AS (VALUES {rows}), tw AS (SELECT ord, license, {words('notice')} AS w FROM t),
tb AS (SELECT ord, license, {pairs('w')} AS g FROM tw), tg AS (SELECT ord, license, len(g) AS n, unnest(g) AS b FROM tb),
u AS (
  SELECT doc_id, unnest(range(0, len(string_split(text, chr(10)))))::INTEGER AS line, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, -1, text FROM documents WHERE contains(text, chr(10))
), uw AS (SELECT doc_id, line, {words('x')} AS w FROM u), ub AS (SELECT doc_id, line, {pairs('w')} AS g FROM uw),
ug AS (SELECT doc_id, line, len(g) AS n, unnest(g) AS b FROM ub),
hit AS (
  SELECT doc_id, line, ord, license, 2.0::DOUBLE * count(*) / (ug.n + tg.n) AS dice FROM ug JOIN tg USING (b)
  GROUP BY doc_id, line, ord, license, ug.n, tg.n HAVING 2.0::DOUBLE * count(*) / (ug.n + tg.n) >= {threshold}::DOUBLE
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, ord, line) AS r, FROM hit
), n AS (SELECT doc_id, count(DISTINCT line) AS n_hits FROM hit GROUP BY doc_id)
SELECT d.doc_id, license, ord::INTEGER AS template, round(coalesce(dice, 0), 6)::DOUBLE AS dice, line, coalesce(n_hits, 0) AS n_hits
FROM documents d LEFT JOIN best ON best.doc_id = d.doc_id AND best.r = 1 LEFT JOIN n ON n.doc_id = d.doc_id
"""


SQL = {"op1_topk_search": TOP_K, "op3_minhash_dedup": NEAR, "op7_url_filter": url_sql(), "op8_quality_rules": rules_sql(), "op9_line_dedup": LINES, "op10_license_scan": license_sql()}
