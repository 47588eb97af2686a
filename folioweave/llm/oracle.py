"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_PLAIN = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_BLANK = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_HOST = r"coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_BLANK} AS w FROM documents),
win AS (SELECT r, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
lin AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (
  SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t.text) - length(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lin.l) - len(list_distinct(lin.l)) AS BIGINT) AS n_dup_lines, CAST(len(lin.l) AS BIGINT) AS n_lines, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words,
    length(t.text) - length(regexp_replace(t.text, '[A-Z]', '', 'g')) AS n_upper, length(t.text) - length(regexp_replace(t.text, '[A-Za-z]', '', 'g')) AS n_letters
  FROM t JOIN lin USING (r) LEFT JOIN hit USING (r)),
b AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 5 * word_chars THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END + CASE WHEN n_letters >= 50 AND 100 * n_upper > 45 * n_letters THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 40 * n_words OR (n_words > 0 AND word_chars < 2 * n_words) THEN 32 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits % 4 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b""",
    "op2_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark WHERE item_id IS NOT NULL),
size AS (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], chr(32)) AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM size)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], chr(32)) AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT r, iw.k, i, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)""",
    # units end at marks or line feeds; a run of repeated ones goes if it has 15 words (lines.LEAST)
    "op3_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
x AS (SELECT r, doc_id, regexp_extract_all(text, '[^.!?,;:\n]*[.!?,;:\n]+|[^.!?,;:\n]+') AS x FROM d WHERE text IS NOT NULL AND doc_id IS NOT NULL),
p AS (SELECT r, doc_id, i, x[i] AS piece FROM (SELECT r, doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM x)),
u AS (SELECT *, list_filter(regexp_split_to_array(translate(regexp_replace(piece, '[.!?,;:\n]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM p),
k AS (SELECT r, i, piece, len(w) AS n, len(w) > 0 AND row_number() OVER (PARTITION BY array_to_string(w, chr(32)) ORDER BY doc_id, i) > 1 AS again FROM u),
b AS (SELECT *, sum(CASE WHEN n > 0 AND NOT again THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM k),
s AS (SELECT *, (again OR n = 0) AND sum(CASE WHEN again THEN n ELSE 0 END) OVER (PARTITION BY r, run) >= 15 AS gone FROM b),
g AS (SELECT r, count(*) FILTER (n > 0) AS n_units, count(*) FILTER (n > 0 AND gone) AS n_removed, string_agg(piece, '' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY r)
SELECT doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (r)""",
    "op8_url_filter": rf"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
rules(h, f, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT r, h || f AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || f) DESC, length(h) DESC, v DESC) AS n FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE n = 1) AS best USING (r)""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
last AS (SELECT html, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN last.last IS NULL OR p.page_id = last.last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last.last IS NOT NULL AND p.page_id <> last.last THEN last.last END AS refers_to
FROM p LEFT JOIN last ON p.html = last.html AND p.n >= 1000""",
    # levels by whole counts; sums and products in 128 bits
    "op13_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM t)),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM s, (VALUES (1), (2), (3), (4)) AS v(k) WHERE i + k - 1 <= len(w) GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 30),
cut AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
sc AS (SELECT cut.lang, cut.phrase, a, j, l.f AS l, r.f AS r, CAST(CAST(a AS HUGEINT) * 2000000 // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM cut JOIN g l ON l.lang = cut.lang AND l.phrase = x JOIN g r ON r.lang = cut.lang AND r.phrase = y),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM sc) WHERE o = 1),
sub AS (SELECT lang, a, array_to_string(w[i:i + z - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - z + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS z FROM c WHERE k > 2))),
big AS (SELECT lang, phrase, max(a) AS longer FROM sub GROUP BY 1, 2),
kept AS (SELECT low.* FROM low LEFT JOIN big USING (lang, phrase) WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
}
