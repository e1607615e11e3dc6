"""DuckDB statements with the same rows as the text queries, where SQL can say them."""

from __future__ import annotations

from specband.llm.quality_rules import BOILERPLATE, SYMBOLS, Rules

SPLIT = r"[\x20\x09-\x0D]+"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def words(table: str, key: str, text: str = "coalesce(text, '')", split: str = SPLIT) -> str:
    return f"SELECT {key}, list_filter(string_split_regex({text}, '{split}'), lambda x: x <> '') AS ws FROM {table}"


NGRAM_JOIN = f"""
WITH RECURSIVE w AS ({words('documents', 'doc_id', f"translate(coalesce(text, ''), {AZ})")}),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
d AS (SELECT DISTINCT doc_id, g FROM s), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM d a JOIN d b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
e2 AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id AS s, doc_id AS u FROM documents UNION SELECT r.s, e2.v FROM r JOIN e2 ON r.u = e2.u),
m AS (SELECT u AS doc_id, min(s) AS component_id FROM r GROUP BY u)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""

WORD_PASSAGES = f"""
WITH w AS ({words('documents', 'doc_id')}),
x AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS g FROM w WHERE len(ws) >= 13),
m AS (SELECT g, min(doc_id) AS m FROM x GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM x JOIN m USING (g), range(13) AS t(k) WHERE m < doc_id),
wl AS (SELECT doc_id, unnest(ws) AS t, unnest(range(1, len(ws) + 1)) AS p FROM w),
o AS (SELECT wl.doc_id, count(gone.p) AS n_removed, string_agg(t, ' ' ORDER BY wl.p) FILTER (WHERE gone.p IS NULL) AS kept
      FROM wl LEFT JOIN gone ON gone.doc_id = wl.doc_id AND gone.p = wl.p GROUP BY wl.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN o ON o.doc_id = w.doc_id
"""

BYTE_STRINGS = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents),
x AS (SELECT doc_id, i, substring(b, 2 * i + 1, 100) AS g, substring(b, 2 * i + 1, 2) AS c FROM (SELECT doc_id, b, unnest(range(0, length(b) // 2)) AS i FROM h)),
m AS (SELECT g, min(doc_id) AS m FROM x WHERE length(g) = 100 GROUP BY g),
f AS (SELECT x.doc_id, x.i, x.c, max(CASE WHEN m.m < x.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
      FROM x LEFT JOIN m ON m.g = x.g),
l AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM f),
o AS (SELECT doc_id, sum(gone) AS n_removed, sum(CASE WHEN gone = 1 AND before = 0 THEN 1 ELSE 0 END) AS n_spans,
      string_agg(c, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM l GROUP BY doc_id)
SELECT h.doc_id, CAST(length(b) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN o ON o.doc_id = h.doc_id
"""

CONTAMINATION = rf"""
WITH bw AS ({words('benchmark', 'item_id', f"translate(coalesce(text, ''), {AZ})", r'[\x00-\x2F\x3A-\x60\x7B-\x7F]+')}),
bg AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(ws)) AS n,
       unnest(list_transform(range(1, len(ws) - least(10, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(10, len(ws)) - 1], ' '))) AS g FROM bw WHERE len(ws) > 0),
dw AS ({words('documents', 'doc_id', f"translate(coalesce(text, ''), {AZ})", r'[\x00-\x2F\x3A-\x60\x7B-\x7F]+')}),
dg AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g
       FROM dw, (SELECT DISTINCT n FROM bg) WHERE len(ws) >= n),
hit AS (SELECT DISTINCT dg.doc_id, dg.i, dg.n, bg.item FROM dg JOIN bg ON bg.n = dg.n AND bg.g = dg.g),
wd AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), range(10) AS t(k) WHERE k < n GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN wd ON wd.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id
"""

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {AZ}) AS t FROM documents),
x AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
z AS (SELECT lang, count(*) AS size, sum(n) AS whole FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM x GROUP BY ALL),
f AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.n AS n_lang FROM g JOIN v ON v.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
s AS (SELECT lang, source, sum(n) AS total FROM f GROUP BY lang, source),
p AS (SELECT f.lang, f.source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (total + 5 * size) AS p, 1 + 1000000000::HUGEINT * (n_lang + 5) // (whole + 5 * size) AS q
      FROM f JOIN s ON s.lang = f.lang AND s.source = f.source JOIN z ON z.lang = f.lang),
e AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(e.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o QUALIFY part = 'pair' OR rank <= 50
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.r AS u, b.r AS w FROM ok a JOIN ok b ON a.r < b.r AND list_cosine_similarity(a.e, b.e) >= 0.9),
e AS (SELECT u, w FROM p UNION ALL SELECT w, u FROM p),
n AS (SELECT u AS r, count(*) AS n FROM e GROUP BY u),
x AS (SELECT r AS s, r AS u FROM v UNION SELECT x.s, e.w FROM x JOIN e ON x.u = e.u),
m AS (SELECT x.s AS r, min(v.vec_id) AS low FROM x JOIN v ON v.r = x.u GROUP BY x.s)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.low AS component_id, v.vec_id = m.low AS kept FROM v JOIN m ON m.r = v.r LEFT JOIN n ON n.r = v.r
"""


def quality(r: Rules = Rules()) -> str:
    boiler = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)
    symbols = lambda c: f"(length({c}) - length(translate({c}, '{SYMBOLS}', '')))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS ({words('d', 'doc_id', 't')}),
tri AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS g FROM w WHERE len(ws) >= 3),
twice AS (SELECT doc_id, g FROM tri GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM tri JOIN twice USING (doc_id, g), range(3) AS x(k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
j AS (SELECT doc_id, l, regexp_replace(l, '{SPLIT}', '', 'g') <> '' AS worded,
      (length(l) - length(translate(l, '|»›•', ''))) >= {r.nav_cells}
      OR {symbols('l')} > {r.line_symbols_per_word} * len(string_split_regex(trim(l, ' '), '{SPLIT}')) + 2
      OR (length(regexp_replace(l, '[^\p{{L}}]+', '', 'g')) >= {r.min_shout_letters}
          AND length(regexp_replace(l, '[^\p{{Lu}}]+', '', 'g')) * 100 > length(regexp_replace(l, '[^\p{{L}}]+', '', 'g')) * {r.upper_percent})
      OR (({boiler}) AND length(l) < 200) AS bad FROM ln),
lines AS (SELECT doc_id, count(*) FILTER (WHERE worded) AS n, count(*) FILTER (WHERE worded) - count(DISTINCT l) FILTER (WHERE worded) AS dups,
          coalesce(sum(length(l)) FILTER (WHERE bad), 0) AS lost FROM j GROUP BY doc_id),
b AS (SELECT d.doc_id, length(t) AS chars, len(ws) AS n_words, length(regexp_replace(t, '{SPLIT}', '', 'g')) AS word_chars, {symbols('t')} AS n_symbols,
      dups AS n_dup_lines, lines.n AS n_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(lost AS BIGINT) AS n_lost_chars
      FROM d JOIN w USING (doc_id) JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < {r.min_words} OR n_repeat_words * 100 > n_words * {r.max_repeat_percent} AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost_chars,
  NOT base_failed AND n_lost_chars * 100 <= chars * {r.max_lost_percent}
  AND NOT (n_dup_lines >= {r.min_dup_lines} AND n_dup_lines * 100 > n_lines * {r.max_dup_line_percent})
  AND NOT (word_chars < n_words * {r.min_mean_chars} OR word_chars > n_words * {r.max_mean_chars}) AS kept FROM f
"""
