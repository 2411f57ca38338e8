"""DuckDB SQL with the results of those queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import linededup, rules, substring

_WORD = r"[^\x20\x09-\x0D]+"
_ANY = r"[^\x20\x09-\x0D]"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {}

_W = substring.WINDOW
SQL["op2_substring"] = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ws) - {_W - 2})) AS i, unnest(list_transform(range(1, len(ws) - {_W - 2}), lambda i: array_to_string(ws[i:i + {_W - 1}], ' '))) AS k FROM w WHERE len(ws) >= {_W}),
m AS (SELECT k, min(doc_id) AS least FROM x GROUP BY k),
gone AS (SELECT DISTINCT x.doc_id, unnest(range(i, i + {_W})) AS p FROM x JOIN m ON m.k = x.k WHERE least < x.doc_id),
e AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS text, count(*) AS n FROM e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p WHERE g.p IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

_B = rules.BITS
SQL["op3_rules"] = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS k FROM w WHERE len(ws) >= 8),
two AS (SELECT doc_id, k FROM x GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT x.doc_id, unnest(range(i, i + 8)) AS p FROM x JOIN two ON two.doc_id = x.doc_id AND two.k = x.k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_ANY}')) AS ls, coalesce(rep.n, 0) AS n_repeat_words,
len(list_filter(ws, lambda v: v = upper(v))) AS n_capital, len(list_filter(ws, lambda v: v = upper(v) AND v = lower(v))) AS n_letterless FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM m),
f AS (SELECT *, CASE WHEN n_words < 20 THEN {_B['few_words']} ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN {_B['repeated_windows']} ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN {_B['symbols']} ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN {_B['repeated_lines']} ELSE 0 END
+ CASE WHEN word_chars < 2 * n_words THEN {_B['short_words']} ELSE 0 END + CASE WHEN word_chars > 14 * n_words THEN {_B['long_words']} ELSE 0 END + CASE WHEN 2 * (n_capital - n_letterless) > n_words THEN {_B['capitals']} ELSE 0 END + CASE WHEN 5 * n_letterless > 2 * n_words THEN {_B['letterless']} ELSE 0 END AS bits FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, bits & {rules.mask('base-1')} <> 0 AS base_failed, bits & {rules.mask('prose-1')} = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits FROM f"""

SQL["op7_decontamination"] = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS ws FROM benchmark),
i AS (SELECT DISTINCT item, least(len(ws), 10) AS n, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + 9], ' '))) AS k FROM b WHERE len(ws) > 0),
x AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS p, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(ws) >= n),
h AS (SELECT x.doc_id, x.p, x.n, i.item FROM x JOIN i ON i.k = x.k AND i.n = x.n),
g AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

_M = linededup.MIN_WORDS
SQL["op10_line_runs"] = f"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, i, x, len(regexp_extract_all(x, '{_WORD}')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l WHERE regexp_matches(x, '{_ANY}')),
a AS (SELECT doc_id, list(x ORDER BY r) AS xs, list(w ORDER BY r) AS ws FROM v GROUP BY doc_id),
s AS (SELECT doc_id, xs, ws, unnest(range(1, len(xs) + 1)) AS r FROM a), n AS (SELECT s.*, n FROM s, (SELECT unnest(range(1, {_M + 1})) AS n) WHERE r + n - 1 <= len(xs)),
c AS (SELECT doc_id, r, n, array_to_string(xs[r:r + n - 1], chr(10)) AS k FROM n WHERE list_sum(ws[r:r + n - 1]) >= {_M} AND (list_sum(ws[r:r + n - 1]) - ws[r + n - 1] < {_M} OR list_sum(ws[r:r + n - 1]) - ws[r] < {_M})),
f AS (SELECT k, min({{'d': doc_id, 'r': r}}) AS first FROM c GROUP BY k),
g AS (SELECT DISTINCT c.doc_id, unnest(range(c.r, c.r + n)) AS r FROM c JOIN f ON f.k = c.k WHERE {{'d': c.doc_id, 'r': c.r}} > first),
o AS (SELECT v.doc_id, v.i, v.r, g.r IS NOT NULL AS gone FROM v LEFT JOIN g ON g.doc_id = v.doc_id AND g.r = v.r),
p AS (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next_i, lead(gone) OVER (PARTITION BY doc_id ORDER BY i) AS next_gone, lag(gone) OVER (PARTITION BY doc_id ORDER BY i) AS last_gone FROM o),
z AS (SELECT doc_id, unnest(range(i, CASE WHEN next_gone THEN next_i ELSE i + 1 END)) AS i FROM p WHERE gone),
q AS (SELECT doc_id, count(*) FILTER (WHERE gone AND NOT coalesce(last_gone, false)) AS n_runs FROM p GROUP BY doc_id),
y AS (SELECT l.doc_id, count(*) AS n_lines, count(z.i) AS n_removed, string_agg(l.x, chr(10) ORDER BY l.i) FILTER (WHERE z.i IS NULL) AS kept FROM l LEFT JOIN z ON z.doc_id = l.doc_id AND z.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 1) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN y ON y.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id"""
