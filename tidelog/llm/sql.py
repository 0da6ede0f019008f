"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import quality_rules as _rules

WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_sql = lambda p: p.replace("'", "''")
END_MARKS, NAVIGATION, BOILERPLATE, MIN_KEPT_SHARE = _sql(_rules.END_MARKS), _sql(_rules.NAVIGATION), _sql(_rules.BOILERPLATE), _rules.MIN_KEPT_SHARE
WORD = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(role) + length(text) + len(regexp_extract_all(role || chr(0) || text, '<\\*\|')) + length('<|im_start|><|im_sep|><|im_end|>') + 1)::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

OP3 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5(doc_id::VARCHAR) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * source_size AS cap FROM s),
r AS (SELECT *, row_number() OVER o AS rank,
    sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS num, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS den
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST), b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT num, den, rank AS first FROM r WHERE num * w <= cap * den ORDER BY rank LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN rank < first THEN cap::DOUBLE ELSE (f.num * w)::DOUBLE / f.den::DOUBLE END AS target FROM r, f),
p AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p),
c AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - (upto - size))))::BIGINT AS taken FROM c
"""

OP4 = rf"""
WITH b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS w FROM benchmark),
bl AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS w FROM documents),
x AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT x.doc_id, x.i, x.n, g.item FROM x JOIN g USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP5 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {WS}) <> '') AS lines FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, gram FROM x GROUP BY ALL HAVING count(*) > 1),
p AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n FROM (SELECT x.doc_id, unnest(range(i, i + 8)) AS q FROM x JOIN r USING (doc_id, gram)) GROUP BY doc_id),
l AS (SELECT doc_id, trim(unnest(lines), {WS}) AS s, unnest(lines) AS line FROM d),
m AS (SELECT doc_id, line, s, len(regexp_extract_all(s, '{WORD}')) AS n FROM l),
v AS (
  SELECT doc_id, length(line) AS c, (regexp_matches(s, '{END_MARKS}') OR (n >= 12 AND regexp_matches(s, '[.!?] ')))
    AND length(regexp_replace(s, '[^#*$%&|<>!{{}}=~^_\\]+', '', 'g')) * 4 <= n
    AND (n < 4 OR length(regexp_replace(s, '[^\p{{Lu}}]+', '', 'g')) <= length(regexp_replace(s, '[^\p{{Ll}}]+', '', 'g')))
    AND NOT regexp_matches(s, '{NAVIGATION}') AND NOT regexp_matches(s, '{BOILERPLATE}') AS good FROM m),
g AS (SELECT doc_id, count(*) FILTER (WHERE good)::BIGINT AS n_kept_lines, coalesce(sum(c) FILTER (WHERE good), 0)::DOUBLE / sum(c)::DOUBLE AS share FROM v GROUP BY doc_id),
b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, coalesce(g.n_kept_lines, 0)::BIGINT AS n_kept_lines, coalesce(share, 0) AS share
  FROM d LEFT JOIN p USING (doc_id) LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND share >= {MIN_KEPT_SHARE} AS kept, n_lines, n_kept_lines FROM b
"""

OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)
"""

OP10 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {WS}), '{UPPER}', '{LOWER}') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, r.first IS NOT NULL AND r.first <> k.doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

ORACLE_SQL = {"op1_chat_format": OP1, "op3_mix_sources": OP3, "op4_decontaminate": OP4, "op5_quality_rules": OP5, "op7_jaccard_join": OP7, "op10_line_dedup": OP10}
