"""The same rows in DuckDB's SQL, for the queries that SQL can express over whole tables."""

from __future__ import annotations

_SPACES = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
#: crc32 of a string of ASCII characters, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({s}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"

NEAR = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS sh FROM d),
x AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS one FROM s),
e AS MATERIALIZED (SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS both_n, COUNT(*) AS c FROM x a JOIN x b ON a.one = b.one AND a.doc_id <> b.doc_id GROUP BY 1, 2, 3) WHERE 100 * c >= 80 * (both_n - c)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM s UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT node, MIN(reach) AS component_id FROM r GROUP BY 1) m ON s.doc_id = m.node"""

_AFTER = "CASE q WHEN 2 THEN 3 ELSE 2 END"
_NAME = "CASE q WHEN 2 THEN 'assistant' ELSE 'user' END"
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. st holds the cheapest edits of the first i rows to each state.
REPAIR = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, {_CRC.format(s="COALESCE(CAST(conv_id AS VARCHAR), ' ')||':'||COALESCE(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations),
damaged AS MATERIALIZED (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS nth FROM c WHERE k <> 0),
placed AS (SELECT *, rtrim(text, {_SPACES}) AS said, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i, ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, nth) AS seen FROM damaged),
rows_ AS MATERIALIZED (SELECT *, substr(role, 1, 1) AS r0, CASE WHEN said = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f FROM placed),
st AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM rows_
 UNION ALL SELECT conv_id, i, q, cost, audit, lines FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS place FROM (
   SELECT conv_id, i, unnest([{{'q': q, 'cost': cost + 2, 'audit': audit||'D', 'lines': lines}},
     {{'q': CASE WHEN f IN (0, 3) THEN {_AFTER} END, 'cost': cost + 1 + CASE f WHEN 3 THEN 5 ELSE 0 END, 'audit': audit||'R', 'lines': list_append(lines, {_NAME}||':'||text)}},
     {{'q': CASE WHEN f NOT IN (0, 3) THEN NULL WHEN q = 0 AND r0 = 's' THEN 1 WHEN q IN (0, 1, 3) AND r0 = 'u' THEN 2 WHEN q = 2 AND r0 = 'a' THEN 3 END, 'cost': cost + CASE f WHEN 3 THEN 5 ELSE 0 END, 'audit': audit||'K', 'lines': list_append(lines, role||':'||text)}}], recursive := true)
   FROM (SELECT s.conv_id, t.i, t.f, t.r0, t.role, t.text, unnest([{{'q': q, 'cost': cost, 'audit': audit, 'lines': lines}}, {{'q': {_AFTER}, 'cost': cost + 5, 'audit': audit||'I', 'lines': list_append(lines, {_NAME}||':')}}], recursive := true) FROM st s JOIN rows_ t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i + 1))
  WHERE q IS NOT NULL) WHERE place = 1),
ends AS (SELECT conv_id, cost, audit, lines FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS place FROM (
  SELECT s.conv_id, unnest([{{'q': q, 'cost': cost, 'audit': audit, 'lines': lines}}, {{'q': {_AFTER}, 'cost': cost + 5, 'audit': audit||'I', 'lines': list_append(lines, {_NAME}||':')}}], recursive := true)
  FROM st s JOIN (SELECT conv_id, MAX(i) AS n FROM rows_ GROUP BY 1) m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.n = s.i) WHERE q IN (0, 3)) WHERE place = 1),
counts AS (SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, SUM(CASE f WHEN 1 THEN 1 ELSE 0 END) AS blank, SUM(CASE f WHEN 2 THEN 1 ELSE 0 END) AS duplicate, SUM(CASE f WHEN 3 THEN 1 ELSE 0 END) AS truncated,
  SUM(CASE WHEN before||r0 NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal FROM (SELECT *, LAG(r0) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM rows_) GROUP BY 1)
SELECT o.conv_id, {', '.join(f'CAST(COALESCE({c}, 0) AS BIGINT) AS {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal', 'cost'))}, COALESCE(audit, '') AS audit, sha256(COALESCE(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""

#: Windows of every item, those of short items as long as they are, found among the windows of the same length of every document.
LEAKS = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS MATERIALIZED (SELECT ROW_NUMBER() OVER () AS k, * FROM low),
t AS MATERIALIZED (SELECT COALESCE(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS MATERIALIZED (SELECT DISTINCT item, size, array_to_string(w[start:start+size-1], ' ') AS said FROM (SELECT item, w, LEAST(10, len(w)) AS size, unnest(range(1, len(w) - LEAST(10, len(w)) + 2)) AS start FROM t WHERE len(w) > 0)),
o AS (SELECT k, start, size, array_to_string(w[start:start+size-1], ' ') AS said FROM (SELECT k, w, z.size, unnest(range(1, len(w) - z.size + 2)) AS start FROM d CROSS JOIN (SELECT DISTINCT size FROM i) z WHERE len(w) >= z.size)),
m AS MATERIALIZED (SELECT o.k, o.start, o.size, i.item FROM o JOIN i ON o.size = i.size AND o.said = i.said),
h AS (SELECT k, COUNT(DISTINCT p) AS n_hit FROM (SELECT DISTINCT k, unnest(range(start, start + size)) AS p FROM (SELECT DISTINCT k, start, size FROM m)) GROUP BY 1),
f AS (SELECT k, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, COALESCE(h.n_hit, 0) AS n_hit, CAST(COALESCE(len(f.items), 0) AS BIGINT) AS n_items, sha256(COALESCE(array_to_string(f.items, ','), '')) AS items_sha256, COALESCE(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.k = h.k LEFT JOIN f ON d.k = f.k"""

#: Pairs of equal words a period apart, in stretches of neighbours; a stretch whose period is a multiple of another run's around it is no run.
RUNS = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(COALESCE(text, ''), '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '') AS w, {_CRC.format(s="CAST(doc_id AS VARCHAR)")} AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
r AS MATERIALIZED (SELECT ROW_NUMBER() OVER () AS k, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i+1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM g),
p AS MATERIALIZED (SELECT k, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM r),
c AS MATERIALIZED (SELECT * FROM p QUALIFY COUNT(*) OVER (PARTITION BY k, word) >= 4),
e AS (SELECT x.k, x.i, y.i - x.i AS q FROM c x JOIN c y ON x.k = y.k AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT k, q, MIN(i) AS start, COUNT(*) + q AS length FROM (SELECT *, i - ROW_NUMBER() OVER (PARTITION BY k, q ORDER BY i) AS part FROM e) GROUP BY k, q, part HAVING COUNT(*) + q >= GREATEST(6, 4 * q)),
u AS MATERIALIZED (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.k = s.k AND b.q < s.q AND s.q % b.q = 0 AND b.start <= s.start AND b.start + b.length >= s.start + s.length)),
l AS (SELECT k, COUNT(*) AS n_runs, list({{'start': start, 'length': length, 'period': q}} ORDER BY length DESC, start, q)[1] AS b, string_agg(start||','||length||','||q||chr(10), '' ORDER BY start, q) AS said FROM u GROUP BY 1),
gone AS (SELECT DISTINCT k, unnest(range(start + q, start + length)) AS i FROM u),
t AS (SELECT p.k, string_agg(p.word, ' ' ORDER BY p.i) AS text FROM p LEFT JOIN gone ON p.k = gone.k AND p.i = gone.i WHERE gone.i IS NULL GROUP BY 1)
SELECT r.doc_id, COALESCE(l.n_runs, 0) AS n_runs, CAST(l.b.start AS BIGINT) AS start, CAST(l.b.length AS BIGINT) AS length, CAST(l.b.period AS BIGINT) AS period, CAST(1000 * l.b.length // l.b.period AS BIGINT) AS exponent_milli, sha256(COALESCE(l.said, '')) AS runs_sha256, sha256(COALESCE(t.text, '')) AS collapsed_sha256
FROM r LEFT JOIN l ON r.k = l.k LEFT JOIN t ON r.k = t.k"""

SQL = {"op7_decontamination": LEAKS, "op11_periodic_runs": RUNS, "op12_minhash": NEAR, "op13_conversation_repair": REPAIR}
