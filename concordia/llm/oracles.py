"""SQL whose rows equal those of the opN_ queries, where SQL can express them.

Left out: operators 5 to 8 and 10, which need a parser, a tokenizer, ranked retrieval or a
trained forest.  Their tests hold them against plain versions.
"""

from __future__ import annotations

from concordia.llm.queries import PROBE

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"

OP1 = f"""WITH RECURSIVE c AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, (role <> 'system'), role, text) AS i,
  replace(replace(replace(text, '\\', '\\\\'), '</', '<\\/'), '##', '#\\#') AS esc FROM c),
r AS (SELECT *, '### ' || role || ': ' || esc || '</turn>' || chr(10) AS shown FROM e),
t AS (SELECT *, ceil(octet_length(encode(shown)) / 4.0)::BIGINT AS tok, floor(turn / 256)::BIGINT AS seg,
  first_value(role) OVER (PARTITION BY conv_id ORDER BY i) AS role1, first_value(shown) OVER (PARTITION BY conv_id ORDER BY i) AS shown1,
  first_value(turn) OVER (PARTITION BY conv_id ORDER BY i) AS turn1 FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, seg ORDER BY i) AS k, sum(tok) OVER (PARTITION BY conv_id, seg ORDER BY i) AS upto,
  CASE WHEN role1 = 'system' THEN shown1 END AS sys, CASE WHEN role1 = 'system' THEN floor(turn1 / 256)::BIGINT ELSE -1 END AS sys_seg FROM t),
room AS (SELECT *, 1024 - 128 - CASE WHEN sys IS NULL THEN 0 ELSE ceil(octet_length(encode(sys)) / 4.0) END AS room FROM s),
w AS (SELECT conv_id, seg, k, 1::BIGINT AS win_start, 0::BIGINT AS old_start, tok AS held, room FROM room WHERE k = 1
  UNION ALL SELECT n.conv_id, n.seg, n.k, CASE WHEN w.held + n.tok > n.room THEN n.k ELSE w.win_start END,
  CASE WHEN w.held + n.tok > n.room THEN w.win_start ELSE w.old_start END, CASE WHEN w.held + n.tok > n.room THEN n.tok ELSE w.held + n.tok END, n.room
  FROM w JOIN room n ON n.conv_id = w.conv_id AND n.seg = w.seg AND n.k = w.k + 1),
starts AS (SELECT DISTINCT conv_id, seg, win_start, old_start FROM w),
hist AS (SELECT st.conv_id, st.seg, st.win_start, sum(length(h.shown)) AS chars FROM starts st JOIN room h ON h.conv_id = st.conv_id AND h.seg = st.seg
  AND h.k >= st.old_start AND h.k < st.win_start JOIN room b ON b.conv_id = st.conv_id AND b.seg = st.seg AND b.k = st.win_start - 1
  WHERE st.win_start > 1 AND b.upto - h.upto + h.tok <= 128 AND (h.sys IS NULL OR h.shown <> h.sys) GROUP BY ALL),
tails AS (SELECT a.conv_id, a.seg + 1 AS seg, a.shown, sum(a.tok) OVER (PARTITION BY a.conv_id, a.seg ORDER BY a.i DESC) AS back, a.role, a.sys,
  row_number() OVER (PARTITION BY a.conv_id, a.seg ORDER BY a.i DESC) AS n FROM room a),
tail AS (SELECT conv_id, seg, sum(length(shown)) AS chars FROM tails WHERE n <= 4 AND back <= 128 AND role <> 'system' AND (sys IS NULL OR shown <> sys) GROUP BY ALL),
extra AS (SELECT st.conv_id, sum(coalesce(CASE WHEN st.win_start = 1 THEN tail.chars ELSE hist.chars END, 0)
  + CASE WHEN b.sys IS NOT NULL AND NOT (st.win_start = 1 AND b.sys_seg = st.seg) THEN length(b.sys) ELSE 0 END) AS chars
  FROM starts st JOIN room b ON b.conv_id = st.conv_id AND b.seg = st.seg AND b.k = st.win_start
  LEFT JOIN hist ON hist.conv_id = st.conv_id AND hist.seg = st.seg AND hist.win_start = st.win_start
  LEFT JOIN tail ON tail.conv_id = st.conv_id AND tail.seg = st.seg GROUP BY st.conv_id),
d AS (SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length(shown)) AS own FROM r GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, (own + chars)::BIGINT AS formatted_chars FROM d JOIN extra ON d.conv_id = extra.conv_id"""

OP2 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines FROM documents),
g AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
m AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT doc_id, i AS p FROM m UNION ALL SELECT doc_id, i + 1 FROM m UNION ALL SELECT doc_id, i + 2 FROM m) GROUP BY 1),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(text, '[^a-z]', '', 'g')) AS small, length(regexp_replace(text, '[^!]', '', 'g')) AS shouts FROM d),
a AS (SELECT f.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM f LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (10 * n_symbols > n_words OR 10 * n_dup_lines > 5 * n_lines
  OR capitals > small OR 10 * shouts > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept FROM b"""

OP3 = """WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, 's' || source AS stratum, octet_length(encode(coalesce(text, ''))) + 8 AS size, ('0x' || substr(md5('42|' || doc_id), 1, 15))::BIGINT AS h,
  list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
k AS (SELECT d.* EXCLUDE (bytes), xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS crc FROM d, tab),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, size, crc) AS rank, count(*) OVER (PARTITION BY stratum) AS total,
  ('0x' || substr(md5('42|phase|' || stratum), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS phase FROM k),
g AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY (rank - 1 + phase) / total, stratum, h, doc_id, size, crc) - 1 AS g FROM r)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, (g * 24 // n)::INTEGER AS shard, (g - ((g * 24 // n) * n + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM g"""

OP4 = """WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
c AS (SELECT x, y FROM u UNION SELECT c.x, u.y FROM c JOIN u ON c.y = u.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.lo, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.lo, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS lo FROM c GROUP BY 1) m ON m.x = d.doc_id"""

OP9 = """WITH l AS (SELECT doc_id, text, (unnest(list_zip(string_split(text, chr(10)), range(0, len(string_split(text, chr(10))))))) AS z FROM documents WHERE text IS NOT NULL),
m0 AS (SELECT doc_id, md5(text) AS h, z[2] AS line_no, CASE WHEN regexp_matches(z[1], '[\\t\\r\\f\\x0B]|  |^ | $') THEN trim(regexp_replace(z[1], '[ \\t\\r\\f\\x0B]+', ' ', 'g')) ELSE z[1] END AS line FROM l),
m AS (SELECT doc_id, h, line_no, CASE WHEN regexp_matches(line, '[0-9]') THEN regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g') ELSE line END AS line FROM m0),
t AS (SELECT *, string_split(line, ' ') AS tok FROM m WHERE len(string_split(line, ' ')) >= 3),
v AS (SELECT *, len(tok) || '|' || array_to_string(tok[1:4], ' ') AS leaf FROM t),
cand AS (SELECT leaf FROM v GROUP BY leaf HAVING count(*) >= 5 AND min(h) <> max(h)),
f AS (SELECT leaf, line, any_value(tok) AS tok, count(*) AS n FROM v WHERE leaf IN (SELECT leaf FROM cand) GROUP BY leaf, line),
p AS (SELECT leaf, line, n, len(tok) AS size, unnest(list_zip(tok, range(0, len(tok)))) AS z FROM f),
q AS (SELECT leaf, line, n, size, z[1] AS token, z[2] AS place FROM p),
k AS (SELECT leaf, place, token FROM q GROUP BY ALL HAVING sum(n) >= 5),
tpl AS (SELECT leaf, line, leaf || '#' || string_agg(place || '=' || token, ' ' ORDER BY place) AS tpl FROM (SELECT q.* FROM q JOIN k USING (leaf, place, token) WHERE token <> '<*>') GROUP BY leaf, line HAVING count(*) * 10 >= max(size) * 6),
pl AS (SELECT v.doc_id, v.h, v.line_no, tpl FROM v JOIN tpl ON v.line = tpl.line AND v.leaf = tpl.leaf),
rec AS (SELECT tpl, min(doc_id * 1000000 + line_no) AS first FROM pl GROUP BY tpl HAVING count(DISTINCT h) >= 5),
gone AS (SELECT DISTINCT doc_id, line_no FROM pl JOIN rec USING (tpl) WHERE doc_id * 1000000 + line_no <> first),
kept AS (SELECT l.doc_id, string_agg(z[1], chr(10) ORDER BY z[2]) AS text, count(*) AS n FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.line_no = z[2] WHERE gone.doc_id IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(string_split(d.text, chr(10))) - coalesce(kept.n, 0), 0)::BIGINT AS n_dropped,
  length(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END)::BIGINT AS text_chars, md5(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END) AS text_md5 FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

SQL: dict[str, str] = {
    "op1_chat_windows": OP1,
    "op2_quality_cascade": OP2,
    "op3_stratified_shards": OP3,
    "op4_minhash_neardup": OP4,
    "op9_template_line_dedup": OP9,
}
