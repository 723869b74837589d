"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

OP6 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
told AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
         length(replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>')) AS chars,
         length(replace(replace(replace(replace(role, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>'), ': ', ':\ ')) AS role_chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars + 7 + CASE WHEN before IS DISTINCT FROM role THEN role_chars + 6 ELSE 0 END
           + CASE WHEN after IS DISTINCT FROM role THEN 1 ELSE 0 END)::BIGINT AS formatted_chars
FROM told GROUP BY conv_id
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, count(*) OVER () AS n,
         row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS rn FROM documents),
p AS (SELECT a.rn, a.doc_id, a.t, b.rn AS next_rn, b.t AS next_t FROM d a JOIN d b ON b.rn = a.rn % a.n + 1),
e AS (SELECT *, left(t, length(t) - length(t) // 2) || left(next_t, length(t) // 2) AS edited FROM p),
texts AS (SELECT rn, 0 AS which, t FROM e UNION ALL SELECT rn, 1, edited FROM e),
parts AS (SELECT rn, which, unnest(string_split(t, chr(10))) AS part FROM texts),
hashed AS (SELECT rn, which, sha256('0:' || part) || sha256('1:' || part) || sha256('2:' || part) || sha256('3:' || part) AS h
           FROM parts WHERE part <> ''),
sums AS (SELECT rn, which, j, sum(('0x' || substr(h, 4 * j + 1, 4))::BIGINT - 32768)::BIGINT AS s
         FROM hashed, (SELECT range AS j FROM range(64)) GROUP BY ALL),
lanes AS (
  SELECT x.rn, x.which, y.j, ((coalesce(s, 0) % 4294967296) + 4294967296) % 4294967296 AS lane
  FROM texts x CROSS JOIN (SELECT range AS j FROM range(64)) y LEFT JOIN sums z ON z.rn = x.rn AND z.which = x.which AND z.j = y.j),
signed AS (SELECT *, CASE WHEN lane < 2147483648 THEN lane ELSE lane - 4294967296 END::DOUBLE AS v FROM lanes),
prints AS (SELECT rn, which, string_agg(format('{:08x}', lane), '' ORDER BY j) AS f FROM lanes GROUP BY ALL),
pairs AS (SELECT rn, rn AS other, 1 AS which FROM e UNION ALL SELECT rn, next_rn, 0 FROM e),
dots AS (
  SELECT q.rn, q.which, sum(a.v * b.v) AS ab, sum(a.v * a.v) AS aa, sum(b.v * b.v) AS bb, bool_and(a.lane = b.lane) AS same
  FROM pairs q JOIN signed a ON a.rn = q.rn AND a.which = 0 JOIN signed b ON b.rn = q.other AND b.which = q.which AND b.j = a.j
  GROUP BY ALL),
near AS (
  SELECT rn, which, CASE WHEN same THEN 1.0::DOUBLE WHEN aa = 0 OR bb = 0 THEN 0.0::DOUBLE
         ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ab / (sqrt(aa) * sqrt(bb)))) END AS near FROM dots)
SELECT e.doc_id, length(e.t)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, f0.f AS fingerprint, f1.f AS edited_fingerprint,
       n1.near AS near_edited, n0.near AS near_next
FROM e JOIN prints f0 ON f0.rn = e.rn AND f0.which = 0 JOIN prints f1 ON f1.rn = e.rn AND f1.which = 1
JOIN near n1 ON n1.rn = e.rn AND n1.which = 1 JOIN near n0 ON n0.rn = e.rn AND n0.which = 0
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS k1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS k2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, array_to_string(u[1:least(k1, k2)], '') AS prefix, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS middle,
         array_to_string(u[greatest(k1, k2) + 1:], '') AS suffix FROM k)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
places AS (SELECT rn, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
windows AS (SELECT rn, i, array_to_string(w[i:i + 7], ' ') AS g FROM places JOIN d USING (rn)),
twice AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rn, count(DISTINCT i + j) AS n FROM twice, (SELECT range AS j FROM range(8)) GROUP BY rn),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM d LEFT JOIN covered c USING (rn)),
f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN 4 * n_marks > n_words THEN 64 ELSE 0 END + CASE WHEN 2 * n_upper > n_letters THEN 128 ELSE 0 END)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""

OP13 = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, sha256(length(role) || ':' || role || text) AS key, strlen(text) AS bytes FROM t),
crc AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, (x % 2) * 3988292384)))
  AS c FROM (SELECT DISTINCT conv_id FROM t)),
h AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM crc),
taken AS (
  SELECT h.conv_id, 0 AS own, k.place, k.key, k.bytes FROM h JOIN k ON k.conv_id = h.conv_id - h.conv_id % 5 AND k.place <= h.h
  UNION ALL SELECT h.conv_id, 1, k.place, k.key, k.bytes FROM h JOIN k ON k.conv_id = h.conv_id AND k.place > h.h),
r AS (SELECT conv_id, row_number() OVER w AS d, key, bytes, string_agg(key, ',') OVER w AS path FROM taken WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)),
seats AS (SELECT conv_id, d, path, bytes FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM h),
last AS (SELECT conv_id, max(d) AS d FROM seats GROUP BY conv_id),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM seats JOIN last USING (conv_id, d) GROUP BY path),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes FROM seats GROUP BY path, d),
pairs AS (SELECT DISTINCT a.path AS top, b.path AS sub FROM seats a JOIN seats b ON a.conv_id = b.conv_id AND a.d <= b.d),
up AS (SELECT DISTINCT b.path, a.path AS above FROM seats a JOIN seats b ON a.conv_id = b.conv_id AND a.d + 1 = b.d),
kids AS (SELECT above AS path, count(*) AS n FROM up GROUP BY above),
below AS (
  SELECT p.top AS path, count(*) FILTER (WHERE k.n IS NULL) AS leaves, sum((s.n - 1) * s.bytes)::BIGINT AS saved
  FROM pairs p JOIN nodes s ON s.path = p.sub LEFT JOIN kids k ON k.path = p.sub GROUP BY p.top)
SELECT x.conv_id, x.d::BIGINT AS depth, a.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
       b.leaves AS n_leaves, b.saved AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes x LEFT JOIN up u ON u.path = x.path LEFT JOIN nodes a ON a.path = u.above LEFT JOIN kids k ON k.path = x.path
JOIN below b ON b.path = x.path LEFT JOIN ends e ON e.path = x.path
"""

ORACLES: dict[str, str] = {"op6_chat": OP6, "op8_multiset_hash": OP8, "op11_fill_middle": OP11, "op12_quality_ledger": OP12, "op13_prefix_trie": OP13}
