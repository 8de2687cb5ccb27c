"""DuckDB SQL for the queries that SQL can express, written plainly and without the operators' methods."""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * source_size AS cap,
             row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s),
f AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
             sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS onward FROM k),
g AS (SELECT *, cap * onward <= (total - before) * w AS is_full FROM f),
t AS (SELECT sid, source, source_size,
             CASE WHEN is_full THEN cap::DOUBLE
                  ELSE (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::DOUBLE * w / (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::DOUBLE END AS target
      FROM g),
u AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM t),
v AS (SELECT *, round(target)::BIGINT - whole * source_size AS budget FROM u),
a AS (SELECT d.*, v.sid, v.source_size, v.target, v.whole, v.budget,
             sum(size) OVER (PARTITION BY v.sid ORDER BY h) <= budget AS in0, sum(size) OVER (PARTITION BY v.sid ORDER BY h) AS c0
      FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
b AS (SELECT *, budget - coalesce(max(CASE WHEN in0 THEN c0 END) OVER (PARTITION BY sid), 0) AS r0 FROM a),
b1 AS (SELECT *, NOT in0 AND size <= r0 AS open1 FROM b),
c AS (SELECT *, sum(CASE WHEN open1 THEN size ELSE 0 END) OVER (PARTITION BY sid ORDER BY h) AS c1 FROM b1),
c1 AS (SELECT *, open1 AND c1 <= r0 AS in1 FROM c),
e AS (SELECT *, r0 - coalesce(max(CASE WHEN in1 THEN c1 END) OVER (PARTITION BY sid), 0) AS r1,
             coalesce(min(CASE WHEN open1 AND NOT in1 THEN h END) OVER (PARTITION BY sid), 1152921504606846976) AS t1 FROM c1),
e1 AS (SELECT *, NOT in0 AND NOT in1 AND h >= t1 AND size <= r1 AS open2 FROM e),
x AS (SELECT *, sum(CASE WHEN open2 THEN size ELSE 0 END) OVER (PARTITION BY sid ORDER BY h) AS c2 FROM e1),
y AS (SELECT *, open2 AND c2 <= r1 AS in2 FROM x),
z AS (SELECT *, r1 - coalesce(max(CASE WHEN in2 THEN c2 END) OVER (PARTITION BY sid), 0) AS r2 FROM y),
q AS (SELECT sid, h, sum(size)::BIGINT AS words, any_value(r2) AS r2 FROM z WHERE NOT (in0 OR in1 OR in2) AND size > 0 AND size < 2 * r2 GROUP BY sid, h),
n AS (SELECT sid, arg_min(h, (abs(words - r2), h)) AS final FROM q WHERE words < 2 * r2 GROUP BY sid)
SELECT doc_id, size, source_size, target, size * (whole + (in0 OR in1 OR in2 OR coalesce(h = final, false))::BIGINT) AS taken FROM z LEFT JOIN n USING (sid)
"""


DECONTAM = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                  coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM s),
lens AS (SELECT DISTINCT n FROM win),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM p, lens WHERE i + n - 1 <= len(w)),
h AS (SELECT r, i, n, item FROM g JOIN win USING (n, win)),
x AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS q FROM h) GROUP BY r),
y AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (r) LEFT JOIN y USING (r)
"""

SECRETS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k(kind, re, grp, least, ent) AS (VALUES
  (0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12, false),
  (1, '(AKIA[A-Z0-9]+)()', 0, 18, false), (2, '([0-9a-f]+)()', 0, 16, false),
  (3, '([0-9A-Fa-f]{24,})()', 0, 24, true), (4, '([A-Za-z0-9+/_=-]{24,})()', 0, 24, true)),
m AS (SELECT r, kind, least, ent, regexp_extract_all(t, re, 0) AS whole, CASE grp WHEN 2 THEN regexp_extract_all(t, re, 2) ELSE regexp_extract_all(t, re, 0) END AS part,
             string_split_regex(t, re) AS pieces FROM d, k WHERE regexp_matches(t, re)),
e AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m),
f AS (SELECT r, kind, ent, whole[i] AS s, len(part[i]) >= least AS ok,
             (list_sum(list_transform(pieces[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: len(x))), 0))::BIGINT AS a FROM e),
base AS (SELECT r, kind, a, a + len(s) AS z FROM f WHERE ok AND NOT ent),
c AS (SELECT * FROM f WHERE ok AND ent AND regexp_matches(s, '[0-9]') AND regexp_matches(s, CASE kind WHEN 3 THEN '[A-Fa-f]' ELSE '[A-Za-z]' END)
        AND NOT regexp_matches(s, '^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$|^/?[a-z0-9_-]+(/[a-z0-9_-]+){2,}/?$')
        AND NOT regexp_matches(s, '(?i)example|sample|dummy|placeholder|changeme|redacted|xxxxxx|000000|abcdefgh|01234567|12345678')),
w AS (SELECT r, kind, a, s, unnest(range(0, len(s) - 23)) AS o FROM c),
l AS (SELECT r, kind, a, o, unnest(string_split(s[o + 1:o + 24], '')) AS ch FROM w),
n AS (SELECT r, kind, a, o, ch, count(*) AS n FROM l GROUP BY ALL),
h AS (SELECT r, kind, a, o FROM n GROUP BY ALL HAVING round(sum(n * log2(n)), 9) <= round(24 * (log2(24) - CASE kind WHEN 3 THEN 3.1 ELSE 4.05 END), 9)),
g AS (SELECT *, CASE WHEN o - lag(o) OVER (PARTITION BY r, kind, a ORDER BY o) <= 24 THEN 0 ELSE 1 END AS fresh FROM h),
q AS (SELECT *, sum(fresh) OVER (PARTITION BY r, kind, a ORDER BY o) AS run FROM g),
high AS (SELECT r, kind, a + min(o) AS a, a + max(o) + 24 AS z FROM q GROUP BY r, kind, q.a, run),
named(kind, name) AS (VALUES (0, 'assign'), (1, 'access'), (2, 'hex'), (3, 'entropy_hex'), (4, 'entropy_base64')),
b AS (SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
             string_agg(name || ':' || a || ':' || z, ',' ORDER BY a, kind) AS listed FROM base JOIN named USING (kind) GROUP BY r),
v AS (SELECT r, string_agg(name || ':' || a || ':' || z, ',' ORDER BY a, kind) AS listed FROM (FROM base UNION ALL FROM high) JOIN named USING (kind) GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b.listed, '')) AS base_sha256, coalesce(v.listed, '') AS spans
FROM d LEFT JOIN b USING (r) LEFT JOIN v USING (r)
"""

CHAT = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length('<|im_start|>' || '<|im_end|>') + 2
                + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\1\\|', 'g'))
                + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS written FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(written)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

SUBSTRING = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM p),
x AS (SELECT r, i FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM x),
a AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM a ANTI JOIN c USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN n USING (r)
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM q WHERE payload_bytes >= 1000 GROUP BY 1),
j AS (SELECT q.*, CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to FROM q LEFT JOIN k USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j
"""


#: CRC-32 of a number's decimal digits: its table, and the sum over the digits.
CRC_TABLE = r"""crc AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)))"""
CRC = r"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"

RUNS = rf"""
WITH {CRC_TABLE},
d0 AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {CRC.format('doc_id')} AS h FROM documents, crc),
d1 AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d0),
d2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d1),
d AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1])) END AS w FROM d2),
s AS (SELECT r, w, unnest(range(0, n - 5)) AS i FROM d WHERE n >= 6),
g AS (SELECT r, i, array_to_string(w[i + 1:i + 6], ' ') AS g FROM s),
m AS (SELECT y.r, y.i, y.i - x.i AS q FROM g x JOIN g y ON x.r = y.r AND x.g = y.g AND x.i < y.i),
k AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
e AS (SELECT r, q, min(i) - q AS start, max(i) + 5 AS last FROM k GROUP BY r, q, island),
runs AS (SELECT r, start, last - start + 1 AS length, min(q) AS period FROM e WHERE last - start + 1 >= greatest(12, 2 * q) GROUP BY r, start, last),
top AS (SELECT r, count(*) AS n_runs, arg_min(start, (-length, start, period)) AS start, max(length) AS length, arg_min(period, (-length, start, period)) AS period,
               string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
a AS (SELECT r, unnest(w) AS word, unnest(range(0, n)) AS i FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM a ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN top USING (r) LEFT JOIN kept USING (r)
"""

TRIE = rf"""
WITH {CRC_TABLE},
own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {CRC.format('conv_id')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own), crc),
t AS (SELECT c.conv_id, 0 AS side, i, role, text FROM c JOIN own ON own.conv_id = c.conv_id - c.conv_id % 5 WHERE i <= h
      UNION ALL SELECT conv_id, 1, i, role, text FROM c JOIN own USING (conv_id) WHERE i > h),
p AS (SELECT conv_id, text, row_number() OVER w AS depth, string_agg(md5(role) || md5(text), '') OVER w AS node FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY side, i ROWS UNBOUNDED PRECEDING)),
o AS (SELECT conv_id, 0 AS depth, '' AS node, '' AS text FROM c UNION ALL SELECT conv_id, depth, node, text FROM p),
n AS (SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * strlen(any_value(text)) AS saved, left(node, 64 * (any_value(depth) - 1)) AS up FROM o GROUP BY node),
k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
x AS (SELECT left(node, 64 * d) AS node, saved, n_children FROM (SELECT node, saved, n_children, unnest(range(0, depth + 1)) AS d FROM v)),
y AS (SELECT node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM x GROUP BY node),
e AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM (SELECT conv_id, arg_max(node, depth) AS node FROM o GROUP BY conv_id) GROUP BY node)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM v LEFT JOIN v u ON v.depth > 0 AND u.node = v.up JOIN y ON y.node = v.node LEFT JOIN e ON e.node = v.node
"""

EXACT = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY chars DESC, doc_id NULLS LAST, r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix": MIX, "op3_decontam": DECONTAM, "op5_secrets": SECRETS, "op6_chat": CHAT, "op8_substring": SUBSTRING, "op9_warc": WARC, "op11_runs": RUNS, "op12_trie": TRIE, "op13_exact_dedup": EXACT}
