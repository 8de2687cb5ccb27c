"""DuckDB SQL for the registered queries of the change-tracking operators."""

from __future__ import annotations

from tidemark.functions.places import COUNTIES, DISPLAY
from tidemark.plans.report import STYLE, WAYS

_NAMES = "[" + ", ".join(f"'{c}'" for c in COUNTIES) + "]"

_PANEL = """p AS (
  SELECT c_mktsegment AS program, n_name AS county, strftime(o_orderdate, '%Y-%m') AS month, count(*)::BIGINT AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
m AS (SELECT program, month, lag(month) OVER (PARTITION BY program ORDER BY month) AS prior FROM (SELECT DISTINCT program, month FROM p)),
last AS (SELECT program, max(month) AS month, arg_max(prior, month) AS prior FROM m GROUP BY program)"""
_RANKED = """r AS (
  SELECT a.program, a.county, a.month, a.value AS now, b.value AS "then", a.value - b.value AS change,
         CASE WHEN b.value <> 0 THEN (a.value - b.value)::DOUBLE / b.value::DOUBLE * 100.0 ELSE 0.0 END AS pct
  FROM {months} x JOIN p a USING (program, month) JOIN p b ON b.program = a.program AND b.county = a.county AND b.month = x.prior)"""
_LATEST = f"WITH {_PANEL}, {_RANKED.format(months='last')}"
_TOTALS = "t AS (SELECT program, month, sum(value)::BIGINT AS total FROM p GROUP BY ALL)"

_LINES = """s AS (
  SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS total, n, found
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2)) AS found FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""
_SECTIONS = f"""{_LINES},
c AS (SELECT o_orderkey, list(DISTINCT l_linenumber::VARCHAR) AS conflicts FROM (
        SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_extendedprice) > 1) GROUP BY ALL),
o AS (SELECT o_orderkey, coalesce(n, 0) AS n, floor(found)::BIGINT AS found, floor(total)::BIGINT AS total, coalesce(conflicts, []) AS conflicts FROM s LEFT JOIN c USING (o_orderkey)),
q AS (SELECT *, coalesce(abs(found - total)::DOUBLE > greatest(5.0, total::DOUBLE * 0.005), false) AS off FROM o)"""

_DAILY = "d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, ts, event_id, event_type, value FROM events)"
_SEEN = "s AS (SELECT user_id || '|' || event_type AS key, 'value ' || value::DECIMAL(18,2) AS detail, strftime(ts, '%Y-%m-%d') AS seen FROM events)"

_ANCHOR = r"""(?is)<a\s[^>]*href="([^"]+)"[^>]*>(.*?)</a>"""
_TEXT = r"trim(regexp_replace(replace(regexp_replace({x}, '<[^>]+>', '', 'g'), chr(8203), ''), '\s+', ' ', 'g'))"
_LINKS = rf"""a AS (
  SELECT page_id, unnest(range(0, len(h)))::INT AS pos, unnest(h) AS href, unnest(i) AS inner_html
  FROM (SELECT page_id, regexp_extract_all(html, '{_ANCHOR}', 1) AS h, regexp_extract_all(html, '{_ANCHOR}', 2) AS i FROM pages)),
l AS (SELECT page_id, pos, href, {_TEXT.format(x='inner_html')} AS label FROM a)"""
_PRINTS = f"""{_LINKS},
f AS (SELECT page_id, label, arg_max(href, pos) AS href FROM l WHERE label <> '' GROUP BY page_id, label),
old AS (SELECT page_id // 2 AS page_id, label, href FROM f WHERE page_id % 2 = 0),
new AS (SELECT page_id // 2 AS page_id, label, href FROM f WHERE page_id % 2 = 1)"""

_SPELT = """s AS (
  SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 7 = 0 THEN substr(strftime(o_orderdate, '%B'), 1, 3) || 'x' || substr(strftime(o_orderdate, '%B'), 4) ELSE strftime(o_orderdate, '%B') END AS m,
         strftime(o_orderdate, '%-d') AS dd, strftime(o_orderdate, '%Y') AS y FROM orders)"""
_MONTHS = "['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december']"

_LABELS = rf"""n AS (SELECT p_partkey, {_NAMES}[(p_partkey % 102 + 1)::INT] AS name, (p_partkey // 102) % 6 AS k FROM part),
l AS (SELECT p_partkey, CASE k
        WHEN 0 THEN regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g')
        WHEN 1 THEN regexp_replace(regexp_replace(name, 'ti', '+', 'g'), 'ffi', 'ﬃ', 'g')
        WHEN 2 THEN regexp_replace(name, 'tt', ' ', 'g') WHEN 3 THEN substr(name, 1, 4)
        WHEN 4 THEN regexp_replace(name, '[aeiou]', '', 'g') ELSE lower(name) END AS label FROM n),
dim AS (SELECT unnest({_NAMES}) AS name),
dn AS (SELECT name, regexp_replace(lower(name), '[^a-z]', '', 'g') AS norm FROM dim),
u AS (SELECT DISTINCT label, regexp_replace(lower(label), '[^a-z]', '', 'g') AS norm,
             regexp_replace(lower(replace(replace(replace(label, 'ﬃ', 'ffi'), '+', 'ti'), '#', 'ti')), '[^a-z]', '', 'g') AS probe FROM l),
e AS (SELECT label, name FROM u JOIN dn USING (norm)),
h AS (SELECT u.label, dn.name, starts_with(dn.norm, probe) AS pre
      FROM u, dn WHERE u.label NOT IN (SELECT label FROM e) AND length(probe) >= 3 AND regexp_matches(dn.norm, array_to_string(string_split(probe, ''), '.*'))),
g AS (SELECT label, count(*) FILTER (pre) AS np, min(name) FILTER (pre) AS pn, count(*) AS ns, min(name) AS sn FROM h GROUP BY label),
z AS (SELECT label, name, 'exact' AS how FROM e
      UNION ALL SELECT label, CASE WHEN np = 1 THEN pn ELSE sn END, CASE WHEN np = 1 THEN 'prefix' ELSE 'subsequence' END FROM g WHERE np = 1 OR (np = 0 AND ns = 1))"""

_ITEMS = """b AS (SELECT s_suppkey AS k, 'S' || s_suppkey AS id, 'http://x/' || s_suppkey AS url, s_name AS name, floor(s_acctbal)::BIGINT AS amount FROM supplier),
i AS (SELECT k, CASE WHEN k % 5 = 0 THEN id ELSE 'N' || k END AS id, CASE WHEN k % 5 = 1 THEN url ELSE 'http://y/' || k END AS url,
             CASE k % 5 WHEN 2 THEN upper(name) WHEN 3 THEN name || 'x' WHEN 4 THEN 'Other ' || name ELSE name END AS name,
             amount + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS amount FROM b),
near AS (SELECT i.k, substr(min(levenshtein(x, y)::VARCHAR || b.id), 2) AS near_id FROM (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS x FROM i) i,
               (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS y FROM b) b WHERE levenshtein(x, y) <= 2 GROUP BY i.k),
c AS (SELECT i.*, coalesce((SELECT min(b.id) FROM b WHERE b.id = i.id), (SELECT min(b.id) FROM b WHERE b.url = i.url),
                        (SELECT min(b.id) FROM b WHERE regexp_replace(lower(b.name), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(i.name), '[^a-z0-9]+', '', 'g')), near_id) AS matched_id FROM i LEFT JOIN near USING (k)),
x AS (SELECT c.*, CASE WHEN matched_id IS NULL THEN NULL WHEN EXISTS (SELECT 1 FROM b WHERE b.id = c.id) THEN 'id' WHEN EXISTS (SELECT 1 FROM b WHERE b.url = c.url) THEN 'url' ELSE 'name' END AS matched_by,
             CASE WHEN matched_id IS NULL THEN 'NEW' WHEN c.amount IS DISTINCT FROM b.amount THEN 'UPDATE' ELSE 'unchanged' END AS status
      FROM c LEFT JOIN b ON b.id = c.matched_id)"""

_FILINGS = "f AS (SELECT o_orderpriority AS source, o_orderkey::VARCHAR AS entity, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS reported FROM orders)"

_DOCS = f"""{_PANEL},
v AS (SELECT CASE program WHEN 'BUILDING' THEN 'healthchoice' ELSE 'dual' END AS prog, program || '/' || month AS doc_id, month, substr(month, 6, 2)::INT AS k,
             {_NAMES}[n_nationkey + 1] AS county, value FROM p JOIN nation ON n_name = county WHERE program IN ('BUILDING', 'MACHINERY')),
w AS (SELECT *, min(county) OVER (PARTITION BY doc_id) AS first_county, sum(value) OVER (PARTITION BY doc_id)::BIGINT AS total FROM v),
y AS (SELECT *, CASE WHEN county = first_county AND k % 3 = 0 THEN value + 1 ELSE value END AS val FROM w)"""

_HTML_CLEAN = r"""trim(regexp_replace(replace(replace(regexp_replace(replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\x{200B}\x{00A0}]', ' ', 'g'), '&amp;', '&'), '&#0?39;|&apos;|&rsquo;', '''', 'g'), '&quot;', '"'), '&nbsp;', ' '), '\s+', ' ', 'g'))"""

_CATALOG = """c AS (
  SELECT n_name AS state, (SELECT string_agg(upper(w[1]) || lower(w[2:]), ' ' ORDER BY i) FROM (SELECT unnest(string_split(n_name, ' ')) AS w, unnest(range(len(string_split(n_name, ' ')))) AS i)) AS name,
         'Agency ' || n_nationkey AS agency, 'https://x/' || s_suppkey AS url, ['news', 'grants', 'minutes'][(s_suppkey % 3 + 1)::INT] AS kind,
         CASE WHEN s_suppkey % 4 = 0 THEN 'note ' || s_name END AS note, CASE WHEN s_suppkey % 2 = 0 THEN 'rural health|award ' || s_suppkey ELSE '' END AS terms,
         s_suppkey % 5 = 0 AS unverified, CASE WHEN s_suppkey % 7 = 0 THEN (s_suppkey % 10)::BIGINT END AS tries
  FROM nation JOIN supplier ON s_nationkey = n_nationkey)"""

_REPORT = f"""{_LATEST}, {_TOTALS},
f AS (SELECT l.program, l.month, a.total, a.total - coalesce(b.total, a.total) AS mom, c.month AS base, a.total - c.total AS base_change,
             CASE WHEN c.total <> 0 THEN (a.total - c.total)::DOUBLE / c.total::DOUBLE * 100.0 ELSE 0.0 END AS base_pct
      FROM last l JOIN t a USING (program, month) LEFT JOIN t b ON b.program = l.program AND b.month = l.prior LEFT JOIN t c ON c.program = l.program AND c.month = '1998-01'),
k AS (SELECT program, count(*) FILTER (change < 0) || ' declined, ' || count(*) FILTER (change > 0) || ' gained, ' || count(*) FILTER (change = 0) || ' flat, of ' || count(*) AS counts FROM r GROUP BY program),
v AS (SELECT program, 1 AS ord, 'Data month' AS name, month AS value, 0 AS way FROM f
      UNION ALL SELECT program, 2, 'Total enrollment', format('{{:,}}', total), 0 FROM f
      UNION ALL SELECT program, 3, 'Change vs prior month', CASE WHEN mom < 0 THEN '' ELSE '+' END || format('{{:,}}', mom), sign(mom) FROM f
      UNION ALL SELECT program, 4, 'Change vs ' || base || ' baseline', CASE WHEN base_change < 0 THEN '' ELSE '+' END || format('{{:,}}', base_change) || ' (' || printf('%+.1f%%', base_pct) || ')', sign(base_change) FROM f WHERE base IS NOT NULL
      UNION ALL SELECT program, 5, 'Counties', counts, 0 FROM k),
s AS (SELECT program, county, change, pct, format('{{:,}}', "then") AS before, format('{{:,}}', now) AS now, CASE WHEN change < 0 THEN '' ELSE '+' END || format('{{:,}}', change) AS moved, printf('%+.1f%%', pct) AS p FROM r),
down AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY change, pct, county) AS rank FROM s WHERE change < 0 QUALIFY rank <= 15),
up AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY change DESC, pct, county) AS rank FROM s WHERE change > 0 QUALIFY rank <= 5)"""
_ABOUT = "A monthly reading of enrollment by county, showing where it declines."
_CAVEAT = "Figures cover the tracked program alone; they are a trend, not a headcount."


def _fit(x: str, width: int, left: bool = False) -> str:
    return f"CASE WHEN length({x}) >= {width} THEN {x} ELSE {'rpad' if left else 'lpad'}({x}, {width}, ' ') END"


def _text_row(*cells: tuple[str, int]) -> str:
    return "'  ' || " + " || ' ' || ".join(_fit(x, w, i == 0) for i, (x, w) in enumerate(cells))


_REPORT_TEXT = f"""{_REPORT},
lines AS (
  SELECT program, 0 AS part, 0 AS ord, 'Enrollment change report' AS line FROM f
  UNION ALL SELECT program, 1, 0, '{_ABOUT}' FROM f UNION ALL SELECT program, 5, 0, '{_CAVEAT}' FROM f
  UNION ALL SELECT program, 2, ord, name || ': ' || value FROM v
  UNION ALL SELECT DISTINCT program, 3, -2, 'Where enrollment fell most' FROM down UNION ALL SELECT DISTINCT program, 4, -2, 'Where enrollment rose most' FROM up
  UNION ALL SELECT DISTINCT program, 3, -1, {_text_row(("'County'", 14), ("'Prior'", 9), ("'Now'", 9), ("'Change'", 8), ("'%'", 8))} FROM down
  UNION ALL SELECT DISTINCT program, 4, -1, {_text_row(("'County'", 14), ("'Change'", 8), ("'%'", 8))} FROM up
  UNION ALL SELECT program, 3, rank, {_text_row(("county", 14), ("before", 9), ("now", 9), ("moved", 8), ("p", 8))} FROM down
  UNION ALL SELECT program, 4, rank, {_text_row(("county", 14), ("moved", 8), ("p", 8))} FROM up),
parts AS (SELECT program, part, string_agg(line, chr(10) ORDER BY ord) AS text FROM lines GROUP BY program, part)
SELECT program, string_agg(text, chr(10) || chr(10) ORDER BY part) AS body FROM parts GROUP BY program"""


def _html_row(tag: str, cells: list[str], coloured: bool) -> str:
    style = lambda i: STYLE["number" if i else "name"]
    colour = f" || CASE WHEN change < 0 THEN '; color: {WAYS[-1]}' WHEN change > 0 THEN '; color: {WAYS[1]}' ELSE '' END || "
    cell = lambda i, x: f"'<{tag} style=\"{style(i)}'" + (colour if coloured and i > len(cells) - 3 else " || ") + f"'\">' || {x} || '</{tag}>'"
    return "'<tr>' || " + " || ".join(cell(i, x) for i, x in enumerate(cells)) + " || '</tr>'"


_REPORT_HTML = f"""{_REPORT},
lines AS (
  SELECT program, -1 AS part, 0 AS ord, '<main style="{STYLE["page"]}">' AS line FROM f
  UNION ALL SELECT program, 0, 0, '<h1 style="{STYLE["heading"]}">Enrollment change report</h1>' FROM f
  UNION ALL SELECT program, 1, 0, '<p>{_ABOUT}</p>' FROM f UNION ALL SELECT program, 5, 0, '<p>{_CAVEAT}</p>' FROM f
  UNION ALL SELECT program, 2, -1, '<table>' FROM f UNION ALL SELECT program, 2, 99, '</table>' FROM f
  UNION ALL SELECT program, 2, ord, '<tr><th style="{STYLE["name"]}">' || name || '</th><td' || CASE WHEN way < 0 THEN ' style="color: {WAYS[-1]}"' WHEN way > 0 THEN ' style="color: {WAYS[1]}"' ELSE '' END || '>' || value || '</td></tr>' FROM v
  UNION ALL SELECT DISTINCT program, 3, -3, '<table>' FROM down UNION ALL SELECT DISTINCT program, 3, 99, '</table>' FROM down
  UNION ALL SELECT DISTINCT program, 4, -3, '<table>' FROM up UNION ALL SELECT DISTINCT program, 4, 99, '</table>' FROM up
  UNION ALL SELECT DISTINCT program, 3, -2, '<caption style="{STYLE["caption"]}">Where enrollment fell most</caption>' FROM down
  UNION ALL SELECT DISTINCT program, 4, -2, '<caption style="{STYLE["caption"]}">Where enrollment rose most</caption>' FROM up
  UNION ALL SELECT DISTINCT program, 3, -1, {_html_row("th", ["'County'", "'Prior'", "'Now'", "'Change'", "'%'"], False)} FROM down
  UNION ALL SELECT DISTINCT program, 4, -1, {_html_row("th", ["'County'", "'Change'", "'%'"], False)} FROM up
  UNION ALL SELECT program, 3, rank, {_html_row("td", ["county", "before", "now", "moved", "p"], True)} FROM down
  UNION ALL SELECT program, 4, rank, {_html_row("td", ["county", "moved", "p"], True)} FROM up
  UNION ALL SELECT program, 7, 0, '</main>' || chr(10) FROM f)
SELECT program, string_agg(line, chr(10) ORDER BY part, ord) AS body FROM lines GROUP BY program"""

_TICKS = "least(CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END, 2)"

ORACLES = {
    "explode_catalog": f"WITH {_CATALOG} SELECT * FROM c",
    "report_text": _REPORT_TEXT,
    "report_html": _REPORT_HTML,
    "event_properties": """SELECT event_id, key, value::BIGINT AS value, 'number' AS kind FROM (
        SELECT event_id, unnest(json_keys(props)) AS key, json_extract(props, '$.' || unnest(json_keys(props))) AS value FROM events)""",
    "stream_state_ledger": f"""SELECT user_id, day, event_id FROM (SELECT CASE WHEN user_id % 11 > 0 THEN user_id END AS user_id, strftime(ts, '%Y-%m-%d') AS day, ts, event_id, {_TICKS} AS tick FROM events)
        QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY tick, ts, event_id) = 1""",
    "stream_problem_registry": f"""WITH {_SEEN},
        b AS (SELECT key, CASE WHEN substr(seen, 9, 2)::INT <= 10 THEN 0 WHEN substr(seen, 9, 2)::INT <= 20 THEN 1 ELSE 2 END AS tick, min(seen) AS a, max(seen) AS z, arg_min(detail, (seen, detail)) AS detail FROM s GROUP BY ALL),
        c AS (SELECT *, coalesce((a::DATE - max(z) OVER (PARTITION BY key ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::DATE) >= 4, true) AS fresh FROM b),
        g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY key ORDER BY tick) AS spell FROM c),
        h AS (SELECT key, spell, arg_min(detail, tick) AS detail, min(a) AS first_seen, max(z) AS last_seen FROM g GROUP BY key, spell)
        SELECT key, detail, first_seen, last_seen FROM h QUALIFY row_number() OVER (PARTITION BY key ORDER BY spell DESC) = 1""",
    "null_key_ledger": f"""WITH {_DAILY}, n AS (SELECT CASE WHEN user_id % 3 > 0 THEN user_id END AS user_id, event_type, ts, event_id FROM d)
        SELECT user_id, event_type, event_id FROM n QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
    "match_repeated_ids": f"""WITH {_ITEMS}, q AS (SELECT row_number() OVER () AS r, CASE WHEN k % 3 > 0 THEN 'Q' || k // 10 END AS id, url, name, amount, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS plain FROM i),
        w AS (SELECT id, url, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS plain, amount - CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS amount FROM b),
        y AS (SELECT q.*, (SELECT min(w.id) FROM w WHERE w.url = q.url) AS by_url, (SELECT min(w.id) FROM w WHERE w.plain = q.plain) AS by_name FROM q),
        e AS (SELECT y.r, arg_min(w.id, (levenshtein(y.plain, w.plain), w.id)) AS by_near FROM y JOIN w ON levenshtein(y.plain, w.plain) <= 2 GROUP BY y.r),
        z AS (SELECT y.*, coalesce(by_url, by_name, by_near) AS matched_id FROM y LEFT JOIN e USING (r))
        SELECT z.id, name, matched_id, CASE WHEN matched_id IS NULL THEN NULL WHEN by_url IS NOT NULL THEN 'url' ELSE 'name' END AS matched_by,
               CASE WHEN matched_id IS NULL THEN 'NEW' WHEN z.amount = w.amount THEN 'unchanged' ELSE 'UPDATE' END AS status FROM z LEFT JOIN w ON w.id = matched_id""",
    "fuzzy_large_dimension": r"""WITH t AS (SELECT DISTINCT p_type AS name, regexp_replace(lower(p_type), '[^a-z]', '', 'g') AS norm FROM part),
        l AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN regexp_replace(p_type, '[AEIOU]', '', 'g') WHEN 1 THEN left(p_type, length(p_type) - 3)
                WHEN 2 THEN regexp_replace(p_type, '[A-Z]( |$)', ' ', 'g') ELSE regexp_replace(p_type, '^[A-Z]', 'Q') END AS label FROM part),
        u AS (SELECT label, regexp_replace(lower(label), '[^a-z]', '', 'g') AS probe FROM l),
        e AS (SELECT label, name FROM u JOIN t ON t.norm = u.probe),
        h AS (SELECT label, t.name, starts_with(t.norm, probe) AS pre FROM u, t WHERE label NOT IN (SELECT label FROM e) AND length(probe) >= 3 AND regexp_matches(t.norm, array_to_string(string_split(probe, ''), '.*'))),
        g AS (SELECT label, count(*) FILTER (pre) AS np, min(name) FILTER (pre) AS pn, count(*) AS ns, min(name) AS sn FROM h GROUP BY label),
        z AS (SELECT label, name, 'exact' AS how FROM e
              UNION ALL SELECT label, CASE WHEN np = 1 THEN pn ELSE sn END, CASE WHEN np = 1 THEN 'prefix' ELSE 'subsequence' END FROM g WHERE np = 1 OR (np = 0 AND ns = 1))
        SELECT u.label, z.name, how FROM u LEFT JOIN z USING (label)""",
    "sections_cross_check": f"WITH {_DOCS} SELECT doc_id, count(*) AS n_rows, max((k % 3 = 0)::BIGINT) AS n_conflicts, 0::BIGINT AS n_differ FROM y GROUP BY doc_id",
    "landed_listing": """WITH p AS (SELECT (page_id // 5)::INT AS page, page_id::VARCHAR AS source_id, md5(html) AS seen FROM pages WHERE page_id // 5 <> 12)
        SELECT * FROM p WHERE page >= 2 AND page < least(40, (SELECT min(i) FROM range((SELECT count(*) + 1 FROM p)) r(i) WHERE i NOT IN (SELECT page FROM p)))""",
    "document_folder": "SELECT (doc_id % 2)::INT AS batch, doc_id, md5(coalesce(text, '')) AS seen FROM documents",
    "silence_gate": f"""WITH {_DAILY}, r AS (SELECT user_id, day, count(*) FILTER (event_type = 'purchase') AS alerts, count(*) FILTER (value < 1) AS problems FROM d GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) = 1 AS fresh, coalesce(sum(alerts) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS history FROM r)
        SELECT user_id, day, CASE WHEN NOT fresh AND alerts = 0 AND problems = 0 THEN 'NO_UPDATE' WHEN history = 0 THEN 'NO_DATA' ELSE 'REPORT' END AS says FROM o""",
    "idempotent_rerun": f"WITH {_DAILY}, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id, day FROM d)) SELECT n AS n_added, 0::BIGINT AS n_added_again, n AS n_recorded FROM n",
    "saved_fingerprint": f"WITH {_PRINTS} SELECT * FROM new ANTI JOIN old USING (page_id, label)",
    "report_files": f"SELECT program, md5(body) AS seen FROM ({_REPORT_HTML})",
    "portal_cells": """SELECT o_orderkey AS page, 'Clinic ' || o_orderkey || ' A &amp; B "x" "y" ''s end' AS entity, 'WI' AS state, '1,500' AS individuals_affected,
        strftime(o_orderdate, '%m/%d/%Y') AS submission_date, NULL::VARCHAR AS total_listed FROM orders""",
    "labelled_blocks": """SELECT 'Firm & Sons ' || o_orderkey AS entity, CASE WHEN o_orderkey % 4 IN (0, 2) THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS reported, '1/2/2003' AS breach_dates,
        CASE o_orderkey % 4 WHEN 1 THEN '12' WHEN 2 THEN '7' END AS state_residents, CASE WHEN o_orderkey % 4 = 0 THEN '1,234' END AS total FROM orders""",
    "observed_gate": f"""WITH {_SECTIONS} SELECT count(*) AS sections, count(*) FILTER (NOT bad) AS accepted, count(*) FILTER (bad) AS refused, count(*) FILTER (len(conflicts) > 0) AS conflicts,
        count(*) FILTER (total IS NULL) AS unstated, sum(n)::BIGINT AS n_rows FROM (SELECT *, len(conflicts) > 0 OR n = 0 OR off AS bad FROM q)""",
    "sources_by_kind": f"WITH {_CATALOG} SELECT kind, count(*) AS n, count(*) FILTER (unverified) AS n_unverified FROM c GROUP BY kind",
    "mom_rank": f"WITH {_PANEL}, {_RANKED.format(months='m')} SELECT * FROM r",
    "mom_latest_decline_top15": f"{_LATEST} SELECT *, row_number() OVER (PARTITION BY program ORDER BY change, pct, county)::INT AS rank FROM r WHERE change < 0 QUALIFY rank <= 15",
    "mom_gainers_top5": f"{_LATEST} SELECT *, row_number() OVER (PARTITION BY program ORDER BY change DESC, pct, county)::INT AS rank FROM r WHERE change > 0 QUALIFY rank <= 5",
    "direction_counts": f"{_LATEST} SELECT program, count(*) FILTER (change < 0) AS declined, count(*) FILTER (change > 0) AS gained, count(*) FILTER (change = 0) AS flat, count(*) AS n FROM r GROUP BY program",
    "baseline_change": f"""WITH {_PANEL}, {_TOTALS} SELECT a.program, a.month, b.month AS baseline, a.total AS now, b.total AS "then", a.total - b.total AS change,
        CASE WHEN b.total <> 0 THEN (a.total - b.total)::DOUBLE / b.total::DOUBLE * 100.0 ELSE 0.0 END AS pct FROM last JOIN t a USING (program, month) JOIN t b ON b.program = a.program AND b.month = '1998-01'""",
    "mom_override_prior": f"WITH {_PANEL}, x0 AS (SELECT program, month, '1997-06' AS prior FROM last), {_RANKED.format(months='x0')} SELECT * FROM r",
    "county_series": f"WITH {_PANEL} SELECT program, county, count(*)::INT AS n_months, string_agg(month || '=' || value, ',' ORDER BY month) AS series FROM p GROUP BY program, county",
    "month_coverage": f"WITH {_PANEL} SELECT program, count(DISTINCT month) AS n_months, min(month) AS first_month, max(month) AS last_month FROM p GROUP BY program",
    "month_totals_by_year": f"WITH {_PANEL} SELECT program, substr(month, 1, 4) AS year, count(DISTINCT month) AS n_months, sum(value)::BIGINT AS total FROM p GROUP BY ALL",
    "reconcile_total": f"""WITH {_LINES} SELECT o_orderkey, n, found::DOUBLE AS found, total::DOUBLE AS total, abs(found - total)::DOUBLE AS difference,
        abs(found - total)::DOUBLE > greatest(5.0, total::DOUBLE * 0.005) AS refused FROM s WHERE n IS NOT NULL""",
    "conflict_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows, count(DISTINCT l_extendedprice) AS n_values FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_extendedprice) > 1",
    "short_list_gate": f"WITH {_PANEL} SELECT program, month, count(*) AS n, NOT (month < '1998') AND count(*) < 20 AS refused FROM p GROUP BY program, month",
    "validation_status": f"WITH {_SECTIONS} SELECT o_orderkey, n, found, total, CASE WHEN len(conflicts) > 0 THEN 'CONFLICT' WHEN total IS NULL OR off THEN 'CHK' ELSE 'OK' END AS status FROM q",
    "first_problem": f"""WITH {_SECTIONS}, g AS (SELECT *, len(conflicts) > 0 AS c1, n = 0 AS c2, n > 0 AND off AS c3 FROM q)
        SELECT o_orderkey, (c1::INT + c2::INT + c3::INT) AS n_problems,
               CASE WHEN c1 THEN 'Places with two values in a section: ' || array_to_string(list_sort(conflicts)[1:5], ', ')
                    WHEN c2 THEN 'A section without rows of places'
                    WHEN c3 THEN format('Rows add up to {{:,}}, stated are {{:,}}: off by {{:,}} where {{:,}} may be', found, total, abs(found - total), round_even(greatest(5.0, total::DOUBLE * 0.005), 0)::BIGINT) END AS first_problem,
               NOT (c1 OR c2 OR c3) AS accepted FROM g""",
    "first_write_wins": f"WITH {_DAILY} SELECT user_id, day, event_id, event_type, value FROM d QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) = 1",
    "problem_registry": f"""WITH {_SEEN}, a AS (SELECT key, min(seen) AS first_seen, max(seen) AS last_seen FROM s GROUP BY key)
        SELECT a.key, (SELECT min(s.detail) FROM s WHERE s.key = a.key AND s.seen = a.first_seen) AS detail, first_seen, last_seen FROM a""",
    "new_problem_only": f"""WITH {_SEEN}, a AS (SELECT key, min(seen) AS first_seen, max(seen) AS last_seen FROM s GROUP BY key HAVING min(seen) >= '2024-01-05')
        SELECT a.key, (SELECT min(s.detail) FROM s WHERE s.key = a.key AND s.seen = a.first_seen) AS detail, first_seen, last_seen FROM a""",
    "clear_problem": f"""WITH {_SEEN}, a AS (SELECT key, min(seen) AS first_seen, max(seen) AS last_seen FROM s WHERE key NOT LIKE '%|purchase' GROUP BY key)
        SELECT a.key, (SELECT min(s.detail) FROM s WHERE s.key = a.key AND s.seen = a.first_seen) AS detail, first_seen, last_seen FROM a""",
    "insert_if_absent": f"WITH {_DAILY} SELECT user_id, day, event_id FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "retention_last_n": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30",
    "retention_last_500": "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
    "new_period_keys": f"WITH {_PANEL} SELECT DISTINCT program, month FROM p WHERE month >= '2000-01'",
    "run_summary": f"""WITH {_DAILY}, f AS (SELECT first_day AS day, count(*) AS n_new FROM (SELECT user_id, min(day) AS first_day FROM d GROUP BY user_id) GROUP BY 1)
        SELECT d.day, count(DISTINCT user_id) AS checked, count(*) FILTER (value < 1) AS failed, coalesce(any_value(n_new), 0) AS n_new FROM d LEFT JOIN f USING (day) GROUP BY d.day""",
    "baseline_flags": f"""WITH {_DAILY}, s AS (SELECT *, event_type || '/' || user_id AS source FROM d)
        SELECT event_id, source, source NOT IN (SELECT source FROM s WHERE day < '2024-01-10') AS is_baseline FROM s WHERE day >= '2024-01-10'""",
    "still_open": "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 OR o_orderdate >= DATE '2001-05-01'",
    "discovery_audit": """WITH r AS (SELECT CASE WHEN o_orderkey % 11 > 0 THEN strftime(o_orderdate, '%Y-%m') END AS month, '/r' || o_orderkey AS url, o_orderkey AS pos FROM orders)
        SELECT substr(month, 1, 4) AS year, count(DISTINCT month) AS n_months, count(*) AS n_links, arg_min(url, (coalesce(month, ''), pos)) AS first_url FROM r GROUP BY 1""",
    "extract_links": f"WITH {_LINKS} SELECT * FROM l",
    "dedupe_links_first": f"""WITH {_LINKS}, u AS (SELECT CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://site.example' || href END AS url, label, page_id, pos FROM l WHERE label <> '')
        SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, pos) = 1""",
    "report_links": f"""WITH {_LINKS}, u AS (SELECT CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://site.example' || href END AS url, label, page_id, pos FROM l WHERE regexp_matches(label, '[Tt][Hh]'))
        SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, pos) = 1""",
    "link_fingerprint": f"WITH {_PRINTS} SELECT * FROM f",
    "fingerprint_added": f"WITH {_PRINTS} SELECT * FROM new ANTI JOIN old USING (page_id, label)",
    "fingerprint_removed": f"WITH {_PRINTS} SELECT * FROM old ANTI JOIN new USING (page_id, label)",
    "page_alerts": f"WITH {_PRINTS} SELECT page_id, label, '[' || page_id || '] new: ' || label AS alert FROM new ANTI JOIN old USING (page_id, label) WHERE page_id % 5 <> 0 OR page_id NOT IN (SELECT page_id // 2 FROM pages WHERE page_id % 2 = 0)",
    "carry_forward_failed": f"""WITH {_PRINTS}, bad AS (SELECT page_id // 2 AS page_id FROM pages WHERE page_id % 2 = 0 AND (page_id // 2) % 5 = 0)
        SELECT * FROM new ANTI JOIN bad USING (page_id) UNION ALL SELECT * FROM old SEMI JOIN bad USING (page_id)""",
    "url_resolve": f"WITH {_LINKS} SELECT page_id, pos, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://site.example' || href END AS url FROM l",
    "strip_tags": f"SELECT page_id, {_TEXT.format(x='html')} AS text FROM pages",
    "html_clean": f"SELECT page_id, {_HTML_CLEAN} AS text FROM pages",
    "html_escape": "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM pages",
    "norm_name": "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS norm FROM part",
    "period_key": f"WITH {_SPELT} SELECT o_orderkey, CASE WHEN list_position({_MONTHS}, lower(m)) > 0 THEN y || '-' || lpad(list_position({_MONTHS}, lower(m))::VARCHAR, 2, '0') END AS period FROM s",
    "period_hint": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 AND o_orderdate >= DATE '2000-01-01' THEN strftime(o_orderdate, '%Y%m') END AS hint FROM orders""",
    "iso_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS reported FROM orders",
    "iso_long_date": f"WITH {_SPELT} SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 AND NOT (substr(lower(m), 1, 3) IN ('jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec')) THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS reported FROM s",
    "slug_id": """SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') || ':' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') || ':' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS id FROM part""",
    "email_valid": r"""WITH m AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) || '@mail.example' WHEN 1 THEN c_name || '@mail' WHEN 2 THEN ' a.b@' || lower(c_name) || '.org ' ELSE c_name END AS mail FROM customer)
        SELECT c_custkey, regexp_matches(trim(mail), '^[^\s@]+@[^\s@]+\.[^\s@]+$') AS valid, trim(mail) <> '' AS filled FROM m""",
    "phone_valid": "SELECT c_custkey, c_custkey % 3 = 0 AND length(c_custkey::VARCHAR) + 8 <= 16 AS valid FROM customer",
    "ease_out": "SELECT p_partkey, floor(p_size * (1.0::DOUBLE - pow(1.0::DOUBLE - least((p_partkey % 13)::DOUBLE / 10.0::DOUBLE, 1.0::DOUBLE), 4.0::DOUBLE)))::BIGINT AS shown FROM part",
    "percent_change": """WITH r AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS "then", count(*) FILTER (l_linestatus = 'O') AS now FROM lineitem GROUP BY l_suppkey)
        SELECT l_suppkey, CASE WHEN "then" <> 0 THEN (now - "then")::DOUBLE / "then"::DOUBLE * 100.0 ELSE 0.0 END AS pct, CASE WHEN now < "then" THEN 'down' WHEN now > "then" THEN 'up' ELSE 'flat' END AS direction,
               (CASE WHEN now < "then" THEN '-' ELSE '+' END) || format('{:,}', abs(now - "then")) AS told FROM r""",
    "canonical_exact": f"WITH {_LABELS} SELECT p_partkey, label, e.name FROM l LEFT JOIN e USING (label)",
    "fuzzy_labels": f"WITH {_LABELS} SELECT label, z.name, how FROM u LEFT JOIN z USING (label)",
    "fuzzy_prefix": f"WITH {_LABELS} SELECT label, name FROM z WHERE how = 'prefix'",
    "fuzzy_subsequence_unique": f"WITH {_LABELS} SELECT label, name FROM z WHERE how = 'subsequence'",
    "display_name": f"WITH {_LABELS} SELECT p_partkey, CASE z.name {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in DISPLAY.items())} ELSE z.name END AS shown FROM l LEFT JOIN z USING (label)",
    "match_cascade": f"WITH {_ITEMS} SELECT id, matched_id, matched_by, status FROM x",
    "material_update": f"""WITH {_ITEMS}, up AS (SELECT matched_id AS id, min(amount) AS amount FROM x WHERE status = 'UPDATE' GROUP BY 1)
        SELECT b.id, url, name, coalesce(up.amount, b.amount) AS amount, '2024-01-01' AS first_seen, CASE WHEN up.id IS NULL THEN '2024-01-01' ELSE '2024-02-01' END AS last_updated FROM b LEFT JOIN up USING (id)
        UNION ALL SELECT id, url, name, amount, '2024-02-01', '2024-02-01' FROM x WHERE status = 'NEW'""",
    "sheet_upsert": f"WITH {_ITEMS} SELECT coalesce(b.id, i.id) AS id, b.url, b.name, coalesce(i.amount, b.amount) AS amount, 'kept ' || b.id AS note FROM b FULL JOIN i ON b.id = i.id",
    "naming_known": r"""WITH a AS (SELECT c_custkey, 'Supplier#' || lpad(c_custkey::VARCHAR, 9, '0') || CASE WHEN c_custkey % 3 = 0 THEN ' Inc.' ELSE '' END AS award FROM customer)
        SELECT c_custkey FROM a WHERE regexp_replace(lower(award), '[^a-z]', '', 'g') IN (SELECT regexp_replace(lower(s_name), '[^a-z]', '', 'g') FROM supplier WHERE s_suppkey % 2 = 1)""",
    "since_filter": f"WITH {_FILINGS} SELECT source, entity, reported FROM f WHERE reported >= '2000-06-01'",
    "since_by_source": f"""WITH {_FILINGS}, a AS (SELECT o_orderpriority AS source, strftime(min(o_orderdate) + INTERVAL 200 DAY, '%Y-%m-%d') AS since FROM orders GROUP BY 1)
        SELECT source, entity, reported FROM f JOIN a USING (source) WHERE reported >= since AND source NOT LIKE '1%'""",
    "since_refused": """SELECT o_orderpriority AS source_key, strftime(min(o_orderdate) + INTERVAL 200 DAY, '%d.%m.%Y') AS since, 'since must be YYYY-MM-DD, not ' || strftime(min(o_orderdate) + INTERVAL 200 DAY, '%d.%m.%Y') AS problem
        FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1""",
    "newest_per_source": f"WITH {_FILINGS} SELECT source AS source_key, max(nullif(reported, '')) AS newest FROM f GROUP BY source",
    "filings_sorted": f"WITH {_FILINGS} SELECT source, entity, reported FROM f WHERE reported >= '2001-07-01' ORDER BY reported DESC, source, entity",
    "lookback_window": f"WITH {_FILINGS} SELECT entity, reported FROM f WHERE reported BETWEEN '2000-03-01' AND '2000-03-31'",
    "lookback_baseline": f"WITH {_FILINGS} SELECT entity, reported FROM f WHERE reported BETWEEN '2000-03-01' AND '2000-03-31'",
    "cell_filings": "SELECT 'cells' AS source, 'Firm ' || o_orderkey AS entity, strftime(o_orderdate, '%Y-%m-%d') AS reported, o_custkey::VARCHAR AS state_residents, o_orderstatus || ', TX; ' || o_orderpriority AS extra FROM orders",
    "combined_filings": f"WITH {_FILINGS} SELECT CASE WHEN source = '1-URGENT' THEN 'urgent' ELSE 'other' END AS source_key, source, entity, reported FROM f",
    "isolated_sources": "SELECT 'good' AS source_key, true AS read, count(*) AS n FROM orders UNION ALL SELECT x, false, 0 FROM (VALUES ('empty'), ('bad'), ('unknown')) t(x)",
    "problem_keys": "SELECT o_orderkey, 'http://x/' || o_orderkey || '|' || CASE WHEN o_orderkey % 2 = 0 THEN substr('Total of order ' || o_orderkey || ' is far from what its lines add up to', 1, 40) ELSE 'err' END AS key FROM orders",
    "wanted_months": f"""WITH {_PANEL}, l AS (SELECT o_orderkey, o_orderkey % 3 AS k, strftime(o_orderdate, '%Y-%m') AS m, strftime(o_orderdate, '%Y%m') AS f FROM orders),
        g AS (SELECT CASE WHEN k = 0 THEN 'http://x/' || f || '-' || o_orderkey || '.pdf' ELSE 'http://x/report-' || o_orderkey || '.pdf' END AS url, CASE WHEN k = 1 OR (k = 0 AND f >= '200001') THEN m END AS month FROM l)
        SELECT url, month FROM g WHERE month IS NULL OR month NOT IN (SELECT month FROM p WHERE program = 'BUILDING' AND substr(month, 6, 2) <= '06')""",
    "landed_pages": """SELECT page_id::VARCHAR AS source_id, md5(CASE WHEN page_id % 7 = 0 THEN substr(url || ': Timeout: ' || repeat('slow ', 60), 1, 200)
        WHEN page_id % 2 = 0 THEN html || chr(65533) ELSE html END) AS seen FROM pages""",
    "pages_read": "SELECT (o_orderkey // 100)::INT AS page, o_orderkey FROM orders WHERE o_orderkey // 100 < least(50, (SELECT min(i) FROM range(60) r(i) WHERE i = 40 OR i NOT IN (SELECT o_orderkey // 100 FROM orders)))",
    "listings_read": """WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS listing, (day(o_orderdate) - 1)::INT AS page, (month(o_orderdate) + 12)::INT AS most, o_orderkey FROM orders WHERE o_orderkey % 5 < 3)
        SELECT listing, page, most, o_orderkey FROM r WHERE page < most AND (SELECT count(DISTINCT b.page) FROM r b WHERE b.listing = r.listing AND b.page <= r.page) = page + 1""",
    "reference_file": "SELECT p_partkey, p_name, p_size FROM part",
    "json_rows": """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS value FROM nation""",
    "state_versions": "SELECT n_nationkey, 3::INT AS n FROM nation",
    "full_list_gate": """SELECT c_nationkey, n, n <= 50 OR n >= 102 AS accepted, CASE WHEN n > 50 AND n < 102 THEN 'Only ' || n || ' of 102 places, without a stated total to hold them against' END AS first_problem
        FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)""",
    "documents_without_sections": f"WITH {_PANEL} SELECT DISTINCT program || '/' || month AS doc_id, program || '/' || month || ': a document without sections' AS problem FROM p WHERE program NOT IN ('BUILDING', 'MACHINERY')",
    "subject_line": f"""WITH {_PANEL}, {_TOTALS}, s AS (SELECT l.month, a.total - coalesce(b.total, a.total) AS moved FROM last l JOIN t a USING (program, month) LEFT JOIN t b ON b.program = l.program AND b.month = l.prior WHERE l.program = 'BUILDING')
        SELECT 'Enrollment ' || month || ': ' || CASE WHEN moved = 0 THEN 'no change' WHEN moved > 0 THEN '+' || format('{{:,}}', moved) ELSE format('{{:,}}', moved) END || ' MoM' AS subject FROM s""",
    "active_hold": f"WITH {_FILINGS} SELECT entity, (DATE '2000-03-03' - reported::DATE)::INT AS days FROM f WHERE reported <> '' AND DATE '2000-03-03' - reported::DATE BETWEEN 0 AND 14",
    "html_table_rows": """SELECT 'table' AS source, o_orderkey::VARCHAR AS entity, strftime(o_orderdate, '%Y-%m-%d') AS reported, o_orderstatus AS breach_dates, o_custkey || ' & more' AS state_residents, 'sent ' || o_orderpriority AS extra FROM orders""",
    "laid_out_lines": """SELECT 'Clinic ' || o_custkey AS entity, strftime(o_orderdate, '%Y-%m-%d') AS reported, '1/2/2003' AS breach_dates,
        CASE WHEN o_orderkey % 3 > 0 THEN '1,234' END AS state_residents, CASE WHEN o_orderkey % 3 > 1 THEN '5,678' END AS total FROM orders""",
    "text_blocks": "SELECT 'Firm ' || o_orderkey AS entity, '2001-03-05' AS reported, strftime(o_orderdate, '%-m/%-d/%Y') AS breach_dates, '12' AS state_residents, NULL::VARCHAR AS total FROM orders",
    "portal_listing": "SELECT o_orderkey AS page, o_orderkey::VARCHAR AS entity, 'WI' AS state, '500' AS individuals_affected, strftime(o_orderdate, '%m/%d/%Y') AS submission_date, '1,234' AS total_listed FROM orders",
    "portal_newest": "SELECT count(*) AS n_rows, '1,234' AS total_listed, arg_min(strftime(o_orderdate, '%m/%d/%Y'), o_orderkey) AS newest_submission_date FROM orders",
    "tier_bucket": "SELECT CASE WHEN c_acctbal >= 8000 THEN 'Tier 1' WHEN c_acctbal >= 4000 THEN 'Tier 2' WHEN c_acctbal >= 0 THEN 'Tier 3' ELSE 'none' END AS tier, count(*) AS n FROM customer GROUP BY 1",
    "tier_top_n_with_remainder": """WITH c AS (SELECT c_mktsegment AS tier, c_custkey, floor(c_acctbal)::BIGINT AS size FROM customer),
        t AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY size DESC, c_custkey)::INT AS rank FROM c)
        SELECT tier, c_custkey, size, rank, NULL::BIGINT AS n_more FROM t WHERE rank <= 40 UNION ALL SELECT tier, NULL, NULL, NULL, count(*) - 40 FROM c GROUP BY tier HAVING count(*) > 40""",
    "signal_cap": """WITH s AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 9 END AS kind, floor(value)::BIGINT AS score FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-30'),
        r AS (SELECT *, row_number() OVER (ORDER BY kind, score DESC, event_id)::INT AS rank FROM s) SELECT *, rank > 15 AS include_next_run FROM r""",
    "group_order": "SELECT o_orderpriority, count(*) AS n, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority)::BIGINT AS place FROM orders GROUP BY 1",
    "group_counts": "SELECT o_orderpriority, string_agg(o_orderstatus || ' ' || n, ', ' ORDER BY o_orderstatus) AS told FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1",
    "size_word": "SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN 'Very large' WHEN o_totalprice >= 50000 THEN 'Large' WHEN o_totalprice >= 25000 THEN 'Mid-size' WHEN o_totalprice >= 10000 THEN 'Small' ELSE 'Very small' END AS size FROM orders",
    "rural_score": "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 0.80::DOUBLE ELSE 0.10::DOUBLE END + CASE WHEN c_acctbal < 0 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS score FROM customer",
    "parse_sections": f"WITH {_DOCS} SELECT doc_id, prog AS program, month, county, value FROM w",
    "section_totals": f"WITH {_DOCS} SELECT doc_id, prog AS program, count(*) AS n, sum(value)::BIGINT AS found, any_value(total) AS total FROM w GROUP BY doc_id, prog",
    "orphan_claim": f"WITH {_DOCS} SELECT doc_id, count(*) AS n, arg_min(val, county) AS first_value, sum(val)::BIGINT AS found FROM y GROUP BY doc_id",
    "section_conflicts": f"WITH {_DOCS} SELECT DISTINCT doc_id, first_county AS county FROM w WHERE k % 3 = 0",
    "section_gate": f"""WITH {_DOCS}, g AS (SELECT doc_id, k % 3 = 0 AS c, abs(sum(val) - any_value(total + CASE WHEN k % 4 = 0 THEN 50 ELSE 0 END))::DOUBLE > greatest(5.0, any_value(total + CASE WHEN k % 4 = 0 THEN 50 ELSE 0 END)::DOUBLE * 0.005) AS off FROM y GROUP BY doc_id, k)
        SELECT doc_id, NOT (c OR off) AS accepted, c::INT + off::INT AS n_problems FROM g""",
    "mail_new_or_grown": """WITH o AS (SELECT conv_id, count(*) AS before FROM conversations WHERE turn < 2 AND conv_id % 4 <> 0 GROUP BY conv_id), n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
        SELECT conv_id, n, before, CASE WHEN before IS NULL THEN 'new' ELSE 'grown' END AS reason FROM n LEFT JOIN o USING (conv_id) WHERE before IS NULL OR n > before""",
    "mail_items": "SELECT 'Sender ' || conv_id AS sender, 'Subject' AS subject, CASE WHEN count(*) > 2 THEN count(*)::INT ELSE 1 END AS count, 'Mon' AS date, 'first line second line' AS snippet FROM conversations GROUP BY conv_id",
    "unread_summary": "SELECT last_role, count(*) AS threads, sum(n)::BIGINT AS messages FROM (SELECT conv_id, arg_max(role, turn) AS last_role, count(*) AS n FROM conversations GROUP BY conv_id) GROUP BY last_role",
    "stream_append_ledger": f"WITH {_DAILY} SELECT user_id, day, event_id FROM d QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) = 1",
    "period_from_text": "SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS period FROM orders",
    "closest_month": f"WITH {_SPELT} SELECT DISTINCT lower(m) AS word, extract(month FROM o_orderdate)::INT AS month FROM s",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
