"""DuckDB oracle SQL for the bound queries (same column names and types).

The SQL is written independently of the Spark plans, from the operator
semantics. HTML and rules have patterns of their own here (the engine parses
HTML; these regular expressions hold for the stored pages); of fixed values
only word lists, template texts and the strip set are shared. DuckDB uses RE2,
so patterns avoid back-references.
"""

from __future__ import annotations

from ..functions import text as X
from ..operators import extract, links
from . import queries as Q


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


NL = "chr(10)"
# line boundaries of Python's str.splitlines()
LINE_BREAKS = r"[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
W = X.PY_WS


WS_SET = " || ".join(f"chr({ord(c)})" for c in X.PY_WS_CHARS)


def strip(e: str) -> str:
    return f"trim({e}, {WS_SET})"


# Entities that occur in the stored pages; '&amp;' comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"),
            ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")]
# Comments and dropped elements, whichever comes first, in one alternation.
DROPPED = "(?is)<!--.*?-->|" + "|".join(
    f"<{t}(?:\\s[^>]*)?>.*?</{t}\\s*>" for t in
    ("script", "style", "nav", "footer", "header", "aside", "noscript", "iframe", "svg"))
MARKUP = r"""</?[A-Za-z](?:[^>"']|"[^"]*"|'[^']*')*>|<[!?][^>]*>"""
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"']*)["'][^>]*>((?:[^<]|<[^a]|<a\w)*?)</a\s*>"""
REFERENCE = r"[A-Z]{2,}(?:/[A-Z0-9]+){2,}"
LATE = r"(?i)closing\s+soon"


def decode(e: str) -> str:
    for ent, ch in ENTITIES:
        e = f"replace({e}, {lit(ent)}, {lit(ch)})"
    # a form without its ';' at the end of a piece or before a blank
    return f"regexp_replace({e}, '&(amp)([^;#A-Za-z0-9]|$)', '&\\2', 'g')"


def clean(e: str) -> str:
    x = f"regexp_replace({e}, {lit(DROPPED)}, chr(1), 'g')"
    x = f"regexp_replace({x}, {lit(MARKUP)}, chr(1), 'g')"
    x = decode(x)
    x = f"regexp_replace({x}, {lit(W + '*(?:' + chr(92) + 'x01' + W + '*)+')}, {NL}, 'g')"
    x = strip(x)
    x = f"regexp_replace({x}, {lit(chr(92) + 'n{3,}')}, {NL} || {NL}, 'g')"
    return f"regexp_replace({x}, '[ \\t]{{2,}}', ' ', 'g')"


def anchor_text(e: str) -> str:
    x = decode(f"regexp_replace({e}, {lit(MARKUP)}, chr(1), 'g')")
    x = f"regexp_replace({x}, {lit(W + '*' + chr(92) + 'x01+' + W + '*')}, '', 'g')"
    return strip(x)


def fp(ref: str, title: str) -> str:
    r = f"nullif(lower({strip(ref)}), '')"
    t = f"nullif(lower({strip(title)}), '')"
    return f"sha256(concat_ws(' ', {r}, {t}))"


ORIGIN_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
SCHEME_HREF_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
DOTS_RE = r"(^|/)\.\.?(/|$|[?#])"


def url_join(base: str, href: str) -> str:
    """RFC-3986 join for hrefs that need no dot-segment removal (absolute,
    protocol-relative, root-relative, query-only, fragment-only, plain
    relative); NULL otherwise."""
    o = f"regexp_extract({base}, {lit(ORIGIN_RE)}, 1)"
    dots = f"regexp_matches({href}, {lit(DOTS_RE)})"
    nofrag = f"split_part({base}, '#', 1)"
    noq = f"split_part({nofrag}, '?', 1)"
    path = f"substring({noq}, length({o}) + 1)"
    directory = (f"CASE WHEN strpos({path}, '/') > 0 THEN {o} || regexp_extract({path}, '^(.*/)', 1) "
                 f"ELSE {o} || '/' END")
    return (f"CASE WHEN {href} = '' THEN {base} "
            f"WHEN regexp_matches({href}, '^https?://') AND NOT {dots} THEN {href} "
            f"WHEN starts_with({href}, '//') AND {o} <> '' AND NOT {dots} "
            f"THEN regexp_extract({base}, {lit(SCHEME_RE)}, 1) || ':' || {href} "
            f"WHEN regexp_matches({href}, '^/([^/]|$)') AND {o} <> '' AND NOT {dots} THEN {o} || {href} "
            f"WHEN starts_with({href}, '?') AND {o} <> '' THEN {noq} || {href} "
            f"WHEN starts_with({href}, '#') AND {o} <> '' THEN {nofrag} || {href} "
            f"WHEN {o} <> '' AND NOT regexp_matches({href}, {lit(SCHEME_HREF_RE)}) "
            f"AND NOT starts_with({href}, '/') AND NOT {dots} "
            f"AND NOT regexp_matches({path}, {lit(DOTS_RE)}) THEN {directory} || {href} END")


def contains_any(e: str, needles) -> str:
    return "(" + " OR ".join(f"strpos({e}, {lit(n)}) > 0" for n in needles) + ")"


TSF = "'%Y-%m-%d %H:%M:%S.%f'"

def links_cte(src: str = "pages") -> str:
    return PAGE_LINKS_CTE.replace("\n  FROM pages),", f"\n  FROM {src}),", 1)


PAGE_LINKS_CTE = f"""
a AS (
  SELECT page_id, url AS page_url,
         regexp_extract_all(html, {lit(ANCHOR)}, 1) AS hrefs,
         regexp_extract_all(html, {lit(ANCHOR)}, 2) AS inners
  FROM pages),
e AS (
  SELECT page_id, page_url, hrefs, inners,
         unnest(generate_series(0, len(hrefs) - 1)) AS pos FROM a),
r AS (
  SELECT page_id, page_url, CAST(pos AS BIGINT) AS pos,
         {strip(decode('hrefs[pos + 1]'))} AS href,
         {anchor_text('inners[pos + 1]')} AS text
  FROM e),
links AS (
  SELECT *, {url_join('page_url', 'href')} AS link_url FROM r
  WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:')
        AND NOT starts_with(href, 'mailto:')),
ulinks AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, link_url ORDER BY pos) AS rn
                 FROM links) WHERE rn = 1)
"""

DOC_FP = fp("source", "text")


def _chunks_cte(src: str, cols: str) -> str:
    size, step = X.CHUNK_SIZE, X.CHUNK_SIZE - X.CHUNK_OVERLAP
    return f"""
  SELECT {cols}, CAST(chunk_start AS BIGINT) AS chunk_start,
         CAST(chunk_start // {step} AS BIGINT) AS chunk_no,
         substring(text, chunk_start + 1, {size}) AS chunk
  FROM (SELECT *, unnest(CASE WHEN length(text) <= {size} THEN [0]
                              ELSE generate_series(0, length(text) - 1, {step}) END) AS chunk_start
        FROM {src})"""


def _prompt(site: str, hint: str, text: str) -> str:
    import string
    parts = []
    vals = {"site": site, "hint": hint, "text": text}
    for literal, field, _, _ in string.Formatter().parse(X.LISTING_TEMPLATE):
        if literal:
            parts.append(lit(literal))
        if field is not None:
            parts.append(f"coalesce(CAST({vals[field]} AS VARCHAR), '')")
    return "concat(" + ", ".join(parts) + ")"


HINT_DE = (f"CASE WHEN lang = 'de' THEN {lit(X.HINT_SECTION[0])} || 'Seiten in deutscher Sprache' "
           f"|| {lit(X.HINT_SECTION[1])} ELSE '' END")


def _esc(e: str) -> str:
    return f"replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _cell(c: str) -> str:
    return f"coalesce({_esc(f"nullif({c}, '')")}, '—')"


EVENT_RECS = f"""
recs AS (
  SELECT user_id AS site_id, CAST(dayofyear(ts) AS BIGINT) AS page_num, event_id AS pos,
         {fp('event_type', 'props')} AS fingerprint, event_type
  FROM events),
hist AS (SELECT fingerprint FROM recs WHERE event_type = 'signup')"""


def _lifecycle_sql(as_of: str) -> str:
    """Steps and lease ends of jobs, each job's events numbered in order."""
    return f"""WITH {JOB_EVENTS},
nu AS (SELECT id, ts, seq, status, row_number() OVER (PARTITION BY id ORDER BY ts, seq) AS i
       FROM (SELECT DISTINCT id, ts, seq, status FROM ev WHERE id IS NOT NULL AND ts < {as_of})),
op AS (SELECT *, min(CASE WHEN status = 'pending' THEN i END) OVER (PARTITION BY id) AS o FROM nu),
la AS (SELECT *, max(CASE WHEN status = 'running' AND i > o THEN ts END)
                 OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM op),
ru AS (SELECT *, coalesce(ts <= last + INTERVAL 6 HOUR, false) AS runs FROM la),
fi AS (SELECT *, min(CASE WHEN status IN ('done', 'error') AND runs THEN i END) OVER (PARTITION BY id) AS f FROM ru),
fs AS (SELECT *, max(CASE WHEN i = f THEN status END) OVER (PARTITION BY id) AS final,
              coalesce(i > o, false) AND NOT coalesce(i > f, false) AS live FROM fi),
steps AS (
  SELECT *, CASE WHEN NOT coalesce(i > o, false) THEN NULL WHEN i > f THEN final WHEN runs THEN 'running' ELSE 'pending' END AS from_status,
         CASE WHEN i = o THEN 'applied'
              WHEN live AND status = 'running' AND runs THEN 'renewed'
              WHEN live AND status = 'running' THEN 'applied'
              WHEN live AND status IN ('done', 'error') AND runs THEN 'applied' ELSE 'refused' END AS verdict FROM fs),
signs AS (SELECT *, lead(ts) OVER (PARTITION BY id ORDER BY i) AS nxt FROM fs WHERE live AND status <> 'pending')
SELECT id, strftime(ts, {TSF}) AS ts, seq, from_status, CASE WHEN verdict = 'refused' THEN from_status ELSE status END AS to_status, verdict FROM steps
UNION ALL
SELECT id, strftime(ts + INTERVAL 6 HOUR, {TSF}), -1, 'running', 'pending', 'lease_end' FROM signs
WHERE status = 'running' AND ts + INTERVAL 6 HOUR < {as_of} AND (nxt IS NULL OR nxt > ts + INTERVAL 6 HOUR)"""


def _early_stop_cte(recs: str = "recs", order: str = "page_num, pos",
                    stop_cond: str = "page_num > 1", pages: str | None = None, sites: str | None = None) -> str:
    """CTEs firsts … summary; ``pages`` (site_id, page_num) were fetched, ``sites``
    (site_id) ran."""
    empty = f" UNION ALL SELECT DISTINCT site_id, page_num, 0 FROM {pages}" if pages else ""
    every = f"(SELECT DISTINCT site_id FROM {sites})" if sites else "(SELECT DISTINCT site_id FROM stats)"
    return f"""
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, fingerprint ORDER BY {order}) AS rn
                 FROM {recs}) WHERE rn = 1),
new AS (SELECT * FROM firsts WHERE fingerprint NOT IN (SELECT fingerprint FROM hist WHERE fingerprint IS NOT NULL)),
n_new AS (SELECT site_id, page_num, count(*) AS n_new FROM new GROUP BY ALL),
n_ext AS (SELECT site_id, page_num, sum(n)::BIGINT AS n_extracted
          FROM (SELECT site_id, page_num, count(*) AS n FROM {recs} GROUP BY ALL{empty}) GROUP BY ALL),
stats0 AS (
  SELECT x.site_id, x.page_num, x.n_extracted, coalesce(n.n_new, 0) AS n_new
  FROM n_ext x LEFT JOIN n_new n USING (site_id, page_num)),
stop AS (
  SELECT site_id, min(CASE WHEN {stop_cond} AND n_new = 0 THEN page_num END) AS stop_page
  FROM stats0 GROUP BY site_id),
stats AS (
  SELECT s.*, (t.stop_page IS NULL OR s.page_num <= t.stop_page) AS scraped
  FROM stats0 s JOIN stop t USING (site_id)),
kept AS (
  SELECT n.* FROM new n JOIN stop t USING (site_id)
  WHERE t.stop_page IS NULL OR n.page_num < t.stop_page),
stored AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY site_id, {order}) AS rn2
                 FROM kept) WHERE rn2 = 1),
summary AS (
  SELECT e.site_id, CAST(coalesce(p.pages_scraped, 0) AS BIGINT) AS pages_scraped,
         CAST(coalesce(p.records_extracted, 0) AS BIGINT) AS records_extracted,
         CAST(coalesce(f.tenders_found, 0) AS BIGINT) AS tenders_found, 'success' AS status
  FROM {every} e LEFT JOIN
       (SELECT site_id, count(*) FILTER (WHERE scraped) AS pages_scraped,
               sum(CASE WHEN scraped THEN n_extracted ELSE 0 END) AS records_extracted
        FROM stats GROUP BY site_id) p USING (site_id)
  LEFT JOIN (SELECT site_id, count(*) AS tenders_found FROM stored GROUP BY site_id) f USING (site_id))"""


REPLIES = """
rep AS (
  SELECT event_id,
         CASE WHEN event_type = 'error' THEN 'Here are [3]: [' || props || ']'
              WHEN event_type = 'view' THEN props
              ELSE '```json' || chr(10) || '[' || props || ']' || chr(10) || '```' END AS reply
  FROM events),
sp AS (SELECT event_id, regexp_extract(reply, '(?s)[\\[{].*[\\]}]', 0) AS span FROM rep),
kd AS (
  SELECT event_id, span, coalesce(json_valid(span), false) AS ok,
         CASE WHEN NOT coalesce(json_valid(span), false) THEN 'invalid'
              WHEN starts_with(span, '[') THEN 'array' ELSE 'object' END AS kind
  FROM sp)"""

JOB_EVENTS = """
ev AS (
  SELECT user_id AS id,
         CASE WHEN event_type = 'signup' THEN 'pending'
              WHEN event_type IN ('view', 'click') THEN 'running'
              WHEN event_type = 'purchase' THEN 'done' ELSE 'error' END AS status,
         ts, event_id AS seq,
         CASE WHEN event_type = 'error' THEN 'failed: ' || props END AS error
  FROM events),
st AS (
  SELECT id,
         arg_max_null(status, (ts, seq)) AS status,
         arg_max_null(error, (ts, seq)) AS error,
         min(ts) AS created_at,
         min(ts) FILTER (WHERE status = 'running') AS started_at,
         max(ts) FILTER (WHERE status IN ('done', 'error')) AS finished_at,
         CAST(count(*) AS BIGINT) AS n_events
  FROM ev GROUP BY id)"""

TITLE = strip(decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))
FROM_HOST = f"regexp_extract(url, {lit(Q.HOST_RE)}, 1)"

PAGE_DOCS = f"""
pd AS (
  SELECT {fp('CAST(NULL AS VARCHAR)', TITLE)} AS fingerprint, url, {TITLE} AS text, page_id AS pos
  FROM pages),
top AS (
  SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY pos) AS rk FROM pd),
fn AS (
  SELECT *, CASE WHEN strpos(nm, '.') > 0 THEN nm ELSE nm || '.pdf' END AS file_name
  FROM (SELECT *, CASE WHEN seg = '' THEN 'document' ELSE seg END AS nm
        FROM (SELECT *, split_part(string_split(url, '/')[-1], '?', 1) AS seg FROM top))),
mf AS (
  SELECT * FROM (
    SELECT fingerprint, 'tender-docs/' || fingerprint || '/' || file_name AS path, pos, file_name,
           text AS name, url, rk,
           row_number() OVER (PARTITION BY fingerprint, 'tender-docs/' || fingerprint || '/' || file_name
                              ORDER BY pos DESC) AS rl
    FROM fn) WHERE rl = 1)"""


def _mime(e: str) -> str:
    from ..functions.urls import DEFAULT_MIME, MIME_TYPES
    ext = f"CASE WHEN strpos({e}, '.') > 0 THEN lower(string_split({e}, '.')[-1]) END"
    whens = " ".join(f"WHEN {lit(k[1:])} THEN {lit(v)}" for k, v in MIME_TYPES.items())
    return f"coalesce(CASE {ext} {whens} END, {lit(DEFAULT_MIME)})"


def _pages_cte(src: str = "pages") -> str:
    return f"""p AS (
  SELECT page_id, {FROM_HOST} AS site_id, url,
         coalesce(TRY_CAST(nullif(regexp_extract(url, {lit(Q.PAGE_PARAM_RE)}, 1), '') AS INTEGER), 1)
           AS page_num,
         {clean('html')} AS text
  FROM {src})"""


HISTORY = f"""hist AS (
  SELECT {fp('CAST(NULL AS VARCHAR)', "split_part(text, chr(10), 1)")} AS fingerprint FROM documents WHERE lang = 'de')"""


def run_sql(p_cte: str, stop_cond: str = "page_num > 1", sites: str = "p") -> str:
    """The batch run over the fetched pages of CTE ``p`` (page_id, site_id,
    page_num, text): lines as records → first-seen per page → early stop
    against the history → first-seen across sites → per-site summary."""
    return f"""
WITH {p_cte},
ln0 AS (
  SELECT page_id, site_id, page_num, lines, unnest(generate_series(0, len(lines) - 1)) AS pos
  FROM (SELECT *, string_split(text, chr(10)) AS lines FROM p)),
ln AS (SELECT page_id, site_id, page_num, pos, {strip('lines[pos + 1]')} AS line FROM ln0),
rec0 AS (
  SELECT page_id, site_id, page_num, pos,
         {fp(f"regexp_extract_all(line, {lit(REFERENCE)}, 0)[1]", 'line')} AS fingerprint
  FROM ln WHERE line <> ''),
recs AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, fingerprint ORDER BY pos) AS rn
    FROM rec0) WHERE rn = 1),
{HISTORY},
{_early_stop_cte('recs', 'page_num, page_id, pos', stop_cond, pages='p', sites=sites)}
SELECT * FROM summary"""


def rule_cte(src: str, key: str) -> str:
    """CTEs ru_l0 … ru_r: rule-extracted records (before the closed/awarded
    filter) of the ``text`` of ``src``, keyed by ``key``."""
    exc = lit("(?i)(" + "|".join(w.replace(" ", r"\s+") for w in extract.EXCLUDED_SECTIONS) + ")")
    inc = lit("(?i)(" + "|".join(w.replace(" ", r"\s+") for w in extract.INCLUDED_SECTIONS) + ")")
    refs = f"regexp_extract_all(line, {lit(REFERENCE)}, 0)"
    return f"""ru_l0 AS (SELECT {key}, lines, unnest(generate_series(0, len(lines) - 1)) AS line_no
       FROM (SELECT *, string_split(text, chr(10)) AS lines FROM {src})),
ru_l1 AS (SELECT {key}, line_no, {strip('lines[line_no + 1]')} AS line FROM ru_l0),
ru_l2 AS (SELECT *, len({refs}) = 0 AND (regexp_matches(line, {exc}) OR regexp_matches(line, {inc})) AS is_hdr
       FROM ru_l1 WHERE line <> ''),
ru_l3 AS (SELECT *, last_value(CASE WHEN is_hdr THEN line END IGNORE NULLS) OVER (
         PARTITION BY {key} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section,
       max(CASE WHEN is_hdr AND regexp_matches(line, {inc}) THEN 1 ELSE 0 END) OVER (PARTITION BY {key}) AS labelled
       FROM ru_l2),
ru_r AS (SELECT {key}, CAST(line_no AS BIGINT) AS pos, section, line AS title, {refs}[1] AS reference,
        CASE WHEN regexp_matches(line, {lit(LATE)}) THEN 'Closing Soon'
             WHEN regexp_matches(line, '(?i)\\bawarded\\b') THEN 'Awarded'
             WHEN regexp_matches(line, '(?i)\\bclosed\\b') THEN 'Closed'
             WHEN regexp_matches(line, '(?i)\\bopen\\b') THEN 'Open' ELSE 'Unknown' END AS status,
        CASE WHEN regexp_extract(line, '(?i)\\b(RFQ|RFP|RFI|EOI)\\b', 1) <> ''
               THEN upper(regexp_extract(line, '(?i)\\b(RFQ|RFP|RFI|EOI)\\b', 1))
             WHEN regexp_matches(line, '(?i)\\btender\\b') THEN 'Tender' ELSE 'Unknown' END AS tender_type
      FROM ru_l3
      WHERE len({refs}) > 0
        AND NOT coalesce(regexp_matches(section, {exc}), false)
        AND (labelled = 0 OR coalesce(regexp_matches(section, {inc}), false)))"""


NUMBERED = """numbered AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0
  THEN html || '<p>Works ABC/DEF/' || CAST(page_id AS VARCHAR) || '</p>' ELSE html END AS html FROM pages)"""

NOTICES = """cut AS (SELECT doc_id, lang, source, string_split(text, '. ') AS s FROM documents),
numbered_s AS (SELECT doc_id, lang, source, unnest(s) AS x, unnest(generate_series(0, len(s) - 1)) AS i FROM cut),
notice_lines AS (SELECT doc_id, i,
  CASE WHEN i % 17 = 16 AND doc_id % 4 = 0 THEN 'Keputusan ' || x
       WHEN i % 17 = 8 AND doc_id % 4 = 0 THEN 'Active  Tenders'
       WHEN i % 3 = 0 THEN x || ' ' || upper(lang) || '/' || upper(source) || '/' || doc_id || '/' || i
         || CASE WHEN i % 5 = 0 THEN ' open RFQ' WHEN i % 7 = 0 THEN ' awarded'
                 WHEN i % 4 = 0 THEN ' tender closing soon' ELSE '' END
       ELSE x END AS line FROM numbered_s),
notices AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM notice_lines GROUP BY doc_id)"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["listing_run"] = run_sql(_pages_cte())
    q["blanked_run"] = run_sql(_pages_cte("(SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN '<p> </p>' ELSE html END AS html FROM pages)"))
    q["clean_text"] = f"SELECT page_id, {clean('html')} AS text FROM pages"
    q["clean_text_exact"] = q["clean_text"]
    q["page_links"] = f"WITH {PAGE_LINKS_CTE} SELECT page_id, pos, href, text, link_url FROM links"
    q["unique_links"] = f"WITH {PAGE_LINKS_CTE} SELECT page_id, link_url, pos, href, text FROM ulinks"
    pats = Q.TEST_DETAIL_PATTERNS
    q["detail_links_top20"] = f"""WITH {PAGE_LINKS_CTE},
d AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM ulinks
      WHERE {contains_any('lower(link_url)', pats)} OR {contains_any('lower(text)', pats)})
SELECT page_id, link_url, pos, text, CAST(rank AS BIGINT) AS rank FROM d
WHERE rank <= {links.FALLBACK_LINKS}"""
    q["small_pages"] = """SELECT page_id, url, CAST(length(html) AS BIGINT) AS html_chars,
  length(html) < 5000 AS is_small FROM pages"""
    host = f"regexp_extract(url, {lit(Q.HOST_RE)}, 1)"
    q["page_urls"] = f"""WITH s AS (
  SELECT CAST(page_id AS VARCHAR) AS site_id, url,
         CASE WHEN ends_with({host}, '.com') THEN 'url_param'
              WHEN ends_with({host}, '.net') THEN 'next_button' ELSE 'none' END AS strategy,
         CASE WHEN strpos(url, '/en/') > 0 THEN [url, replace(url, '/en/', '/de/')] END AS tabs
  FROM pages),
t AS (
  SELECT site_id, strategy, CAST(0 AS BIGINT) AS tab_no, url AS base FROM s WHERE tabs IS NULL
  UNION ALL
  SELECT site_id, strategy, CAST(i - 1 AS BIGINT) AS tab_no, tabs[i] AS base
  FROM (SELECT *, unnest(generate_series(1, len(tabs))) AS i FROM s WHERE tabs IS NOT NULL)),
pg AS (
  SELECT *, unnest(CASE WHEN strategy = 'url_param' THEN generate_series(1, 20) ELSE [1] END) AS page_num
  FROM t)
SELECT site_id, tab_no, CAST(page_num AS BIGINT) AS page_num,
  CASE WHEN strategy <> 'url_param' THEN base
       WHEN strpos(base, 'page=') > 0
         THEN regexp_replace(base, '\\Qpage\\E=\\d+', 'page=' || CAST(page_num AS VARCHAR), 'g')
       ELSE split_part(base, '#', 1)
            || CASE WHEN strpos(split_part(base, '#', 1), '?') > 0 THEN '&' ELSE '?' END
            || 'page=' || CAST(page_num AS VARCHAR)
            || CASE WHEN strpos(base, '#') > 0 THEN '#' || substring(base, strpos(base, '#') + 1) ELSE '' END
  END AS url,
  strategy, strategy IN ('next_button', 'load_more', 'infinite') AS needs_browser
FROM pg"""
    site_p = f"""pu AS (SELECT * FROM ({q['page_urls']})),
pgu AS (SELECT url, html FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rnu FROM pages) WHERE rnu = 1),
p AS (
  SELECT pu.site_id || ':' || CAST(pu.tab_no AS VARCHAR) || ':' || CAST(pu.page_num AS VARCHAR) AS page_id,
         pu.site_id, pu.tab_no * 1000000000 + pu.page_num AS page_num, {clean('pgu.html')} AS text
  FROM pu JOIN pgu USING (url))"""
    q["site_run"] = run_sql(site_p, "page_num % 1000000000 > 1", sites="(SELECT CAST(page_id AS VARCHAR) AS site_id FROM pages)")
    q["chunks"] = f"SELECT doc_id, chunk_no, chunk_start, chunk FROM ({_chunks_cte('documents', 'doc_id')})"
    q["fingerprints"] = f"SELECT doc_id, {DOC_FP} AS fingerprint FROM documents"
    q["first_seen"] = f"""SELECT fingerprint, doc_id, source, lang FROM (
  SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id) AS rn
  FROM (SELECT {DOC_FP} AS fingerprint, doc_id, source, lang FROM documents)) WHERE rn = 1"""
    ins = f"""WITH d AS (SELECT {DOC_FP} AS fingerprint, doc_id, lang FROM documents),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id) AS rn FROM d)
      WHERE rn = 1),
ins AS (SELECT fingerprint, doc_id, lang FROM f
        WHERE fingerprint NOT IN (SELECT fingerprint FROM d WHERE lang = 'de'))"""
    q["insert_if_absent"] = ins + " SELECT * FROM ins"
    q["inserted_count"] = ins + " SELECT CAST(count(*) AS BIGINT) AS inserted FROM ins"
    q["prompts"] = f"""SELECT doc_id, chunk_no, {_prompt('source', HINT_DE, 'chunk')} AS prompt
FROM ({_chunks_cte('documents', 'doc_id, source, lang')})"""
    cells = {"title": "text", "issuer": "source",
             "deadline": "CAST(NULL AS VARCHAR)", "status": "lang", "source_site": "source"}
    cell_sql = ", ".join(f"{_cell(v)} AS {k}" for k, v in cells.items())
    row = " || ".join(f"'<td>' || {k} || '</td>'" for k in cells)
    q["digest"] = f"""SELECT *, '<tr>' || {row} || '</tr>' AS row_html
FROM (SELECT doc_id, {cell_sql} FROM documents)"""
    q["digest_header"] = """SELECT n_new,
  '[Digest] ' || CAST(n_new AS VARCHAR) || ' new notice(s) — ' || strftime(TIMESTAMP '2026-12-01 09:00:00', '%Y-%m-%d') AS subject,
  'Notice digest — ' || strftime(TIMESTAMP '2026-12-01 09:00:00', '%d %B %Y') AS heading
FROM (SELECT CAST(count(*) AS BIGINT) AS n_new FROM documents) WHERE n_new > 0"""
    q["rule_extract"] = f"WITH {NOTICES}, " + rule_cte("notices", "doc_id") + \
        " SELECT * FROM ru_r WHERE status NOT IN ('Closed', 'Awarded')"
    q["early_stop"] = f"WITH {EVENT_RECS}, {_early_stop_cte()} SELECT site_id, fingerprint, page_num, pos FROM kept"
    q["run_summary"] = f"WITH {EVENT_RECS}, {_early_stop_cte()} SELECT * FROM summary"
    q["run_totals"] = f"""WITH {EVENT_RECS}, {_early_stop_cte()}
SELECT CAST(sum(tenders_found) AS BIGINT) AS total_new, CAST(count(*) AS BIGINT) AS n_sites FROM summary"""
    q["keyed_replace"] = f"""SELECT user_id, event_id, event_type, props, strftime(ts, {TSF}) AS updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1"""
    q["parse_replies"] = f"""WITH {REPLIES},
objs AS (
  SELECT event_id, ok, kind,
         CASE WHEN kind = 'array' THEN list_filter(CAST(json_extract(span, '$[*]') AS JSON[]),
                                                   lambda x: json_type(x) = 'OBJECT') ELSE [] END AS recs
  FROM kd)
SELECT event_id, ok, CAST(len(recs) AS BIGINT) AS n_records, json_extract_string(recs[1], '$.k') AS k
FROM objs"""
    q["shape_guard"] = f"""WITH {REPLIES}
SELECT event_id, kind, CASE WHEN kind = 'object' THEN json_extract_string(span, '$.k') END AS k FROM kd"""
    q["job_state"] = f"""WITH {JOB_EVENTS}
SELECT id, status, error, strftime(created_at, {TSF}) AS created_at, strftime(started_at, {TSF}) AS started_at,
       strftime(finished_at, {TSF}) AS finished_at, n_events FROM st"""
    q["queue_status"] = f"WITH {JOB_EVENTS} SELECT status, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY status"
    q["job_lifecycle"] = _lifecycle_sql("(SELECT date_trunc('milliseconds', max(ts)) + INTERVAL 1 MILLISECOND FROM events)")
    q["stream_lifecycle"] = _lifecycle_sql("(SELECT date_trunc('milliseconds', max(ts)) FROM events)")
    q["next_jobs"] = f"""WITH {JOB_EVENTS}
SELECT id, strftime(created_at, {TSF}) AS created_at FROM st WHERE status = 'pending'
ORDER BY st.created_at, id LIMIT 5"""
    q["enqueue_jobs"] = """SELECT CAST(s_suppkey AS VARCHAR) AS site_id, CAST(NULL AS VARCHAR) AS triggered_by,
  'pending' AS status, '2026-12-01 09:00:00.000000' AS created_at FROM supplier WHERE s_acctbal > 0"""
    q["job_site_lookup"] = """SELECT o.o_orderkey, o.o_custkey, c.c_name,
  CASE WHEN c.c_custkey IS NULL THEN 'error' ELSE 'running' END AS lookup_status,
  CASE WHEN c.c_custkey IS NULL THEN 'Site not found' END AS lookup_error
FROM orders o LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'AUTOMOBILE') c
  ON o.o_custkey = c.c_custkey"""
    q["site_delete_setnull"] = """SELECT o_orderkey,
  CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE') THEN NULL
       ELSE CAST(o_custkey AS VARCHAR) END AS o_custkey FROM orders"""
    q["site_delete_cascade"] = """SELECT o_custkey, o_orderkey FROM orders
WHERE o_custkey IS NULL OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')"""
    q["name_filter"] = "SELECT p_partkey, p_name AS name FROM part WHERE strpos(lower(p_name), 'ring') > 0"
    q["listing"] = f"""SELECT o_orderkey, strftime(o_orderdate, {TSF}) AS o_orderdate, o_orderpriority
FROM orders WHERE o_orderstatus = 'O' ORDER BY orders.o_orderdate DESC, o_orderkey"""
    q["enum_status"] = """SELECT o_orderkey, status FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'Open' WHEN o_orderstatus = 'F' THEN 'Closed'
                          ELSE 'Unknown' END AS status FROM orders)
WHERE status NOT IN ('Closed', 'Awarded')"""
    q["merge_enrichment"] = """WITH s AS (
  SELECT conv_id, turn, text,
         CASE WHEN turn > 0 THEN role END AS contact_name,
         CASE WHEN role = 'assistant' THEN 'a' || CAST(turn AS VARCHAR) || '@x' END AS contact_email,
         CASE WHEN turn > 0 AND length(text) > 200 THEN substring(text, 1, 20) END AS requirements,
         CASE WHEN turn = 0 THEN 'Unknown' END AS tender_type,
         CASE WHEN turn = 0 THEN role END AS contact
  FROM conversations),
c AS (SELECT *, nullif(concat_ws(' | ', nullif(contact_name, ''), nullif(contact_email, '')), '') AS cs FROM s)
SELECT conv_id,
  string_agg(nullif(text, ''), chr(10) || chr(10) ORDER BY turn) AS description,
  arg_min(contact_name, turn) FILTER (WHERE nullif(contact_name, '') IS NOT NULL) AS contact_name,
  arg_min(contact_email, turn) FILTER (WHERE nullif(contact_email, '') IS NOT NULL) AS contact_email,
  arg_min(requirements, turn) FILTER (WHERE nullif(requirements, '') IS NOT NULL) AS requirements,
  arg_min(tender_type, turn) FILTER (WHERE nullif(tender_type, '') IS NOT NULL) AS tender_type,
  coalesce(arg_max(cs, turn) FILTER (WHERE turn >= 1 AND cs IS NOT NULL),
           arg_min(nullif(contact, ''), turn) FILTER (WHERE turn = 0)) AS contact,
  CAST(count(*) AS BIGINT) AS n_sources
FROM c GROUP BY conv_id"""
    q["document_text"] = f"""WITH a AS (
  SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn) AS text, CAST(count(*) AS BIGINT) AS n_pages, false AS truncated
  FROM conversations WHERE text IS NOT NULL AND text <> '' GROUP BY conv_id)
SELECT * FROM a WHERE {strip('text')} <> ''"""
    q["file_manifest"] = f"""WITH {PAGE_DOCS}
SELECT fingerprint, path, pos, file_name, {_mime('file_name')} AS mime_type, name, url, CAST(rk AS BIGINT) AS rank FROM mf"""
    q["document_refs"] = f"""WITH {PAGE_DOCS}
SELECT fingerprint, CAST(to_json(list({{'name': name, 'url': url}} ORDER BY pos)) AS VARCHAR) AS document_urls_json
FROM mf GROUP BY fingerprint"""
    with_files = """(SELECT page_id, url, html || '<p><a href="/files/' || page_id || '.PDF?v=1">Notice ' || page_id
  || '</a> <a href="' || page_id || '.xlsx"></a> <a href="/files/' || page_id || '.PDF?v=1">again</a></p>' AS html FROM pages)"""
    q["download_links"] = f"""WITH {links_cte(with_files)},
dl AS (SELECT page_id, link_url, pos, CASE WHEN text = '' THEN 'document' ELSE text END AS text,
              row_number() OVER (PARTITION BY page_id, link_url ORDER BY pos) AS rk
       FROM links WHERE {contains_any('lower(href)', links.DOWNLOAD_EXTS)})
SELECT page_id, link_url, pos, text FROM dl WHERE rk = 1"""
    targets = f"""{NUMBERED}, {_pages_cte('numbered')},
{rule_cte('p', 'page_id')},
rr AS (SELECT * FROM ru_r WHERE status NOT IN ('Closed', 'Awarded')),
empty AS (SELECT n.page_id, n.url, n.html, p.site_id FROM p JOIN numbered n USING (page_id)
          WHERE page_num = 1 AND page_id NOT IN (SELECT page_id FROM rr)),
{links_cte('empty')},
d AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM ulinks
      WHERE {contains_any('lower(link_url)', Q.TEST_DETAIL_PATTERNS)}
         OR {contains_any('lower(text)', Q.TEST_DETAIL_PATTERNS)})"""
    q["fallback_links"] = f"""WITH {targets}
SELECT e.site_id, d.page_id AS listing_page_id, d.link_url, CAST(d.rank AS BIGINT) AS link_rank
FROM d JOIN empty e USING (page_id)"""
    # The whole run: rule records, those behind the links of empty page-1
    # listings, early stop, first-seen, the detail page's text of the latter.
    q["full_run"] = f"""WITH {targets},
own AS (SELECT * EXCLUDE (rn) FROM (
  SELECT p.site_id, p.page_num, r.page_id, r.pos, r.title, r.reference, r.status, r.tender_type, p.url, p.url AS page_url,
         {fp('reference', 'title')} AS fingerprint,
         row_number() OVER (PARTITION BY r.page_id, {fp('reference', 'title')} ORDER BY r.pos) AS rn
  FROM rr r JOIN p USING (page_id)) WHERE rn = 1),
by_url AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url),
linked AS (SELECT * EXCLUDE (rn) FROM (
  SELECT e.site_id, 1 AS page_num, e.page_id, r.pos, r.title, r.reference, r.status, r.tender_type, d.link_url AS url, e.url AS page_url,
         {fp('reference', 'title')} AS fingerprint,
         row_number() OVER (PARTITION BY e.page_id, {fp('reference', 'title')} ORDER BY d.rank, r.pos) AS rn
  FROM d JOIN empty e USING (page_id) JOIN by_url u ON u.url = d.link_url JOIN rr r ON r.page_id = u.page_id) WHERE rn = 1),
recs AS (SELECT * FROM own UNION ALL SELECT * FROM linked),
{HISTORY},
{_early_stop_cte('recs', 'page_num, page_id, pos', pages='p', sites='p')},
detail AS (SELECT s.fingerprint, p.text FROM stored s JOIN by_url u USING (url) JOIN p ON p.page_id = u.page_id
           WHERE starts_with(s.url, 'http') AND rtrim(s.url, '/') <> rtrim(s.page_url, '/'))
SELECT s.fingerprint, s.site_id, upper(s.site_id) AS source_site, s.title, s.reference, s.status, s.tender_type, s.url,
       nullif(d.text, '') AS description, '2026-12-01 09:00:00.000000' AS scraped_at
FROM stored s LEFT JOIN detail d USING (fingerprint)"""
    q["known_keys"] = f"SELECT DISTINCT {DOC_FP} AS fingerprint FROM documents"
    q["page_stats"] = f"""WITH {EVENT_RECS}, {_early_stop_cte()}
SELECT site_id, page_num, CAST(n_extracted AS BIGINT) AS n_extracted, CAST(n_new AS BIGINT) AS n_new, scraped
FROM stats"""
    q["run_log"] = f"""WITH {EVENT_RECS}, {_early_stop_cte()}
SELECT 'run-' || CAST(site_id AS VARCHAR) AS id, CAST(site_id AS VARCHAR) AS site_id, status,
       '2026-12-01 09:00:00.000000' AS started_at, '2026-12-01 09:30:00.000000' AS finished_at,
       pages_scraped, tenders_found
FROM summary"""
    # kept views equal the views over all events
    for name, of in (("kept_job_state", "job_state"), ("stream_job_state", "job_state"),
                     ("kept_queue_status", "queue_status"), ("kept_run_log", "run_log")):
        q[name] = q[of]
    q["stream_dedupe"] = ins + " SELECT * FROM ins"
    # model_extract with the deterministic stub model: every line is a record;
    # a chunk of a length divisible by 7 (the prompt ends with one more
    # character) fails both times
    q["model_extract"] = f"""WITH p AS (SELECT page_id, url AS page_url, {clean('html')} AS text FROM pages),
ch AS ({_chunks_cte('p', 'page_id, page_url')}),
l0 AS (SELECT page_id, chunk_no, ls, unnest(generate_series(1, len(ls))) AS i
       FROM (SELECT *, string_split(chunk, chr(10)) AS ls FROM ch WHERE (length(chunk) + 1) % 7 <> 0)),
l1 AS (SELECT page_id, chunk_no, i, {strip('ls[i]')} AS title FROM l0 WHERE {strip('ls[i]')} <> ''),
rec AS (SELECT page_id, chunk_no, title,
               CAST(row_number() OVER (PARTITION BY page_id, chunk_no ORDER BY i) - 1 AS BIGINT) AS pos FROM l1),
f AS (SELECT *, {fp('CAST(NULL AS VARCHAR)', 'title')} AS fingerprint FROM rec WHERE length(title) % 11 <> 0)
SELECT page_id, fingerprint, chunk_no, CAST(pos AS VARCHAR) AS pos, title, 'Open' AS status, CAST(NULL AS VARCHAR) AS attempts, CAST(NULL AS VARCHAR) AS error FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, fingerprint ORDER BY chunk_no, pos) AS rn FROM f)
WHERE rn = 1
UNION ALL SELECT page_id, NULL, chunk_no, NULL, NULL, NULL, '2', 'rejected reply' FROM ch WHERE (length(chunk) + 1) % 7 = 0"""
    from . import batch as B
    q["enrich_run"] = f"""WITH pg AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM pages)
  WHERE rn = 1),
rec AS (
  SELECT {fp('url', TITLE)} AS fingerprint, {TITLE} AS title, url,
         split_part({clean('html')}, chr(10), 1) AS description,
         regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || '/' AS page_url, html
  FROM pg),
det AS (
  SELECT fingerprint, {clean('html')} AS t FROM rec
  WHERE starts_with(url, 'http') AND rtrim(url, '/') <> rtrim(page_url, '/')),
d2 AS (
  SELECT fingerprint, nullif(t, '') AS description,
         nullif(regexp_extract(t, {lit(B.EMAIL_RE)}, 0), '') AS contact_email,
         nullif(regexp_extract(t, {lit(B.PHONE_RE)}, 0), '') AS contact_phone,
         nullif(regexp_extract(t, {lit(B.REQ_LINE)}, 2), '') AS requirements,
         nullif(regexp_extract(t, {lit(B.SUB_LINE)}, 2), '') AS submission_method
  FROM det)
SELECT r.fingerprint, r.title, r.url,
       nullif(concat_ws(chr(10) || chr(10), nullif(r.description, ''), d.description), '') AS description,
       d.contact_email, d.contact_phone, d.requirements, d.submission_method,
       nullif(concat_ws(' | ', d.contact_email, d.contact_phone), '') AS contact,
       CAST(1 + CASE WHEN d.fingerprint IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_sources
FROM rec r LEFT JOIN d2 d USING (fingerprint)"""
    # One page after the other, in the order of sites and pages, with the list of
    # keys seen so far.
    fold = f"""WITH RECURSIVE {EVENT_RECS.strip()},
ids AS (SELECT fingerprint, row_number() OVER (ORDER BY fingerprint) AS k
        FROM (SELECT DISTINCT fingerprint FROM recs WHERE fingerprint NOT IN (SELECT fingerprint FROM hist))),
pages AS (
  SELECT site_id, page_num, row_number() OVER (ORDER BY site_id, page_num) AS n, count(*) AS n_extracted,
         coalesce(list(DISTINCT k) FILTER (WHERE k IS NOT NULL), []) AS keys
  FROM recs LEFT JOIN ids USING (fingerprint) GROUP BY site_id, page_num),
fold AS (
  SELECT 0::BIGINT AS n, []::BIGINT[] AS seen, NULL::BIGINT AS site_id, NULL::BIGINT AS page_num, 0::BIGINT AS n_extracted,
         []::BIGINT[] AS new, true AS scraped, NULL::BIGINT AS stopped
  UNION ALL
  SELECT p.n, CASE WHEN f.stopped IS NOT DISTINCT FROM p.site_id THEN f.seen ELSE list_concat(f.seen, p.new) END,
         p.site_id, p.page_num, p.n_extracted, p.new,
         f.stopped IS DISTINCT FROM p.site_id,
         CASE WHEN f.stopped IS NOT DISTINCT FROM p.site_id OR (len(p.new) = 0 AND p.page_num > 1) THEN p.site_id END
  FROM fold f, LATERAL (SELECT q.*, list_filter(q.keys, lambda x: NOT list_contains(f.seen, x)) AS new FROM pages q WHERE q.n = f.n + 1) p),
kept AS (
  SELECT f.site_id, f.page_num, i.fingerprint FROM (SELECT site_id, page_num, unnest(new) AS k FROM fold WHERE scraped AND n > 0) f JOIN ids i USING (k))"""
    q["coupled_stop"] = fold + """
SELECT site_id, fingerprint, page_num, min(pos) AS pos FROM kept JOIN recs USING (site_id, page_num, fingerprint) GROUP BY ALL"""
    # Behind a stop, what counts as new is told by the sites before alone.
    q["coupled_pages"] = fold + """,
taken AS (SELECT fingerprint, min(site_id) AS taker FROM kept GROUP BY fingerprint),
firsts AS (SELECT site_id, fingerprint, min(page_num) AS page_num FROM recs WHERE fingerprint IN (SELECT fingerprint FROM ids) GROUP BY ALL),
news AS (SELECT f.site_id, f.page_num, count(*) AS n_new FROM firsts f LEFT JOIN taken t USING (fingerprint)
         WHERE t.taker IS NULL OR t.taker >= f.site_id GROUP BY ALL)
SELECT fold.site_id, fold.page_num, fold.n_extracted, coalesce(news.n_new, 0) AS n_new, fold.scraped
FROM fold LEFT JOIN news USING (site_id, page_num) WHERE fold.n > 0"""

    def states(where: str) -> str:
        return f"""(SELECT user_id, event_type, props, event_id FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events {where})
  WHERE rn = 1 AND event_type <> 'error')"""

    was, now = states("WHERE ts < TIMESTAMP '2024-01-20 00:00:00'"), states("")
    q["change_rows"] = f"""SELECT CAST(2 AS BIGINT) AS version, coalesce(a.user_id, b.user_id) AS user_id,
  CASE WHEN b.user_id IS NULL THEN 'insert' WHEN a.user_id IS NULL THEN 'delete' ELSE 'update' END AS op,
  CAST(b.event_id AS VARCHAR) AS before_event, b.event_type AS before_type, CAST(a.event_id AS VARCHAR) AS after_event, a.event_type AS after_type, a.props AS after_props
FROM {was} b FULL JOIN {now} a ON a.user_id = b.user_id
WHERE a.user_id IS NULL OR b.user_id IS NULL OR (a.event_type, a.props, a.event_id) IS DISTINCT FROM (b.event_type, b.props, b.event_id)"""
    q["changes_applied"] = f"SELECT * FROM {now}"
    q["cascade_changes"] = """SELECT CAST(3 AS BIGINT) AS version, o_orderkey, 'update' AS op, o_custkey AS before_custkey,
  CAST(NULL AS BIGINT) AS after_custkey, o_orderstatus
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'"""
    q["stored_upsert"] = q["keyed_replace"]
    return q


ORACLE_SQL = build()
