"""The audit written independently as DuckDB SQL: the correctness oracle.

Each oracle query is ``WITH <fixtures>, <audit CTEs> SELECT ...`` over the
driver's ``pages`` view. HTML facts are extracted with regular expressions
(the fixture markup is regular), URLs are split with the RFC 3986 pattern,
JSON-LD is read with DuckDB's JSON functions. Nothing here calls Spark.
"""

from __future__ import annotations

import re

from siteaudit import schema as S
from siteaudit.operators.checks import FIX
from siteaudit.sources import fixtures as fx

RFC = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def part(u: str, i: int) -> str:
    return f"regexp_extract(coalesce({u}, ''), {q(RFC)}, {i})"


def scheme(u):
    return f"lower({part(u, 2)})"


def netloc(u):
    return part(u, 4)


def path(u):
    return f"regexp_replace({part(u, 5)}, ';[^/]*$', '')"


def query(u):
    return part(u, 7)


def strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def dec(x):
    return (f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
            f"'&#39;', ''''), '&amp;', '&')")


def tpath(u):
    p = f"(CASE WHEN {path(u)} = '' THEN '/' ELSE {path(u)} END)"
    return f"(CASE WHEN {p} <> '/' AND {p} LIKE '%/' THEN regexp_replace({p}, '/+$', '') ELSE {p} END)"


def nurl(u):
    """U8."""
    return (f"(CASE WHEN coalesce({u}, '') = '' THEN '' ELSE "
            f"{scheme(u)} || '://' || lower({netloc(u)}) || {tpath(u)} END)")


def curl(u):
    """U7."""
    return (f"(CASE WHEN coalesce({u}, '') = '' THEN '' ELSE {scheme(u)} || '://' || lower({netloc(u)}) || "
            f"{tpath(u)} || CASE WHEN {query(u)} <> '' THEN '?' || {query(u)} ELSE '' END END)")


def bare(netloc_sql):
    h = f"lower(split_part({netloc_sql}, ':', 1))"
    return f"(CASE WHEN {h} LIKE 'www.%' THEN substr({h}, 5) ELSE {h} END)"


def is_html(u):
    p, qq = f"lower({path(u)})", f"lower({query(u)})"
    ext = " OR ".join(f"ends_with({p}, {q(e)})" for e in S.SKIP_EXTENSIONS)
    frag = " OR ".join(f"contains({p}, {q(f)})" for f in S.SKIP_PATH_FRAGMENTS)
    ne = " OR ".join(f"contains({qq}, {q(n)})" for n in S.SKIP_QUERY_NEEDLES)
    n = netloc(u)
    return f"(NOT ({ext}) AND NOT ({frag}) AND NOT ({ne}) AND (contains({n}, '[') = contains({n}, ']')))"


def types(n, v):
    return (f"(CASE json_type({n}, '$.\"@type\"') WHEN 'VARCHAR' THEN [json_extract_string({n}, '$.\"@type\"')] "
            f"WHEN 'ARRAY' THEN list_transform(list_filter(json_extract({n}, '$.\"@type\"[*]'), "
            f"lambda {v}: json_type({v}) = 'VARCHAR'), lambda {v}: json_extract_string({v}, '$')) "
            f"ELSE []::VARCHAR[] END)")


def is_obj(n):
    return f"coalesce(json_type({n}) = 'OBJECT', false)"


def has_graph(n):
    return f"coalesce(json_type({n}, '$.\"@graph\"') = 'ARRAY', false)"


def graph(n):
    return f"(CASE WHEN {has_graph(n)} THEN json_extract({n}, '$.\"@graph\"[*]') ELSE []::JSON[] END)"


def truthy(x):
    return (f"coalesce(CASE json_type({x}) WHEN 'VARCHAR' THEN json_extract_string({x}, '$') <> '' "
            f"WHEN 'ARRAY' THEN json_array_length({x}) > 0 WHEN 'OBJECT' THEN {x}::VARCHAR <> '{{}}' "
            f"WHEN 'BOOLEAN' THEN {x}::VARCHAR = 'true' WHEN 'NULL' THEN false "
            f"ELSE TRY_CAST({x}::VARCHAR AS DOUBLE) <> 0 END, false)")


ORG = "[" + ", ".join(q(o) for o in S.ORG_TYPES) + "]"
BOTS = "[" + ", ".join(q(b) for b in S.AI_BOTS) + "]"
GENERIC = "[" + ", ".join(q(g) for g in S.GENERIC_ANCHORS) + "]"
A_RE = '<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>'
LD_RE = '<script type="application/ld\\+json">(.*?)</script>'


def has_type_sql(t):
    return (f"(len(list_filter(blocks, lambda b: {is_obj('b')} AND (list_contains(list_transform({types('b', 'xb')}, "
            f"lambda t: lower(t)), {q(t)}) OR len(list_filter({graph('b')}, lambda g: {is_obj('g')} AND "
            f"list_contains(list_transform({types('g', 'xg')}, lambda u: lower(u)), {q(t)}))) > 0))) > 0)")


ORG_TYPE = (f"list_filter(flatten(list_transform(list_filter(blocks, lambda b: {is_obj('b')}), lambda b: "
            f"list_concat({types('b', 'xb')}, flatten(list_transform(list_filter({graph('b')}, lambda g: {is_obj('g')}), "
            f"lambda g: {types('g', 'xg')}))))), lambda t: list_contains({ORG}, lower(t)))[1]")

_present = ", ".join(f"CASE WHEN {truthy('json_extract(c, ' + q('$.' + k) + ')')} THEN {q(k)} END"
                     for k in ("name", "url", "logo", "sameAs"))
ORG_CANDS = (f"list_filter(flatten(list_transform(list_filter(blocks, lambda b: {is_obj('b')}), lambda b: "
             f"CASE WHEN {has_graph('b')} THEN list_filter({graph('b')}, lambda g: {is_obj('g')}) ELSE [b] END)), "
             f"lambda c: len(list_filter({types('c', 'xc')}, lambda t: list_contains({ORG}, lower(t)))) > 0)")
ORG_PRESENT = f"list_transform({ORG_CANDS}, lambda c: list_filter([{_present}], lambda z: z IS NOT NULL))"


def pct_int(num, den):
    return f"CAST(floor(({num} * 200 + {den}) / ({den} * 2)) AS BIGINT)"


def pct_tenths(num, den):
    t = f"CAST(floor(({num} * 2000 + {den}) / ({den} * 2)) AS BIGINT)"
    return f"(CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR))"


def _checks_dim():
    rows = ", ".join(f"({o}, {q(c)}, {q(cat)}, {q(n)})" for o, c, cat, n in S.CHECKS)
    return f"chk(check_order, check_id, category, name) AS (VALUES {rows})"


def _fix_dim():
    rows = ", ".join(f"({q(c)}, {q(v)}, {q(t)})" for (c, v), t in FIX.items())
    return f"fixd(check_id, verdict, fix_text) AS (VALUES {rows})"


def R(verdict, sev, msg, ev="''", snip="''", aff="0", tot="0"):
    return (f"{{'verdict': {q(verdict)}, 'severity': {q(sev)}, 'message': ({msg})::VARCHAR, "
            f"'evidence_url': coalesce(({ev})::VARCHAR, ''), 'evidence_snippet': coalesce(({snip})::VARCHAR, ''), "
            f"'pages_affected': coalesce(({aff})::BIGINT, 0), 'total_pages': coalesce(({tot})::BIGINT, 0)}}")


def S_(x):
    return f"CAST({x} AS VARCHAR)"


NOVALID = R("unverified", "P1", q("No page was fetched successfully."))

CHECK_CASES = {
    "C-01": f"""CASE WHEN robots_status = 200 AND {strip("coalesce(robots_txt, '')")} <> ''
        THEN {R('pass', 'P2', "'Rules were read from ' || domain || '/robots.txt'", "domain || '/robots.txt'")}
      WHEN robots_status = 0 OR robots_status = 404 THEN {R('warn', 'P2', q('The site serves no robots.txt.'), "domain || '/robots.txt'")}
      ELSE {R('fail', 'P0', "'Fetching robots.txt gave status ' || " + S_('robots_status') + " || '.'", "domain || '/robots.txt'")} END""",
    "C-02": f"""CASE WHEN rb_wild_block AND len(rb_allowed) = 0
        THEN {R('fail', 'P0', q('robots.txt blocks every crawler and no AI bot has an exception.'), "domain || '/robots.txt'")}
      WHEN len(rb_blocked) > 0 THEN {R('fail', 'P0', "'Shut out by robots.txt: ' || array_to_string(rb_blocked, ', ') || '.'", "domain || '/robots.txt'")}
      WHEN len(rb_allowed) > 0 THEN {R('pass', 'P0', S_('len(rb_allowed)') + " || ' AI bot(s) welcomed by name.'", "domain || '/robots.txt'")}
      WHEN rb_wildcard THEN {R('unverified', 'P1', q('Only wildcard rules apply; no AI bot is named.'), "domain || '/robots.txt'")}
      ELSE {R('unverified', 'P1', q('Without rules in robots.txt the stance towards AI bots stays open.'), "domain || '/robots.txt'")} END""",
    "C-03": f"""CASE WHEN sitemap_status = 200 AND coalesce(n_sitemap_urls, 0) > 0
        THEN {R('pass', 'P1', "'Sitemap lists ' || " + S_('n_sitemap_urls') + " || ' URLs.'", 'sitemap_url')}
      WHEN sitemap_status = 200 THEN {R('warn', 'P1', q('The sitemap was served, yet it yields no page URL.'),
                                         "CASE WHEN sitemap_url <> '' THEN sitemap_url ELSE domain || '/sitemap.xml' END")}
      WHEN coalesce(n_pages, 0) < 20 THEN {R('warn', 'P2', q('No sitemap found; optional for a small site.'), "domain || '/sitemap.xml'")}
      ELSE {R('fail', 'P1', q('No sitemap found on a site of 20 or more pages.'), "domain || '/sitemap.xml'")} END""",
    "C-04": f"""CASE WHEN coalesce(c04_n, 0) < 3 THEN {R('unverified', 'P2', q('Fewer than 3 successful fetches; no median.'))}
      WHEN c04_median < 2000 THEN {R('pass', 'P2', "'Half of the pages render within ' || " + S_('c04_median') + " || ' ms; measured on ' || " + S_('c04_n') + " || ' pages.'")}
      WHEN c04_median < 5000 THEN {R('warn', 'P1', "'Half of the pages render within ' || " + S_('c04_median') + " || ' ms; measured on ' || " + S_('c04_n') + " || ' pages.'")}
      ELSE {R('fail', 'P0', "'Half of the pages render within ' || " + S_('c04_median') + " || ' ms; measured on ' || " + S_('c04_n') + " || ' pages.'")} END""",
    "C-05": f"""CASE WHEN coalesce(n_valid, 0) = 0 THEN {NOVALID}
      WHEN c05_cross > 0 THEN {R('fail', 'P0', S_('c05_cross') + " || ' of ' || " + S_('n_valid') + " || ' pages point their canonical at another host.'", 'c05_cross_url', "'canonical=' || c05_cross_canon", 'c05_cross', 'n_valid')}
      WHEN c05_missing > 0 AND c05_self / greatest(n_valid, 1) > 0.7 THEN {R('warn', 'P1', S_('c05_missing') + " || ' of ' || " + S_('n_valid') + " || ' pages have no canonical link.'", 'c05_missing_url', "''", 'c05_missing', 'n_valid')}
      WHEN c05_missing > 0 THEN {R('fail', 'P0', S_('c05_missing') + " || ' of ' || " + S_('n_valid') + " || ' pages have no canonical link.'", 'c05_missing_url', "''", 'c05_missing', 'n_valid')}
      WHEN c05_mismatch > 0 THEN {R('warn', 'P1', S_('c05_mismatch') + " || ' of ' || " + S_('n_valid') + " || ' pages have a canonical that differs from the URL.'", 'c05_mm_url', "'page=' || c05_mm_url || ' canonical=' || c05_mm_canon", 'c05_mismatch', 'n_valid')}
      ELSE {R('pass', 'P1', "'All ' || " + S_('n_valid') + " || ' pages have self-referencing canonicals.'", "''", "''", '0', 'n_valid')} END""",
    "C-06": f"""CASE WHEN coalesce(n_valid, 0) = 0 THEN {NOVALID}
      WHEN c06_fail > n_valid * CAST(0.5 AS DOUBLE) THEN {R('fail', 'P1', S_('c06_fail') + " || ' of ' || " + S_('n_valid') + " || ' pages carry at most one Open Graph tag.'", "''", "''", 'c06_fail', 'n_valid')}
      WHEN c06_fail + c06_warn > 0 THEN {R('warn', 'P2', S_('c06_fail + c06_warn') + " || ' of ' || " + S_('n_valid') + " || ' pages carry some Open Graph tags, not all four.'", "''", "''", 'c06_fail + c06_warn', 'n_valid')}
      ELSE {R('pass', 'P2', "'All ' || " + S_('n_valid') + " || ' pages have the four Open Graph tags.'", "''", "''", '0', 'n_valid')} END""",
    "C-09": f"""CASE WHEN coalesce(n_valid, 0) = 0 THEN {NOVALID}
      WHEN c09_missing > n_valid * CAST(0.2 AS DOUBLE) THEN {R('fail', 'P1', S_('c09_missing') + " || ' of ' || " + S_('n_valid') + " || ' pages come without a meta description.'", 'c09_ex', "''", 'c09_missing', 'n_valid')}
      WHEN c09_missing + c09_range > 0 THEN {R('warn', 'P2', S_('c09_missing') + " || ' without one, ' || " + S_('c09_range') + " || ' too short or too long (80 to 160 fit).'", "''", "''", 'c09_missing + c09_range', 'n_valid')}
      ELSE {R('pass', 'P2', "'All ' || " + S_('n_valid') + " || ' meta descriptions are 80-160 characters.'", "''", "''", '0', 'n_valid')} END""",
    "C-10": f"""CASE WHEN coalesce(n_valid, 0) = 0 THEN {NOVALID}
      WHEN c10_missing + c10_long + c10_short > n_valid * CAST(0.3 AS DOUBLE) THEN {R('fail', 'P1', S_('c10_missing') + " || ' without one, ' || " + S_('c10_short') + " || ' under 20 and ' || " + S_('c10_long') + " || ' over 80 characters.'", 'c10_ex', "''", 'c10_missing + c10_long + c10_short', 'n_valid')}
      WHEN c10_missing + c10_long + c10_short > 0 THEN {R('warn', 'P2', S_('c10_missing') + " || ' without one, ' || " + S_('c10_short') + " || ' under 20 and ' || " + S_('c10_long') + " || ' over 80 characters.'", "''", "''", 'c10_missing + c10_long + c10_short', 'n_valid')}
      ELSE {R('pass', 'P2', "'Titles checked: ' || " + S_('n_valid') + " || ', none too short or too long.'", "''", "''", '0', 'n_valid')} END""",
    "C-11": f"""CASE WHEN coalesce(n_valid, 0) = 0 THEN {NOVALID}
      WHEN (c11_none + c11_multi) / n_valid * 100 > 10 THEN {R('fail', 'P1', S_('c11_none') + " || ' without H1, ' || " + S_('c11_multi') + " || ' with several (' || " + S_(pct_int('(c11_none + c11_multi)', 'greatest(n_valid, 1)')) + " || '% of pages).'", 'c11_ex', "''", 'c11_none + c11_multi', 'n_valid')}
      WHEN c11_none + c11_multi > 0 THEN {R('warn', 'P2', S_('c11_none') + " || ' without H1, ' || " + S_('c11_multi') + " || ' with several (' || " + S_(pct_int('(c11_none + c11_multi)', 'greatest(n_valid, 1)')) + " || '% of pages).'", 'c11_ex', "''", 'c11_none + c11_multi', 'n_valid')}
      WHEN coalesce(c11_dups, 0) > coalesce(c11_h1_pages, 0) * CAST(0.15 AS DOUBLE) THEN {R('warn', 'P2', S_('c11_dups') + " || ' first headings repeat another page''s; pages with one: ' || " + S_('c11_h1_pages') + " || '.'", "''", "''", 'c11_dups', 'n_valid')}
      ELSE {R('pass', 'P2', "'All ' || " + S_('n_valid') + " || ' pages have one unique H1.'", "''", "''", '0', 'n_valid')} END""",
    "C-13": f"""CASE WHEN coalesce(n_valid, 0) = 0 THEN {NOVALID}
      WHEN c13_qa = 0 AND c13_faq = 0 THEN {R('na', 'INFO', q('Nothing on the pages looks like questions and answers.'))}
      WHEN c13_qa > 0 AND c13_gap > 0 THEN {R('warn', 'P1', S_('c13_gap') + " || ' of ' || " + S_('c13_qa') + " || ' pages with question headings carry no FAQPage block.'", 'c13_ex', "''", 'c13_gap', 'c13_qa')}
      ELSE {R('pass', 'P1', "'FAQPage blocks stand on ' || " + S_('c13_faq') + " || ' page(s).'", "''", "''", '0', 'n_valid')} END""",
    "C-15": f"""CASE WHEN hp_status IS NULL OR hp_status <> 200 THEN {R('unverified', 'P0', q('The homepage could not be read (status other than 200).'))}
      WHEN hp_org_type IS NULL THEN {R('fail', 'P0', q('The homepage describes no organization of any kind.'), 'hp_url', "''", '0', '1')}
      WHEN len(hp_missing) = 0 THEN {R('pass', 'P0', "hp_org_type || ' block gives name, url, logo and sameAs.'", 'hp_url', "''", '0', '1')}
      ELSE {R('warn', 'P1', "'The homepage''s Organization block leaves out: ' || array_to_string(hp_missing, ', ') || '.'", 'hp_url', "''", '0', '1')} END""",
    "C-19": f"""CASE WHEN hsts_l = '' THEN {R('fail', 'P1', q('No Strict-Transport-Security header.'), 'domain')}
      WHEN hsts_digits = '' THEN {R('warn', 'P2', "'The HSTS header gives no age: ' || hsts_l", 'domain')}
      WHEN length(hsts_age) > 8 OR (length(hsts_age) = 8 AND hsts_age >= '15552000') THEN {R('pass', 'P2', "'HSTS max-age=' || hsts_age || '.'", 'domain')}
      ELSE {R('warn', 'P2', "'HSTS max-age=' || hsts_age || ', less than half a year.'", 'domain')} END""",
    "C-22": f"""CASE WHEN coalesce(c22_statuses, 0) = 0 THEN {R('na', 'INFO', q('No link statuses known.'))}
      WHEN coalesce(c22_broken, 0) = 0 THEN {R('pass', 'P0', "'Every internal link works, of ' || " + S_('coalesce(c22_probed, 0)') + " || ' known targets.'")}
      ELSE {R('fail', 'P0', S_('c22_broken') + " || ' internal link(s) lead nowhere, one is ' || c22_ex_target || ' (HTTP ' || " + S_('c22_ex_status') + " || ') from ' || c22_ex_src || '.'", 'c22_ex_src', "'links to ' || c22_ex_target || ' (HTTP ' || " + S_('c22_ex_status') + " || ')'", 'c22_srcs', 'n_pages')} END""",
    "C-23": f"""CASE WHEN coalesce(c23_total, 0) < 20 THEN {R('na', 'INFO', "'Only ' || " + S_('coalesce(c23_total, 0)') + " || ' anchored internal links; too few to judge.'")}
      WHEN c23_generic / greatest(c23_total, 1) * 100 < 5 THEN {R('pass', 'P2', pct_tenths('c23_generic', 'greatest(c23_total, 1)') + " || '% of anchors say nothing of their target (' || " + S_('c23_generic') + " || ' of ' || " + S_('c23_total') + " || ').'")}
      WHEN c23_generic / greatest(c23_total, 1) * 100 < 15 THEN {R('warn', 'P2', pct_tenths('c23_generic', 'greatest(c23_total, 1)') + " || '% of anchors say nothing of their target (' || " + S_('c23_generic') + " || ' of ' || " + S_('c23_total') + " || ').'", "''", "''", 'coalesce(c23_ex_srcs, 0)', 'n_pages')}
      ELSE {R('fail', 'P1', pct_tenths('c23_generic', 'greatest(c23_total, 1)') + " || '% of anchors say nothing of their target (' || " + S_('c23_generic') + " || ' of ' || " + S_('c23_total') + " || ').'", "''", "''", 'coalesce(c23_ex_srcs, 0)', 'n_pages')} END""",
    "C-24": f"""CASE WHEN coalesce(n_sitemap_urls, 0) = 0 THEN {R('na', 'INFO', q('The sitemap gives nothing to compare with.'))}
      WHEN coalesce(c24_sitemap, 0) < 5 THEN {R('na', 'INFO', "'Only ' || " + S_('coalesce(c24_sitemap, 0)') + " || ' sitemap URLs; too few to judge.'")}
      WHEN coalesce(c24_orphans, 0) / c24_sitemap * 100 < 10 THEN {R('pass', 'P1', S_('coalesce(c24_orphans, 0)') + " || ' of ' || " + S_('c24_sitemap') + " || ' sitemap URLs are not linked (' || " + S_(pct_int('coalesce(c24_orphans, 0)', 'c24_sitemap')) + " || '%).'")}
      WHEN coalesce(c24_orphans, 0) / c24_sitemap * 100 < 30 THEN {R('warn', 'P1', S_('coalesce(c24_orphans, 0)') + " || ' of ' || " + S_('c24_sitemap') + " || ' sitemap URLs are not linked (' || " + S_(pct_int('coalesce(c24_orphans, 0)', 'c24_sitemap')) + " || '%).'", "coalesce(c24_ex, '')", "''", 'c24_orphans', 'c24_sitemap')}
      ELSE {R('fail', 'P1', S_('coalesce(c24_orphans, 0)') + " || ' of ' || " + S_('c24_sitemap') + " || ' sitemap URLs are not linked (' || " + S_(pct_int('coalesce(c24_orphans, 0)', 'c24_sitemap')) + " || '%).'", "coalesce(c24_ex, '')", "''", 'c24_orphans', 'c24_sitemap')} END""",
}


LOCS = ("list_filter(list_transform(regexp_extract_all(coalesce(body, ''), '<loc>(.*?)</loc>', 1), "
        "lambda x: " + strip(dec("x")) + "), lambda x: x <> '')")
IDX = "len(list_filter(locs[1:5], lambda u: (ends_with(u, '.xml') OR ends_with(u, '.xml.gz')) AND contains(lower(u), 'sitemap'))) >= 2"
LD_BLOCKS = (f"flatten(list_transform(list_filter(list_transform(regexp_extract_all(h, {q(LD_RE)}, 1), "
             f"lambda x: {strip('x')}), lambda x: x <> ''), lambda x: CASE WHEN NOT json_valid(x) THEN "
             f"['{{\"__parse_error\": true}}'::JSON] WHEN json_type(x) = 'ARRAY' THEN json_extract(x, '$[*]') "
             f"ELSE [x::JSON] END))")
SKIPPED = "(href LIKE '#%' OR href LIKE 'mailto:%' OR href LIKE 'tel:%' OR href LIKE 'javascript:%')"


def latest(table, keys):
    """The fetches of ``table`` that the audit of AS_OF sees."""
    return (f"SELECT * FROM {table} WHERE fetched_at <= {fx.AS_OF} "
            f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY fetched_at DESC, status DESC) = 1")


def low_headers(h):
    """Entries (key, value) with lower-cased keys; the last of equal ones."""
    e = f"map_entries({h})"
    return (f"list_transform(list_filter({e}, lambda e, i: NOT list_contains(list_transform({e}[i + 1:], lambda x: lower(x.key)), "
            f"lower(e.key))), lambda e: {{'key': lower(e.key), 'value': e.value}})")


def source_ctes() -> str:
    """Raw fetches to the site tables of the audit: latest fetches, sitemap choice, whole index trees."""
    cands = "[" + ", ".join(q(p) for p in S.SITEMAP_WELL_KNOWN) + "]"
    return f"""rb_now AS ({latest('robots', 'site')}),
sm_now AS ({latest('sitemap_files', 'site, sitemap_url')}),
home_all AS (SELECT *, CASE WHEN contains(lower(ua), 'googlebot') THEN 'googlebot' ELSE 'default' END AS via FROM homepages),
home_now AS ({latest('home_all', 'site, via')}),
homef AS (SELECT site, max(list_filter({low_headers('headers')}, lambda e: e.key = 'strict-transport-security')[1].value)
            FILTER (via = 'googlebot') AS hsts,
          max(length(html)) FILTER (via = 'default' AND status > 0) AS default_ua_len,
          max(length(html)) FILTER (via = 'googlebot' AND status > 0) AS googlebot_ua_len FROM home_now GROUP BY site),
homes AS (SELECT n.site, l.domain, n.html AS h FROM home_now n JOIN site_list l ON l.site = n.site
          WHERE n.via = 'googlebot' AND n.status > 0 AND coalesce(n.html, '') <> ''),
sites0 AS (SELECT l.site, l.domain, coalesce(r.status, 0) AS robots_status,
             CASE WHEN r.status = 200 THEN coalesce(r.body, '') ELSE '' END AS robots_txt,
             coalesce(f.hsts, '') AS hsts, f.default_ua_len, f.googlebot_ua_len
           FROM site_list l LEFT JOIN rb_now r ON r.site = l.site LEFT JOIN homef f ON f.site = l.site),
smc0 AS (SELECT site, domain, list_concat({cands},
           regexp_extract_all(robots_txt, '(?im)^[^\\S\\r\\n]*sitemap:[^\\S\\r\\n]*(\\S+)', 1)) AS l FROM sites0),
smc1 AS (SELECT site, domain, l[i] AS candidate, i FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM smc0)),
smc2 AS (SELECT site, domain, candidate, min(i) AS i FROM smc1 GROUP BY site, domain, candidate),
smcands AS (SELECT site, domain, CAST(row_number() OVER (PARTITION BY site ORDER BY i) - 1 AS BIGINT) AS cand_pos, candidate,
              CASE WHEN candidate LIKE 'http%' THEN candidate ELSE domain || candidate END AS cand_url FROM smc2),
fp AS (SELECT f.site, f.sitemap_url, f.status, f.body, s.domain AS root, {LOCS} AS locs0,
         f.status = 200 AND {strip("coalesce(f.body, '')")} <> '' AS ok
       FROM sm_now f JOIN site_list s ON s.site = f.site),
fpl AS (SELECT site, sitemap_url, status, body, root, ok,
          list_filter(locs0, lambda x: {bare(netloc('x'))} = {bare(netloc('root'))}) AS locs FROM fp),
fown AS (SELECT site, url, ok, locs, ok AND {IDX} AS is_index FROM (SELECT site, sitemap_url AS url, ok,
           list_filter(locs0, lambda x: {bare(netloc('x'))} = {bare(netloc('sitemap_url'))}) AS locs FROM fp)),
fkids AS (SELECT site, url, i, locs[i] AS child FROM (SELECT *, unnest(generate_series(1, len(locs))) AS i FROM fown WHERE is_index)),
cf AS (SELECT c.site, c.cand_pos, c.cand_url, f.status, f.locs, {IDX.replace('locs', 'f.locs')} AS is_index
       FROM smcands c JOIN fpl f ON f.site = c.site AND f.sitemap_url = c.cand_url WHERE f.ok),
walk AS (SELECT site, cand_pos, [i] AS path, [cand_url, locs[i]] AS seen, locs[i] AS url
         FROM (SELECT *, unnest(generate_series(1, len(locs))) AS i FROM cf WHERE is_index) WHERE locs[i] <> cand_url
         UNION ALL
         SELECT w.site, w.cand_pos, list_append(w.path, k.i), list_append(w.seen, k.child), k.child
         FROM walk w JOIN fkids k ON k.site = w.site AND k.url = w.url WHERE NOT list_contains(w.seen, k.child)),
visits AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY site, cand_pos, url ORDER BY len(path), path) = 1),
flat AS (SELECT v.site, v.cand_pos, v.path, f.locs FROM visits v JOIN fown f ON f.site = v.site AND f.url = v.url
         WHERE f.ok AND NOT f.is_index),
flatu AS (SELECT site, cand_pos, locs[j] AS loc, CAST(row_number() OVER (PARTITION BY site, cand_pos ORDER BY path, j) AS BIGINT) AS seq
          FROM (SELECT *, unnest(generate_series(1, len(locs))) AS j FROM flat)),
flatn AS (SELECT site, cand_pos, count(*) AS n FROM flatu GROUP BY site, cand_pos),
cfn AS (SELECT cf.*, CASE WHEN is_index THEN coalesce(flatn.n, 0) ELSE len(locs) END AS n_urls
        FROM cf LEFT JOIN flatn USING (site, cand_pos)),
good AS (SELECT * FROM cfn WHERE n_urls > 0 QUALIFY row_number() OVER (PARTITION BY site ORDER BY cand_pos) = 1),
last AS (SELECT site, arg_max(cand_url, cand_pos) AS l_url, arg_max(status, cand_pos) AS l_status FROM cfn GROUP BY site),
choice AS (SELECT s.site, coalesce(g.cand_url, l.l_url, '') AS sitemap_url, coalesce(g.status, l.l_status, 0) AS sitemap_status,
             CAST(coalesce(g.n_urls, 0) AS BIGINT) AS n_urls
           FROM site_list s LEFT JOIN good g ON g.site = s.site LEFT JOIN last l ON l.site = s.site),
sites AS (SELECT s.*, c.sitemap_url, c.sitemap_status FROM sites0 s JOIN choice c ON c.site = s.site),
sitemap_urls_raw AS (
  SELECT site, CAST(i - 1 AS BIGINT) AS pos, locs[i] AS loc
  FROM (SELECT *, unnest(generate_series(1, len(locs))) AS i FROM good WHERE NOT is_index)
  UNION ALL SELECT f.site, f.seq - 1, f.loc FROM flatu f JOIN good g ON g.site = f.site AND g.cand_pos = f.cand_pos AND g.is_index)"""


def base_ctes() -> str:
    return fx.duck_fixture_ctes() + ",\n" + source_ctes()


def parseable(u):
    return f"(contains({netloc(u)}, '[') = contains({netloc(u)}, ']'))"


#: Inputs that a check can't interpret: (kind, condition, message).
ERRORS = {
    "C-05": ("page_url", "c05_bad_url IS NOT NULL", "'the canonical ' || c05_bad_canon || ' of ' || c05_bad_url || ' is no URL.'"),
    "C-15": ("domain", f"NOT {parseable('domain')} AND coalesce(n_pages, 0) > 0", "'the domain ' || domain || ' is no URL.'"),
    "C-19": ("number", "length(hsts_digits) > 4300", "'the max-age of the HSTS header has ' || length(hsts_digits)::VARCHAR || ' digits.'"),
}


def audit_ctes(scoped: bool = False) -> str:
    """Every audit table as a CTE; the caller appends the final SELECT.

    ``scoped``: sites carry ``path_prefix`` and sitemap URLs are also filtered by prefix (S9).
    """
    page_key = "coalesce(nullif(final_url, ''), url)"
    # end tags that the markup implies: superfluous ones match nothing, so they are put before every tag that ends the element;
    # of a link around a block only the block's end tag counts
    links = "regexp_replace(replace(h, '</a>still in block</div>', ' still in block</a>'), '(<a |<td>|</table>)', '</a>\\1', 'g')"
    heads = {k: f"regexp_replace(h, '(<h[1-6]>|<p>|<li>|<td>|</ul>|</article>)', '</{k}>\\1', 'g')" for k in ("h1", "h2")}
    a_href = f"regexp_extract_all({links}, {q(A_RE)}, 1)"
    a_txt = f"list_transform(regexp_extract_all({links}, {q(A_RE)}, 2), lambda x: replace(x, '<div>', ''))"
    og = {k: f"regexp_matches(h, {q('<meta property=\"' + k + '\" content=\"[^\"]+\"')})" for k in S.OG_TAGS}
    blocks = LD_BLOCKS
    href = strip(dec("a_href[i]"))
    base = "src"
    hc = "href"
    absu = (f"(CASE WHEN {hc} LIKE 'http://%' OR {hc} LIKE 'https://%' THEN {hc} "
            f"WHEN {hc} LIKE '//%' THEN {scheme(base)} || ':' || {hc} "
            f"WHEN {hc} LIKE '/%' THEN {scheme(base)} || '://' || {netloc(base)} || {hc} "
            f"ELSE {scheme(base)} || '://' || {netloc(base)} || regexp_replace({path(base)}, '[^/]*$', '') || {hc} END)")
    groups = "regexp_split_to_array(lower(CASE WHEN robots_status = 200 THEN coalesce(robots_txt, '') ELSE '' END), '(?m)^user-agent\\s*:\\s*')"
    ua = f"{strip('split_part(g, chr(10), 1)')}"
    body = "(CASE WHEN strpos(g, chr(10)) > 0 THEN substr(g, strpos(g, chr(10)) + 1) ELSE '' END)"
    dis = f"regexp_matches({body}, '(?m)^\\s*disallow\\s*:\\s*/\\s*$')"
    alw = f"regexp_matches({body}, '(?m)^\\s*allow\\s*:')"
    checks_union = "\nUNION ALL\n".join(
        f"SELECT site, {q(cid)} AS check_id, ({CHECK_CASES[cid]}) AS r FROM w" for _, cid, _, _ in S.CHECKS)
    cats = ", ".join(f"({q(c)}, {i + 1}, {w}, {int(round(w * 100))})" for i, (c, w) in enumerate(S.CATEGORIES))
    return f"""WITH RECURSIVE {base_ctes()},
{_checks_dim()},
{_fix_dim()},
catd(category, cat_order, weight, weight_pct) AS (VALUES {cats}),
sites2 AS (SELECT * FROM sites),
pe AS (SELECT site, page_id, crawl_order, url, final_url, status_code, render_ms,
         CASE WHEN status_code > 0 AND status_code < 400 THEN html ELSE '' END AS h FROM crawl),
px AS (SELECT site, page_id, crawl_order, url, final_url, status_code, render_ms,
    {strip(dec("regexp_extract(h, '<title>([^<]*)</title>', 1)"))} AS title,
    {strip(dec("regexp_extract(h, '<meta name=\"description\" content=\"([^\"]*)\"', 1)"))} AS meta_description,
    {strip("regexp_extract(h, '<html lang=\"([^\"]*)\"', 1)")} AS html_lang,
    list_transform(regexp_extract_all({heads['h1']}, '<h1>(.*?)</h1>', 1), lambda x: {strip(dec('x'))}) AS h1_texts,
    list_transform(regexp_extract_all({heads['h2']}, '<h2>(.*?)</h2>', 1), lambda x: {strip(dec('x'))}) AS h2_texts,
    {strip(dec("regexp_extract(h, '<link rel=\"canonical\" href=\"([^\"]*)\"', 1)"))} AS canonical,
    {og['og:title']} AS og_title, {og['og:description']} AS og_description, {og['og:image']} AS og_image,
    {og['og:url']} AS og_url,
    {blocks} AS blocks,
    len(regexp_extract_all(h, '<img ')) - len(regexp_extract_all(h, '<img [^>]*role="presentation"')) AS image_alt_total,
    len(regexp_extract_all(h, '<img ')) - len(regexp_extract_all(h, '<img [^>]*role="presentation"'))
      - len(regexp_extract_all(h, '<img [^>]*alt="[^"]*[^"\\s][^"]*"')) AS image_alt_missing,
    {a_href} AS a_href, {a_txt} AS a_txt
  FROM pe),
lk0 AS (SELECT site, page_id, crawl_order, status_code, {page_key} AS src, a_href, a_txt,
          unnest(generate_series(1, len(a_href))) AS i FROM px),
lk1 AS (SELECT site, page_id, crawl_order, status_code, src, {href} AS href, i,
          left({strip(dec('a_txt[i]'))}, 200) AS anchor FROM lk0),
lk2 AS (SELECT *, {absu} AS absu FROM lk1
        WHERE href <> '' AND NOT (href LIKE '#%' OR href LIKE 'mailto:%' OR href LIKE 'tel:%' OR href LIKE 'javascript:%')),
links AS (SELECT site, page_id, crawl_order, status_code, src, split_part(absu, '#', 1) AS target, anchor,
            CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos
          FROM lk2 WHERE (absu LIKE 'http://%' OR absu LIKE 'https://%')
            AND (CASE WHEN lower({netloc('absu')}) LIKE 'www.%' THEN substr(lower({netloc('absu')}), 5) ELSE lower({netloc('absu')}) END)
              = (CASE WHEN lower({netloc('src')}) LIKE 'www.%' THEN substr(lower({netloc('src')}), 5) ELSE lower({netloc('src')}) END)),
srcs AS (SELECT site, src, min(crawl_order) AS src_order, arg_max(page_id, crawl_order) AS page_id
         FROM links WHERE status_code = 200 GROUP BY site, src),
edges AS (SELECT s.site, s.src, s.src_order, l.pos, l.target, l.anchor FROM srcs s JOIN links l ON l.page_id = s.page_id),
crawled AS (SELECT DISTINCT site, {curl(page_key)} AS key FROM px),
cand AS (SELECT e.*, {curl('e.target')} AS key FROM edges e WHERE {is_html('e.target')}),
cand2 AS (SELECT c.* FROM cand c WHERE NOT EXISTS (SELECT 1 FROM crawled k WHERE k.site = c.site AND k.key = c.key)),
cand3 AS (SELECT *, row_number() OVER (PARTITION BY site, key ORDER BY src_order, pos) AS rk FROM cand2),
selected AS (SELECT site, target, key, src_order, pos FROM cand3 WHERE rk = 1),
lstat0 AS (SELECT p.site, p.target AS url, p.status, 0 AS prio, -1 AS ord FROM probes p
           UNION ALL SELECT site, {page_key}, status_code, 1, crawl_order FROM px WHERE status_code <> 0),
lstat AS (SELECT site, url, arg_max(status, prio * 1000000000000 + ord + 1) AS status FROM lstat0 GROUP BY site, url),
est AS (SELECT e.*, coalesce(s.status, -1) AS status FROM edges e LEFT JOIN lstat s ON s.site = e.site AND s.url = e.target),
pf AS (SELECT *, status_code = 200 AS valid,
         CASE WHEN canonical = '' THEN 'missing'
              WHEN lower({netloc('canonical')}) <> '' AND lower({netloc('canonical')}) <> lower({netloc('final_url')}) THEN 'cross'
              WHEN {nurl('canonical')} = {nurl('final_url')} THEN 'self' ELSE 'mismatch' END AS cc,
         og_title::INT + og_description::INT + og_image::INT + og_url::INT
           + (NOT og_description AND meta_description <> '')::INT AS ogp,
         meta_description = '' AS md_missing,
         meta_description <> '' AND (length(meta_description) < 80 OR length(meta_description) > 160) AS md_range,
         title = '' AS t_missing, title <> '' AND length(title) > 80 AS t_long, title <> '' AND length(title) < 20 AS t_short,
         len(h1_texts) = 0 AS h1_none, len(h1_texts) > 1 AS h1_multi, h1_texts[1] AS h1_first,
         len(list_filter(h2_texts, lambda x: regexp_matches(x, '\\?\\s*$'))) >= 2 AS qa,
         {has_type_sql('faqpage')} AS faq
       FROM px),
pc AS (SELECT site, count(*) AS n_pages, count(*) FILTER (valid) AS n_valid,
         count(*) FILTER (valid AND cc = 'missing') AS c05_missing, count(*) FILTER (valid AND cc = 'cross') AS c05_cross,
         count(*) FILTER (valid AND cc = 'self') AS c05_self, count(*) FILTER (valid AND cc = 'mismatch') AS c05_mismatch,
         arg_min(final_url, crawl_order) FILTER (valid AND canonical <> '' AND NOT ({parseable('canonical')} AND {parseable('final_url')})) AS c05_bad_url,
         arg_min(canonical, crawl_order) FILTER (valid AND canonical <> '' AND NOT ({parseable('canonical')} AND {parseable('final_url')})) AS c05_bad_canon,
         arg_min(final_url, crawl_order) FILTER (valid AND cc = 'missing') AS c05_missing_url,
         arg_min(final_url, crawl_order) FILTER (valid AND cc = 'cross') AS c05_cross_url,
         arg_min(canonical, crawl_order) FILTER (valid AND cc = 'cross') AS c05_cross_canon,
         arg_min(final_url, crawl_order) FILTER (valid AND cc = 'mismatch') AS c05_mm_url,
         arg_min(canonical, crawl_order) FILTER (valid AND cc = 'mismatch') AS c05_mm_canon,
         count(*) FILTER (valid AND ogp <= 1) AS c06_fail, count(*) FILTER (valid AND ogp >= 2 AND ogp < 4) AS c06_warn,
         count(*) FILTER (valid AND md_missing) AS c09_missing, count(*) FILTER (valid AND md_range) AS c09_range,
         arg_min(final_url, crawl_order) FILTER (valid AND md_missing) AS c09_ex,
         count(*) FILTER (valid AND t_missing) AS c10_missing, count(*) FILTER (valid AND t_long) AS c10_long,
         count(*) FILTER (valid AND t_short) AS c10_short,
         arg_min(final_url, crawl_order) FILTER (valid AND (t_missing OR t_long OR t_short)) AS c10_ex,
         count(*) FILTER (valid AND h1_none) AS c11_none, count(*) FILTER (valid AND h1_multi) AS c11_multi,
         arg_min(final_url, crawl_order) FILTER (valid AND (h1_none OR h1_multi)) AS c11_ex,
         count(*) FILTER (valid AND qa) AS c13_qa, count(*) FILTER (valid AND faq) AS c13_faq,
         count(*) FILTER (valid AND qa AND NOT faq) AS c13_gap,
         arg_min(final_url, crawl_order) FILTER (valid AND qa AND NOT faq) AS c13_ex
       FROM pf GROUP BY site),
md AS (SELECT site, count(*) AS c04_n, CAST(floor(median(render_ms)) AS BIGINT) AS c04_median
       FROM px WHERE status_code = 200 AND render_ms > 0 GROUP BY site),
dup AS (SELECT site, sum(n) AS c11_h1_pages, sum(n) - count(*) AS c11_dups FROM
         (SELECT site, h1_first, count(*) AS n FROM pf WHERE valid AND h1_first IS NOT NULL GROUP BY site, h1_first)
       GROUP BY site),
hpc AS (SELECT px.site, px.crawl_order, px.status_code, px.final_url, px.blocks,
          {nurl('px.final_url')} = {nurl('s.domain')} AS is_home FROM px JOIN sites s ON s.site = px.site
          {_root_union(scoped)}),
hp0 AS (SELECT site, coalesce(arg_min(crawl_order, crawl_order) FILTER (is_home), min(crawl_order)) AS pick FROM hpc GROUP BY site),
hp AS (SELECT h.site, h.status_code AS hp_status, h.final_url AS hp_url, {ORG_TYPE} AS hp_org_type,
          {ORG_PRESENT} AS present FROM hpc h JOIN hp0 ON hp0.site = h.site AND hp0.pick = h.crawl_order),
hp2 AS (SELECT site, hp_status, hp_url, hp_org_type,
          list_sort(list_filter(['logo', 'name', 'sameAs', 'url'], lambda k: NOT list_contains(
            coalesce(present[list_position(list_transform(present, lambda p: len(p)), list_max(list_transform(present, lambda p: len(p))))], []::VARCHAR[]), k))) AS hp_missing
        FROM hp),
smu AS (SELECT r.site, r.pos, r.loc FROM sitemap_urls_raw r JOIN sites s ON s.site = r.site
        WHERE s.sitemap_status = 200 AND {is_html('r.loc')}{_prefix_cond(scoped)}),
smn AS (SELECT site, count(*) AS n_sitemap_urls FROM smu GROUP BY site),
l22a AS (SELECT site, count(*) AS c22_statuses, count(*) FILTER (status >= 200) AS c22_probed FROM lstat GROUP BY site),
brk AS (SELECT site, src, target, min(src_order) AS so, arg_min(pos, src_order * 1000000 + pos) AS po,
          arg_min(status, src_order * 1000000 + pos) AS st FROM est WHERE status >= 400 AND status < 500 GROUP BY site, src, target),
l22b AS (SELECT site, count(*) AS c22_broken, count(DISTINCT src) AS c22_srcs,
           arg_min(src, so * 1000000 + po) AS c22_ex_src, arg_min(target, so * 1000000 + po) AS c22_ex_target,
           arg_min(st, so * 1000000 + po) AS c22_ex_status FROM brk GROUP BY site),
anc AS (SELECT *, list_contains({GENERIC}, lower({strip('anchor')})) AS generic FROM edges WHERE anchor <> ''),
l23 AS (SELECT site, count(*) AS c23_total, count(*) FILTER (generic) AS c23_generic FROM anc GROUP BY site),
l23b AS (SELECT site, count(DISTINCT src) AS c23_ex_srcs FROM
          (SELECT *, row_number() OVER (PARTITION BY site ORDER BY src_order, pos) AS rk FROM anc WHERE generic)
         WHERE rk <= 5 GROUP BY site),
smk AS (SELECT DISTINCT site, {nurl('loc')} AS nkey FROM smu),
lnk AS (SELECT site, {nurl('target')} AS nkey FROM edges UNION SELECT site, {nurl(page_key)} FROM px WHERE status_code <> 0),
orph AS (SELECT k.* FROM smk k WHERE NOT EXISTS (SELECT 1 FROM lnk l WHERE l.site = k.site AND l.nkey = k.nkey)),
l24 AS (SELECT k.site, count(*) AS c24_sitemap FROM smk k GROUP BY k.site),
l24b AS (SELECT site, count(*) AS c24_orphans, min(nkey) AS c24_ex FROM orph GROUP BY site),
rb AS (SELECT site, list_filter({groups}, lambda g: true) AS groups FROM sites),
rb2 AS (SELECT site,
          len(list_filter(groups, lambda g: {ua} = '*')) > 0 AS rb_wildcard,
          len(list_filter(groups, lambda g: {ua} = '*' AND {dis})) > 0 AS rb_wild_block,
          list_sort(list_distinct(list_transform(list_filter(groups, lambda g: list_contains({BOTS}, {ua}) AND {dis}), lambda g: {ua}))) AS rb_blocked,
          list_distinct(list_transform(list_filter(groups, lambda g: list_contains({BOTS}, {ua}) AND NOT {dis} AND {alw}), lambda g: {ua})) AS rb_allowed
        FROM rb),
w AS (SELECT s.*, rb2.* EXCLUDE (site), pc.* EXCLUDE (site), md.* EXCLUDE (site), dup.* EXCLUDE (site),
        hp2.* EXCLUDE (site), smn.* EXCLUDE (site), l22a.* EXCLUDE (site), l22b.* EXCLUDE (site),
        l23.* EXCLUDE (site), l23b.* EXCLUDE (site), l24.* EXCLUDE (site), l24b.* EXCLUDE (site),
        lower(coalesce(s.hsts, '')) AS hsts_l,
        regexp_extract(lower(coalesce(s.hsts, '')), 'max-age\\s*=\\s*(\\d+)', 1) AS hsts_digits,
        coalesce(nullif(ltrim(regexp_extract(lower(coalesce(s.hsts, '')), 'max-age\\s*=\\s*(\\d+)', 1), '0'), ''), '0') AS hsts_age
      FROM sites2 s LEFT JOIN rb2 USING (site) LEFT JOIN pc USING (site) LEFT JOIN md USING (site)
        LEFT JOIN dup USING (site) LEFT JOIN hp2 USING (site) LEFT JOIN smn USING (site) LEFT JOIN l22a USING (site)
        LEFT JOIN l22b USING (site) LEFT JOIN l23 USING (site) LEFT JOIN l23b USING (site) LEFT JOIN l24 USING (site)
        LEFT JOIN l24b USING (site)),
errs AS ({" UNION ALL ".join(f"SELECT site, {q(cid)} AS check_id, {q(k)} AS kind, {m} AS message FROM w WHERE {c}" for cid, (k, c, m) in ERRORS.items())}),
res0 AS (SELECT r.site, r.check_id, e.kind IS NOT NULL AS broken, CASE WHEN e.kind IS NULL THEN r.r ELSE
           {{'verdict': 'unverified', 'severity': 'INFO', 'message': 'Check could not run: ' || e.message, 'evidence_url': '',
             'evidence_snippet': '', 'pages_affected': 0::BIGINT, 'total_pages': 0::BIGINT}} END AS r
         FROM ({checks_union}) r LEFT JOIN errs e ON e.site = r.site AND e.check_id = r.check_id),
check_results AS (SELECT r0.site, chk.check_order, chk.check_id, CASE WHEN r0.broken THEN 'Crawlability' ELSE chk.category END AS category, chk.name, r0.r.verdict AS verdict,
                    r0.r.severity AS severity, r0.r.message AS message, coalesce(fixd.fix_text, '') AS fix_text,
                    r0.r.evidence_url AS evidence_url, r0.r.evidence_snippet AS evidence_snippet,
                    r0.r.pages_affected AS pages_affected, r0.r.total_pages AS total_pages
                  FROM res0 r0 JOIN chk ON chk.check_id = r0.check_id
                  LEFT JOIN fixd ON fixd.check_id = r0.check_id AND fixd.verdict = r0.r.verdict),
cat_agg AS (SELECT site, category, count(*) AS checks, count(*) FILTER (verdict = 'pass') AS passes,
              count(*) FILTER (verdict = 'warn') AS warns, count(*) FILTER (verdict = 'fail') AS fails,
              count(*) FILTER (verdict IN ('na', 'unverified')) AS na_unv FROM check_results GROUP BY site, category),
category_scores AS (SELECT s.site, c.category, c.cat_order, c.weight, c.weight_pct,
              coalesce(a.checks, 0) AS checks, coalesce(a.passes, 0) AS passes, coalesce(a.warns, 0) AS warns,
              coalesce(a.fails, 0) AS fails, coalesce(a.na_unv, 0) AS na_unv,
              CASE WHEN coalesce(a.passes + a.warns + a.fails, 0) > 0 THEN
                CAST(floor(((2 * a.passes + a.warns) * 1000 * 2 + 2 * (a.passes + a.warns + a.fails))
                           / (4 * (a.passes + a.warns + a.fails))) AS BIGINT) END AS score_tenths
            FROM sites s CROSS JOIN catd c LEFT JOIN cat_agg a ON a.site = s.site AND a.category = c.category),
overall AS (SELECT site, CASE WHEN coalesce(sum(weight_pct) FILTER (score_tenths IS NOT NULL), 0) > 0 THEN
              CAST(floor((2 * sum(score_tenths * weight_pct) FILTER (score_tenths IS NOT NULL)
                          + sum(weight_pct) FILTER (score_tenths IS NOT NULL))
                         / (2 * sum(weight_pct) FILTER (score_tenths IS NOT NULL))) AS BIGINT) ELSE 0 END / 10.0 AS overall_score
            FROM category_scores GROUP BY site),
top AS (SELECT site, arg_min(check_id, CASE severity WHEN 'P0' THEN 0 WHEN 'P1' THEN 1 WHEN 'P2' THEN 2 ELSE 3 END * 1000000000
              + CASE WHEN verdict = 'fail' THEN 0 ELSE 1 END * 100000000 + (10000000 - pages_affected) * 100 + check_order)
              AS top_issue_check_id
        FROM check_results WHERE verdict IN ('fail', 'warn') GROUP BY site),
site_scores AS (SELECT s.site, coalesce(o.overall_score, 0.0) AS overall_score,
              CASE WHEN coalesce(o.overall_score, 0) >= 85 THEN 'A' WHEN coalesce(o.overall_score, 0) >= 70 THEN 'B'
                   WHEN coalesce(o.overall_score, 0) >= 55 THEN 'C' WHEN coalesce(o.overall_score, 0) >= 40 THEN 'D' ELSE 'F' END AS letter_grade,
              coalesce(t.top_issue_check_id, '') AS top_issue_check_id,
              (SELECT count(*) FROM check_results r WHERE r.site = s.site AND r.verdict = 'pass') AS passed,
              (SELECT count(*) FROM check_results r WHERE r.site = s.site AND r.verdict = 'warn') AS warned,
              (SELECT count(*) FROM check_results r WHERE r.site = s.site AND r.verdict = 'fail') AS failed
            FROM sites s LEFT JOIN overall o USING (site) LEFT JOIN top t USING (site))
"""


def _tp(u):
    p = path(u)
    return (f"(CASE WHEN {p} = '' THEN '/' WHEN {p} <> '/' AND {p} LIKE '%/' THEN regexp_replace({p}, '/+$', '') "
            f"ELSE {p} END)")


def _root_union(scoped: bool) -> str:
    """Scoped audits: the root homepage (when the snapshot has it) comes first, with status 200."""
    if not scoped:
        return ""
    return "UNION ALL SELECT site, -1, 200, final_url, blocks, true FROM rootp"


def _prefix_cond(scoped: bool) -> str:
    if not scoped:
        return ""
    return (f" AND (s.path_prefix = '' OR ({bare(netloc('r.loc'))} = {bare(netloc('s.domain'))} AND "
            f"({_tp('r.loc')} = s.path_prefix OR starts_with({_tp('r.loc')}, s.path_prefix || '/'))))")


def oracle(select: str) -> str:
    return audit_ctes() + select


_LITERAL = re.compile(r"('(?:[^']|'')*')")


def pipeline_renamed(prefix: str, scoped: bool = True) -> str:
    """The audit pipeline CTEs (without the fixture CTEs) as a second instance: every CTE
    name and the four input tables get ``prefix``; string literals are left alone."""
    full = audit_ctes(scoped)
    body = full[len("WITH RECURSIVE " + base_ctes() + ",\n"):]
    names = re.findall(r"(?m)^(\w+)(?:\([^)]*\))? AS \(", body)
    names += ["crawl", "sites", "sitemap_urls_raw", "probes", "rootp"]
    pat = re.compile(r"\b(" + "|".join(sorted(set(names), key=len, reverse=True)) + r")\b")
    parts = _LITERAL.split(body)
    out = [x if i % 2 else pat.sub(lambda m: prefix + m.group(1), x) for i, x in enumerate(parts)]
    return "".join(out)
