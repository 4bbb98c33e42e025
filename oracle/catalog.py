"""DuckDB oracle SQL for every query of ``siteaudit.plans.catalog`` that SQL can express.

Every query has one; the file round trips are held against the tables they store.
"""

from __future__ import annotations

from oracle.duck_audit import (A_RE, GENERIC, IDX, LD_BLOCKS, ORG_TYPE, RFC, SKIPPED, bare, curl, dec, graph, has_type_sql, is_html,
                               is_obj, low_headers, netloc, nurl, oracle, path, pipeline_renamed, q, query, scheme, strip, types)
from siteaudit import schema as S
from siteaudit.plans.catalog import AUDIT_DATE, CHECK_COLS, CHECK_KEYS, REPORT_COLUMNS

COLS = ", ".join(CHECK_COLS)
PK = "coalesce(nullif(final_url, ''), url)"
SEV = "CASE severity WHEN 'P0' THEN 0 WHEN 'P1' THEN 1 WHEN 'P2' THEN 2 ELSE 3 END"


def fmt0(x):
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def grade(x):
    return (f"CASE WHEN {x} >= 85 THEN 'A' WHEN {x} >= 70 THEN 'B' WHEN {x} >= 55 THEN 'C' "
            f"WHEN {x} >= 40 THEN 'D' ELSE 'F' END")


def bucket():
    return ("CASE WHEN verdict = 'pass' THEN 'PASS' WHEN verdict = 'fail' AND severity IN ('P0', 'P1') THEN 'P1' "
            "WHEN verdict = 'warn' AND severity IN ('P0', 'P1') THEN 'P2' ELSE 'P3' END")


def _task_dim():
    rows = ", ".join(f"({q(cid)}, {q(S.CHECK_OWNER[cid])}, {q(S.CHECK_EFFORT[cid])}, {q(S.CHECK_WHY[cid])})"
                     for _, cid, _, _ in S.CHECKS)
    return f"(VALUES {rows}) AS td(check_id, owner, effort, why)"


# Nodes of JSON-LD trees, level by level through lists of @graph; a page's distinct types, sorted, first 8.
SCHEMA_NODES = f"""jnodes AS (SELECT site, page_id, unnest(blocks) AS n FROM px
  UNION ALL SELECT site, page_id, unnest(CASE WHEN json_type(n) = 'ARRAY' THEN json_extract(n, '$[*]') ELSE {graph('n')} END) FROM jnodes),
jtypes AS (SELECT site, page_id, array_to_string(list_sort(list_distinct(flatten(list({types('n', 'xn')}))))[1:8], ', ') AS label
  FROM jnodes WHERE {is_obj('n')} GROUP BY site, page_id)"""
SCHEMA_LABEL = "CASE WHEN coalesce(j.label, '') = '' THEN '(none)' ELSE j.label END"

PAGE_ISSUES = f"""pi AS (SELECT p.site, p.page_id, {PK.replace('final_url', 'p.final_url').replace(' url)', ' p.url)')} AS page_url,
    count(r.name) AS issues,
    coalesce(arg_min(r.name, ({SEV.replace('severity', 'r.severity')}) * 100 + r.check_order), '') AS top_issue
  FROM px p LEFT JOIN check_results r ON r.site = p.site AND r.evidence_url = {PK.replace('final_url', 'p.final_url').replace(' url)', ' p.url)')}
    AND r.verdict IN ('fail', 'warn') AND r.evidence_url <> ''
  GROUP BY p.site, p.page_id, p.final_url, p.url)"""

HUB = f"""hub0 AS (SELECT l.site, l.page_id, l.href, l.i, s.domain AS root FROM lk2 l JOIN sites s ON s.site = l.site
                 WHERE l.status_code = 200),
hub1 AS (SELECT site, page_id, root, i, split_part(CASE WHEN href LIKE 'http://%' OR href LIKE 'https://%' THEN href
           WHEN href LIKE '//%' THEN {scheme('root')} || ':' || href
           WHEN href LIKE '/%' THEN {scheme('root')} || '://' || {netloc('root')} || href
           ELSE root || '/' || href END, '#', 1) AS link,
           CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS BIGINT) AS lpos FROM hub0),
hub AS (SELECT site, page_id, arg_min(lpos, lpos) AS lpos, link FROM hub1
        WHERE (link LIKE 'http://%' OR link LIKE 'https://%') AND {bare(netloc('link'))} = {bare(netloc('root'))}
        GROUP BY site, page_id, link)"""


def with_extra(extra: str, select: str) -> str:
    """Audit CTEs plus extra CTEs (appended after the standard chain)."""
    return oracle(", " + extra + "\n" + select)


ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- sources
ORACLES["scan_crawl"] = oracle("SELECT site, page_id, crawl_order, url, final_url, status_code, render_ms, "
                               "length(html) AS html_chars FROM crawl")
ORACLES["page_head"] = oracle(f"""SELECT site, page_id, final_url, status_code, render_ms,
  CASE WHEN contains(lower(ua), 'googlebot') THEN 'googlebot' ELSE 'default' END AS fetched_via,
  array_to_string(list_transform(list_sort({low_headers('headers')}), lambda e: e.key || '=' || e.value), '; ') AS headers,
  coalesce(list_filter({low_headers('headers')}, lambda e: e.key = 'content-type')[1].value, '') AS content_type,
  status_code > 0 AND status_code < 400 AS parsed FROM crawl""")
ORACLES["robots_source"] = oracle("SELECT site, robots_status, robots_txt FROM sites0")
ORACLES["sitemap_parse"] = oracle("SELECT site, sitemap_url, CAST(i - 1 AS BIGINT) AS pos, locs[i] AS loc "
                                  "FROM (SELECT *, unnest(generate_series(1, len(locs))) AS i FROM fpl)")
ORACLES["sitemap_is_index"] = oracle(f"SELECT site, sitemap_url, {IDX} AS is_index, CAST(len(locs) AS BIGINT) AS n_locs FROM fpl")
ORACLES["sitemap_candidates"] = oracle("SELECT site, cand_pos, candidate, cand_url FROM smcands")
ORACLES["sitemap_choice"] = oracle("SELECT site, sitemap_url, sitemap_status, n_urls FROM choice")
ORACLES["sitemap_flatten"] = oracle("SELECT site, cand_pos, seq, loc FROM flatu")
ORACLES["sitemap_filter"] = oracle(f"""SELECT r.site, t.path_prefix, r.pos, r.loc FROM sitemap_urls_raw r
  JOIN sites s ON s.site = r.site JOIN targets t ON t.site = r.site
  WHERE s.sitemap_status = 200 AND {is_html('r.loc')} AND (t.path_prefix = '' OR (
    {bare(netloc('r.loc'))} = {bare(netloc('t.root'))} AND (
      (CASE WHEN {path('r.loc')} = '' THEN '/' WHEN {path('r.loc')} <> '/' AND {path('r.loc')} LIKE '%/'
            THEN regexp_replace({path('r.loc')}, '/+$', '') ELSE {path('r.loc')} END) = t.path_prefix
      OR starts_with(CASE WHEN {path('r.loc')} = '' THEN '/' WHEN {path('r.loc')} <> '/' AND {path('r.loc')} LIKE '%/'
            THEN regexp_replace({path('r.loc')}, '/+$', '') ELSE {path('r.loc')} END, t.path_prefix || '/'))))""")
ORACLES["sitemap_gz"] = oracle("SELECT site, sitemap_url, CASE WHEN length(body) % 7 = 3 THEN '' ELSE body END AS body, "
                               "CASE WHEN length(body) % 7 = 3 THEN 'broken' ELSE '' END AS error FROM sm_now")
ORACLES["spa_detect"] = oracle("""SELECT site, CASE WHEN default_ua_len IS NULL OR googlebot_ua_len IS NULL OR googlebot_ua_len = 0
  THEN false ELSE abs(default_ua_len - googlebot_ua_len) / greatest(default_ua_len, googlebot_ua_len, 1) > 0.30 END AS spa_detected
  FROM sites""")
ORACLES["root_page"] = oracle(f"""SELECT t.site, t.path_prefix, CASE WHEN r.blocks IS NOT NULL THEN 200 END AS root_status,
  CAST(len(r.blocks) AS BIGINT) AS root_blocks
  FROM targets t LEFT JOIN (SELECT site, {LD_BLOCKS} AS blocks FROM homes) r ON r.site = t.site WHERE t.path_prefix <> ''""")

# -------------------------------------------------------------- extraction
for key, expr in {
    "x_title": "title", "x_meta_description": "meta_description", "x_lang": "html_lang",
    "x_h1": "CAST(len(h1_texts) AS BIGINT) AS n_h1, array_to_string(h1_texts, ' | ') AS h1",
    "x_h2": "CAST(len(h2_texts) AS BIGINT) AS n_h2, array_to_string(h2_texts, ' | ') AS h2",
    "x_canonical": "canonical",
    "x_jsonld_count": "CAST(len(blocks) AS BIGINT) AS schema_raw_count",
    "x_img_alt": "CAST(image_alt_total AS BIGINT) AS image_alt_total, CAST(image_alt_missing AS BIGINT) AS image_alt_missing",
}.items():
    ORACLES[key] = oracle(f"SELECT site, page_id, {expr} FROM px")
ORACLES["x_og"] = oracle(f"""SELECT site, page_id, property, {strip(dec('arg_max(content, i)'))} AS content
  FROM (SELECT site, page_id, k[i] AS property, c[i] AS content, i FROM (SELECT *, unnest(generate_series(1, len(k))) AS i FROM (
    SELECT site, page_id, regexp_extract_all(h, '<meta property="(og:[^"]*)" content="([^"]+)"', 1) AS k,
           regexp_extract_all(h, '<meta property="(og:[^"]*)" content="([^"]+)"', 2) AS c FROM pe))) GROUP BY site, page_id, property""")
_ALT = '<link rel="alternate" hreflang="([^"]+)" href="([^"]+)"'
ORACLES["x_hreflang"] = oracle(f"""SELECT site, page_id, CAST(i - 1 AS BIGINT) AS pos, l[i] AS lang, {strip(dec('u[i]'))} AS href
  FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM (
    SELECT site, page_id, regexp_extract_all(h, '{_ALT}', 1) AS l, regexp_extract_all(h, '{_ALT}', 2) AS u FROM pe))""")
ORACLES["x_jsonld"] = oracle(f"""SELECT site, page_id, CAST(i - 1 AS BIGINT) AS pos,
  array_to_string({types('blocks[i]', 'xt')}, ',') AS types,
  coalesce(json_extract(blocks[i], '$.__parse_error')::VARCHAR = 'true', false) AS is_parse_error
  FROM (SELECT *, unnest(generate_series(1, len(blocks))) AS i FROM px)""")
ORACLES["x_internal_links"] = oracle("SELECT site, page_id, CAST(pos AS BIGINT) AS pos, target, anchor FROM links")
ORACLES["x_hub_links"] = with_extra(HUB, "SELECT site, page_id, lpos, link FROM hub")
ORACLES["languages_seen"] = oracle("""SELECT site, string_agg(DISTINCT lower(split_part(html_lang, '-', 1)), ','
  ORDER BY lower(split_part(html_lang, '-', 1))) AS languages FROM px WHERE html_lang <> '' GROUP BY site""")

# -------------------------------------------------------------- url functions
ORACLES["is_html_url"] = oracle(f"SELECT url, {is_html('url')} AS is_html FROM (SELECT target AS url FROM edges "
                                f"UNION SELECT loc FROM sitemap_urls_raw)")
_ND = f"(CASE WHEN starts_with(v, 'http://') OR starts_with(v, 'https://') THEN v ELSE 'https://' || v END)"
ORACLES["normalize_domain"] = oracle(f"SELECT page_id, {scheme(_ND)} || '://' || {netloc(_ND)} AS domain FROM "
                                     f"(SELECT page_id, regexp_replace({strip('url')}, '/+$', '') AS v FROM crawl)")
_NT = f"(CASE WHEN starts_with(v, 'http://') OR starts_with(v, 'https://') THEN v ELSE 'https://' || v END)"
ORACLES["normalize_target"] = oracle(f"""SELECT site, path_prefix, {scheme(_NT)} || '://' || {netloc(_NT)} AS t_root,
  CASE WHEN {path(_NT)} IN ('', '/') THEN '' ELSE regexp_replace({path(_NT)}, '/+$', '') END AS t_prefix
  FROM (SELECT site, path_prefix, {strip('site || path_prefix')} AS v FROM targets)""")
_TP = (f"(CASE WHEN {path('c.final_url')} = '' THEN '/' WHEN {path('c.final_url')} <> '/' AND {path('c.final_url')} "
       f"LIKE '%/' THEN regexp_replace({path('c.final_url')}, '/+$', '') ELSE {path('c.final_url')} END)")
ORACLES["matches_prefix"] = oracle(f"""SELECT c.page_id, t.path_prefix, {bare(netloc('c.final_url'))} = {bare(netloc('t.root'))}
  AND (t.path_prefix = '' OR {_TP} = t.path_prefix OR starts_with({_TP}, t.path_prefix || '/')) AS matches
  FROM crawl c JOIN targets t ON t.site = c.site WHERE t.path_prefix <> ''""")
ORACLES["bare_host"] = oracle(f"SELECT page_id, {bare(netloc('url'))} AS host FROM crawl")
ORACLES["same_host"] = oracle(f"""SELECT page_id, {bare(netloc('url'))} = {bare(netloc("'https://www.' || site"))} AS same_www,
  {bare(netloc('url'))} = 'elsewhere.example' AS same_other FROM crawl""")
ORACLES["canonicalize_url"] = oracle(f"SELECT page_id, {curl('url')} AS key FROM crawl")
ORACLES["normalize_url"] = oracle(f"SELECT page_id, {nurl('url')} AS nkey FROM crawl")
ORACLES["resolve_url"] = oracle("""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS BIGINT) AS pos,
  href, absu AS resolved FROM lk2""")

# -------------------------------------------------------------- link graph
ORACLES["link_edges"] = oracle("SELECT site, src, src_order, pos, target, anchor FROM edges")
ORACLES["probe_targets"] = oracle("SELECT site, target, src_order, CAST(pos AS BIGINT) AS pos FROM selected")
ORACLES["link_status"] = oracle("SELECT site, url, status FROM lstat")
ORACLES["edge_status"] = oracle("SELECT site, src, pos, target, status FROM est")
ORACLES["orphan_urls"] = oracle("SELECT site, nkey FROM orph")

# -------------------------------------------------------------- checks, helpers
for key, cid in CHECK_KEYS.items():
    ORACLES[key] = oracle(f"SELECT {COLS} FROM check_results WHERE check_id = '{cid}'")
ORACLES["all_checks"] = oracle(f"SELECT {COLS} FROM check_results")
ORACLES["check_error_rows"] = oracle("SELECT site, check_id, kind, message FROM errs")
ORACLES["has_schema_type"] = oracle(f"SELECT site, page_id, {has_type_sql('faqpage')} AS has_faq, "
                                    f"{has_type_sql('organization')} AS has_org FROM px")
ORACLES["is_qa_content"] = oracle("SELECT site, page_id, qa FROM pf")
ORACLES["org_subtype"] = oracle(f"SELECT site, page_id, {ORG_TYPE} AS org_type FROM px")

# -------------------------------------------------------------- scoring
ORACLES["category_scores"] = oracle("SELECT site, category, cat_order, checks, passes, warns, fails, na_unv, "
                                    "score_tenths / 10.0 AS score FROM category_scores")
ORACLES["overall_score"] = oracle("SELECT site, overall_score FROM site_scores")
ORACLES["letter_grade"] = oracle("SELECT site, overall_score, letter_grade FROM site_scores")
ORACLES["severity_rank"] = oracle(f"SELECT site, check_id, severity, {SEV} AS severity_rank FROM check_results")
ORACLES["top_issue"] = oracle("SELECT site, top_issue_check_id FROM top")
ORACLES["site_scorecard"] = oracle("SELECT * FROM site_scores")

# -------------------------------------------------------------- views
ORACLES["priority_bucket"] = oracle(f"SELECT site, check_id, verdict, severity, {bucket()} AS bucket FROM check_results")
ORACLES["task_dimensions"] = oracle(f"""SELECT r.site, r.check_id, coalesce(td.owner, {q(S.DEFAULT_OWNER)}) AS owner,
  coalesce(td.effort, {q(S.DEFAULT_EFFORT)}) AS effort, coalesce(td.why, {q(S.DEFAULT_WHY)}) AS why
  FROM check_results r LEFT JOIN {_task_dim()} ON td.check_id = r.check_id""")
ORACLES["recommend_resource"] = oracle(f"""SELECT s.site, s.top_issue_check_id AS check_id, coalesce(x.url, '') AS resource_url,
  coalesce(x.blurb, {q('Follow the fix text of the check in the action list.')}) AS resource_blurb FROM site_scores s
  LEFT JOIN (SELECT check_id, min(evidence_url) AS url, count(*)::VARCHAR || ' site(s) pass this check.' AS blurb FROM check_results
             WHERE verdict = 'pass' AND evidence_url <> '' GROUP BY check_id) x ON x.check_id = s.top_issue_check_id
  WHERE s.top_issue_check_id <> ''""")
ORACLES["action_plan"] = oracle(f"""SELECT r.site, r.bucket, row_number() OVER (PARTITION BY r.site, r.bucket ORDER BY {SEV.replace('severity', 'r.severity')}, r.check_id) AS item_no,
  r.check_id, CASE WHEN r.fix_text <> '' THEN r.fix_text ELSE r.message END AS what,
  coalesce(td.owner, {q(S.DEFAULT_OWNER)}) AS owner, coalesce(td.effort, {q(S.DEFAULT_EFFORT)}) AS effort,
  coalesce(td.why, {q(S.DEFAULT_WHY)}) AS why,
  CASE WHEN r.pages_affected > 0 THEN CAST(r.pages_affected AS VARCHAR) || ' of ' ||
         CAST(CASE WHEN r.total_pages > 0 THEN r.total_pages ELSE coalesce(pc.n_pages, 0) END AS VARCHAR)
       WHEN r.total_pages > 0 OR r.message <> '' THEN 'site-wide' ELSE '' END AS pages_label
  FROM (SELECT *, {bucket()} AS bucket FROM check_results WHERE verdict NOT IN ('na', 'unverified')) r
  LEFT JOIN pc ON pc.site = r.site LEFT JOIN {_task_dim()} ON td.check_id = r.check_id
  WHERE r.bucket <> 'PASS'""")
ORACLES["already_good"] = oracle("SELECT site, check_order, check_id, name || ': ' || message AS line FROM check_results "
                                 "WHERE verdict = 'pass'")
ORACLES["scope_totals"] = oracle(f"""SELECT s.site, b.bucket, coalesce(t.tasks, 0) AS tasks FROM sites s
  CROSS JOIN (VALUES ('P1'), ('P2'), ('P3')) AS b(bucket)
  LEFT JOIN (SELECT site, {bucket()} AS bucket, count(*) AS tasks FROM check_results
             WHERE verdict NOT IN ('na', 'unverified') GROUP BY ALL) t ON t.site = s.site AND t.bucket = b.bucket""")
ORACLES["summary_categories"] = oracle(f"""SELECT site, category, cat_order,
  CASE WHEN score_tenths IS NULL THEN 'n/a' ELSE {fmt0('score_tenths / 10.0')} END AS score_text,
  CASE WHEN score_tenths IS NULL THEN 'no checks' ELSE {grade('score_tenths / 10.0')} END AS grade_text
  FROM category_scores""")
_TOP_ORDER = f"{SEV}, CASE WHEN verdict = 'fail' THEN 0 ELSE 1 END, -pages_affected, check_order"
ORACLES["top_actions"] = oracle(f"""SELECT site, rank, check_id, severity, category, name, pages_affected, fix FROM (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY {_TOP_ORDER}) AS rank,
    CASE WHEN fix_text <> '' THEN substr(fix_text, 1, 300) ELSE message END AS fix
  FROM check_results WHERE verdict IN ('fail', 'warn')) WHERE rank <= 5""")
ORACLES["action_list"] = oracle(f"""SELECT site, row_number() OVER (PARTITION BY site ORDER BY {SEV},
  CASE WHEN verdict = 'fail' THEN 0 WHEN verdict = 'warn' THEN 1 ELSE 2 END, check_id) AS position, check_id, category,
  severity, verdict, name || ': ' || message AS issue, pages_affected, fix_text FROM check_results WHERE verdict <> 'na'""")
ORACLES["page_schema_types"] = with_extra(SCHEMA_NODES, f"SELECT p.site, p.page_id, {SCHEMA_LABEL} AS schema_types FROM px p "
                                          "LEFT JOIN jtypes j ON j.site = p.site AND j.page_id = p.page_id")
ORACLES["page_issues"] = with_extra(PAGE_ISSUES, "SELECT site, page_id, page_url, issues, top_issue FROM pi")
ORACLES["page_detail"] = with_extra(PAGE_ISSUES + ",\n" + SCHEMA_NODES, f"""SELECT p.site, p.page_id, p.crawl_order, {PK.replace('final_url', 'p.final_url').replace(' url)', ' p.url)')} AS url,
  substr(p.title, 1, 120) AS title, p.status_code, p.render_ms, CASE WHEN p.canonical <> '' THEN 'yes' ELSE 'no' END AS has_canonical,
  p.og_title::INT + p.og_description::INT + p.og_image::INT + p.og_url::INT AS og_tags,
  {SCHEMA_LABEL} AS schema_types, pi.issues, pi.top_issue
  FROM px p JOIN pi ON pi.site = p.site AND pi.page_id = p.page_id LEFT JOIN jtypes j ON j.site = p.site AND j.page_id = p.page_id""")
ORACLES["score_breakdown"] = oracle(f"""SELECT site, CAST(cat_order AS BIGINT) AS row_no, category AS label,
  CAST(weight_pct AS VARCHAR) || '%' AS weight, checks, passes, warns, fails, na_unv,
  CASE WHEN score_tenths IS NULL THEN 'n/a' ELSE {fmt0('score_tenths / 10.0')} END AS score_text,
  CASE WHEN score_tenths IS NULL THEN 'excluded' ELSE printf('%.1f', round_even(score_tenths * weight_pct / 1000.0, 1)) END
    AS contribution FROM category_scores
  UNION ALL
  SELECT c.site, {len(S.CATEGORIES) + 1}, 'Overall (weighted)', '', NULL, NULL, NULL, NULL, NULL,
    {fmt0('s.overall_score')} || ' (' || s.letter_grade || ')',
    printf('%.1f', round_even(coalesce(sum(c.score_tenths * c.weight_pct) FILTER (c.score_tenths IS NOT NULL), 0) / 1000.0, 1))
  FROM category_scores c JOIN site_scores s ON s.site = c.site GROUP BY c.site, s.overall_score, s.letter_grade""")
ORACLES["report_bands"] = with_extra(PAGE_ISSUES, """SELECT site, 'verdict' AS kind, check_id AS item,
    CASE verdict WHEN 'pass' THEN 'pass' WHEN 'warn' THEN 'warn' WHEN 'fail' THEN 'fail' ELSE 'neutral' END AS band
  FROM check_results
  UNION ALL SELECT site, 'grade', letter_grade, CASE WHEN letter_grade IN ('A', 'B') THEN 'pass'
    WHEN letter_grade = 'C' THEN 'warn' ELSE 'fail' END FROM site_scores
  UNION ALL SELECT site, 'issues', page_url, CASE WHEN issues = 0 THEN 'pass' WHEN issues <= 3 THEN 'warn' ELSE 'fail' END
  FROM pi""")
ORACLES["audit_summary"] = oracle(f"""SELECT s.site, {fmt0('s.overall_score')} || '/100 (' || s.letter_grade || ')' AS score_text,
  b.category_bands, coalesce(r.name, '') AS top_issue_name, coalesce(r.message, '') AS top_issue_message
  FROM site_scores s
  LEFT JOIN check_results r ON r.site = s.site AND r.check_id = s.top_issue_check_id
  LEFT JOIN (SELECT site, string_agg(category || '=' || CASE WHEN score_tenths IS NULL THEN 'n/a'
      WHEN score_tenths >= 700 THEN 'good' WHEN score_tenths >= 550 THEN 'fair' ELSE 'poor' END, '; ' ORDER BY cat_order)
      AS category_bands FROM category_scores GROUP BY site) b ON b.site = s.site""")
ORACLES["open_issues"] = oracle(f"SELECT {COLS} FROM check_results WHERE verdict IN ('fail', 'warn', 'unverified')")
ORACLES["compare_sites"] = oracle("""SELECT p.site_a, p.site_b, ca.category, ca.cat_order, ca.score_tenths / 10.0 AS score_a,
    cb.score_tenths / 10.0 AS score_b, abs(ca.score_tenths - cb.score_tenths) / 10.0 AS score_gap,
    coalesce(g.gaps, '') AS largest_check_gaps
  FROM (SELECT site AS site_a, lead(site) OVER (ORDER BY site) AS site_b FROM sites) p
  JOIN category_scores ca ON ca.site = p.site_a JOIN category_scores cb ON cb.site = p.site_b AND cb.category = ca.category
  LEFT JOIN (SELECT site_a, site_b, string_agg(check_id, ',' ORDER BY rk) AS gaps FROM (
      SELECT p2.site_a, p2.site_b, ra.check_id, row_number() OVER (PARTITION BY p2.site_a, p2.site_b
        ORDER BY abs(ra.pts - rb.pts) DESC, ra.check_order) AS rk
      FROM (SELECT site AS site_a, lead(site) OVER (ORDER BY site) AS site_b FROM sites) p2
      JOIN (SELECT site, check_id, check_order, CASE verdict WHEN 'pass' THEN 2 WHEN 'warn' THEN 1 WHEN 'fail' THEN 0 END AS pts
            FROM check_results) ra ON ra.site = p2.site_a
      JOIN (SELECT site, check_id, CASE verdict WHEN 'pass' THEN 2 WHEN 'warn' THEN 1 WHEN 'fail' THEN 0 END AS pts
            FROM check_results) rb ON rb.site = p2.site_b AND rb.check_id = ra.check_id
      WHERE ra.pts IS NOT NULL AND rb.pts IS NOT NULL AND ra.pts <> rb.pts) WHERE rk <= 3 GROUP BY site_a, site_b) g
    ON g.site_a = p.site_a AND g.site_b = p.site_b
  WHERE p.site_b IS NOT NULL""")
ORACLES["report_id"] = oracle(f"""SELECT site, path_prefix, replace({netloc('root')}, ':', '-') ||
  CASE WHEN path_prefix <> '' THEN '_' || replace(regexp_replace(path_prefix, '^/+|/+$', '', 'g'), '/', '-') ELSE '' END
  || '-' || {q(AUDIT_DATE)} AS report_id FROM targets""")


# -------------------------------------------------------------- frontier
def _tpath(u):
    p = path(u)
    return (f"(CASE WHEN {p} = '' THEN '/' WHEN {p} <> '/' AND {p} LIKE '%/' THEN regexp_replace({p}, '/+$', '') "
            f"ELSE {p} END)")


def _mp(u, root, prefix):
    return (f"({bare(netloc(u))} = {bare(netloc(root))} AND ({prefix} = '' OR {_tpath(u)} = {prefix} "
            f"OR starts_with({_tpath(u)}, {prefix} || '/')))")


def _stage_sql(n, prev, cands, gate):
    """CTEs of stage n: candidates ``cands`` (site, path_prefix, url, o1, o2) appended to ``prev``."""
    return f"""c{n}k AS (SELECT c.*, {curl('c.url')} AS key FROM {cands} c
    JOIN ({gate}) g ON g.site = c.site AND g.path_prefix = c.path_prefix),
c{n}a AS (SELECT c.* FROM c{n}k c WHERE NOT EXISTS (SELECT 1 FROM {prev} p WHERE p.site = c.site
    AND p.path_prefix = c.path_prefix AND p.key = c.key)),
c{n}d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, path_prefix, key ORDER BY o1, o2) AS rk
    FROM c{n}a) WHERE rk = 1),
c{n}n AS (SELECT site, path_prefix, count(*) AS n_prev FROM {prev} GROUP BY ALL),
c{n}r AS (SELECT d.site, d.path_prefix, d.url, d.key, coalesce(n.n_prev, 0) AS n_prev, t.max_pages,
    row_number() OVER (PARTITION BY d.site, d.path_prefix ORDER BY d.o1, d.o2) AS r
    FROM c{n}d d JOIN targets t ON t.site = d.site AND t.path_prefix = d.path_prefix
    LEFT JOIN c{n}n n ON n.site = d.site AND n.path_prefix = d.path_prefix),
st{n} AS (SELECT * FROM {prev} UNION ALL SELECT site, path_prefix, url, key, CAST(n_prev + r - 1 AS BIGINT) AS pos,
    {n} AS stage FROM c{n}r WHERE r <= max_pages - n_prev)"""


def _gate(prev, cond):
    return (f"SELECT t.site, t.path_prefix, t.root, t.max_pages FROM targets t LEFT JOIN (SELECT site, path_prefix, "
            f"count(*) AS n FROM {prev} GROUP BY ALL) x ON x.site = t.site AND x.path_prefix = t.path_prefix "
            f"WHERE {cond.replace('@N', 'coalesce(x.n, 0)')}")


_SEED = "CASE WHEN path_prefix = '' THEN root ELSE root || path_prefix || '/' END"
_FR = HUB.replace("s.domain AS root", "'https://' || s.site AS root") + f""",
homeh0 AS (SELECT site, domain AS root, {strip(dec('a[i]'))} AS href, i
           FROM (SELECT *, unnest(generate_series(1, len(a))) AS i FROM (SELECT site, 'https://' || site AS domain, regexp_extract_all(h, {q(A_RE)}, 1) AS a FROM homes))),
homeh1 AS (SELECT site, root, CAST(row_number() OVER (PARTITION BY site ORDER BY i) - 1 AS BIGINT) AS lpos,
             split_part(CASE WHEN href LIKE 'http://%' OR href LIKE 'https://%' THEN href WHEN href LIKE '/%' THEN root || href
                        ELSE root || '/' || href END, '#', 1) AS link FROM homeh0 WHERE href <> '' AND NOT {SKIPPED}),
homeh AS (SELECT site, min(lpos) AS lpos, link FROM homeh1 WHERE {bare(netloc('link'))} = {bare(netloc('root'))} GROUP BY site, link),
fcache AS (SELECT site, {curl(PK)} AS fkey, arg_min(page_id, crawl_order) AS page_id FROM px WHERE status_code = 200
           GROUP BY ALL),
st0 AS (SELECT '' AS site, '' AS path_prefix, '' AS url, '' AS key, CAST(0 AS BIGINT) AS pos, 0 AS stage WHERE false),
fc1 AS (SELECT t.site, t.path_prefix, u.url, u.o1, u.o2 FROM targets t JOIN (
          SELECT site, path_prefix, {_SEED} AS url, 0 AS o1, CAST(0 AS BIGINT) AS o2 FROM targets
          UNION ALL SELECT r.site, t2.path_prefix, r.loc, 1, r.pos FROM sitemap_urls_raw r
            JOIN sites s ON s.site = r.site AND s.sitemap_status = 200 JOIN targets t2 ON t2.site = r.site) u
        ON u.site = t.site AND u.path_prefix = t.path_prefix
        WHERE {is_html('u.url')} AND {_mp('u.url', 't.root', 't.path_prefix')}),
{_stage_sql(1, 'st0', 'fc1', 'SELECT site, path_prefix FROM targets')},
fh2 AS (SELECT g.site, g.path_prefix, h.link AS url, 0 AS o1, h.lpos AS o2 FROM ({_gate('st1', '@N < t.max_pages')}) g
        JOIN fcache f ON f.site = g.site AND f.fkey = {curl(_SEED.replace('path_prefix', 'g.path_prefix').replace('root', 'g.root'))}
        JOIN hub h ON h.page_id = f.page_id
        WHERE {is_html('h.link')} AND {_mp('h.link', 'g.root', 'g.path_prefix')}
          AND NOT (g.path_prefix = '' AND EXISTS (SELECT 1 FROM homes x WHERE x.site = g.site))
        UNION ALL
        SELECT g.site, g.path_prefix, h.link, 0, h.lpos FROM ({_gate('st1', '@N < t.max_pages')}) g
        JOIN homeh h ON h.site = g.site WHERE g.path_prefix = '' AND {is_html('h.link')}),
{_stage_sql(2, 'st1', 'fh2', _gate('st1', '@N < t.max_pages'))},
fh3 AS (SELECT g.site, g.path_prefix, h.link AS url, s.pos AS o1, h.lpos AS o2
        FROM ({_gate('st2', '@N < greatest(3, floor(t.max_pages / 2))')}) g
        JOIN st2 s ON s.site = g.site AND s.path_prefix = g.path_prefix AND s.pos < 5
        JOIN fcache f ON f.site = g.site AND f.fkey = {curl('s.url')}
        JOIN hub h ON h.page_id = f.page_id
        WHERE {is_html('h.link')} AND {_mp('h.link', 'g.root', 'g.path_prefix')}),
{_stage_sql(3, 'st2', 'fh3', _gate('st2', '@N < greatest(3, floor(t.max_pages / 2))'))},
hubs4 AS (SELECT * FROM (SELECT s.*, t.root, row_number() OVER (PARTITION BY s.site, s.path_prefix ORDER BY s.pos) AS hr
          FROM st3 s JOIN targets t ON t.site = s.site AND t.path_prefix = s.path_prefix
          WHERE {_mp('s.url', 't.root', 't.path_prefix')}) WHERE hr <= 10),
fh4 AS (SELECT g.site, g.path_prefix, h.link AS url, s.pos AS o1, h.lpos AS o2
        FROM ({_gate('st3', "t.path_prefix <> '' AND @N < t.max_pages")}) g
        JOIN hubs4 s ON s.site = g.site AND s.path_prefix = g.path_prefix
        JOIN fcache f ON f.site = g.site AND f.fkey = {curl('s.url')}
        JOIN hub h ON h.page_id = f.page_id
        WHERE {is_html('h.link')} AND {bare(netloc('h.link'))} = {bare(netloc('g.root'))}),
{_stage_sql(4, 'st3', 'fh4', _gate('st3', "t.path_prefix <> '' AND @N < t.max_pages"))},
st5 AS (SELECT s.* FROM st4 s JOIN targets t ON t.site = s.site AND t.path_prefix = s.path_prefix WHERE s.pos < t.max_pages)"""
for _k, _n in (("frontier_seed", 1), ("frontier_hub", 2), ("frontier_depth2", 3), ("frontier_scoped", 4), ("frontier", 5)):
    ORACLES[_k] = with_extra(_FR, f"SELECT site, path_prefix, pos, url, stage FROM st{_n}")

# First <p> after the first <h1>: the paragraph runs until the next block start or an ancestor's
# end tag; its text nodes are stripped and joined by one space (get_text(" ", strip=True)).
_P_END = "(</p>|<p[ >]|<div|<h[1-6]|<ul|<ol|<nav|<footer|<header|<section|<article|<table|<form|<pre|<blockquote|<hr|<li|<tr>|<td>|</table>|</ul>|</article>|</div>|</section>|</body>|</html>|$)"
_FP_INNER = ("regexp_extract(regexp_replace(h, '<script[^>]*>.*?</script>', '', 'g'), "
             "'<h1[ >].*?<p>(.*?)" + _P_END + "', 1)")
ORACLES["x_first_paragraph"] = oracle(
    "SELECT site, page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(" + _FP_INNER +
    ", '<[^>]*>'), lambda x: " + strip(dec('x')) + "), lambda x: x <> ''), ' ') AS first_paragraph FROM pe")


# -------------------------------------------------------------- scoped audits
_SCOPED_BASE = f"""sc_t AS (SELECT site, root, path_prefix, site || path_prefix AS audit_id FROM targets WHERE path_prefix <> ''),
sc_key AS (SELECT * FROM (SELECT c.*, {curl(PK)} AS key,
             row_number() OVER (PARTITION BY site, {curl(PK)} ORDER BY crawl_order) AS rk FROM crawl c) WHERE rk = 1),
s_crawl AS (SELECT t.audit_id AS site, k.page_id, f.pos AS crawl_order, f.url, coalesce(k.final_url, '') AS final_url,
              coalesce(k.status_code, 0) AS status_code, coalesce(k.render_ms, 0) AS render_ms, k.html
            FROM st5 f JOIN sc_t t ON t.site = f.site AND t.path_prefix = f.path_prefix
            LEFT JOIN sc_key k ON k.site = f.site AND k.key = f.key),
s_sites AS (SELECT t.audit_id AS site, t.root || t.path_prefix AS domain, s.robots_status, s.robots_txt, s.hsts,
              s.sitemap_status, s.default_ua_len, s.googlebot_ua_len, t.path_prefix, s.sitemap_url
            FROM sites s JOIN sc_t t ON t.site = s.site),
s_sitemap_urls_raw AS (SELECT t.audit_id AS site, r.pos, r.loc FROM sitemap_urls_raw r JOIN sc_t t ON t.site = r.site),
s_probes AS (SELECT t.audit_id AS site, p.target, p.status FROM probes p JOIN sc_t t ON t.site = p.site),
s_rootp AS (SELECT t.audit_id AS site, t.root AS final_url, {LD_BLOCKS} AS blocks FROM homes p JOIN sc_t t ON t.site = p.site)"""
_SCOPED_ALL = _FR + ",\n" + _SCOPED_BASE + ",\n" + pipeline_renamed("s_")
_SC_COLS = ", ".join(("site AS audit_id" if c == "site" else c) for c in CHECK_COLS)
ORACLES["scoped_checks"] = with_extra(_SCOPED_ALL, f"SELECT {_SC_COLS} FROM s_check_results")
ORACLES["scoped_scorecard"] = with_extra(_SCOPED_ALL, "SELECT * EXCLUDE (site), site AS audit_id FROM s_site_scores")

# One JSON document per site (checks in registry order, open issues filtered)
_CHECK_STRUCT = ("{'check_order': check_order, 'check_id': check_id, 'category': category, 'severity': severity, "
                 "'verdict': verdict, 'name': name, 'message': message, 'pages_affected': pages_affected, "
                 "'fix_text': fix_text}")
ORACLES["audit_json"] = oracle(f"""SELECT s.site, to_json({{'site': s.site, 'overall_score': s.overall_score,
    'letter_grade': s.letter_grade, 'top_issue_check_id': s.top_issue_check_id, 'checks': c.checks,
    'open_issues': list_filter(c.checks, lambda x: x.verdict IN ('fail', 'warn', 'unverified'))}})::VARCHAR AS summary_json
  FROM site_scores s LEFT JOIN (SELECT site, list({_CHECK_STRUCT} ORDER BY check_order) AS checks
                                FROM check_results GROUP BY site) c ON c.site = s.site""")

# K1: every sheet of the report, a line of text for each row
ORACLES["write_report"] = "\nUNION ALL\n".join(
    f"SELECT '{view}' AS view, site, concat_ws('|', {', '.join(f'coalesce({c}::VARCHAR, {chr(39) * 2})' for c in columns)}) AS line "
    f"FROM ({ORACLES['audit_summary' if view == 'summary' else view]})" for view, columns in REPORT_COLUMNS.items())
