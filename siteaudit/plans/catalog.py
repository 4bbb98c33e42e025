"""Every operator of the audit as a named query over a snapshot directory.

``QUERIES[name](spark, sf_dir) -> DataFrame``. All of them read the snapshot
derived from the driver's tables (``sources.fixtures.snapshot``) and the
audit built on it (``plans.audit.audit_fixture``), over all rows.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit import schema as S
from siteaudit.functions import urls as U
from siteaudit.operators import checks as C
from siteaudit.operators import frontier as FR
from siteaudit.operators import links as L
from siteaudit.operators import scoring as A
from siteaudit.plans import report as V
from siteaudit.plans import sink
from siteaudit.plans.audit import FIXTURE_DATE, audit_fixture, filter_sitemap_urls, fixture_context, fixture_pages
from siteaudit.session import checkpoint_dir
from siteaudit.sources import fixtures as fx
from siteaudit.sources import sitemaps as SM
from siteaudit.sources.context import fetched_via, latest, lower_headers, site_fetches

AUDIT_DATE = FIXTURE_DATE   # audit parameter: the snapshot's date

CHECK_COLS = ["site", "check_order", "check_id", "category", "name", "verdict", "severity", "message", "fix_text",
              "evidence_url", "evidence_snippet", "pages_affected", "total_pages"]

CHECK_KEYS = {
    "c01_robots": "C-01", "c02_ai_bots": "C-02", "c03_sitemap": "C-03", "c04_render_time": "C-04",
    "c05_canonical": "C-05", "c06_og": "C-06", "c09_meta_description": "C-09", "c10_title_length": "C-10",
    "c11_h1": "C-11", "c13_faq_schema": "C-13", "c15_org_schema": "C-15", "c19_hsts": "C-19",
    "c22_broken_links": "C-22", "c23_anchor_text": "C-23", "c24_orphans": "C-24",
}


def _a(spark, sf):
    return audit_fixture(spark, sf)


def _s(spark, sf):
    """Raw tables of the snapshot, and what the audit takes from them as of its date."""
    found = fixture_context(spark, sf)
    return fx.snapshot(spark, sf) | {"sites": found.sites, "sitemap_urls_raw": found.sitemap_urls_raw}


def _results(spark, sf):
    return _a(spark, sf).check_results


def _n_pages(spark, sf):
    return _a(spark, sf).pages.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"))


def _files(spark, sf):
    return latest(_s(spark, sf)["sitemap_files"], ["site", "sitemap_url"], "body", FIXTURE_DATE)


def _files_with_root(spark, sf):
    return _files(spark, sf).join(_s(spark, sf)["site_list"].select("site", F.col("domain").alias("root")), "site")


def _robots(spark, sf):
    return SM.robots_source(latest(_s(spark, sf)["robots"], ["site"], "body", FIXTURE_DATE))


def _sites_robots(spark, sf):
    return _s(spark, sf)["site_list"].join(_robots(spark, sf), "site", "left")


# ---------------------------------------------------------------- sources
def scan_crawl(spark, sf):
    c = _s(spark, sf)["crawl"]
    return c.select("site", "page_id", "crawl_order", "url", "final_url", "status_code", "render_ms",
                    F.length("html").cast("bigint").alias("html_chars"))


def page_head(spark, sf):
    c = _s(spark, sf)["crawl"].withColumn("h", lower_headers("headers"))
    shown = F.transform(F.array_sort(F.map_entries("h")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return c.select("site", "page_id", "final_url", "status_code", "render_ms", fetched_via("ua").alias("fetched_via"),
                    F.array_join(shown, "; ").alias("headers"), F.coalesce(F.col("h")["content-type"], F.lit("")).alias("content_type"),
                    ((F.col("status_code") > 0) & (F.col("status_code") < 400)).alias("parsed"))


def robots_source(spark, sf):
    return _robots(spark, sf)


def sitemap_parse(spark, sf):
    f = SM.parse_files(_files_with_root(spark, sf))
    return f.select("site", "sitemap_url", F.posexplode("locs").alias("pos", "loc")) \
        .select("site", "sitemap_url", F.col("pos").cast("bigint").alias("pos"), "loc")


def sitemap_is_index(spark, sf):
    f = SM.parse_files(_files_with_root(spark, sf))
    return f.select("site", "sitemap_url", SM.is_sitemap_index("locs").alias("is_index"),
                    F.size("locs").cast("bigint").alias("n_locs"))


def sitemap_flatten(spark, sf):
    parsed = SM.parsed_files(_files(spark, sf)).checkpoint(eager=True)
    flat = SM.flatten_index(SM.index_starts(SM.candidate_files(_sites_robots(spark, sf), parsed)), parsed)
    return flat.select("site", F.col("cand_pos").cast("bigint").alias("cand_pos"), "seq", "loc")


def sitemap_candidates(spark, sf):
    c = SM.sitemap_candidates(_sites_robots(spark, sf))
    return c.select("site", F.col("cand_pos").cast("bigint").alias("cand_pos"), "candidate", "cand_url")


def sitemap_choice(spark, sf):
    choice, _ = SM.choose_sitemap(_sites_robots(spark, sf), _files(spark, sf))
    return choice.select("site", "sitemap_url", "sitemap_status", F.col("n_urls").cast("bigint").alias("n_urls"))


def sitemap_filter(spark, sf):
    snap = _s(spark, sf)
    t = snap["targets"].select("site", "root", "path_prefix")
    live = snap["sites"].filter(F.col("sitemap_status") == 200).select("site")
    j = snap["sitemap_urls_raw"].join(live, "site").join(t, "site")
    keep = U.is_html_url("loc") & ((F.col("path_prefix") == "") | U.matches_prefix("loc", "root", "path_prefix"))
    return j.filter(keep).select("site", "path_prefix", "pos", "loc")


def sitemap_gz(spark, sf):
    """Sitemap files as compressed bytes in storage, inflated; streams that end early are error rows."""
    path = os.path.join(checkpoint_dir(spark), "sitemap-gz-" + uuid.uuid4().hex)
    fx.with_content(_files(spark, sf)).select("site", "sitemap_url", "content").write.parquet(path)
    return SM.inflated_bodies(spark.read.parquet(path)).select("site", "sitemap_url", "body", "error")


def spa_detect(spark, sf):
    return SM.spa_detect(site_fetches(_s(spark, sf)["sites"]))


def root_page(spark, sf):
    """For scoped targets, the site's homepage parsed as a successful fetch (when the snapshot has it)."""
    from siteaudit.plans.scoped import root_pages
    t = _s(spark, sf)["targets"]
    rp = root_pages(t, _homes(spark, sf)).select(
        F.col("site").alias("audit_id"), F.col("status_code").alias("root_status"),
        F.size("schema_blocks").cast("bigint").alias("root_blocks"))
    scoped = t.filter(F.col("path_prefix") != "").select("site", "path_prefix",
                                                         F.concat("site", "path_prefix").alias("audit_id"))
    return scoped.join(rp, "audit_id", "left").select("site", "path_prefix", "root_status", "root_blocks")


# -------------------------------------------------------------- extraction
def _pages(spark, sf):
    return fixture_pages(spark, sf)[0]


def _homes(spark, sf):
    return fixture_pages(spark, sf)[1]


def _x(col_exprs):
    def run(spark, sf):
        return _pages(spark, sf).select("site", "page_id", *col_exprs())
    return run


def x_jsonld(spark, sf):
    p = _pages(spark, sf).select("site", "page_id", F.posexplode("schema_blocks").alias("pos", "block"))
    types = F.expr(f"array_join({C._types('v')}, ',')")
    err = F.coalesce(F.expr("try_variant_get(v, '$.__parse_error', 'boolean')"), F.lit(False))
    return p.withColumn("v", F.expr("try_parse_json(block)")).select(
        "site", "page_id", F.col("pos").cast("bigint").alias("pos"), types.alias("types"), err.alias("is_parse_error"))


def x_og(spark, sf):
    """A row for each Open Graph property of a page."""
    return _pages(spark, sf).select("site", "page_id", F.explode("og").alias("property", "content"))


def x_hreflang(spark, sf):
    p = _pages(spark, sf).select("site", "page_id", F.posexplode("hreflang").alias("pos", "h"))
    return p.select("site", "page_id", F.col("pos").cast("bigint").alias("pos"), "h.lang", "h.href")


def x_internal_links(spark, sf):
    p = _pages(spark, sf).select("site", "page_id", F.inline("internal_links"))
    return p.select("site", "page_id", F.col("pos").cast("bigint").alias("pos"), "target", "anchor")


def x_hub_links(spark, sf):
    snap = _s(spark, sf)
    p = _pages(spark, sf).filter(F.col("status_code") == 200).select("site", "page_id", "raw_links") \
        .join(snap["sites"].select("site", F.col("domain").alias("root")), "site")
    h = FR.hub_links(p)
    return h.select("site", "page_id", F.col("lpos").cast("bigint").alias("lpos"), "link")


def languages_seen(spark, sf):
    p = _pages(spark, sf).filter(F.col("html_lang") != "")
    lang = F.lower(F.split("html_lang", "-", 2).getItem(0))
    # bounded: one entry per language code, partial-aggregated per site
    return p.groupBy("site").agg(F.array_join(F.array_sort(F.collect_set(lang)), ",").alias("languages"))


# -------------------------------------------------------------- url functions
def is_html_url_q(spark, sf):
    a = _a(spark, sf)
    urls = a.edges.select(F.col("target").alias("url")).unionByName(
        _s(spark, sf)["sitemap_urls_raw"].select(F.col("loc").alias("url"))).distinct()
    return urls.select("url", U.is_html_url("url").alias("is_html"))


def normalize_domain_q(spark, sf):
    return _s(spark, sf)["crawl"].select("page_id", U.normalize_domain("url").alias("domain"))


def normalize_target_q(spark, sf):
    t = _s(spark, sf)["targets"].select("site", "path_prefix", F.concat("site", "path_prefix").alias("target"))
    n = U.normalize_target("target")
    return t.select("site", "path_prefix", n["root"].alias("t_root"), n["prefix"].alias("t_prefix"))


def matches_prefix_q(spark, sf):
    snap = _s(spark, sf)
    t = snap["targets"].filter(F.col("path_prefix") != "").select("site", "root", "path_prefix")
    c = snap["crawl"].select("site", "page_id", "final_url").join(t, "site")
    return c.select("page_id", "path_prefix", U.matches_prefix("final_url", "root", "path_prefix").alias("matches"))


def bare_host_q(spark, sf):
    return _s(spark, sf)["crawl"].select("page_id", U.bare_host(U.url_netloc("url")).alias("host"))


def same_host_q(spark, sf):
    c = _s(spark, sf)["crawl"]
    return c.select("page_id", U.same_host("url", F.concat(F.lit("https://www."), F.col("site"))).alias("same_www"),
                    U.same_host("url", F.lit("https://elsewhere.example")).alias("same_other"))


def canonicalize_url_q(spark, sf):
    return _s(spark, sf)["crawl"].select("page_id", U.canonicalize_url("url").alias("key"))


def normalize_url_q(spark, sf):
    return _s(spark, sf)["crawl"].select("page_id", U.normalize_url("url").alias("nkey"))


def resolve_url_q(spark, sf):
    p = _pages(spark, sf).select("page_id", F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")).alias("base"),
                                 F.inline("raw_links"))
    return p.select("page_id", F.col("pos").cast("bigint").alias("pos"), "href",
                    U.resolve_url("base", "href").alias("resolved"))


# -------------------------------------------------------------- link graph
def link_edges(spark, sf):
    return _a(spark, sf).edges


def probe_targets(spark, sf):
    return _a(spark, sf).probe_targets.select("site", "target", "src_order", F.col("pos").cast("bigint").alias("pos"))


def link_status(spark, sf):
    return _a(spark, sf).link_status


def edge_status(spark, sf):
    return _a(spark, sf).edge_status.select("site", "src", "pos", "target", "status")


def orphan_urls(spark, sf):
    a = _a(spark, sf)
    return L.orphan_urls(a.sitemap_urls, a.edges, a.pages)


# -------------------------------------------------------------- checks, helpers
def _check(cid):
    def run(spark, sf):
        return _results(spark, sf).filter(F.col("check_id") == cid).select(*CHECK_COLS)
    return run


def all_checks(spark, sf):
    return _results(spark, sf).select(*CHECK_COLS)


def check_error_rows(spark, sf):
    return C.error_rows(_a(spark, sf).facts)


def has_schema_type(spark, sf):
    return _pages(spark, sf).select("site", "page_id", C.has_schema_type("FAQPage").alias("has_faq"),
                                    C.has_schema_type("Organization").alias("has_org"))


def is_qa_content(spark, sf):
    return _pages(spark, sf).select("site", "page_id", C.is_qa_content().alias("qa"))


def org_subtype(spark, sf):
    return _pages(spark, sf).select("site", "page_id", C.org_subtype().alias("org_type"))


# -------------------------------------------------------------- scoring
def category_scores(spark, sf):
    return _a(spark, sf).category_scores.select(
        "site", "category", "cat_order", "checks", "passes", "warns", "fails", "na_unv",
        (F.col("score_tenths") / 10.0).alias("score"))


def overall_score(spark, sf):
    return _a(spark, sf).site_scores.select("site", "overall_score")


def letter_grade(spark, sf):
    return _a(spark, sf).site_scores.select("site", "overall_score", A.letter_grade("overall_score").alias("letter_grade"))


def severity_rank(spark, sf):
    return _results(spark, sf).select("site", "check_id", "severity", A.severity_rank("severity").alias("severity_rank"))


def top_issue(spark, sf):
    return A.top_issues(_results(spark, sf))


def site_scorecard(spark, sf):
    return _a(spark, sf).site_scores


# -------------------------------------------------------------- views
def priority_bucket(spark, sf):
    return _results(spark, sf).select("site", "check_id", "verdict", "severity", V.priority_bucket().alias("bucket"))


def task_dimensions(spark, sf):
    return V.task_dimensions(_results(spark, sf))


def recommend_resource(spark, sf):
    """Resources are the first page that passes a check, as an example to follow."""
    a = _a(spark, sf)
    passed = a.check_results.filter((F.col("verdict") == "pass") & (F.col("evidence_url") != ""))
    resources = passed.groupBy("check_id").agg(F.min("evidence_url").alias("url"), F.concat(
        F.count(F.lit(1)).cast("string"), F.lit(" site(s) pass this check.")).alias("blurb"))
    return V.recommend_resource(a.site_scores, resources)


def action_plan(spark, sf):
    return V.action_plan(_results(spark, sf), _n_pages(spark, sf))


def already_good(spark, sf):
    return V.already_good(_results(spark, sf))


def scope_totals(spark, sf):
    a = _a(spark, sf)
    return V.scope_totals(a.check_results, a.sites)


def summary_categories(spark, sf):
    return V.summary_categories(_a(spark, sf).category_scores)


def top_actions(spark, sf):
    return V.top_actions(_results(spark, sf))


def action_list(spark, sf):
    return V.action_list(_results(spark, sf))


def page_detail(spark, sf):
    a = _a(spark, sf)
    return V.page_detail(a.pages, a.check_results)


def page_schema_types(spark, sf):
    return V.page_schema_types(_pages(spark, sf))


def page_issues(spark, sf):
    a = _a(spark, sf)
    return V.page_issues(a.pages, a.check_results)


def score_breakdown(spark, sf):
    a = _a(spark, sf)
    return V.score_breakdown(a.category_scores, a.site_scores)


def report_bands(spark, sf):
    a = _a(spark, sf)
    return V.report_bands(a.check_results, a.site_scores, V.page_issues(a.pages, a.check_results))


def audit_summary(spark, sf):
    a = _a(spark, sf)
    return V.audit_summary(a.site_scores, a.check_results, a.category_scores)


def audit_json(spark, sf):
    a = _a(spark, sf)
    return V.audit_json(a.site_scores, a.check_results)


def open_issues(spark, sf):
    return V.open_issues(_results(spark, sf)).select(*CHECK_COLS)


def compare_sites(spark, sf):
    a = _a(spark, sf)
    return V.compare_sites(a.category_scores, a.check_results, V.successor_pairs(a.sites))


#: The sheets of a report, and the columns of each in the order of the read-back query.
REPORT_COLUMNS = {
    "action_plan": ["bucket", "item_no", "check_id", "what", "owner", "effort", "why", "pages_label"],
    "summary": ["score_text", "category_bands", "top_issue_name", "top_issue_message"],
    "action_list": ["position", "check_id", "category", "severity", "verdict", "issue", "pages_affected", "fix_text"],
    "page_detail": ["page_id", "crawl_order", "url", "title", "status_code", "render_ms", "has_canonical", "og_tags", "schema_types",
                    "issues", "top_issue"],
    "score_breakdown": ["row_no", "label", "weight", "checks", "passes", "warns", "fails", "na_unv", "score_text", "contribution"]}


def write_report(spark, sf):
    """All sheets written and committed together, then read back through the manifest, one line of text for each row."""
    base = os.path.join(checkpoint_dir(spark), "reports-" + uuid.uuid4().hex)
    views = {"action_plan": action_plan, "summary": audit_summary, "action_list": action_list, "page_detail": page_detail,
             "score_breakdown": score_breakdown}
    sink.write_report({name: view(spark, sf) for name, view in views.items()}, base, AUDIT_DATE)
    out = None
    for name, df in sink.read_report(spark, base, AUDIT_DATE).items():
        line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in REPORT_COLUMNS[name]])
        part = df.select(F.lit(name).alias("view"), "site", line.alias("line"))
        out = part if out is None else out.unionByName(part)
    return out


def report_id(spark, sf):
    t = _s(spark, sf)["targets"]
    return t.select("site", "path_prefix", V.report_id("root", "path_prefix", F.lit(AUDIT_DATE)).alias("report_id"))


# -------------------------------------------------------------- scoped audits
_SCOPED: dict = {}


def _scoped(spark, sf):
    from siteaudit.plans.scoped import scoped_audit
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SCOPED:
        snap, a = _s(spark, sf), _a(spark, sf)
        _SCOPED[key] = scoped_audit(snap["targets"], snap["crawl"], snap["sites"], snap["sitemap_urls_raw"],
                                    snap["probes"], a.pages, a.sitemap_urls, _final_frontier(spark, sf), a.homes)
    return _SCOPED[key]


def scoped_checks(spark, sf):
    """Check rows of every path-scoped audit target (site = site + path prefix)."""
    return _scoped(spark, sf).check_results.select(*CHECK_COLS).withColumnRenamed("site", "audit_id")


def scoped_scorecard(spark, sf):
    return _scoped(spark, sf).site_scores.withColumnRenamed("site", "audit_id")


# -------------------------------------------------------------- frontier
_FRONTIERS: dict = {}


def _planned(spark, sf, upto):
    snap = _s(spark, sf)
    urls = filter_sitemap_urls(snap["sitemap_urls_raw"], snap["sites"])
    return FR.frontier(snap["targets"], urls, _pages(spark, sf), upto=upto, homes=_homes(spark, sf))


def _final_frontier(spark, sf):
    """F5 frontier of all targets, computed once per session (its stages are checkpointed)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FRONTIERS:
        _FRONTIERS[key] = _planned(spark, sf, 5)
    return _FRONTIERS[key]


def _frontier(upto):
    def run(spark, sf):
        fr = _final_frontier(spark, sf) if upto == 5 else _planned(spark, sf, upto)
        return fr.select("site", "path_prefix", "pos", "url", "stage")
    return run


QUERIES = {
    "scan_crawl": scan_crawl, "page_head": page_head, "robots_source": robots_source,
    "sitemap_parse": sitemap_parse, "sitemap_is_index": sitemap_is_index, "sitemap_flatten": sitemap_flatten,
    "sitemap_candidates": sitemap_candidates, "sitemap_choice": sitemap_choice, "sitemap_filter": sitemap_filter,
    "sitemap_gz": sitemap_gz, "spa_detect": spa_detect, "root_page": root_page,
    "x_title": _x(lambda: [F.col("title")]),
    "x_meta_description": _x(lambda: [F.col("meta_description")]),
    "x_lang": _x(lambda: [F.col("html_lang")]),
    "x_h1": _x(lambda: [F.size("h1_texts").cast("bigint").alias("n_h1"), F.array_join("h1_texts", " | ").alias("h1")]),
    "x_h2": _x(lambda: [F.size("h2_texts").cast("bigint").alias("n_h2"), F.array_join("h2_texts", " | ").alias("h2")]),
    "x_canonical": _x(lambda: [F.col("canonical")]),
    "x_og": x_og, "x_hreflang": x_hreflang,
    "x_jsonld": x_jsonld,
    "x_jsonld_count": _x(lambda: [F.col("schema_raw_count").cast("bigint").alias("schema_raw_count")]),
    "x_img_alt": _x(lambda: [F.col("image_alt_total").cast("bigint").alias("image_alt_total"),
                             F.col("image_alt_missing").cast("bigint").alias("image_alt_missing")]),
    "x_first_paragraph": _x(lambda: [F.col("first_paragraph")]),
    "x_internal_links": x_internal_links, "x_hub_links": x_hub_links, "languages_seen": languages_seen,
    "is_html_url": is_html_url_q, "normalize_domain": normalize_domain_q, "normalize_target": normalize_target_q,
    "matches_prefix": matches_prefix_q, "bare_host": bare_host_q, "same_host": same_host_q,
    "canonicalize_url": canonicalize_url_q, "normalize_url": normalize_url_q, "resolve_url": resolve_url_q,
    "frontier_seed": _frontier(1), "frontier_hub": _frontier(2), "frontier_depth2": _frontier(3),
    "frontier_scoped": _frontier(4), "frontier": _frontier(5),
    "link_edges": link_edges, "probe_targets": probe_targets, "link_status": link_status,
    "edge_status": edge_status, "orphan_urls": orphan_urls,
    **{k: _check(cid) for k, cid in CHECK_KEYS.items()},
    "all_checks": all_checks, "check_error_rows": check_error_rows, "has_schema_type": has_schema_type,
    "is_qa_content": is_qa_content, "org_subtype": org_subtype,
    "category_scores": category_scores, "overall_score": overall_score, "letter_grade": letter_grade,
    "severity_rank": severity_rank, "top_issue": top_issue, "site_scorecard": site_scorecard,
    "priority_bucket": priority_bucket, "task_dimensions": task_dimensions, "recommend_resource": recommend_resource,
    "action_plan": action_plan, "already_good": already_good, "scope_totals": scope_totals,
    "summary_categories": summary_categories, "top_actions": top_actions, "action_list": action_list,
    "page_detail": page_detail, "page_schema_types": page_schema_types, "page_issues": page_issues,
    "score_breakdown": score_breakdown, "report_bands": report_bands, "audit_summary": audit_summary,
    "audit_json": audit_json, "open_issues": open_issues, "compare_sites": compare_sites,
    "write_report": write_report, "report_id": report_id,
    "scoped_checks": scoped_checks, "scoped_scorecard": scoped_scorecard,
}
