"""Scoped (path-prefix) audits: frontier pages, display domain, and the root homepage for C-15."""

from pyspark.sql import functions as F

from siteaudit.operators.frontier import frontier
from siteaudit.plans.audit import AuditInputs, audit
from siteaudit.plans.scoped import scoped_audit

CRAWL = "site string, page_id bigint, crawl_order bigint, url string, final_url string, status_code int, render_ms int, html string"
SITES = ("site string, domain string, robots_status int, robots_txt string, hsts string, sitemap_status int, "
         "default_ua_len bigint, googlebot_ua_len bigint")
ORG = ('<script type="application/ld+json">{"@type":"Organization","name":"n","url":"u","logo":"l",'
       '"sameAs":["s"]}</script>')


def _page(title, extra=""):
    return f"<html><head><title>{title}</title>{extra}</head><body><h1>{title}</h1><a href='/blog/a'>A</a></body></html>"


def test_scoped_audit_uses_root_homepage(spark):
    crawl = spark.createDataFrame([
        ("r.test", 1, 0, "https://r.test/", "https://r.test/", 200, 900, _page("Root page of the site")),
        ("r.test", 2, 1, "https://r.test/blog/a", "https://r.test/blog/a", 200, 900, _page("Blog article number A")),
        ("r.test", 3, 2, "https://r.test/blog/b", "https://r.test/blog/b", 200, 900, _page("Blog article number B")),
    ], CRAWL)
    sites = spark.createDataFrame([("r.test", "https://r.test", 200, "User-agent: *\nAllow: /\n", "", 200, 1, 1)], SITES)
    raw = spark.createDataFrame([("r.test", 0, "https://r.test/blog/a"), ("r.test", 1, "https://r.test/blog/b"),
                                 ("r.test", 2, "https://r.test/about")], "site string, pos bigint, loc string")
    probes = spark.createDataFrame([], "site string, target string, status int")
    homepages = spark.createDataFrame([("r.test", _page("Fetched apart", ORG))], "site string, html string")
    whole = audit(AuditInputs(crawl=crawl, sites=sites, sitemap_urls_raw=raw, probes=probes, homepages=homepages))
    assert whole.pages.count() == 3 and whole.homes.first().title == "Fetched apart"
    targets = spark.createDataFrame([("r.test", "https://r.test", "", 20), ("r.test", "https://r.test", "/blog", 20)],
                                    "site string, root string, path_prefix string, max_pages int")
    sc = scoped_audit(targets, crawl, sites, raw, probes, whole.pages, whole.sitemap_urls, homes=whole.homes)
    rows = {r.check_id: r for r in sc.check_results.collect()}
    assert {r.site for r in sc.check_results.collect()} == {"r.test/blog"}
    c15 = rows["C-15"]
    assert (c15.verdict, c15.evidence_url) == ("pass", "https://r.test")
    # C-03 counts only the in-prefix sitemap URLs; the evidence is the root's sitemap
    assert rows["C-03"].verdict == "pass" and "2 URLs" in rows["C-03"].message
    assert rows["C-03"].evidence_url == "https://r.test/sitemap.xml"
    assert rows["C-01"].evidence_url == "https://r.test/blog/robots.txt"
    # scoped pages are the frontier: seed (not crawled, so a page with status 0) + the two in-prefix sitemap URLs
    got = sc.pages.filter(F.col("site") == "r.test/blog").orderBy("crawl_order").collect()
    assert [(r.url, r.status_code, len(r.h1_texts)) for r in got] == [
        ("https://r.test/blog/", 0, 0), ("https://r.test/blog/a", 200, 1), ("https://r.test/blog/b", 200, 1)]
    assert (got[0].title, got[0].raw_links, got[0].og, got[0].schema_raw_count) == ("", [], {}, 0)


def test_hub_links_come_from_the_homepage_that_was_fetched_apart(spark):
    crawl = spark.createDataFrame([("r.test", 1, 0, "https://r.test", "https://r.test", 200, 900, _page("Root")),
                                   ("q.test", 2, 0, "https://q.test", "https://q.test", 200, 900, _page("Root"))], CRAWL)
    sites = spark.createDataFrame([(s, f"https://{s}", 404, "", "", 0, 1, 1) for s in ("r.test", "q.test")], SITES)
    none = spark.createDataFrame([], "site string, pos bigint, loc string")
    homepages = spark.createDataFrame([("r.test", "<a href='/new'>n</a><a href='deep/x#y'>x</a><a href='/new'>again</a>")],
                                      "site string, html string")
    t = audit(AuditInputs(crawl=crawl, sites=sites, sitemap_urls_raw=none, homepages=homepages,
                          probes=spark.createDataFrame([], "site string, target string, status int")))
    targets = spark.createDataFrame([(s, f"https://{s}", "", 20) for s in ("r.test", "q.test")],
                                    "site string, root string, path_prefix string, max_pages int")
    got = frontier(targets, none, t.pages, upto=2, homes=t.homes).orderBy("site", "pos").collect()
    assert [(r.url, r.stage) for r in got] == [("https://q.test", 1), ("https://q.test/blog/a", 2), ("https://r.test", 1),
                                               ("https://r.test/new", 2), ("https://r.test/deep/x", 2)]


def test_frontier_fills_a_budget_above_100(spark):
    crawl = spark.createDataFrame([("r.test", 1, 0, "https://r.test/", "https://r.test/", 200, 900, _page("Root page of the site"))], CRAWL)
    sites = spark.createDataFrame([("r.test", "https://r.test", 200, "", "", 200, 1, 1)], SITES)
    raw = spark.createDataFrame([("r.test", i, f"https://r.test/p{i}") for i in range(400)], "site string, pos bigint, loc string")
    pages = audit(AuditInputs(crawl=crawl, sites=sites, sitemap_urls_raw=raw,
                              probes=spark.createDataFrame([], "site string, target string, status int"))).pages
    targets = spark.createDataFrame([("r.test", "https://r.test", "", 300), ("s.test", "https://s.test", "", 20)],
                                    "site string, root string, path_prefix string, max_pages int")
    got = frontier(targets, raw, pages).filter("site = 'r.test'").orderBy("pos").collect()
    assert [r.url for r in got] == ["https://r.test"] + [f"https://r.test/p{i}" for i in range(299)]
    assert [r.pos for r in got] == list(range(300))
