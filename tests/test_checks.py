"""Check branches the driver data does not reach, on a small literal snapshot, plus invariants."""

import pytest
from pyspark.sql import functions as F

from siteaudit.plans.audit import AuditInputs, audit

CRAWL = "site string, page_id bigint, crawl_order bigint, url string, final_url string, status_code int, render_ms int, html string"
SITES = ("site string, domain string, robots_status int, robots_txt string, hsts string, sitemap_status int, "
         "default_ua_len bigint, googlebot_ua_len bigint")


def _page_a(i):
    links = "".join(f'<a href="/p{j}">click here</a><a href="/t{j}">Topic number {j}</a>' for j in range(3))
    return (f'<html lang="en-GB"><head><title>Title for page number {i:02d}</title>'
            f'<meta property="og:title" content="t"></head><body><h1>Heading {i}</h1>{links}</body></html>')


@pytest.fixture(scope="module")
def tables(spark):
    crawl = [("a.test", i, i, f"https://a.test/p{i}", f"https://a.test/p{i}", 200, 1500 + 100 * i, _page_a(i))
             for i in range(4)]
    crawl += [("b.test", 10 + i, i, f"https://b.test/x{i}", f"https://b.test/x{i}", 0, 0, None) for i in range(3)]
    sites = [("a.test", "https://a.test", 200, "User-agent: GPTBot\nDisallow: /\n", "max-age=15552000", 404, 10, 10),
             ("b.test", "https://b.test", 404, "", "", 404, 10, 0),
             ("c.test", "https://c.test", 403, "", "max-age=1", 200, 0, 0)]
    inp = AuditInputs(
        crawl=spark.createDataFrame(crawl, CRAWL), sites=spark.createDataFrame(sites, SITES),
        sitemap_urls_raw=spark.createDataFrame([("c.test", 0, "https://c.test/a.pdf")], "site string, pos bigint, loc string"),
        probes=spark.createDataFrame([], "site string, target string, status int"))
    t = audit(inp)
    rows = {(r.site, r.check_id): r for r in t.check_results.collect()}
    return t, rows


def v(rows, site, cid):
    r = rows[(site, cid)]
    return r.verdict, r.severity


def test_fifteen_rows_per_site_even_without_pages(tables):
    t, rows = tables
    counts = {r.site: r.n for r in t.check_results.groupBy("site").agg(F.count("*").alias("n")).collect()}
    assert counts == {"a.test": 15, "b.test": 15, "c.test": 15}


def test_og_fail_branch(tables):
    _, rows = tables
    assert v(rows, "a.test", "C-06") == ("fail", "P1")
    assert rows[("a.test", "C-06")].pages_affected == 4


def test_anchor_fail_branch(tables):
    _, rows = tables
    assert v(rows, "a.test", "C-23") == ("fail", "P1")
    assert "50.0%" in rows[("a.test", "C-23")].message
    assert rows[("a.test", "C-23")].pages_affected == 2   # distinct sources of the first 5 generic links


def test_robots_explicit_block_and_hsts_boundary(tables):
    _, rows = tables
    assert v(rows, "a.test", "C-02") == ("fail", "P0")
    assert v(rows, "a.test", "C-19") == ("pass", "P2")       # exactly 180 days
    assert v(rows, "c.test", "C-19") == ("warn", "P2")
    assert v(rows, "c.test", "C-01") == ("fail", "P0")       # 403
    assert v(rows, "b.test", "C-01") == ("warn", "P2")       # 404


def test_median_render_time(tables):
    _, rows = tables
    # 1500,1600,1700,1800 -> median 1650 -> pass
    assert v(rows, "a.test", "C-04") == ("pass", "P2")
    assert "1650 ms" in rows[("a.test", "C-04")].message


def test_no_valid_pages_and_no_statuses(tables):
    _, rows = tables
    for cid in ("C-05", "C-06", "C-09", "C-10", "C-11", "C-13"):
        assert v(rows, "b.test", cid) == ("unverified", "P1")
    assert v(rows, "b.test", "C-22") == ("na", "INFO")
    assert v(rows, "b.test", "C-04") == ("unverified", "P2")
    assert v(rows, "c.test", "C-15") == ("unverified", "P0")


def test_sitemap_of_only_pdfs_is_warn_and_orphans_na(tables):
    _, rows = tables
    assert v(rows, "c.test", "C-03") == ("warn", "P1")        # 200 but no HTML URLs (T14)
    assert v(rows, "c.test", "C-24") == ("na", "INFO")
    assert v(rows, "b.test", "C-03") == ("warn", "P2")        # small site without sitemap


def test_scores_bounded_and_na_excluded(tables):
    t, _ = tables
    for r in t.category_scores.collect():
        if r.score_tenths is not None:
            assert 0 <= r.score_tenths <= 1000
        if r.passes + r.warns + r.fails == 0:
            assert r.score_tenths is None
    for r in t.site_scores.collect():
        assert 0.0 <= r.overall_score <= 100.0


def test_result_independent_of_shuffle_partitions(spark):
    from siteaudit.plans.audit import fixture_inputs
    sf = "/root/testdata/sf0.001"
    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("3", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            t = audit(fixture_inputs(spark, sf))
            out.append(sorted(tuple(r) for r in t.check_results.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]
