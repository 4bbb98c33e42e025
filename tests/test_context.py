"""Site tables from raw fetches: latest fetch up to a date, headers, sitemap choice, the audit fed by it."""

import datetime as dt

from pyspark.sql import functions as F

from siteaudit.plans import catalog as K
from siteaudit.plans.audit import Snapshot, audit_snapshot
from siteaudit.sources.context import fetched_via, latest, lower_headers, site_context

R = "https://s.test"
MAY, JUNE = dt.date(2026, 5, 1), dt.date(2026, 6, 1)
BOT, PLAIN = "x GoogleBot y", "browser"


def _urlset(*paths):
    return "<urlset>" + "".join(f"<url><loc>{R}{p}</loc></url>" for p in paths) + "</urlset>"


def _snapshot(spark):
    page = "<html><head><title>A page of the site</title></head><body><h1>H</h1></body></html>"
    return Snapshot(
        sites=spark.createDataFrame([("s.test", R), ("none.test", "https://none.test")], "site string, domain string"),
        crawl=spark.createDataFrame([("s.test", i, i, f"{R}/p{i}", f"{R}/p{i}", 200, 900, page) for i in range(3)],
                                    "site string, page_id bigint, crawl_order bigint, url string, final_url string, "
                                    "status_code int, render_ms int, html string"),
        robots=spark.createDataFrame([("s.test", MAY, 404, ""), ("s.test", JUNE, 200, f"Sitemap: {R}/news.xml\n")],
                                     "site string, fetched_at date, status int, body string"),
        sitemap_files=spark.createDataFrame(
            [("s.test", R + "/sitemap.xml", MAY, 200, _urlset("/a", "/b", "/c", "/d", "/p0")),
             ("s.test", R + "/sitemap.xml", JUNE, 404, ""), ("s.test", R + "/news.xml", JUNE, 200, _urlset(*[f"/n{i}" for i in range(80)]))],
            "site string, sitemap_url string, fetched_at date, status int, body string"),
        homepages=spark.createDataFrame(
            [("s.test", BOT, MAY, 200, {"STRICT-Transport-Security": "max-age=1"}, "<p>old</p>"),
             ("s.test", BOT, JUNE, 503, {"Strict-Transport-Security": "max-age=5", "strict-transport-security": "max-age=31536000"}, "<p>new</p>"),
             ("s.test", PLAIN, MAY, 0, None, None)],
            "site string, ua string, fetched_at date, status int, headers map<string, string>, html string"),
        probes=spark.createDataFrame([], "site string, target string, status int"))


def test_the_latest_fetch_up_to_the_date_counts(spark):
    snap = _snapshot(spark)
    for as_of, want in ((MAY, (404, "", R + "/sitemap.xml", 200, "max-age=1", None, 10)),
                        (JUNE, (200, f"Sitemap: {R}/news.xml\n", R + "/news.xml", 200, "max-age=31536000", None, 10)),
                        (None, (200, f"Sitemap: {R}/news.xml\n", R + "/news.xml", 200, "max-age=31536000", None, 10)),
                        (dt.date(2020, 1, 1), (0, "", "", 0, "", None, None))):
        found = site_context(snap.sites, snap.robots, snap.sitemap_files, snap.homepages, as_of)
        rows = {r.site: r for r in found.sites.collect()}
        r = rows["s.test"]
        assert (r.robots_status, r.robots_txt, r.sitemap_url, r.sitemap_status, r.hsts, r.default_ua_len, r.googlebot_ua_len) == want
        assert (rows["none.test"].robots_status, rows["none.test"].sitemap_url) == (0, "")
    assert [r.loc for r in site_context(snap.sites, snap.robots, snap.sitemap_files, snap.homepages, JUNE)
            .sitemap_urls_raw.orderBy("pos").collect()] == [f"{R}/n{i}" for i in range(80)]


def test_two_dates_give_two_audits(spark):
    snap = _snapshot(spark)
    got = {}
    for as_of in (MAY, JUNE):
        t = audit_snapshot(snap, as_of)
        got[as_of] = {r.check_id: r for r in t.check_results.filter("site = 's.test'").collect()}
        assert [r.first_paragraph for r in t.homes.collect()] == [""]
    assert (got[MAY]["C-03"].evidence_url, got[MAY]["C-03"].message) == (R + "/sitemap.xml", "Sitemap lists 5 URLs.")
    assert (got[JUNE]["C-03"].evidence_url, got[JUNE]["C-03"].message) == (R + "/news.xml", "Sitemap lists 80 URLs.")
    assert (got[MAY]["C-24"].total_pages, got[JUNE]["C-24"].total_pages) == (5, 80)
    assert (got[MAY]["C-19"].verdict, got[JUNE]["C-19"].verdict) == ("warn", "pass")
    assert (got[MAY]["C-01"].verdict, got[JUNE]["C-01"].verdict) == ("warn", "pass")


def test_fetches_at_the_same_time_and_headers_that_differ_in_case(spark):
    df = spark.createDataFrame([("a", JUNE, 200, "x"), ("a", JUNE, 404, "y"), ("a", JUNE, 404, "y"), ("b", None, 200, "z")],
                               "k string, fetched_at date, status int, body string")
    assert [(r.k, r.status) for r in latest(df, ["k"], "body").orderBy("k").collect()] == [("a", 404), ("b", 200)]
    assert [r.k for r in latest(df, ["k"], "body", JUNE).collect()] == ["a"]
    h = spark.sql(f"""SELECT * FROM VALUES (map('A', '1', 'b', '2', 'a', '3'), '{BOT}'), (map_from_arrays(array(), array()), '{PLAIN}'),
                      (CAST(NULL AS map<string, string>), CAST(NULL AS string)) AS t(h, ua)""")
    got = h.select(lower_headers("h").alias("h"), fetched_via("ua").alias("v")).collect()
    assert [(r.h, r.v) for r in got] == [({"b": "2", "a": "3"}, "googlebot"), ({}, "default"), (None, "default")]


def test_checks_of_the_fixture_use_the_sitemap_that_was_chosen(spark):
    sf = "/root/testdata/sf0.001"
    choice = {r.site: r for r in K.QUERIES["sitemap_choice"](spark, sf).collect()}
    c03 = {r.site: r for r in K.QUERIES["c03_sitemap"](spark, sf).collect()}
    assert all(r.evidence_url == choice[s].sitemap_url for s, r in c03.items() if r.verdict == "pass")
    assert {s for s, r in choice.items() if r.sitemap_status == 200} == {s for s, r in c03.items() if r.verdict == "pass"}
    assert K.QUERIES["frontier_hub"](spark, sf).filter("stage = 2").count() > 0
    assert K.QUERIES["root_page"](spark, sf).filter(F.col("root_blocks") > 0).count() > 0
