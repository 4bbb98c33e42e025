"""A check that can't read its input, or whose code fails, is one row; the others stay."""

import pytest
from pyspark.sql import functions as F

from siteaudit import schema as S
from siteaudit.operators import checks as C
from siteaudit.plans import catalog as K
from siteaudit.plans.audit import AuditInputs, audit

CRAWL = "site string, page_id bigint, crawl_order bigint, url string, final_url string, status_code int, render_ms int, html string"
SITES = ("site string, domain string, robots_status int, robots_txt string, hsts string, sitemap_status int, "
         "default_ua_len bigint, googlebot_ua_len bigint")


def _inputs(spark):
    def page(canonical):
        return f'<html><head><title>A title of the right length</title><link rel="canonical" href="{canonical}"></head></html>'

    crawl = [("a.test", 1, 0, "https://a.test/", "https://a.test/", 200, 900, page("https://a.test/")),
             ("a.test", 2, 1, "https://a.test/x", "https://a.test/x", 200, 900, page("https://[a.test/x")),
             ("b.test", 3, 0, "https://b.test/", "https://b.test/", 200, 900, page("https://b.test/")),
             ("c.test", 4, 0, "https://c.test/", "https://c.test/", 200, 900, page("https://c.test/"))]
    sites = [("a.test", "https://a.test", 404, "", "max-age=1", 404, 1, 1), ("b.test", "https://[b.test", 404, "", "max-age=1", 404, 1, 1),
             ("c.test", "https://c.test", 404, "", "max-age=" + "9" * 5000, 404, 1, 1)]
    return AuditInputs(crawl=spark.createDataFrame(crawl, CRAWL), sites=spark.createDataFrame(sites, SITES),
                       sitemap_urls_raw=spark.createDataFrame([], "site string, pos bigint, loc string"),
                       probes=spark.createDataFrame([], "site string, target string, status int"))


def test_each_unreadable_input_takes_one_check_of_one_site(spark):
    t = audit(_inputs(spark))
    errors = {(r.site, r.check_id): (r.kind, r.message) for r in C.error_rows(t.facts).collect()}
    assert {k: v[0] for k, v in errors.items()} == {("a.test", "C-05"): "page_url", ("b.test", "C-15"): "domain", ("c.test", "C-19"): "number"}
    rows = {(r.site, r.check_id): r for r in t.check_results.collect()}
    assert len(rows) == 45
    broken = {k for k, r in rows.items() if r.message.startswith("Check could not run")}
    assert broken == set(errors)
    for k in broken:
        assert (rows[k].verdict, rows[k].severity, rows[k].category, rows[k].fix_text) == ("unverified", "INFO", "Crawlability", "")
        assert rows[k].message == "Check could not run: " + errors[k][1]
    assert rows["c.test", "C-19"].message.endswith("has 5000 digits.")
    for site in ("a.test", "b.test", "c.test"):
        assert sum(r.message.startswith("Check could not run") for (s, _), r in rows.items() if s == site) == 1


@pytest.fixture
def own_checks():
    before = list(S.CHECKS)
    yield
    S.CHECKS[:] = before
    for cid in [c for c in C.CHECK_BUILDERS if c.startswith("X-")]:
        del C.CHECK_BUILDERS[cid], C._CHECK[cid]


def test_failing_code_of_a_check_is_its_own_row(spark, own_checks):
    C.register_check("X-1", "Authority", 90, "Divides", lambda: C.result("X-1", "pass", "P2", C._i(F.lit(1) / (F.col("n_valid") - 1))))
    C.register_check("X-2", "Authority", 91, "Casts", lambda: F.when(
        F.col("site").cast("int") >= 0, C.result("X-2", "pass", "P2", "fine")))
    C.register_check("X-3", "Authority", 92, "Unknown column", lambda: C.result("X-3", "pass", "P2", F.col("no_such_column")))
    C.register_check("X-4", "Authority", 93, "Raises", lambda: 1 / 0)
    C.register_check("X-5", "Authority", 94, "Works", lambda: C.result("X-5", "pass", "P2", "fine"))
    before = spark.conf.get("spark.sql.ansi.enabled")
    rows = {(r.site, r.check_id): r for r in audit(_inputs(spark)).check_results.collect()}
    assert spark.conf.get("spark.sql.ansi.enabled") == before
    assert len(rows) == 3 * 20
    for site in ("a.test", "b.test", "c.test"):
        assert rows[site, "X-2"].message == "Check could not run: it gave no result."
        assert rows[site, "X-3"].message == "Check could not run: AnalysisException in the check's code."
        assert rows[site, "X-4"].message == "Check could not run: ZeroDivisionError in the check's code."
        assert rows[site, "X-5"].verdict == "pass"
    assert rows["a.test", "X-1"].message == "1.0"


def test_the_fixture_holds_three_kinds_of_errors(spark):
    rows = K.QUERIES["check_error_rows"](spark, "/root/testdata/sf0.01").collect()
    assert {r.kind for r in rows} == {"page_url", "domain", "number"}
