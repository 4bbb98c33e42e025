"""Skew: one site holds 90% of all pages. The site-keyed aggregates must stay exact.

The hot site's counters are checked against a brute-force computation over
its collected pages (pandas), which is only possible because the test data
is small.
"""

import statistics

from pyspark.sql import functions as F

from siteaudit.operators import checks as C
from siteaudit.plans.audit import AuditInputs, audit, fixture_inputs


def test_hot_site_counters_match_brute_force(spark):
    base = fixture_inputs(spark, "/root/testdata/sf0.01")
    hot = F.when(F.col("page_id") % 10 != 0, F.lit("hot.example")).otherwise(F.col("site"))
    crawl = base.crawl.withColumn("site", hot)
    sites = base.sites.unionByName(base.sites.limit(1).withColumn("site", F.lit("hot.example"))
                                   .withColumn("domain", F.lit("https://hot.example")))
    t = audit(AuditInputs(crawl=crawl, sites=sites, sitemap_urls_raw=base.sitemap_urls_raw, probes=base.probes))

    n_hot = crawl.filter(F.col("site") == "hot.example").count()
    assert n_hot >= 0.85 * crawl.count()

    facts = t.facts.filter(F.col("site") == "hot.example").first()
    pdf = t.pages.filter(F.col("site") == "hot.example").select(
        "status_code", "render_ms", "title", "h1_texts").toPandas()
    valid = pdf[pdf.status_code == 200]
    assert facts["n_pages"] == len(pdf)
    assert facts["n_valid"] == len(valid)
    ms = sorted(valid.render_ms[valid.render_ms > 0])
    assert facts["c04_n"] == len(ms)
    assert facts["c04_median"] == int(statistics.median(ms))
    assert facts["c10_long"] == int(sum((valid.title != "") & (valid.title.str.len() > 80)))
    assert facts["c10_short"] == int(sum((valid.title != "") & (valid.title.str.len() < 20)))
    firsts = [h[0] for h in valid.h1_texts if len(h) > 0]
    assert facts["c11_dups"] == len(firsts) - len(set(firsts))
    counts = {r.site: r.n for r in t.check_results.groupBy("site").agg(F.count("*").alias("n")).collect()}
    assert set(counts.values()) == {15}


def test_site_aggregates_are_partial(spark):
    """The per-site page counters aggregate map-side before the exchange on site."""
    t = audit(fixture_inputs(spark, "/root/testdata/sf0.001"))
    plan = C.page_counters(C.page_flags(t.pages))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "partial_min_by" in plan
