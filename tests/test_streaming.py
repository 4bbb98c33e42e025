"""Incremental (streaming) audit equals the batch audit for the same sites."""

import os
import tempfile

from pyspark.sql import functions as F

from siteaudit.plans.audit import audit, fixture_context, fixture_inputs
from siteaudit.sources import fixtures as fx
from siteaudit.streaming.incremental import CRAWL_SCHEMA, start_incremental_audit


def test_stream_matches_batch(spark):
    sf = "/root/testdata/sf0.001"
    snap = fx.snapshot(spark, sf)
    work = tempfile.mkdtemp(prefix="siteaudit-stream-")
    crawl_dir = os.path.join(work, "crawl")
    # two arrivals, each holding whole sites
    crawl = snap["crawl"].select(*[f.name for f in CRAWL_SCHEMA.fields])
    first = crawl.filter(F.col("site") < "m")
    first.write.parquet(os.path.join(crawl_dir, "part1"))
    crawl.join(first.select("site").distinct(), "site", "left_anti").select(*crawl.columns) \
        .write.parquet(os.path.join(crawl_dir, "part2"))
    known = fixture_context(spark, sf)
    q = start_incremental_audit(spark, crawl_dir + "/*", known.sites, known.sitemap_urls_raw, snap["probes"],
                                os.path.join(work, "out"), os.path.join(work, "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(work, "out", "check_results")).drop("batch_id")
    want = audit(fixture_inputs(spark, sf)).check_results
    # sites with pages are audited by the stream
    want = want.join(crawl.select("site").distinct(), "site", "left_semi")
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(tuple(r) for r in want.collect())
