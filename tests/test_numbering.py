"""Pages get the numbers of the fixture's SQL, and no task holds a site."""

import random

from pyspark.sql import functions as F

from siteaudit.sources import fixtures as fx


def _stored(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"https://www.hot.test/p/{i}#x" if i % 10 else f"https://s{i % 7}.test/{i}", f"<head></head>{i}") for i in range(3000)]
    rows += [(17, None, "<head></head>"), (19, None, None), (23, "", "x"), (None, "https://none.test/", "x"), rows[1], rows[1], rows[10]]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5).write.parquet(f"{tmp_path}/sf/pages.parquet")
    return f"{tmp_path}/sf"


def test_pages_are_numbered_as_by_the_sql(spark, tmp_path):
    sf = _stored(spark, tmp_path)
    want = fx.bind(spark, fx.CRAWL_SQL, pages=fx.read_pages(spark, sf))
    got = fx.snapshot(spark, sf)["crawl"]
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_pages_of_one_site_are_spread(spark, tmp_path):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        crawl = fx.snapshot(spark, _stored(spark, tmp_path))["crawl"]
    finally:
        spark.conf.unset(key)
    n = [r["count"] for r in crawl.groupBy(F.spark_partition_id()).count().collect()]
    assert max(n) < 0.4 * sum(n)      # nine tenths are of one site
