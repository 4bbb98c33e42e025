"""Arrow batches are bounded by bytes, so that a worker's memory doesn't grow with its task."""

import pandas as pd
from pyspark.sql import functions as F

from siteaudit.functions import html_extract as X
from siteaudit.sources import sitemaps as SM


def test_extraction_batches_are_bounded_by_bytes(spark, monkeypatch):
    def sizes(htmls, bases):
        return [X.extract_fields(None, "") | {"title": str(len(htmls))} for _ in htmls]

    monkeypatch.setattr(X, "batch_fields", sizes)
    crawl = spark.range(0, 60, 1, 1).select(F.lit("s").alias("site"), F.lit("https://s.test/").alias("url"), F.lit("").alias("final_url"),
                                            F.lit(200).alias("status_code"), F.repeat(F.lit("x"), F.lit(1 << 20)).alias("html"))
    got = [int(r.title) for r in X.extract_pages(crawl).select("title").collect()]
    assert len(got) == 60 and max(got) <= 8


def test_sitemap_batches_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(SM, "_xml_locs", lambda bodies: pd.Series([[str(len(bodies))]] * len(bodies)))
    files = spark.range(0, 60, 1, 1).select(F.lit("s").alias("site"), F.col("id").cast("string").alias("sitemap_url"), F.lit(200).alias("status"),
                                            F.repeat(F.lit("x"), F.lit(1 << 20)).alias("body"))
    got = [int(r.raw_locs[0]) for r in SM.parsed_files(files).select("raw_locs").collect()]
    assert len(got) == 60 and max(got) <= 8
