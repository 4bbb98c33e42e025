"""Incremental audits with Structured Streaming.

Crawlers drop snapshot files (crawl rows with HTML) into a folder as they
finish sites. ``start_incremental_audit`` reads that folder as a stream and,
per micro-batch, audits the sites present in the batch against the static
site facts, sitemap entries and probe results, then writes the batch's check
rows and scores under ``out_dir/<table>/batch_id=<id>/``. A batch is written
with ``mode("overwrite")`` on its own partition, so a replay after a failure
rewrites the same folder instead of duplicating rows (the stream's checkpoint
records which batches committed).

A site is audited from the pages of one batch: producers write a site's
snapshot in one file (or one commit), which is how crawlers hand over sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteaudit.plans.audit import AuditInputs, audit

CRAWL_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("site", T.StringType()),
    T.StructField("crawl_order", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("final_url", T.StringType()), T.StructField("status_code", T.IntegerType()),
    T.StructField("render_ms", T.IntegerType()), T.StructField("html", T.StringType()),
])


def audit_batch(batch: DataFrame, sites: DataFrame, sitemap_urls_raw: DataFrame, probes: DataFrame,
                out_dir: str, batch_id: int) -> None:
    """Audit the sites of one micro-batch and write their results."""
    keys = batch.select("site").distinct()
    inp = AuditInputs(crawl=batch,
                      sites=sites.join(keys, "site", "left_semi"),
                      sitemap_urls_raw=sitemap_urls_raw.join(keys, "site", "left_semi"),
                      probes=probes.join(keys, "site", "left_semi"))
    t = audit(inp)
    for name, df in (("check_results", t.check_results), ("site_scores", t.site_scores),
                     ("category_scores", t.category_scores)):
        (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .parquet(f"{out_dir}/{name}/batch_id={batch_id}"))


def start_incremental_audit(spark: SparkSession, crawl_dir: str, sites: DataFrame, sitemap_urls_raw: DataFrame,
                            probes: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True,
                            max_files_per_trigger: int | None = None):
    """Start the stream; returns the StreamingQuery."""
    reader = spark.readStream.schema(CRAWL_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(crawl_dir)
    writer = stream.writeStream.foreachBatch(
        lambda df, bid: audit_batch(df, sites, sitemap_urls_raw, probes, out_dir, bid)) \
        .option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
