"""Scoped (path-prefix) audits: a section of a site audited on its own.

A target ``(site, root, path_prefix, max_pages)`` with a non-empty prefix is
audited as its own unit, keyed by ``audit_id = site + path_prefix``:

* pages: the URLs of the target's final frontier (F5), in frontier order, looked
  up among crawled pages by U7 key (first crawl row per key); a URL that wasn't
  fetched is a page with status 0;
* domain: ``root + path_prefix`` (what homepage matching and evidence use);
* sitemap URLs: HTML and in-prefix only (S9);
* robots, HSTS, probes: the site's;
* C-15 homepage: the site's homepage, fetched apart from the crawl (S12), when the
  snapshot has it.

The same ``audit()`` then runs unchanged, since every operator keys on the
``site`` column, which here carries the audit id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.functions import urls as U
from siteaudit.functions.html_extract import with_empty_facts
from siteaudit.operators.frontier import frontier
from siteaudit.plans.audit import AuditInputs, AuditTables, audit, prepare_sites


def scoped_inputs(targets: DataFrame, crawl: DataFrame, sites: DataFrame, sitemap_urls_raw: DataFrame,
                  probes: DataFrame, pages: DataFrame, sitemap_urls: DataFrame,
                  final_frontier: DataFrame | None = None) -> tuple[AuditInputs, DataFrame]:
    """``final_frontier``: an already computed F5 frontier of (at least) the scoped targets;
    per-target stages are independent, so a frontier of all targets can be passed."""
    scoped = targets.filter(F.col("path_prefix") != "").select(
        "site", "root", "path_prefix", F.concat("site", "path_prefix").alias("audit_id"))
    if final_frontier is None:
        final_frontier = frontier(targets.join(scoped.select("site", "path_prefix"), ["site", "path_prefix"],
                                               "left_semi"), sitemap_urls, pages)
    fr = final_frontier.join(scoped.select("site", "path_prefix"), ["site", "path_prefix"], "left_semi")
    first = Window.partitionBy("site", "key").orderBy("crawl_order")
    by_key = crawl.withColumn("key", U.canonicalize_url(F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")))) \
        .withColumn("rk", F.row_number().over(first)).filter("rk = 1").drop("rk")
    on = fr.join(scoped, ["site", "path_prefix"]).select("site", "key", "audit_id", F.col("pos").alias("_pos"), F.col("url").alias("_url"))
    fpages = on.join(by_key.select("site", "key", "page_id", "final_url", "status_code", "render_ms", "html"), ["site", "key"], "left")
    unseen = {"status_code": F.coalesce("status_code", F.lit(0)), "render_ms": F.coalesce("render_ms", F.lit(0)),
              "final_url": F.coalesce("final_url", F.lit(""))}
    s_crawl = fpages.withColumns(unseen).select(F.col("audit_id").alias("site"), "page_id", F.col("_pos").alias("crawl_order"),
                                                F.col("_url").alias("url"), "final_url", "status_code", "render_ms", "html")
    # the same pages, already extracted by the site audit: relabelled, not parsed again
    # (link resolution used final_url, which is unchanged)
    s_pages = with_empty_facts(on.join(_keyed_pages(pages), ["site", "key"], "left").withColumns(unseen)) \
        .withColumns({"site": F.col("audit_id"), "crawl_order": F.col("_pos"), "url": F.col("_url")}).select(*pages.columns)
    # the sitemap is found at the root; the display domain is root + prefix
    s_sites = prepare_sites(sites).join(scoped, "site") \
        .withColumn("domain", F.concat("root", "path_prefix")) \
        .withColumn("site", F.col("audit_id")).drop("audit_id", "root")
    s_raw = sitemap_urls_raw.join(scoped, "site").select(F.col("audit_id").alias("site"), "pos", "loc")
    s_probes = probes.join(scoped, "site").select(F.col("audit_id").alias("site"), "target", "status")
    return AuditInputs(crawl=s_crawl, sites=s_sites, sitemap_urls_raw=s_raw, probes=s_probes), s_pages


def root_pages(targets: DataFrame, homes: DataFrame) -> DataFrame:
    """Per scoped target, the site's homepage (extracted, one row per site), as a successful fetch of
    the root: status 200, final URL = root."""
    scoped = targets.filter(F.col("path_prefix") != "").select("site", "root", F.concat("site", "path_prefix").alias("audit_id"))
    return scoped.join(homes.select("site", "schema_blocks"), "site").select(
        F.col("audit_id").alias("site"), F.lit(200).alias("status_code"), F.col("root").alias("final_url"), "schema_blocks")


def _keyed_pages(pages: DataFrame) -> DataFrame:
    """Extracted pages by U7 key of ``final_url or url``: the first crawl row per key."""
    first = Window.partitionBy("site", "key").orderBy("crawl_order")
    k = pages.withColumn("key", U.canonicalize_url(F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url"))))
    return k.withColumn("rk", F.row_number().over(first)).filter("rk = 1").drop("rk", "url", "crawl_order")


def scoped_audit(targets: DataFrame, crawl: DataFrame, sites: DataFrame, sitemap_urls_raw: DataFrame,
                 probes: DataFrame, pages: DataFrame, sitemap_urls: DataFrame,
                 final_frontier: DataFrame | None = None, homes: DataFrame | None = None) -> AuditTables:
    """Audit every scoped target; results are keyed by ``site`` = audit id (site + prefix). ``homes``: extracted homepages."""
    inp, s_pages = scoped_inputs(targets, crawl, sites, sitemap_urls_raw, probes, pages, sitemap_urls,
                                 final_frontier)
    return audit(inp, pages=s_pages, root_pages=root_pages(targets, homes) if homes is not None else None)
