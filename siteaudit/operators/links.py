"""The internal link graph and link statuses, as joins keyed by URL.

Every shuffle here is keyed by ``(site, url)`` (or ``(site, src)``), never by
``site`` alone, so one site holding a third of all links still spreads over
all tasks. The only per-site ordered caps use ``row_number() <= k``, which
Catalyst plans as a ``WindowGroupLimit`` that keeps k rows per site in each
map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteaudit import schema as S
from siteaudit.functions import urls as U


def page_key(pages: DataFrame) -> DataFrame:
    """``final_url or url`` as the page's link-graph identity."""
    return pages.withColumn("page_url", F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")))


# L1
def link_edges(pages: DataFrame) -> DataFrame:
    """Edges (site, src, src_order, pos, target, anchor) of successfully fetched pages.

    Pages sharing a source URL collapse to one source: the last page's links,
    at the first page's position (dict-overwrite semantics).
    """
    p = page_key(pages).filter((F.col("status_code") == 200) & (F.size("internal_links") > 0))
    per_src = p.groupBy("site", F.col("page_url").alias("src")).agg(
        F.max_by("internal_links", "crawl_order").alias("links"),
        F.min("crawl_order").alias("src_order"))
    return per_src.select("site", "src", "src_order", F.inline("links")) \
        .select("site", "src", "src_order", F.col("pos").cast("int").alias("pos"), "target", "anchor")


def crawled_keys(pages: DataFrame) -> DataFrame:
    """Canonical keys (U7) of every crawled page, any status."""
    return page_key(pages).select("site", U.canonicalize_url("page_url").alias("key")).distinct()


# L2
def probe_targets(edges: DataFrame, pages: DataFrame, cap: int | None = None) -> DataFrame:
    """Link targets to probe: not crawled (by U7 key), HTML, first per key; with ``cap`` the first ``cap`` per site."""
    e = edges.filter(U.is_html_url("target")).withColumn("key", U.canonicalize_url("target"))
    e = e.join(crawled_keys(pages), ["site", "key"], "left_anti")
    first = Window.partitionBy("site", "key").orderBy("src_order", "pos")
    e = e.withColumn("rk", F.row_number().over(first)).filter("rk = 1")
    if cap is not None:
        per_site = Window.partitionBy("site").orderBy("src_order", "pos")
        e = e.withColumn("probe_rank", F.row_number().over(per_site)).filter(F.col("probe_rank") <= cap)
    else:
        e = e.withColumn("probe_rank", F.lit(None).cast("int"))
    return e.select("site", "target", "key", "src_order", "pos")


# L3
def link_status(probes: DataFrame, pages: DataFrame) -> DataFrame:
    """URL -> status: every known probe result, overridden by crawled pages.

    Crawled pages record their status unless it is 0; later pages win for a
    shared URL. Probes are matched by exact target string.
    """
    probed = probes.select("site", F.col("target").alias("url"), "status",
                           F.lit(0).alias("prio"), F.lit(-1).cast("bigint").alias("ord"))
    crawled = page_key(pages).filter(F.col("status_code") != 0).select(
        "site", F.col("page_url").alias("url"), F.col("status_code").alias("status"),
        F.lit(1).alias("prio"), F.col("crawl_order").cast("bigint").alias("ord"))
    return probed.unionByName(crawled).groupBy("site", "url").agg(
        F.max_by("status", F.struct("prio", "ord")).alias("status"))


# L4
def edge_status(edges: DataFrame, status: DataFrame) -> DataFrame:
    """Each edge with the status of its exact target string, -1 when unknown."""
    s = status.select("site", F.col("url").alias("target"), "status")
    return edges.join(s, ["site", "target"], "left").withColumn("status", F.coalesce("status", F.lit(-1)))


# L5
def orphan_urls(sitemap_urls: DataFrame, edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Sitemap URLs (U8 key) that no edge targets and no fetched page is."""
    sm = sitemap_urls.select("site", U.normalize_url("loc").alias("nkey")).distinct()
    linked = edges.select("site", U.normalize_url("target").alias("nkey")).unionByName(
        page_key(pages).filter(F.col("status_code") != 0).select("site", U.normalize_url("page_url").alias("nkey"))).distinct()   # a target linked from everywhere is one row
    return sm.join(linked, ["site", "nkey"], "left_anti")
