"""What an audit knows of a site besides its pages, from raw fetches.

Snapshot tables, one row per fetch; a resource may have been fetched on several dates:

* ``sites(site, domain)``
* ``robots(site, fetched_at, status, body)``
* ``sitemap_files(site, sitemap_url, fetched_at, status, body)``, or ``content`` (the bytes, compressed or not) in place of ``body``
* ``homepages(site, ua, fetched_at, status, headers map<string, string>, html)``

``site_context`` takes of each resource the latest fetch up to a date, finds each site's sitemap from its robots file and the
well-known places, reads it to its end, and gives the tables that ``audit`` works on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.session import checkpoint_dir
from siteaudit.sources import sitemaps as SM


def latest(fetches: DataFrame, keys: list[str], body: str, as_of=None) -> DataFrame:
    """The latest fetch of each resource, not after ``as_of``; of fetches at the same time the one with the largest status,
    then body hash. The cut keeps one row of a resource in each map task, so superseded bodies aren't shuffled."""
    if as_of is not None:
        fetches = fetches.filter(F.col("fetched_at") <= F.lit(as_of).cast(fetches.schema["fetched_at"].dataType))
    order = Window.partitionBy(*keys).orderBy(F.desc("fetched_at"), F.desc("status"), F.xxhash64(body))
    return fetches.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


# S2
def lower_headers(headers: Column | str) -> Column:
    """Header names in lower case; of names that differ in case the last one stays. Null without headers."""
    h = F.col(headers) if isinstance(headers, str) else headers
    entries = F.map_entries(h)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))),
                                                    lambda x: F.lower(x["key"]) == F.lower(e["key"])))
    return F.transform_keys(F.map_from_entries(last), lambda k, v: F.lower(k))


def fetched_via(ua: Column | str) -> Column:
    """Which of the two user agents made the fetch."""
    u = F.col(ua) if isinstance(ua, str) else ua
    return F.when(F.lower(u).contains("googlebot"), "googlebot").otherwise("default")


@dataclass
class SiteContext:
    sites: DataFrame             # site, domain, robots_status, robots_txt, sitemap_url, sitemap_status, hsts, default_ua_len, googlebot_ua_len
    sitemap_urls_raw: DataFrame  # site, pos, loc of the chosen sitemap
    homepages: DataFrame         # site, html: what the googlebot agent got, where it got anything


def homepage_facts(homepages: DataFrame) -> DataFrame:
    """(site, hsts, default_ua_len, googlebot_ua_len) of latest homepage fetches; a fetch without a response has no length.

    One row per site and agent comes in, so a site's group has two rows.
    """
    h = homepages.select("site", fetched_via("ua").alias("via"), lower_headers("headers")["strict-transport-security"].alias("sts"),
                         F.when(F.col("status") > 0, F.coalesce(F.length("html"), F.lit(0))).cast("bigint").alias("body_len"))
    return h.groupBy("site").agg(
        F.coalesce(F.max(F.when(F.col("via") == "googlebot", F.col("sts"))), F.lit("")).alias("hsts"),
        F.max(F.when(F.col("via") == "default", F.col("body_len"))).alias("default_ua_len"),
        F.max(F.when(F.col("via") == "googlebot", F.col("body_len"))).alias("googlebot_ua_len"))


def site_context(sites: DataFrame, robots: DataFrame, sitemap_files: DataFrame, homepages: DataFrame, as_of=None,
                 target: int | None = None, max_fetch: int | None = None) -> SiteContext:
    """The site tables of an audit as of a date. Resources that were never fetched count as answered 0."""
    checkpoint_dir(sites.sparkSession)
    rb = SM.robots_source(latest(robots, ["site"], "body", as_of))
    via = homepages.withColumn("_via", fetched_via("ua"))
    home = latest(via, ["site", "_via"], "html", as_of)
    known = sites.select("site", "domain").join(rb, "site", "left").join(homepage_facts(home), "site", "left").select(
        "site", "domain", F.coalesce("robots_status", F.lit(0)).alias("robots_status"),
        F.coalesce("robots_txt", F.lit("")).alias("robots_txt"), F.coalesce("hsts", F.lit("")).alias("hsts"),
        "default_ua_len", "googlebot_ua_len").checkpoint(eager=True)
    files = latest(sitemap_files, ["site", "sitemap_url"], "content" if "content" in sitemap_files.columns else "body", as_of)
    if "content" in files.columns:
        files = SM.inflated_bodies(files)
    choice, urls = SM.choose_sitemap(known, files, target, max_fetch)
    html = home.filter((F.col("_via") == "googlebot") & (F.col("status") > 0) & (F.coalesce("html", F.lit("")) != ""))
    return SiteContext(sites=known.join(choice.drop("n_urls"), "site"), sitemap_urls_raw=urls, homepages=html.select("site", "html"))


def site_fetches(sites: DataFrame) -> DataFrame:
    """(site, ua, body_len): the two homepage fetches of each site, for ``spa_detect``."""
    return sites.select("site", F.explode(F.array(
        F.struct(F.lit("default").alias("ua"), F.col("default_ua_len").alias("body_len")),
        F.struct(F.lit("googlebot").alias("ua"), F.col("googlebot_ua_len").alias("body_len")))).alias("f")).select("site", "f.*")
