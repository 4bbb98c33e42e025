"""Crawl-set selection, re-aimed as planning over pages already fetched.

A target is ``(site, root, path_prefix, max_pages)``. Its frontier is made of ordered candidates that are filtered,
de-duplicated by the U7 key against everything chosen before, and cut to the room left:

1. seed + sitemap URLs (F1)
2. hub links of the seed page (F2), when room is left
3. links of the first ``min(5, n)`` chosen URLs (F3), when fewer than
   ``max(3, max_pages // 2)`` are chosen
4. scoped audits only: links of the first 10 chosen URLs, same host, no
   prefix filter (F4)

Stages 1 and 2 start from what is known beforehand, so they are one pass that ranks candidates with their stage and cuts
once; stages 3 and 4 each wait for the choice before them. "Fetching" a URL is a lookup of the snapshot's
extracted pages by U7 key (status 200 only); only the links of those few pages are resolved. Every per-target ordered
cut is ``row_number() <= k`` after a de-duplication keyed by ``(target, url key)``, so no stage sorts a whole
site in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.functions import urls as U
from siteaudit.session import checkpoint_dir

T = ["site", "path_prefix"]


def hub_links(pages: DataFrame, root_col: str = "root") -> DataFrame:
    """Links of a page resolved against ``root + '/'``, same host (port dropped),
    http(s) only, fragment dropped, de-duplicated keeping the first."""
    p = pages.select(*[c for c in pages.columns if c != "raw_links"], F.posexplode("raw_links").alias("i", "l"))
    absu = U.resolve_url(F.concat(F.col(root_col), F.lit("/")), F.col("l.href"))
    p = p.withColumn("link", U.strip_fragment(absu)).filter(
        (F.col("link").startswith("http://") | F.col("link").startswith("https://"))
        & U.same_host("link", root_col) & (F.col("link") != ""))
    keys = [c for c in pages.columns if c != "raw_links"]
    first = Window.partitionBy(*keys, "link").orderBy("i")
    return p.withColumn("rk", F.row_number().over(first)).filter("rk = 1").select(*keys, F.col("i").alias("lpos"), "link")


def _fetched(pages: DataFrame) -> DataFrame:
    """(site, fkey, crawl_order): the first page fetched under each key, answering 200."""
    key = U.canonicalize_url(F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")))
    return pages.filter(F.col("status_code") == 200).select("site", key.alias("fkey"), "crawl_order") \
        .groupBy("site", "fkey").agg(F.min("crawl_order").alias("crawl_order")).checkpoint(eager=True)


def _hub_links(hubs: DataFrame, pages: DataFrame, fetched: DataFrame, targets: DataFrame, in_prefix: bool, stage: int) -> DataFrame:
    """Candidates from the hub pages ``hubs(site, path_prefix, hub_url, o1)``, ordered by hub, then link.

    Hubs are a handful for each target; only their links are resolved.
    """
    h = hubs.withColumn("fkey", U.canonicalize_url("hub_url")).join(targets.select(*T, "root"), T).join(fetched, ["site", "fkey"])
    found = pages.filter(F.col("status_code") == 200).select("site", "crawl_order", "raw_links").join(
        h.select(*T, "root", "o1", "crawl_order"), ["site", "crawl_order"])
    # cut: the stage's filters would otherwise be pushed into the resolution and repeat it for every use of the link
    links = hub_links(found.select(*T, "root", "o1", "raw_links")).checkpoint(eager=True)
    return _candidates(links.select(*T, "root", "o1", F.col("lpos").alias("o2"), F.col("link").alias("url")), in_prefix, stage)


def _candidates(links: DataFrame, in_prefix: bool, stage: int) -> DataFrame:
    """(site, path_prefix, url, stage, o1, o2) of the links that the stage takes."""
    keep = U.matches_prefix("url", "root", "path_prefix") if in_prefix else U.same_host("url", "root")
    return links.filter(U.is_html_url("url") & keep).select(*T, "url", F.lit(stage).alias("stage"), F.col("o1").cast("int").alias("o1"),
                                                            F.col("o2").cast("bigint").alias("o2"))


def _choose(chosen: DataFrame | None, cands: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Append de-duplicated candidates (in order of stage, ``o1``, ``o2``) to ``chosen`` up to max_pages, which is ``most`` at most."""
    c = cands.withColumn("key", U.canonicalize_url("url")).groupBy(*T, "key").agg(
        F.min(F.struct("stage", "o1", "o2", "url")).alias("c")).select(*T, "key", "c.*")
    if chosen is not None:
        c = c.join(chosen.select(*T, "key"), T + ["key"], "left_anti")
    order = Window.partitionBy(*T).orderBy("stage", "o1", "o2")
    # the literal bound (the largest max_pages of all targets) is planned as a map-side WindowGroupLimit, so a site with
    # millions of candidates never reaches one task whole; then the room of each target
    c = c.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    room = targets.select(*T, "max_pages")
    if chosen is not None:
        room = room.join(chosen.groupBy(*T).agg(F.count(F.lit(1)).alias("n_prev")), T, "left")
    else:
        room = room.withColumn("n_prev", F.lit(0).cast("bigint"))
    c = c.join(room.withColumn("n_prev", F.coalesce("n_prev", F.lit(0))), T).filter(F.col("r") <= F.col("max_pages") - F.col("n_prev"))
    add = c.select(*T, "url", "key", (F.col("n_prev") + F.col("r") - 1).cast("bigint").alias("pos"), "stage")
    # read again by the next pass, its gate and its hubs: at most max_pages rows for each target
    return (add if chosen is None else chosen.unionByName(add)).checkpoint(eager=True)


def _gate(chosen: DataFrame, targets: DataFrame, cond) -> DataFrame:
    """Targets for which ``cond(n_chosen, max_pages, path_prefix)`` holds."""
    n = chosen.groupBy(*T).agg(F.count(F.lit(1)).alias("n"))
    t = targets.join(n, T, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return t.filter(cond(F.col("n"), F.col("max_pages"), F.col("path_prefix"))).select(*T, "root", "max_pages")


def frontier(targets: DataFrame, sitemap_urls: DataFrame, pages: DataFrame, upto: int = 5,
             homes: DataFrame | None = None) -> DataFrame:
    """(site, path_prefix, pos, url, key, stage) for stages 1..``upto`` (5 = final list).

    ``homes``: extracted homepages that were fetched apart from the crawl; where a site has one, whole-site targets take
    the hub links of stage 2 from it.
    """
    checkpoint_dir(pages.sparkSession)
    t = targets.select(*T, "root", "max_pages").checkpoint(eager=True)
    most = int(t.agg(F.max("max_pages")).first()[0] or 0)
    seed = F.when(F.col("path_prefix") == "", F.col("root")).otherwise(F.concat(F.col("root"), F.col("path_prefix"), F.lit("/")))
    seeds = t.select(*T, "root", seed.alias("url"), F.lit(0).alias("o1"), F.lit(0).alias("o2"))
    listed = sitemap_urls.join(t, "site").select(*T, "root", F.col("loc").alias("url"), F.lit(1).alias("o1"), F.col("pos").alias("o2"))
    cands = _candidates(seeds.unionByName(listed), True, 1)
    fetched = _fetched(pages) if upto >= 2 else None
    if upto >= 2:  # hub links of the seed page
        hubs = t.select(*T, seed.alias("hub_url"), F.lit(0).alias("o1"))
        if homes is not None:
            known = homes.select("site", "raw_links").join(t.filter("path_prefix = ''"), "site")
            links = hub_links(known.select(*T, "root", "raw_links")).checkpoint(eager=True)
            cands = cands.unionByName(_candidates(links.select(*T, "root", F.lit(0).alias("o1"), F.col("lpos").alias("o2"),
                                                               F.col("link").alias("url")), True, 2))
            hubs = hubs.join(known.select(*T), T, "left_anti")
        cands = cands.unionByName(_hub_links(hubs, pages, fetched, t, True, 2))
    chosen = _choose(None, cands, t, most)
    if upto >= 3:  # depth-2 from the first min(5, n) chosen URLs
        g = _gate(chosen, t, lambda n, m, p: n < F.greatest(F.lit(3), F.floor(m / 2)))
        hubs = chosen.join(g.select(*T), T).filter(F.col("pos") < 5).select(*T, F.col("url").alias("hub_url"), F.col("pos").alias("o1"))
        chosen = _choose(chosen, _hub_links(hubs, pages, fetched, t, True, 3), g, most)
    if upto >= 4:  # scoped 1-hop from the first 10 in-prefix URLs, same host only
        g = _gate(chosen, t, lambda n, m, p: (p != "") & (n < m))
        inpre = chosen.join(g, T).filter(U.matches_prefix("url", "root", "path_prefix"))
        w = Window.partitionBy(*T).orderBy("pos")
        hubs = inpre.withColumn("hr", F.row_number().over(w)).filter("hr <= 10") \
            .select(*T, F.col("url").alias("hub_url"), F.col("pos").alias("o1"))
        chosen = _choose(chosen, _hub_links(hubs, pages, fetched, t, False, 4), g, most)
    if upto >= 5:  # final cut
        chosen = chosen.join(t.select(*T, "max_pages"), T).filter(F.col("pos") < F.col("max_pages")).drop("max_pages")
    return chosen.select(*T, "pos", "url", "key", "stage")
