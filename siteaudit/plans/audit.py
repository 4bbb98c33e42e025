"""audit(inputs) -> AuditTables: the whole audit as one lazy DataFrame DAG.

raw fetches -> site_context (latest fetches, sitemap choice) -> sites, sitemap URLs
crawl and homepages -> extract_pages (the one Arrow step) -> pages, edges
-> URL-keyed link joins -> per-site fact row -> check_results -> scores.

The extracted ``pages`` table is the only expensive intermediate: it is cut
from its lineage once (``checkpoint`` into the cluster's shared
``spark.checkpoint.dir``) so executor loss never re-runs HTML parsing of
finished partitions and every downstream view reuses it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit import schema as S
from siteaudit.functions import urls as U
from siteaudit.functions.html_extract import extract_pages
from siteaudit.operators import checks as C
from siteaudit.operators import links as L
from siteaudit.operators import scoring as A
from siteaudit.session import checkpoint_dir
from siteaudit.sources import fixtures as fx
from siteaudit.sources.context import SiteContext, site_context


@dataclass
class AuditInputs:
    crawl: DataFrame          # site, crawl_order, url, final_url, status_code, render_ms, html
    sites: DataFrame          # site, domain, robots_status, robots_txt, hsts, sitemap_status, ...
    sitemap_urls_raw: DataFrame  # site, pos, loc  (URLs of the chosen sitemap)
    probes: DataFrame         # site, target, status
    homepages: DataFrame | None = None   # site, html: homepages fetched apart from the crawl


@dataclass
class AuditTables:
    pages: DataFrame
    sites: DataFrame
    sitemap_urls: DataFrame
    edges: DataFrame
    probe_targets: DataFrame
    link_status: DataFrame
    edge_status: DataFrame
    facts: DataFrame
    check_results: DataFrame
    category_scores: DataFrame
    site_scores: DataFrame
    homes: DataFrame | None = None       # extracted homepages, one row per site
    extra: dict = field(default_factory=dict)


@dataclass
class Snapshot:
    """Raw fetches, as a crawler leaves them (see ``sources.context`` for the columns)."""

    sites: DataFrame             # site, domain
    crawl: DataFrame             # site, crawl_order, url, final_url, status_code, render_ms, html
    robots: DataFrame
    sitemap_files: DataFrame
    homepages: DataFrame
    probes: DataFrame

    def context(self, as_of=None) -> SiteContext:
        return site_context(self.sites, self.robots, self.sitemap_files, self.homepages, as_of)


#: The date of the fixture's audit; its snapshot holds fetches before and after it.
FIXTURE_DATE = "2026-05-20"
_CONTEXTS: dict = {}


def fixture_snapshot(spark: SparkSession, sf_dir: str) -> Snapshot:
    snap = fx.snapshot(spark, sf_dir)
    return Snapshot(sites=snap["site_list"], crawl=snap["crawl"], robots=snap["robots"], sitemap_files=snap["sitemap_files"],
                    homepages=snap["homepages"], probes=snap["probes"])


def fixture_context(spark: SparkSession, sf_dir: str) -> SiteContext:
    """The site tables of the fixture's snapshot, memoised per session and directory."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CONTEXTS:
        found = fixture_snapshot(spark, sf_dir).context(FIXTURE_DATE)
        checkpoint_dir(spark)
        _CONTEXTS[key] = SiteContext(*(df.checkpoint(eager=True) for df in (found.sites, found.sitemap_urls_raw, found.homepages)))
    return _CONTEXTS[key]


def context_inputs(snapshot: Snapshot, context: SiteContext) -> AuditInputs:
    return AuditInputs(crawl=snapshot.crawl, sites=context.sites, sitemap_urls_raw=context.sitemap_urls_raw,
                       probes=snapshot.probes, homepages=context.homepages)


def fixture_inputs(spark: SparkSession, sf_dir: str) -> AuditInputs:
    """Inputs of the audit of the driver's ``pages`` table (see sources.fixtures)."""
    return context_inputs(fixture_snapshot(spark, sf_dir), fixture_context(spark, sf_dir))


def audit_snapshot(snapshot: Snapshot, as_of=None, **options) -> AuditTables:
    """Audit raw fetches as of a date: the latest fetch of each resource counts, sitemaps are found and read here."""
    return audit(context_inputs(snapshot, snapshot.context(as_of)), **options)


def prepare_sites(sites: DataFrame) -> DataFrame:
    """Site facts with the chosen sitemap's URL (when the snapshot does not carry it)."""
    if "sitemap_url" not in sites.columns:
        sites = sites.withColumn("sitemap_url", F.when(F.col("sitemap_status") == 200,
                                                       F.concat(F.col("domain"), F.lit("/sitemap.xml")))
                                 .otherwise(F.lit("")))
    return sites


# S9
def filter_sitemap_urls(raw: DataFrame, sites: DataFrame) -> DataFrame:
    """Sitemap URLs of sites whose sitemap answered 200, HTML only; scoped targets also by prefix."""
    live = sites.filter(F.col("sitemap_status") == 200).select("site", "domain", *(
        ["path_prefix"] if "path_prefix" in sites.columns else []))
    j = raw.join(live, "site")
    cond = U.is_html_url("loc")
    if "path_prefix" in live.columns:
        cond = cond & ((F.col("path_prefix") == "") | U.matches_prefix("loc", "domain", "path_prefix"))
    return j.filter(cond).select("site", "pos", "loc")


#: What a page carries through the extraction besides its HTML.
PAGE_KEYS = ["site", "page_id", "crawl_order", "url", "final_url", "status_code", "render_ms"]


def build_pages(crawl: DataFrame, cut_lineage: bool = True, partitions: int | None = None,
                homepages: DataFrame | None = None, sites: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The one extraction job, over crawled pages and homepages: (pages, extracted homepages).

    A snapshot is parsed where it lies, split as its reader split it; ``partitions`` spreads the rows round-robin first (for an
    input known to arrive in fewer parts than there are cores). Homepages (S12) count as answered 200 at the site's
    domain, whatever their fetch answered, if they have a body.
    """
    rows = crawl.select(*[c for c in PAGE_KEYS if c in crawl.columns], "html")
    if homepages is not None:
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        given = {"site": F.col("site"), "url": F.col("domain"), "final_url": F.col("domain"), "status_code": F.lit(200),
                 "render_ms": F.lit(0), "html": F.col("html")}
        home = homepages.join(sites.select("site", "domain"), "site").select(
            *[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in rows.columns], F.lit("home").alias("role"))
        rows = rows.withColumn("role", F.lit("page")).unionByName(home)
    if partitions is not None:
        rows = rows.repartition(partitions)
    found = extract_pages(rows)
    if cut_lineage:
        checkpoint_dir(crawl.sparkSession)
        found = found.checkpoint(eager=True)
    if homepages is None:
        return found, None
    return found.filter("role = 'page'").drop("role"), found.filter("role = 'home'").drop("role")


def audit(inputs: AuditInputs, probe_cap: int | None = None, cut_lineage: bool = True,
          root_pages: DataFrame | None = None, pages: DataFrame | None = None,
          partitions: int | None = None, extracted: tuple[DataFrame, DataFrame | None] | None = None) -> AuditTables:
    """The audit DAG. ``extracted``: what ``build_pages`` gave, and ``pages``: page rows made from that (then ``inputs.crawl`` is
    not parsed again); ``partitions``: see ``build_pages``."""
    sites = prepare_sites(inputs.sites)
    homes = None
    if extracted is not None:
        pages, homes = extracted
    elif pages is None:
        pages, homes = build_pages(inputs.crawl, cut_lineage, partitions, inputs.homepages, sites)
    elif cut_lineage:
        checkpoint_dir(pages.sparkSession)
        pages = pages.checkpoint(eager=True)
    sitemap_urls = filter_sitemap_urls(inputs.sitemap_urls_raw, sites)
    edges = L.link_edges(pages)
    if cut_lineage:  # read by probe selection, statuses, C-22/23/24 and views
        edges = edges.checkpoint(eager=True)
    selected = L.probe_targets(edges, pages, probe_cap)
    status = L.link_status(inputs.probes, pages)
    edges_st = L.edge_status(edges, status)
    facts = C.site_facts(pages, sites, sitemap_urls, edges, status, edges_st, root_pages)
    results = C.run_checks(facts)
    if cut_lineage:  # 15 rows per site, read by every score and view
        results = results.checkpoint(eager=True)
    cats, scores = A.site_scorecard(results, sites)
    return AuditTables(pages=pages, sites=sites, sitemap_urls=sitemap_urls, edges=edges, probe_targets=selected,
                       link_status=status, edge_status=edges_st, facts=facts, check_results=results,
                       category_scores=cats, site_scores=scores, homes=homes)


_CACHE: dict = {}
_PAGES: dict = {}


def fixture_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame | None]:
    """Extracted pages and homepages of the fixture, memoised per session and directory."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PAGES:
        inputs = fixture_inputs(spark, sf_dir)
        cores = spark.sparkContext.defaultParallelism
        spread = cores if inputs.crawl.rdd.getNumPartitions() < cores else None
        _PAGES[key] = build_pages(inputs.crawl, True, spread, inputs.homepages, inputs.sites)
    return _PAGES[key]


def audit_fixture(spark: SparkSession, sf_dir: str) -> AuditTables:
    """Audit of the fixture snapshot of ``sf_dir``, memoised per session and directory."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = audit(fixture_inputs(spark, sf_dir), extracted=fixture_pages(spark, sf_dir))
    return _CACHE[key]
