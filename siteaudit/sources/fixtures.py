"""Crawl-snapshot fixtures derived from the driver's ``pages`` table.

The driver's ``pages(page_id, url, html)`` carries raw web pages but no crawl
metadata. These statements derive a deterministic crawl snapshot from it
(status codes, render times, head tags, JSON-LD, robots files, HSTS headers,
sitemap entries and link probes), keyed by ``site``. The same text runs on
Spark SQL (``{pages}``/``{crawl}`` bound to DataFrames) and on DuckDB (bound
to view names), which is how the oracle SQL embeds them.

Note on scale: the fixture's SQL numbers pages per site with window functions
over ``site``. On Spark the same numbers come from ranges of the pages' keys
(``numbered_pages``), so that no task holds a site and bodies aren't sorted by
site. A real snapshot carries ``crawl_order`` from the crawler.
"""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.operators.ordering import running

CRAWL_SQL = """WITH b AS (
  SELECT page_id, url, html,
         lower(split_part(url, '/', 3)) AS host,
         split_part(url, '#', 1) AS final_url
  FROM {pages}
), s AS (
  SELECT *, CASE WHEN host LIKE 'www.%' THEN substr(host, 5) ELSE host END AS site FROM b
), o AS (
  SELECT *,
    CAST(row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS BIGINT) AS crawl_order,
    lead(final_url) OVER (PARTITION BY site ORDER BY page_id) AS nxt,
    lag(final_url) OVER (PARTITION BY site ORDER BY page_id) AS prv
  FROM s
), h AS (
  SELECT *,
    concat(
      CASE WHEN page_id % 7 <> 0 THEN concat('<meta name="description" content="', repeat('d', CAST(70 + page_id * 13 % 110 AS INT)), '">') ELSE '' END,
      CASE WHEN page_id % 10 = 8 THEN '' ELSE concat('<link rel="canonical" href="',
        CASE WHEN page_id % 41 = 5 THEN 'https://other.example/x' WHEN page_id % 43 = 6 THEN 'https://[broken/x' WHEN page_id % 23 = 4 THEN '/rel' ELSE final_url END, '">') END,
      CASE WHEN page_id % 5 = 1 THEN '' ELSE '<meta property="og:title" content="t">' END,
      CASE WHEN page_id % 4 = 2 THEN '' ELSE '<meta property="og:description" content="d">' END,
      CASE WHEN page_id % 3 = 0 THEN '' ELSE '<meta property="og:image" content="i.png">' END,
      CASE WHEN page_id % 6 = 5 THEN '' ELSE '<meta property="og:url" content="u">' END,
      CASE WHEN page_id % 9 = 4 THEN '<meta property="og:site_name" content=" A &amp; B "><meta property="og:title" content="later"><meta property="og:type" content="">' ELSE '' END,
      CASE WHEN page_id % 4 = 1 THEN '<link rel="alternate" hreflang="de" href="/de"><link rel="alternate" hreflang="x-default" href=" / ">'
        WHEN page_id % 4 = 3 THEN '<link rel="alternate" hreflang="fr" href=""><link rel="alternate" hreflang="es" href="/es?a=1&amp;b=2">' ELSE '' END,
      CASE WHEN page_id % 12 = 7 THEN '<script type="application/ld+json">{"@type":"A1","@graph":[{"@type":["B2","B1"],"@graph":[{"@graph":[{"@type":"D4","@graph":[{"@type":"E5"}]},"x"]},{"@type":"C3"}]}]}</script>' ELSE '' END,
      CASE page_id % 6
        WHEN 0 THEN '<script type="application/ld+json">{"@type":"FAQPage"}</script>'
        WHEN 1 THEN '<script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"n","url":"u"},{"@type":"WebSite"}]}</script>'
        WHEN 2 THEN '<script type="application/ld+json">{bad</script>'
        WHEN 3 THEN '<script type="application/ld+json">{"@type":["WebPage","LocalBusiness"],"name":"n","url":"u","logo":"l","sameAs":["x"]}</script>'
        WHEN 5 THEN '<script type="application/ld+json">[{"@type":"Article"},{"@type":"NGO","name":"n","logo":""}]</script>'
        ELSE '' END
    ) AS head_extra,
    concat(
      CASE WHEN page_id % 17 = 3 THEN '<h1>Second heading</h1>' ELSE '' END,
      CASE WHEN page_id % 4 = 0 THEN '<h2>What is it?</h2><h2>Why now? </h2>' ELSE '<h2>Overview</h2>' END,
      CASE WHEN nxt IS NULL THEN '' ELSE concat('<a href="', nxt, '">', CASE WHEN page_id % 6 = 0 THEN 'Read more' ELSE 'Next topic' END, '</a>') END,
      CASE WHEN prv IS NULL OR page_id % 3 = 0 THEN '' ELSE concat('<a href="', prv, '#x">', CASE WHEN page_id % 8 = 1 THEN 'here' ELSE 'Earlier topic' END, '</a>') END,
      CASE WHEN page_id % 12 < 4 THEN concat('<a href="https://', site, '/old/', CAST(page_id AS STRING), '">Archive</a>') ELSE '' END,
      '<a href="https://elsewhere.example/y">Off site</a><a href="mailto:a@b.c">Mail</a><a href="/files/report.pdf">Report</a>',
      '<img src="a.png" alt="a"><img src="b.png"><img src="c.png" role="presentation">',
      CASE page_id % 8
        WHEN 1 THEN '<h2>Open part<h3>Sub part</h3><a href="/open/one">Open one<a href="/open/two">Open two</a>'
        WHEN 3 THEN '<table><tr><td><a href="/cell/one">Cell one<td><h2>Cell two<p>Cell text<tr><td><a href="/cell/three">Cell three</table>'
        WHEN 5 THEN '<ul><li><h2>First item<li><h2>Second item</ul><dl><dt>Term<dd><h2>Meaning</h2><dt>Other</dl><select><option>A<option>B</select>'
        WHEN 6 THEN '<a href="/block"><div>In block</a>still in block</div></a><h1>Late heading<p>Late text'
        ELSE '' END
    ) AS body_extra
  FROM o
)
SELECT page_id, site, crawl_order, url, final_url,
  CASE WHEN page_id % 5 = 3 THEN 'Mozilla/5.0 (X11; Linux)' ELSE 'Mozilla/5.0 (compatible; GoogleBot/2.1)' END AS ua,
  {page_headers} AS headers,
  CASE WHEN page_id % 23 = 7 THEN 404 WHEN page_id % 47 = 3 THEN 500 WHEN page_id % 53 = 2 THEN 0 ELSE 200 END AS status_code,
  CASE WHEN page_id % 53 = 2 THEN 0 ELSE CAST(200 + (length(site) * 977 + page_id * 131) % 6200 AS INT) END AS render_ms,
  replace(replace(replace(
     CASE WHEN page_id % 19 = 6 THEN replace(replace(html, '<h1>', '<h3>'), '</h1>', '</h3>') ELSE html END,
     '</head>', concat(head_extra, '</head>')),
     '</article>', concat(body_extra, '</article>')),
     '<title>', CASE WHEN page_id % 13 = 5 THEN concat('<title>', repeat('long ', 9)) ELSE '<title>' END) AS html
FROM h"""

# The sites of the snapshot. What is known of them comes from raw fetches, of which several dates exist:
# AS_OF is the date of the audit, STALE lies before it, LATER after it.
SITE_LIST_SQL = """SELECT site, concat(CASE WHEN min(page_id) % 13 = 6 THEN 'https://[' ELSE 'https://' END, site) AS domain
FROM {crawl} GROUP BY site"""
AS_OF, STALE, LATER = "DATE '2026-05-20'", "DATE '2026-04-02'", "DATE '2026-06-30'"

ROBOTS_SQL = f"""WITH g AS (SELECT site, min(page_id) AS seed FROM {{crawl}} GROUP BY site)
SELECT site, {AS_OF} AS fetched_at, CASE seed % 10 WHEN 0 THEN 404 WHEN 7 THEN 403 ELSE 200 END AS status,
  CASE seed % 10
    WHEN 1 THEN concat('User-agent: *', chr(10), 'Disallow: /', chr(10))
    WHEN 2 THEN concat('User-agent:*', chr(10), 'Disallow: /', chr(10), chr(10), 'User-agent: GPTBot', chr(10), 'Allow: /', chr(10))
    WHEN 3 THEN concat('User-agent: *', chr(10), 'Allow: /', chr(10), 'Sitemap: https://', site, '/sm.xml', chr(10))
    WHEN 4 THEN concat('User-agent: ClaudeBot', chr(10), 'Disallow: /', chr(10), chr(10), 'User-agent: GPTBot', chr(10), 'Disallow: /', chr(10))
    WHEN 5 THEN concat('User-agent: GPTBot', chr(10), 'User-agent: ClaudeBot', chr(10), 'Allow: /', chr(10))
    WHEN 6 THEN '   '
    WHEN 8 THEN concat('# note', chr(13), chr(10), 'user-agent: google-extended', chr(13), chr(10), 'disallow: /private', chr(13), chr(10))
    WHEN 9 THEN concat('User-agent: OAI-SearchBot', chr(10), 'Allow: /', chr(10), 'User-agent: *', chr(10), 'Allow: /', chr(10))
    ELSE '' END AS body
FROM g WHERE seed % 17 <> 16
UNION ALL SELECT site, {STALE}, 500, 'an older answer' FROM g
UNION ALL SELECT site, {LATER}, 200, concat('User-agent: *', chr(10), 'Disallow: /', chr(10)) FROM g"""

HOMEPAGES_SQL = f"""WITH g AS (SELECT site, min(page_id) AS seed, min(final_url) AS lo, max(final_url) AS hi FROM {{crawl}} GROUP BY site),
f AS (SELECT *, 'Mozilla/5.0 (compatible; Googlebot/2.1)' AS ua, {AS_OF} AS fetched_at FROM g WHERE seed % 19 <> 18
  UNION ALL SELECT *, 'Mozilla/5.0 (X11; Linux)' AS ua, {AS_OF} AS fetched_at FROM g
  UNION ALL SELECT *, 'Mozilla/5.0 (compatible; Googlebot/2.1)' AS ua, {STALE} AS fetched_at FROM g WHERE seed % 19 <> 18
  UNION ALL SELECT *, 'Mozilla/5.0 (compatible; Googlebot/2.1)' AS ua, {LATER} AS fetched_at FROM g),
h AS (SELECT *, fetched_at = {AS_OF} AS now, ua LIKE '%Googlebot%' AS bot FROM f)
SELECT site, ua, fetched_at, CASE WHEN now AND seed % 11 = 10 AND bot THEN 0 WHEN seed % 13 = 5 THEN 503 ELSE 200 END AS status,
  {{home_headers}} AS headers,
  CASE WHEN now AND seed % 11 = 10 AND bot THEN ''
    WHEN NOT now THEN '<html><body><a href="/outdated">Outdated</a></body></html>'
    ELSE concat('<html lang="en"><head><title>Home</title>',
      CASE seed % 4 WHEN 0 THEN '<script type="application/ld+json">{{"@type":"Organization","name":"n","url":"u","logo":"l","sameAs":["x"]}}</script>'
        WHEN 1 THEN '<script type="application/ld+json">[{{"@type":"Corporation","name":"n"}},{{"@type":"WebSite"}}]</script>'
        WHEN 2 THEN '<script type="application/ld+json">{{bad</script>' ELSE '' END,
      '</head><body><h1>Home</h1><a href="', lo, '">First</a><a href="/hub/', CAST(seed AS STRING), '#part">Hub</a><a href="', hi,
      '">Last</a><a href="hub/more">More</a><a href="https://elsewhere.example/h">Off site</a><p>',
      repeat('x', CAST(1000 + seed * 37 % 4000 + CASE WHEN bot AND seed % 3 = 0 THEN 900 ELSE 0 END AS INT)), '</p></body></html>') END AS html
FROM h"""

# Header maps, as (name, SQL value or NULL); each engine builds its own map type.
PAGE_HEADERS = [
    ("Content-Type", "CASE WHEN page_id % 11 = 4 THEN NULL ELSE 'text/html; charset=utf-8' END"),
    ("content-TYPE", "CASE WHEN page_id % 37 = 1 THEN 'application/xhtml+xml' END"),
    ("X-Robots-Tag", "CASE WHEN page_id % 9 = 2 THEN 'noindex' END")]
HOME_HEADERS = [
    ("Server", "'test'"),
    ("Strict-Transport-Security", "CASE WHEN NOT now THEN 'max-age=1' ELSE CASE seed % 5 WHEN 0 THEN NULL "
     "WHEN 1 THEN 'max-age=31536000; includeSubDomains' WHEN 2 THEN 'max-age=3600' WHEN 3 THEN 'includeSubDomains' "
     "ELSE CASE WHEN seed % 3 = 1 THEN concat('max-age=', repeat('9', 4400)) ELSE 'MAX-AGE = 99999999999999999999' END END END")]

# What the sitemaps list: pages, unlinked pages, documents (more of them on sites whose sitemap is an index).
SITEMAP_ENTRIES_SQL = """WITH g AS (SELECT site, min(page_id) AS seed FROM {crawl} GROUP BY site)
SELECT c.site, c.crawl_order AS pos, c.final_url AS loc FROM {crawl} c WHERE c.page_id % 9 <> 8
UNION ALL
SELECT c.site, 100000 + c.crawl_order, concat('https://', c.site, '/ghost/', CAST(c.page_id AS STRING)) FROM {crawl} c WHERE c.page_id % 6 = 1
UNION ALL
SELECT c.site, 200000 + c.crawl_order, concat('https://', c.site, '/doc/', CAST(c.page_id AS STRING), '.pdf') FROM {crawl} c WHERE c.page_id % 25 = 0
UNION ALL
SELECT c.site, 300000 + c.crawl_order, concat('https://', c.site, '/scan/', CAST(c.page_id AS STRING), '.pdf') FROM {crawl} c JOIN g ON g.site = c.site WHERE g.seed % 3 = 1
UNION ALL
SELECT c.site, 400000 + c.crawl_order, concat('https://', c.site, '/sheet/', CAST(c.page_id AS STRING), '.xlsx') FROM {crawl} c JOIN g ON g.site = c.site WHERE g.seed % 3 = 1"""

PROBES_SQL = """SELECT c.site, concat('https://', c.site, '/old/', CAST(c.page_id AS STRING)) AS target,
  CASE c.page_id % 4 WHEN 0 THEN 404 WHEN 1 THEN 200 WHEN 2 THEN 0 ELSE 503 END AS status
FROM {crawl} c WHERE c.page_id % 12 < 4"""

# Sitemap files. A quarter of the sites has none. Layout 0: one plain file. Layout 2: a malformed /sitemap.xml, the URLs are in
# /sitemap_index.xml. Layout 1 (and every site of 16,000 pages or more): an index of indexes of files of four
# positions; the root lists itself, every inner index lists the root and the first file again, and one file is missing.
SITEMAP_FILES_SQL = f"""WITH g AS (SELECT site, min(page_id) AS seed, CASE WHEN count(*) >= 16000 THEN 1 ELSE min(page_id) % 3 END AS layout
  FROM {{crawl}} GROUP BY site),
live AS (
  SELECT r.site, r.pos, g.seed, g.layout, concat('<url><loc>', replace(r.loc, '&', '&amp;'), '</loc></url>') AS x,
    CAST(floor(r.pos / 4) AS BIGINT) AS leaf, CAST(floor(r.pos / 32) AS BIGINT) AS mid
  FROM {{sitemap_entries}} r JOIN g ON r.site = g.site WHERE g.seed % 4 <> 0),
lines AS (
  SELECT site, '/sitemap.xml' AS f, pos, x FROM live WHERE layout = 0
  UNION ALL SELECT site, '/sitemap_index.xml', pos, x FROM live WHERE layout = 2
  UNION ALL SELECT site, concat('/sitemap-', CAST(leaf AS STRING), '.xml'), pos, x FROM live WHERE layout = 1 AND leaf <> 1
  UNION ALL SELECT DISTINCT site, concat('/sitemap-m', CAST(mid AS STRING), '.xml'), leaf,
    concat('<sitemap><loc>https://', site, '/sitemap-', CAST(leaf AS STRING), '.xml</loc></sitemap>') FROM live WHERE layout = 1
  UNION ALL SELECT DISTINCT site, concat('/sitemap-m', CAST(mid AS STRING), '.xml'), CAST(-1 AS BIGINT),
    concat('<sitemap><loc>https://', site, '/sitemap.xml</loc></sitemap><sitemap><loc>https://', site, '/sitemap-0.xml</loc></sitemap>')
    FROM live WHERE layout = 1
  UNION ALL SELECT DISTINCT site, '/sitemap.xml', mid, concat('<sitemap><loc>https://', site, '/sitemap-m', CAST(mid AS STRING), '.xml</loc></sitemap>')
    FROM live WHERE layout = 1
  UNION ALL SELECT DISTINCT site, '/sitemap.xml', CAST(-1 AS BIGINT), concat('<sitemap><loc>https://', site, '/sitemap.xml</loc></sitemap>')
    FROM live WHERE layout = 1)
SELECT site, concat('https://', site, f) AS sitemap_url, {AS_OF} AS fetched_at, 200 AS status,
  concat('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', {{agg_x}}, '</urlset>') AS body FROM lines GROUP BY site, f
UNION ALL SELECT DISTINCT site, concat('https://', site, '/sitemap.xml'), {AS_OF}, 200, '<urlset><url><loc>broken' FROM live WHERE layout = 2
UNION ALL SELECT DISTINCT site, concat('https://', site, '/sitemap.xml'), {STALE}, 200,
  concat('<urlset><url><loc>https://', site, '/outdated</loc></url></urlset>') FROM live
UNION ALL SELECT site, concat('https://', site, '/sitemap.xml'), {LATER}, 200,
  concat('<urlset><url><loc>https://', site, '/too-new</loc></url></urlset>') FROM g"""

# Audit requests: whole-site audits of every site, plus a scoped audit of the
# first page's top-level folder for every fifth site.
TARGETS_SQL = """WITH g AS (SELECT site, min(page_id) AS seed FROM {crawl} GROUP BY site),
f AS (SELECT c.site, split_part(c.final_url, '/', 4) AS seg FROM {crawl} c JOIN g ON c.site = g.site AND c.page_id = g.seed)
SELECT g.site, concat('https://', g.site) AS root, '' AS path_prefix, 20 AS max_pages FROM g
UNION ALL
SELECT f.site, concat('https://', f.site), concat('/', f.seg), 20 FROM f JOIN g ON f.site = g.site
WHERE g.seed % 5 = 2 AND f.seg <> '' AND instr(f.seg, '?') = 0"""

_counter = [0]

#: Every table of the snapshot, in an order in which each uses only those before it.
TABLES = {"crawl": CRAWL_SQL, "site_list": SITE_LIST_SQL, "robots": ROBOTS_SQL, "homepages": HOMEPAGES_SQL,
          "sitemap_entries": SITEMAP_ENTRIES_SQL, "probes": PROBES_SQL, "sitemap_files": SITEMAP_FILES_SQL, "targets": TARGETS_SQL}


def spark_sql_text(sql: str) -> str:
    # Ordered string aggregation; written with collect_list + array_sort since
    # listagg ... WITHIN GROUP trips an analyzer error inside these CTEs.
    sql = sql.replace("{agg_x}", "array_join(transform(array_sort(collect_list(struct(pos, x))), e -> e.x), '')")
    for name, headers in (("page_headers", PAGE_HEADERS), ("home_headers", HOME_HEADERS)):
        pairs = ", ".join(f"'{k}', {v}" for k, v in headers)
        sql = sql.replace("{%s}" % name, f"map_filter(map({pairs}), (k, v) -> v IS NOT NULL)")
    return sql


def bind(spark: SparkSession, sql: str, **dfs: DataFrame) -> DataFrame:
    """Run fixture SQL on Spark with ``{name}`` placeholders bound to DataFrames."""
    text = spark_sql_text(sql)
    for name, df in dfs.items():
        _counter[0] += 1
        view = f"sa_{name}_{_counter[0]}"
        df.createOrReplaceTempView(view)
        text = text.replace("{%s}" % name, view)
    return spark.sql(text)


def duck(sql: str) -> str:
    """The same fixture SQL for DuckDB, placeholders bound to CTE names."""
    sql = sql.replace("{agg_x}", "string_agg(x, '' ORDER BY pos)")
    for name, headers in (("page_headers", PAGE_HEADERS), ("home_headers", HOME_HEADERS)):
        pairs = ", ".join(f"{{'key': '{k}', 'value': {v}}}" for k, v in headers)
        sql = sql.replace("{%s}" % name, f"map_from_entries(list_filter([{pairs}], lambda e: e.value IS NOT NULL))")
    for name in ("pages", *TABLES):
        sql = sql.replace("{%s}" % name, name)
    return sql


# CTE prefix for oracle SQL: every fixture table as a named CTE.
def duck_fixture_ctes() -> str:
    return ",\n".join(f"{name} AS ({duck(sql)})" for name, sql in TABLES.items())


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


#: The parts of CRAWL_SQL before and after the windows over ``site``.
SITES_OF_PAGES = CRAWL_SQL.split(", o AS (")[0]
CRAWL_OF_NUMBERED = "WITH h AS (" + CRAWL_SQL.split("), h AS (")[1].replace("FROM o\n", "FROM {numbered}\n")


def numbered_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Stored pages with ``crawl_order``, ``nxt`` and ``prv``: table ``o`` of CRAWL_SQL.

    Only keys are ordered, in ranges of site and page_id, however many pages a site has. Bodies are joined by where their
    rows are stored, since page_ids may repeat.
    """
    # the rows' places go through the SQL, which names its columns, inside the html column
    row = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    with_site = bind(spark, SITES_OF_PAGES + " SELECT * FROM s", pages=pages.select("page_id", "url", "html", *row)
                     .withColumn("html", F.struct("html", "_file", "_row")).drop("_file", "_row"))
    s = with_site.select("page_id", "url", "host", "final_url", "site", "html.*")
    # a site may be null, which is a group of its own here and joins nothing
    keys = s.select("_file", "_row", "page_id", "final_url", F.coalesce("site", F.lit("")).alias("_site"),
                    F.col("site").isNull().alias("_none"), F.lit(1).cast("bigint").alias("_one"))
    site = ["_site", "_none"]
    placed = running(keys, site, ["page_id", "_file", "_row"], "_one").checkpoint(eager=True)

    def beside(step: int, name: str) -> DataFrame:
        return placed.select(*site, (F.col("place") - step).alias("place"), F.col("final_url").alias(name))

    found = placed.join(beside(1, "nxt"), [*site, "place"], "left").join(beside(-1, "prv"), [*site, "place"], "left")
    return s.join(found.select("_file", "_row", (F.col("place") - 1).alias("crawl_order"), "nxt", "prv"), ["_file", "_row"])


_SNAPSHOTS: dict = {}


def snapshot(spark: SparkSession, sf_dir: str) -> dict:
    """All fixture tables of ``sf_dir``, materialised once per session.

    A real audit reads its snapshot tables from storage; the fixture stands in
    for them and is cut from its SQL lineage with ``checkpoint`` (into the
    session's ``spark.checkpoint.dir``) so downstream plans start from tables.
    """
    from siteaudit.session import checkpoint_dir

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SNAPSHOTS:
        checkpoint_dir(spark)
        tables = {"pages": read_pages(spark, sf_dir)}
        for name, sql in TABLES.items():
            used = {n: df for n, df in tables.items() if "{%s}" % n in sql}
            if name == "crawl":
                sql, used = CRAWL_OF_NUMBERED, {"numbered": numbered_pages(spark, tables["pages"])}
            tables[name] = bind(spark, sql, **used).checkpoint(eager=True)
        _SNAPSHOTS[key] = tables
    return _SNAPSHOTS[key]


def with_content(files: DataFrame) -> DataFrame:
    """Sitemap files as fetched bytes: gzip streams, of which those with a body of 7 n + 3 characters end early."""
    def packed(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: gzip.compress(b.encode()) if len(b) % 7 != 3 else gzip.compress(b.encode())[:-9])

    return files.withColumn("content", F.pandas_udf(packed, "binary")("body")).drop("body")
