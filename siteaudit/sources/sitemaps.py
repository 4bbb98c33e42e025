"""Robots, sitemap and homepage-fetch sources over snapshot tables.

Snapshot tables (what a crawler wrote, one row per fetched resource; ``sources.context`` picks the
latest of several fetches):

* ``robots(site, status, body)``
* ``sitemap_files(site, sitemap_url, status, body)``  (``.xml`` or decompressed ``.gz``)
* ``site_fetches(site, ua, body_len)``

Sitemap XML is read by one parser per body, in Arrow batches, which alone
decides whether a body is well formed; one bad file gives no URLs and cannot
end the job. Bodies are parsed once; per-file URL lists stay arrays inside
their row (a sitemap file is bounded by the protocol's 50,000 URLs), and only
chosen lists are exploded. Index trees are walked level by level to their end,
each file once however often it is listed, by joins keyed by URL.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit import schema as S
from siteaudit.functions import urls as U
from siteaudit.operators.ordering import running
from siteaudit.session import bounded_batches, checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# S3
def robots_source(robots: DataFrame) -> DataFrame:
    """robots status kept; body kept only on 200, else ''."""
    return robots.select("site", F.col("status").alias("robots_status"),
                         F.when(F.col("status") == 200, F.coalesce("body", F.lit(""))).otherwise(F.lit(""))
                         .alias("robots_txt"))


def locs_of(body: str | None) -> list[str]:
    """Texts of all ``loc`` elements in any declared namespace; none if the body is not well-formed XML."""
    try:
        root = ElementTree.fromstring((body or "").removeprefix("\ufeff"))
    except (ElementTree.ParseError, ValueError):
        return []
    return [e.text or "" for e in root.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == "loc"]


def _xml_locs(bodies: pd.Series) -> pd.Series:
    return bodies.map(locs_of)


def _with_raw_locs(files: DataFrame) -> DataFrame:
    """``files`` with ``raw_locs``: every <loc> text, stripped, non-empty; none for malformed or blank XML."""
    bounded_batches(files.sparkSession)
    raw = F.transform(F.pandas_udf(_xml_locs, "array<string>")(F.coalesce(F.col("body"), F.lit(""))), lambda x: U.strip_ws(x))
    return files.withColumn("raw_locs", F.filter(raw, lambda x: x != ""))


def parsed_files(files: DataFrame) -> DataFrame:
    """(site, url, status, ok, raw_locs): every file parsed once. ``ok``: answered 200 with a body that isn't blank."""
    ok = (F.col("status") == 200) & (U.strip_ws(F.coalesce("body", F.lit(""))) != "")
    return _with_raw_locs(files.select("site", F.col("sitemap_url").alias("url"), "status", "body")).select(
        "site", "url", "status", ok.alias("ok"), "raw_locs")


def locs_on(root) -> Column:
    """The ``raw_locs`` on the host of ``root``."""
    r = F.col(root) if isinstance(root, str) else root
    return F.filter("raw_locs", lambda x: U.same_host(x, r))


def parse_files(files: DataFrame, root_col: str = "root") -> DataFrame:
    """files(+root) -> files with ``locs`` array<string>."""
    return _with_raw_locs(files).withColumn("locs", locs_on(root_col)).drop("raw_locs")


# S5
def is_sitemap_index(locs) -> Column:
    """At least 2 of the first 5 URLs end in .xml/.xml.gz and contain 'sitemap'."""
    l = F.col(locs) if isinstance(locs, str) else locs
    hits = F.filter(F.slice(l, 1, 5), lambda u: (u.endswith(".xml") | u.endswith(".xml.gz"))
                    & F.lower(u).contains("sitemap"))
    return F.size(hits) >= 2


# S7
def sitemap_candidates(sites: DataFrame) -> DataFrame:
    """(site, cand_pos, candidate, cand_url): well-known paths, then robots Sitemap: lines, deduplicated."""
    lines = F.regexp_extract_all(F.coalesce(F.col("robots_txt"), F.lit("")),
                                 F.lit(r"(?im)^[^\S\r\n]*sitemap:[^\S\r\n]*(\S+)"), F.lit(1))
    cands = F.array_distinct(F.concat(F.array(*[F.lit(p) for p in S.SITEMAP_WELL_KNOWN]), lines))
    c = sites.select("site", "domain", F.posexplode(cands).alias("cand_pos", "candidate"))
    url = F.when(F.col("candidate").startswith("http"), F.col("candidate")) \
        .otherwise(F.concat(F.col("domain"), F.col("candidate")))
    return c.select("site", "domain", "cand_pos", "candidate", url.alias("cand_url"))


# S6
def flatten_index(starts: DataFrame, parsed: DataFrame, target: int | None = None,
                  max_fetch: int | None = None) -> DataFrame:
    """URLs of whole sitemap index trees, in document order.

    ``starts(site, cand_pos, cand_url, child_pos, child_url)``: the children of each index candidate; ``parsed``: see
    ``parsed_files``. Returns ``(site, cand_pos, seq, loc)``. A child's same-host test uses the child's own URL as root.

    Each level is one join with the files. A file is read once for a candidate, where it stands nearest to the top, and there in the
    order of the listing; files listed again, the candidate itself among them, are left out, so that cycles end. ``target`` stops
    once so many URLs are collected and ``max_fetch`` after so many files, both in document order; neither is set by default.
    """
    key = ["site", "cand_pos"]
    checkpoint_dir(starts.sparkSession)
    own = parsed.withColumn("locs", locs_on("url"))
    own = own.withColumn("is_index", F.col("ok") & is_sitemap_index("locs"))
    indexes = own.filter("is_index").select("site", "url", "locs")
    facts = own.select("site", "url", "ok", "is_index", F.size("locs").cast("bigint").alias("n"))
    seen = starts.select(*key, F.col("cand_url").alias("url")).distinct()
    listed = starts.select(*key, F.array(F.col("child_pos").cast("int")).alias("path"), F.col("child_url").alias("url"))
    nodes = None
    while nodes is None or not listed.isEmpty():
        level = listed.groupBy(*key, "url").agg(F.min("path").alias("path")).join(seen, [*key, "url"], "left_anti")
        level = level.join(facts, ["site", "url"], "left").select(
            *key, "url", "path", F.coalesce("is_index", F.lit(False)).alias("is_index"),
            F.when(F.col("ok") & ~F.col("is_index"), F.col("n")).otherwise(0).cast("bigint").alias("n")).checkpoint(eager=True)
        nodes = level if nodes is None else nodes.unionByName(level)
        seen = seen.unionByName(level.select(*key, "url"))
        listed = level.filter("is_index").join(indexes, ["site", "url"]) \
            .select(*key, "path", F.posexplode("locs").alias("i", "url")) \
            .select(*key, F.concat("path", F.array(F.col("i").cast("int"))).alias("path"), "url")
    placed = running(nodes.select(*key, "url", "path", "n"), key, ["path"], "n")
    if max_fetch is not None:
        placed = placed.filter(F.col("place") <= max_fetch)
    if target is not None:
        placed = placed.filter(F.col("before") < target)
    leaves = placed.filter("n > 0").join(own.select("site", "url", "locs"), ["site", "url"])
    return leaves.select(*key, "before", F.posexplode("locs").alias("i", "loc")).select(
        *key, (F.col("before") + F.col("i") + 1).alias("seq"), "loc")


# S8
def candidate_files(sites: DataFrame, parsed: DataFrame) -> DataFrame:
    """Candidates that answered: (site, cand_pos, cand_url, status, locs, is_index); missing ones count as not found."""
    found = sitemap_candidates(sites).join(parsed.filter("ok").withColumnRenamed("url", "cand_url"), ["site", "cand_url"])
    found = found.withColumn("locs", locs_on("domain"))
    return found.select("site", "cand_pos", "cand_url", "status", "locs", is_sitemap_index("locs").alias("is_index"))


def index_starts(found: DataFrame) -> DataFrame:
    return found.filter("is_index").select("site", "cand_pos", "cand_url", F.posexplode("locs").alias("child_pos", "child_url"))


def choose_sitemap(sites: DataFrame, files: DataFrame, target: int | None = None,
                   max_fetch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pick each site's sitemap: the first candidate answering 200 with a non-blank body that
    yields URLs (index files flattened); else the last such candidate, with no URLs.

    Returns (choice(site, sitemap_url, sitemap_status, n_urls), urls(site, pos, loc)).
    ``target`` and ``max_fetch``: see ``flatten_index``.
    """
    checkpoint_dir(sites.sparkSession)
    parsed = parsed_files(files).checkpoint(eager=True)      # read at every level
    c = candidate_files(sites, parsed).checkpoint(eager=True)
    flat = flatten_index(index_starts(c), parsed, target, max_fetch)
    flat_n = flat.groupBy("site", "cand_pos").agg(F.count(F.lit(1)).alias("n_flat"))
    c = c.join(flat_n, ["site", "cand_pos"], "left").withColumn(
        "n_urls", F.when(F.col("is_index"), F.coalesce("n_flat", F.lit(0))).otherwise(F.size("locs")))
    per_site = c.groupBy("site").agg(
        F.min_by(F.struct("cand_pos", "cand_url", "status", "n_urls", "is_index"),
                 F.when(F.col("n_urls") > 0, F.col("cand_pos"))).alias("good"),
        F.max_by(F.struct("cand_pos", "cand_url", "status"), "cand_pos").alias("last"))
    choice = sites.select("site").join(per_site, "site", "left").select(
        "site",
        F.coalesce(F.col("good.cand_url"), F.col("last.cand_url"), F.lit("")).alias("sitemap_url"),
        F.coalesce(F.col("good.status"), F.col("last.status"), F.lit(0)).alias("sitemap_status"),
        F.coalesce(F.col("good.n_urls"), F.lit(0)).cast("bigint").alias("n_urls"),
        F.col("good.cand_pos").alias("cand_pos"), F.coalesce(F.col("good.is_index"), F.lit(False)).alias("is_index")) \
        .checkpoint(eager=True)
    plain = c.join(choice.filter(~F.col("is_index")).select("site", "cand_pos"), ["site", "cand_pos"], "left_semi") \
        .select("site", F.posexplode("locs").alias("pos", "loc")).select("site", F.col("pos").cast("bigint"), "loc")
    flat_urls = flat.join(choice.filter("is_index").select("site", "cand_pos"), ["site", "cand_pos"], "left_semi") \
        .select("site", (F.col("seq") - 1).alias("pos"), "loc")
    return choice.drop("cand_pos", "is_index"), plain.unionByName(flat_urls)


# S10
#: A sitemap file has 50 MB at most; a stream that gives more is no sitemap.
MAX_BODY_BYTES = 50 * 1024 * 1024
INFLATED = "struct<body: string, error: string>"


def inflate(content: bytes | None, limit: int = MAX_BODY_BYTES) -> tuple[str, str]:
    """Text and error of a fetched body: gzip members are inflated piece by piece, anything else is text already.

    Errors: ``too large`` beyond ``limit`` bytes of text, ``broken`` for a stream that ends early or isn't valid; both give no text.
    Bytes that are no UTF-8 become replacement characters.
    """
    content = content or b""
    if content[:2] != b"\x1f\x8b":
        return (content.decode("utf-8", "replace"), "") if len(content) <= limit else ("", "too large")
    parts, size, rest = [], 0, content
    try:
        while rest[:2] == b"\x1f\x8b":       # several members are one body
            stream, todo = zlib.decompressobj(wbits=31), rest
            while not stream.eof and todo:
                parts.append(stream.decompress(todo, 1 << 16))
                todo = stream.unconsumed_tail
                size += len(parts[-1])
                if size > limit:
                    return "", "too large"
            if not stream.eof:
                return "", "broken"
            rest = stream.unused_data
    except zlib.error:
        return "", "broken"
    return b"".join(parts).decode("utf-8", "replace"), ""


def inflated_bodies(files: DataFrame, content: str = "content", limit: int = MAX_BODY_BYTES) -> DataFrame:
    """``files`` with ``body`` and ``error`` in place of the fetched bytes ``content``."""
    bounded_batches(files.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([inflate(c, limit) for c in batch], columns=["body", "error"])

    return files.withColumn("_text", F.pandas_udf(run, INFLATED)(F.col(content))) \
        .withColumns({"body": F.col("_text.body"), "error": F.col("_text.error")}).drop("_text", content)


def read_gz_sitemaps(spark, path: str, limit: int = MAX_BODY_BYTES) -> DataFrame:
    """(file, body, error) of stored sitemap files, compressed or not."""
    return inflated_bodies(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"), limit=limit)


# S11
def spa_detect(site_fetches: DataFrame) -> DataFrame:
    """Homepage body length under the two user agents differs by more than 30 percent.
    A missing response or an empty second body gives false."""
    p = site_fetches.groupBy("site").agg(
        F.max(F.when(F.col("ua") == "default", F.col("body_len"))).alias("a"),
        F.max(F.when(F.col("ua") == "googlebot", F.col("body_len"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    diff = F.abs(a - b) / F.greatest(a, b, F.lit(1))
    return p.select("site", F.when(a.isNull() | b.isNull() | (b == 0), F.lit(False)).otherwise(diff > 0.30)
                    .alias("spa_detected"))
