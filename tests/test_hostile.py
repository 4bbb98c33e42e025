"""Broken pages, sitemaps and settings end neither the job nor each other."""

import json

import pytest
from pyspark.sql import functions as F

from siteaudit.functions.html_extract import extract_pages
from siteaudit.operators import links as L
from siteaudit.sources.sitemaps import locs_of, parse_files

BAD_HREFS = ["http://[x", "https://[abc]/", "http://a℀b.c/", "//[", "http://x:port/"]


def test_bad_links_are_skipped_and_the_page_stays(spark):
    html = "<title>T</title>" + "".join(f'<a href="{h}">b</a>' for h in BAD_HREFS) + '<a href="/ok">ok</a>'
    rows = [("s", 1, u, u, 200, html) for u in ("https://s.example/", None, "http://[x")]
    got = extract_pages(spark.createDataFrame(rows, "site string, crawl_order int, url string, final_url string, "
                                                    "status_code int, html string")).collect()
    assert [r.title for r in got] == ["T"] * 3
    assert "https://s.example/ok" in [x.target for r in got for x in r.internal_links]


@pytest.mark.parametrize("script, expected", [
    ('{"a": NaN, "b": [Infinity, 1]}', [{"a": None, "b": [None, 1]}]),
    (r'{"a": "\ud83d"}', [{"a": "?"}]),
    ("[" * 100000, None),
    ("{broken", None),
])
def test_json_ld_is_strict_or_reported(spark, script, expected):
    html = f'<script type="application/ld+json">{script}</script>'
    got = extract_pages(spark.createDataFrame([("s", "https://s.example/", "", 200, html)],
                                              "site string, url string, final_url string, status_code int, html string")).first()
    blocks = [json.loads(b) for b in got.schema_blocks]
    assert blocks == expected if expected else blocks[0]["__parse_error"] is True


NS = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://s.example/a</loc></url></urlset>'


@pytest.mark.parametrize("body, locs", [
    (NS, ["https://s.example/a"]), ("﻿" + NS, ["https://s.example/a"]), (NS + "tail", []), (NS + NS, []),
    ("<urlset><x:loc>https://s.example/a</x:loc></urlset>", []), (None, []), ("", []), ("\ud83d".encode("utf-8", "replace").decode(), []),
    ("<u><loc>https://s.example/?a=1<![CDATA[&]]>b=2</loc></u>", ["https://s.example/?a=1&b=2"]),
])
def test_one_parser_judges_sitemaps(spark, body, locs):
    assert locs_of(body) == locs
    rows = [("s", body, "https://s.example/"), ("s", NS, "https://s.example/")]
    got = parse_files(spark.createDataFrame(rows, "site string, body string, root string")).collect()
    assert sorted(map(list, (r.locs for r in got))) == sorted([locs, ["https://s.example/a"]])


def test_no_known_status_is_dropped(spark):
    probes = spark.createDataFrame([("s", f"https://s/{i}", 404) for i in range(200)], "site string, target string, status int")
    pages = spark.createDataFrame([("s", "https://s/", "https://s/", 200, 1)],
                                  "site string, url string, final_url string, status_code int, crawl_order int")
    assert L.link_status(probes, pages).where(F.col("status") == 404).count() == 200
