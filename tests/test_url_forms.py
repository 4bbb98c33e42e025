"""URL functions give what their item-by-item forms gave, and take a URL apart a few times only."""

from urllib.parse import urlparse

from pyspark.sql import functions as F

from siteaudit import schema as S
from siteaudit.functions import urls as U
from siteaudit.operators import checks as C

URLS = ["", "/", "//", "https://s.test", "https://s.test/", "https://S.test//", "https://s.test/a/", "https://s.test/a//?q=1", "https://s.test/a/;p",
        "https://s.test/x.PDF", "https://s.test/x.pdf/", "https://s.test/xpdf", "https://s.test/feed/x", "https://s.test/a\n", "https://s.test/a/\n",
        "https://s.test/x.pdf\n", "https://s.test/?oEmbed=1", "https://s.test/?p=1", "https://[s.test/", "https://s.test/é.txt", "a b/c", "#f"]



def test_urls_are_judged_as_item_by_item(spark):
    """Held against the former item-by-item forms."""
    def trimmed(url):
        p = U.url_path(url)
        p = F.when(p == "", F.lit("/")).otherwise(p)
        return F.when((p != "/") & p.endswith("/"), F.regexp_replace(p, "/+$", "")).otherwise(p)

    def html(url):
        path, query = F.lower(U.url_path(url)), F.lower(U.url_query(url))
        ok = U.url_is_parseable(url)
        for e in S.SKIP_EXTENSIONS:
            ok = ok & ~path.endswith(e)
        for f in S.SKIP_PATH_FRAGMENTS:
            ok = ok & ~path.contains(f)
        for n in S.SKIP_QUERY_NEEDLES:
            ok = ok & ~query.contains(n)
        return ok

    df = spark.createDataFrame([(u,) for u in URLS] + [(None,)], "url string")
    rows = df.select("url", U._trimmed_path("url").alias("a"), trimmed("url").alias("b"), U.is_html_url("url").alias("c"), html("url").alias("d")).collect()
    assert [(r.url, r.a, r.c) for r in rows] == [(r.url, r.b, r.d) for r in rows]
    assert {r.c for r in rows} == {True, False}
    plain = {r.url: r.a for r in rows if r.url and "\n" not in r.url and "[" not in r.url and ";" not in r.url}
    assert all(a == ((urlparse(u).path or "/").rstrip("/") if urlparse(u).path not in ("", "/") else "/") for u, a in plain.items())
    # each part of the URL is read a fixed number of times, not once for each item of a list
    shown = str(U.is_html_url("url"))
    assert "exists(" not in shown.lower() and shown.lower().count("regexp_extract") <= 5
    assert str(U._trimmed_path("url")).lower().count("regexp_extract") <= 2


def test_types_are_found_in_blocks_that_escape_them(spark):
    blocks = ['{"@type":"faqPAGE"}', '{"@type":"\\u0046AQPage"}', '{"@graph":[{"@type":["X","FAQPage"]}]}', '{"@type":"X","name":"FAQPage"}',
              '{"@type":"X"}', '{"@type":"FAQ\\\\Page"}', "{bad FAQPage", "[1]"]
    df = spark.createDataFrame([([b],) for b in blocks] + [([blocks[4], blocks[0]],), ([],), (None,)], "schema_blocks array<string>")
    got = [r[0] for r in df.select(C.has_schema_type("FAQPage")).collect()]
    assert got == [True, True, True, False, False, False, False, False, True, False, None]
    assert "filter(schema_blocks" in str(C.has_schema_type("FAQPage"))      # others aren't parsed
