"""Sitemap operators on literal files: malformed XML, namespaces, index trees, cycles, limits, order."""

from pyspark.sql import functions as F

from siteaudit.operators.ordering import running
from siteaudit.sources import sitemaps as SM

FILES = "site string, sitemap_url string, status int, body string"
R = "https://s.test"


def _urlset(*locs):
    return "<urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">" + "".join(
        f"<url><loc> {l} </loc></url>" for l in locs) + "</urlset>"


def _index(*locs):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{l}</loc></sitemap>" for l in locs) + "</sitemapindex>"


def test_parse_guards_and_namespaces(spark):
    files = spark.createDataFrame([
        ("s.test", R + "/a.xml", 200, '<urlset xmlns:image="x"><url><loc>https://s.test/p?a=1&amp;b=2</loc>'
                                     '<image:image><image:loc>https://s.test/i.png</image:loc></image:image></url>'
                                     '<url><loc>https://other.test/q</loc></url></urlset>'),
        ("s.test", R + "/b.xml", 200, "<urlset><url><loc>broken"),
        ("s.test", R + "/c.xml", 200, "   "),
    ], FILES).withColumn("root", F.lit(R))
    got = {r.sitemap_url: r.locs for r in SM.parse_files(files).collect()}
    assert got[R + "/a.xml"] == ["https://s.test/p?a=1&b=2", "https://s.test/i.png"]
    assert got[R + "/b.xml"] == [] and got[R + "/c.xml"] == []


def flat(spark, kids, files, **limits):
    starts = spark.createDataFrame([("s.test", 0, R + "/sitemap.xml", i, u) for i, u in enumerate(kids)],
                                   "site string, cand_pos int, cand_url string, child_pos int, child_url string")
    rows = SM.flatten_index(starts, SM.parsed_files(spark.createDataFrame(files, FILES)), **limits).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, len(rows) + 1))
    return [r.loc.removeprefix(R) for r in rows]


def test_flatten_in_document_order_with_failed_fetch_and_limits(spark):
    files = [
        ("s.test", R + "/sitemap-c1.xml", 200, _index(R + "/sitemap-d1.xml", R + "/sitemap-d2.xml")),
        ("s.test", R + "/sitemap-d1.xml", 200, _urlset(R + "/d1a", R + "/d1b")),
        ("s.test", R + "/sitemap-d2.xml", 200, _urlset(R + "/d2a")),
        ("s.test", R + "/sitemap-c3.xml", 200, _urlset(R + "/c3a", R + "/c3b")),
    ]
    kids = [R + "/sitemap-c1.xml", R + "/sitemap-c2.xml", R + "/sitemap-c3.xml"]  # c2 is missing
    assert flat(spark, kids, files) == ["/d1a", "/d1b", "/d2a", "/c3a", "/c3b"]
    assert flat(spark, kids, files, target=2) == ["/d1a", "/d1b"]          # stops once 2 URLs are collected
    # files in order: c1, d1, d2, c2 (missing, still a fetch), c3
    assert flat(spark, kids, files, max_fetch=2) == ["/d1a", "/d1b"]
    assert flat(spark, kids, files, max_fetch=4) == ["/d1a", "/d1b", "/d2a"]


def test_flatten_reads_cyclic_and_repeated_files_once(spark):
    root, a, b, c, d = (R + f"/sitemap{x}.xml" for x in ("", "-a", "-b", "-c", "-d"))
    files = [("s.test", root, 200, _index(a, b)), ("s.test", a, 200, _index(root, c, b)), ("s.test", b, 200, _index(a, d, b)),
             ("s.test", c, 200, _urlset(R + "/c")), ("s.test", d, 200, _urlset(R + "/d"))]
    assert flat(spark, [a, b, a, root], files) == ["/c", "/d"]


def test_flatten_to_the_end_of_deep_and_wide_trees(spark):
    deep = [("s.test", R + f"/sitemap-{i}.xml", 200, _index(R + f"/sitemap-leaf{i}.xml", R + f"/sitemap-{i + 1}.xml")) for i in range(6)]
    deep += [("s.test", R + f"/sitemap-leaf{i}.xml", 200, _urlset(R + f"/p{i}")) for i in range(6)]
    assert flat(spark, [R + "/sitemap-0.xml"], deep) == [f"/p{i}" for i in range(6)]
    wide = [("s.test", R + f"/sitemap-w{i}.xml", 200, _urlset(*[R + f"/w{i}-{j}" for j in range(7)])) for i in range(300)]
    assert flat(spark, [f[1] for f in wide], wide) == [f"/w{i}-{j}" for i in range(300) for j in range(7)]


def test_running_totals_of_one_large_group(spark):
    rows = [("big", i * 7919 % 20_011, i % 5) for i in range(20_011)] + [("small", 3, 9), ("small", 1, 4)]
    got = running(spark.createDataFrame(rows, "k string, o int, n int").repartition(7), ["k"], ["o"], "n").collect()
    total, want = {}, []
    for place, (k, o, n) in enumerate(sorted(rows)):
        first = 0 if k == "big" else 20_011
        want.append((k, o, n, place + 1 - first, total.get(k, 0)))
        total[k] = total.get(k, 0) + n
    assert sorted(tuple(r) for r in got) == want
