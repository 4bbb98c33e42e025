"""Reports are committed whole; compressed bodies are inflated within bounds; site pairs; deep JSON-LD graphs."""

import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F

from siteaudit.functions.html_extract import extract_fields
from siteaudit.plans import report as V
from siteaudit.plans import sink
from siteaudit.session import checkpoint_dir
from siteaudit.sources import sitemaps as SM


def views(spark, n):
    return {"a": spark.createDataFrame([("s", n)], "site string, n int"), "b": spark.createDataFrame([("s", n * 10)], "site string, m int")}


def read(spark, path, date):
    return {name: [tuple(r) for r in df.collect()] for name, df in sink.read_report(spark, path, date).items()}


def test_reports_of_each_date_and_the_latest_attempt(spark):
    path = checkpoint_dir(spark) + "/dates"
    for date, n in (("2026-05-20", 1), ("2026-05-21", 2), ("2026-05-21", 3)):
        sink.write_report(views(spark, n), path, date)
    assert read(spark, path, "2026-05-20") == {"a": [("s", 1)], "b": [("s", 10)]}
    assert read(spark, path, "2026-05-21") == {"a": [("s", 3)], "b": [("s", 30)]}
    assert read(spark, path, "2026-05-22") == {}
    assert {r["rows"] for r in sink.report_manifest(spark, path).collect()} == {1}


def test_a_failed_attempt_leaves_the_report_before_it_whole(spark):
    path = checkpoint_dir(spark) + "/failed"
    sink.write_report(views(spark, 1), path, "2026-05-20")
    bad = views(spark, 2) | {"c": spark.createDataFrame([("s",)], "site string").select(F.raise_error(F.lit("no")).alias("x"))}
    with pytest.raises(Exception, match="no"):
        sink.write_report(bad, path, "2026-05-20")
    assert read(spark, path, "2026-05-20") == {"a": [("s", 1)], "b": [("s", 10)]}
    for fmt in ("json", "csv", "orc"):
        sink.write_report(views(spark, 4), path, "2026-05-20", fmt)
        assert read(spark, path, "2026-05-20") == {"a": [("s", 4)], "b": [("s", 40)]}


BODY = "<urlset>\n<url><loc>https://s.test/é</loc></url>\n</urlset>\n"


@pytest.mark.parametrize("content, want", [
    (gzip.compress(BODY.encode()), (BODY, "")), (BODY.encode(), (BODY, "")), (None, ("", "")), (b"", ("", "")),
    (gzip.compress(BODY.encode())[:-9], ("", "broken")), (b"\x1f\x8bno gzip", ("", "broken")),
    (gzip.compress(b"one ") + gzip.compress(b"two"), ("one two", "")), (gzip.compress(b"one") + b"tail", ("one", "")),
    (gzip.compress(b"\xff\xfe"), ("��", "")), (gzip.compress(b"x" * 2001), ("", "too large")), (b"x" * 2001, ("", "too large")),
    (gzip.compress(b"x" * 2000), ("x" * 2000, "")), (gzip.compress(b"x" * (1 << 26)), ("", "too large"))])
def test_inflate(content, want):
    assert SM.inflate(content, 2000) == want


def test_stored_files_compressed_or_not(spark, tmp_path):
    for name, content in (("a.xml.gz", gzip.compress(BODY.encode())), ("b.xml", BODY.encode()), ("c.xml.gz", zlib.compress(b"x"))):
        (tmp_path / name).write_bytes(content)
    got = {r.file.rsplit("/", 1)[-1]: (r.body, r.error) for r in SM.read_gz_sitemaps(spark, str(tmp_path)).collect()}
    assert got["a.xml.gz"] == got["b.xml"] == (BODY, "") and got["c.xml.gz"][1] == ""


def test_every_site_is_in_a_pair(spark):
    names = [f"s{i % 7}-{i}.test" for i in range(500)]
    got = sorted(tuple(r) for r in V.successor_pairs(spark.createDataFrame([(n,) for n in names], "site string").repartition(5)).collect())
    assert got == list(zip(sorted(names), sorted(names)[1:]))
    assert V.successor_pairs(spark.createDataFrame([("one",)], "site string")).collect() == []


def test_types_of_graphs_at_any_depth():
    node = {"@type": "Deep"}
    for i in range(200):
        node = {"@type": [f"T{i % 3}", 5], "@graph": [[node], "text", {"@graph": "no list"}]}
    r = extract_fields(f'<script type="application/ld+json">{json.dumps(node)}</script>', "https://s.test/")
    assert r["schema_types"] == ["Deep", "T0", "T1", "T2"]
