"""Spark queries against the DuckDB oracle on the driver's smallest tables (sf0.001).

Same comparison as the driver: sorted column names, order-insensitive value hash.
"""

import duckdb
import pytest

import __spark_entry__ as E
from oracle.catalog import ORACLES
from siteaudit.plans.catalog import QUERIES
from tools_compare import TABLES, digest

SF = "/root/testdata/sf0.001"
KEYS = ["scan_crawl", "x_title", "x_h1", "x_jsonld", "x_internal_links", "resolve_url", "sitemap_choice",
        "link_status", "all_checks", "category_scores", "site_scorecard", "action_plan", "score_breakdown",
        "page_detail", "frontier"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF)
    rel = duck.sql(E.oracle_sql()[key])
    assert sorted(df.columns) == sorted(rel.columns)
    hs, _ = digest(df.columns, [tuple(r) for r in df.collect()])
    hd, _ = digest(rel.columns, rel.fetchall())
    assert hs == hd


def test_every_query_of_the_audit_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["site", "overall_score", "letter_grade", "top_issue_check_id", "passed", "warned", "failed"]
