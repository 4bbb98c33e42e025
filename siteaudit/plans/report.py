"""The report views as tables (``sink`` writes them).

Inputs are per-site tables (15 check rows and 7 category rows per site) and
the per-page table. Ordered positions inside a site use ``row_number`` over a
partition of at most 15 rows; page-level views join check rows on
``(site, url)`` so a large site spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit import schema as S
from siteaudit.functions import urls as U
from siteaudit.operators import checks as C
from siteaudit.operators import scoring as A
from siteaudit.operators.ordering import running


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# V1
def priority_bucket(severity="severity", verdict="verdict") -> Column:
    sev, ver = _c(severity), _c(verdict)
    return (F.when(ver == "pass", "PASS")
            .when((ver == "fail") & sev.isin("P0", "P1"), "P1")
            .when((ver == "warn") & sev.isin("P0", "P1"), "P2")
            .otherwise("P3"))


def _dim(spark, rows, schema) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


# V2
def task_dimensions(results: DataFrame) -> DataFrame:
    """Owner, effort and why per check row (15-row dimension, broadcast), with defaults."""
    spark = results.sparkSession
    dim = _dim(spark, [(cid, S.CHECK_OWNER.get(cid, S.DEFAULT_OWNER),
                        S.CHECK_EFFORT.get(cid, S.DEFAULT_EFFORT), S.CHECK_WHY.get(cid, S.DEFAULT_WHY))
                       for _, cid, _, _ in S.CHECKS], "check_id string, owner string, effort string, why string")
    return results.join(dim, "check_id", "left").select(
        "site", "check_id", F.coalesce("owner", F.lit(S.DEFAULT_OWNER)).alias("owner"),
        F.coalesce("effort", F.lit(S.DEFAULT_EFFORT)).alias("effort"),
        F.coalesce("why", F.lit(S.DEFAULT_WHY)).alias("why"))


DEFAULT_RESOURCE = ("", "Follow the fix text of the check in the action list.")


# V3
def recommend_resource(site_scores: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """Resource for each site's top issue from a user-supplied (check_id, url, blurb) table."""
    if resources is None:
        resources = site_scores.sparkSession.createDataFrame([], "check_id string, url string, blurb string")
    # user-supplied: no proven size bound, so the join strategy is left to Spark's
    # size-checked choice (broadcast only under spark.sql.autoBroadcastJoinThreshold)
    r = resources.select("check_id", F.col("url").alias("resource_url"), F.col("blurb").alias("resource_blurb"))
    top = site_scores.filter(F.col("top_issue_check_id") != "").select("site", F.col("top_issue_check_id").alias("check_id"))
    return top.join(r, "check_id", "left").select(
        "site", "check_id", F.coalesce("resource_url", F.lit(DEFAULT_RESOURCE[0])).alias("resource_url"),
        F.coalesce("resource_blurb", F.lit(DEFAULT_RESOURCE[1])).alias("resource_blurb"))


def _pages_label(n_pages: Column) -> Column:
    aff, tot = F.col("pages_affected"), F.col("total_pages")
    return (F.when(aff > 0, F.concat(aff.cast("string"), F.lit(" of "),
                                     F.when(tot > 0, tot).otherwise(n_pages).cast("string")))
            .when((tot > 0) | (F.col("message") != ""), F.lit("site-wide"))
            .otherwise(F.lit("")))


# V4
def action_plan(results: DataFrame, n_pages: DataFrame) -> DataFrame:
    """Tasks by bucket P1/P2/P3 (na, unverified and passes dropped), numbered per bucket."""
    r = results.filter(~F.col("verdict").isin("na", "unverified")).withColumn("bucket", priority_bucket()) \
        .filter(F.col("bucket") != "PASS")
    w = Window.partitionBy("site", "bucket").orderBy(A.severity_rank("severity"), "check_id")
    t = task_dimensions(results).select("site", "check_id", "owner", "effort", "why")
    return r.join(n_pages, "site", "left").join(t, ["site", "check_id"], "left").select(
        "site", "bucket", F.row_number().over(w).cast("bigint").alias("item_no"), "check_id",
        F.when(F.col("fix_text") != "", F.col("fix_text")).otherwise(F.col("message")).alias("what"),
        "owner", "effort", "why", _pages_label(F.coalesce("n_pages", F.lit(0))).alias("pages_label"))


# V5
def already_good(results: DataFrame) -> DataFrame:
    return results.filter(F.col("verdict") == "pass").select(
        "site", "check_order", "check_id", F.concat("name", F.lit(": "), "message").alias("line"))


# V6
def scope_totals(results: DataFrame, sites: DataFrame) -> DataFrame:
    buckets = F.array(*[F.lit(b) for b in ("P1", "P2", "P3")])
    grid = sites.select("site", F.explode(buckets).alias("bucket"))
    r = results.filter(~F.col("verdict").isin("na", "unverified")).withColumn("bucket", priority_bucket()) \
        .filter(F.col("bucket") != "PASS").groupBy("site", "bucket").agg(F.count(F.lit(1)).alias("tasks"))
    return grid.join(r, ["site", "bucket"], "left").select("site", "bucket", F.coalesce("tasks", F.lit(0)).alias("tasks"))


def fmt0(x: Column) -> Column:
    """Python '{:.0f}' of a one-decimal score: round half to even."""
    return F.bround(x, 0).cast("bigint").cast("string")


# V7
def summary_categories(cat_scores: DataFrame) -> DataFrame:
    s = F.col("score_tenths") / 10.0
    return cat_scores.select(
        "site", "category", "cat_order",
        F.when(F.col("score_tenths").isNull(), "n/a").otherwise(fmt0(s)).alias("score_text"),
        F.when(F.col("score_tenths").isNull(), "no checks").otherwise(A.letter_grade(s)).alias("grade_text"))


# V8
def top_actions(results: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("site").orderBy(A.top_issue_order())
    return results.filter(F.col("verdict").isin("fail", "warn")).withColumn("rank", F.row_number().over(w)) \
        .filter(F.col("rank") <= k).select(
            "site", F.col("rank").cast("bigint").alias("rank"), "check_id", "severity", "category", "name",
            "pages_affected",
            F.when(F.col("fix_text") != "", F.substring("fix_text", 1, 300)).otherwise(F.col("message")).alias("fix"))


# V9
def action_list(results: DataFrame) -> DataFrame:
    vr = F.when(F.col("verdict") == "fail", 0).when(F.col("verdict") == "warn", 1).otherwise(2)
    w = Window.partitionBy("site").orderBy(A.severity_rank("severity"), vr, "check_id")
    return results.filter(F.col("verdict") != "na").select(
        "site", F.row_number().over(w).cast("bigint").alias("position"), "check_id", "category", "severity",
        "verdict", F.concat("name", F.lit(": "), "message").alias("issue"), "pages_affected", "fix_text")


# V11
def page_schema_types(pages: DataFrame) -> DataFrame:
    return pages.select("site", "page_id", C.schema_types_label().alias("schema_types"))


# V12
def page_issues(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Per page: fail/warn results whose evidence URL is the page URL; count and first by severity."""
    p = pages.select("site", "page_id", F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")).alias("page_url"))
    r = results.filter(F.col("verdict").isin("fail", "warn") & (F.col("evidence_url") != "")) \
        .select("site", F.col("evidence_url").alias("page_url"), "name", "severity", "check_order")
    j = p.join(r, ["site", "page_url"], "left")
    return j.groupBy("site", "page_id", "page_url").agg(
        F.count("name").alias("issues"),
        F.min_by("name", F.struct(A.severity_rank("severity"), F.col("check_order"))).alias("top_issue")) \
        .select("site", "page_id", "page_url", "issues", F.coalesce("top_issue", F.lit("")).alias("top_issue"))


# V10
def page_detail(pages: DataFrame, results: DataFrame) -> DataFrame:
    og = F.col("og")
    og_count = sum(F.when(F.coalesce(og.getItem(k), F.lit("")) != "", 1).otherwise(0) for k in S.OG_TAGS)
    base = pages.select("site", "page_id", "crawl_order",
                        F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")).alias("url"),
                        F.substring("title", 1, 120).alias("title"), "status_code", "render_ms",
                        F.when(F.col("canonical") != "", "yes").otherwise("no").alias("has_canonical"),
                        og_count.alias("og_tags"), C.schema_types_label().alias("schema_types"))
    iss = page_issues(pages, results).select("site", "page_id", "issues", "top_issue")
    return base.join(iss, ["site", "page_id"], "left")


# V13
def score_breakdown(cat_scores: DataFrame, site_scores: DataFrame) -> DataFrame:
    """A row for each category and a total row, from one aggregate over grouping sets."""
    tenths, weight = F.col("score_tenths"), F.col("weight_pct")
    total = F.grouping("cat_order") == 1
    kept = ["category", "weight_pct", "checks", "passes", "warns", "fails", "na_unv", "score_tenths"]
    sets = cat_scores.groupingSets([[F.col("site"), F.col("cat_order")], [F.col("site")]], "site", "cat_order").agg(
        *[F.when(~total, F.max(c)).alias(c) for c in kept], F.sum(tenths * weight).alias("points"), total.alias("is_total"))
    overall = site_scores.select("site", F.concat(fmt0(F.col("overall_score")), F.lit(" ("), F.col("letter_grade"), F.lit(")"))
                                 .alias("overall"))
    contribution = F.format_string("%.1f", F.bround(F.coalesce("points", F.lit(0)) / 1000.0, 1))
    return sets.join(overall, "site").select(
        "site", F.coalesce("cat_order", F.lit(len(S.CATEGORIES) + 1)).cast("bigint").alias("row_no"),
        F.when(F.col("is_total"), "Overall (weighted)").otherwise(F.col("category")).alias("label"),
        F.when(F.col("is_total"), "").otherwise(F.concat(weight.cast("string"), F.lit("%"))).alias("weight"),
        "checks", "passes", "warns", "fails", "na_unv",
        F.when(F.col("is_total"), F.col("overall")).when(tenths.isNull(), "n/a").otherwise(fmt0(tenths / 10.0)).alias("score_text"),
        F.when(~F.col("is_total") & tenths.isNull(), "excluded").otherwise(contribution).alias("contribution"))


# V14
def report_bands(results: DataFrame, site_scores: DataFrame, page_iss: DataFrame) -> DataFrame:
    v = F.col("verdict")
    verdict_band = F.when(v == "pass", "pass").when(v == "warn", "warn").when(v == "fail", "fail").otherwise("neutral")
    g = F.col("letter_grade")
    grade_band = F.when(g.isin("A", "B"), "pass").when(g == "C", "warn").otherwise("fail")
    n = F.col("issues")
    issue_band = F.when(n == 0, "pass").when(n <= 3, "warn").otherwise("fail")
    a = results.select("site", F.lit("verdict").alias("kind"), F.col("check_id").alias("item"), verdict_band.alias("band"))
    b = site_scores.select("site", F.lit("grade").alias("kind"), F.col("letter_grade").alias("item"), grade_band.alias("band"))
    c = page_iss.select("site", F.lit("issues").alias("kind"), F.col("page_url").alias("item"), issue_band.alias("band"))
    return a.unionByName(b).unionByName(c)


# V15
def audit_summary(site_scores: DataFrame, results: DataFrame, cat_scores: DataFrame) -> DataFrame:
    s = F.col("score_tenths") / 10.0
    band = F.when(F.col("score_tenths").isNull(), "n/a").when(s >= 70, "good").when(s >= 55, "fair").otherwise("poor")
    # bounded: 7 category rows per site
    bands = cat_scores.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("cat_order", F.concat("category", F.lit("="), band).alias("t")))), lambda x: x["t"]), "; ")
        .alias("category_bands"))
    top = results.select("site", F.col("check_id").alias("top_issue_check_id"), F.col("name").alias("top_issue_name"),
                         F.col("message").alias("top_issue_message"))
    return site_scores.join(top, ["site", "top_issue_check_id"], "left").join(bands, "site", "left").select(
        "site", F.concat(fmt0(F.col("overall_score")), F.lit("/100 ("), F.col("letter_grade"), F.lit(")")).alias("score_text"),
        "category_bands", F.coalesce("top_issue_name", F.lit("")).alias("top_issue_name"),
        F.coalesce("top_issue_message", F.lit("")).alias("top_issue_message"))


# V17
def open_issues(results: DataFrame) -> DataFrame:
    return results.filter(F.col("verdict").isin("fail", "warn", "unverified"))


# V16
def audit_json(site_scores: DataFrame, results: DataFrame) -> DataFrame:
    """One JSON document per site (bounded: 15 check rows per site)."""
    # bounded: 15 check rows per site
    checks = results.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(
        "check_order", "check_id", "category", "severity", "verdict", "name", "message", "pages_affected",
        "fix_text"))).alias("checks"))
    j = site_scores.join(checks, "site", "left")
    return j.select("site", F.to_json(F.struct(
        "site", "overall_score", "letter_grade", "top_issue_check_id", "checks",
        F.filter("checks", lambda c: c["verdict"].isin("fail", "warn", "unverified")).alias("open_issues")))
        .alias("summary_json"))


# V18
def compare_sites(cat_scores: DataFrame, results: DataFrame, pairs: DataFrame, k: int = 3) -> DataFrame:
    """Side-by-side category scores of site pairs (site_a, site_b), with the k checks whose
    verdict points differ most listed per pair."""
    ca = cat_scores.select(F.col("site").alias("site_a"), "category", "cat_order", F.col("score_tenths").alias("ta"))
    cb = cat_scores.select(F.col("site").alias("site_b"), "category", F.col("score_tenths").alias("tb"))
    cats = pairs.join(ca, "site_a").join(cb, ["site_b", "category"])
    pts = F.when(F.col("verdict") == "pass", 2).when(F.col("verdict") == "warn", 1).when(F.col("verdict") == "fail", 0)
    ra = results.select(F.col("site").alias("site_a"), "check_id", "check_order", pts.alias("pa"))
    rb = results.select(F.col("site").alias("site_b"), "check_id", pts.alias("pb"))
    chk = pairs.join(ra, "site_a").join(rb, ["site_b", "check_id"]) \
        .filter(F.col("pa").isNotNull() & F.col("pb").isNotNull() & (F.col("pa") != F.col("pb")))
    w = Window.partitionBy("site_a", "site_b").orderBy(F.desc(F.abs(F.col("pa") - F.col("pb"))), "check_order")
    # bounded: k rows per pair after the cut
    top = chk.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).groupBy("site_a", "site_b").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "check_id"))), lambda x: x["check_id"]), ",")
        .alias("largest_check_gaps"))
    return cats.join(top, ["site_a", "site_b"], "left").select(
        "site_a", "site_b", "category", "cat_order", (F.col("ta") / 10.0).alias("score_a"),
        (F.col("tb") / 10.0).alias("score_b"), (F.abs(F.col("ta") - F.col("tb")) / 10.0).alias("score_gap"),
        F.coalesce("largest_check_gaps", F.lit("")).alias("largest_check_gaps"))


def successor_pairs(sites: DataFrame) -> DataFrame:
    """(site_a, site_b): each site with the next one by name, so that every site is in a pair. The order is made of ranges; no
    task holds all sites."""
    placed = running(sites.select("site").withColumn("one", F.lit(1)), [], ["site"], "one").select("site", "place")
    after = placed.select(F.col("site").alias("site_b"), (F.col("place") - 1).alias("place"))
    return placed.withColumnRenamed("site", "site_a").join(after, "place").select("site_a", "site_b")


# K2
def report_id(target_root, path_prefix, audit_date) -> Column:
    host = F.regexp_replace(U.url_netloc(target_root), ":", "-")
    pre = F.regexp_replace(F.regexp_replace(_c(path_prefix), "^/+|/+$", ""), "/", "-")
    slug = F.when(_c(path_prefix) != "", F.concat(F.lit("_"), pre)).otherwise(F.lit(""))
    return F.concat(host, slug, F.lit("-"), _c(audit_date))
