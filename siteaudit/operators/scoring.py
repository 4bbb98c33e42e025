"""Category scores, weighted overall score, letter grade, top issue.

Scores are exact: points are counted in halves and weights in hundredths,
so every score is an integer ratio rounded half up to one decimal (trap T1:
binary-float ties are not reproduced). All inputs are per-site (15 check
rows per site), so these aggregates are small and partial-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit import schema as S


# A4
def severity_rank(sev) -> Column:
    s = F.col(sev) if isinstance(sev, str) else sev
    expr = F.lit(None).cast("int")
    for k, v in reversed(list(S.SEVERITY_RANK.items())):
        expr = F.when(s == k, F.lit(v)).otherwise(expr)
    return expr


# A3
def letter_grade(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    expr = F.lit("F")
    for bound, grade in reversed(S.GRADE_BOUNDS):
        expr = F.when(s >= bound, F.lit(grade)).otherwise(expr)
    return expr


def _round_half_up_tenths(num: Column, den: Column) -> Column:
    """round(num/den, 1) half up, returned in tenths (integer)."""
    return F.floor((num * 2 + den) / (den * 2)).cast("bigint")


def _category_rows() -> Column:
    return F.array(*[F.struct(F.lit(c).alias("category"), F.lit(i + 1).alias("cat_order"),
                              F.lit(w).alias("weight"), F.lit(int(round(w * 100))).alias("weight_pct"))
                     for i, (c, w) in enumerate(S.CATEGORIES)])


# A1
def category_scores(check_results: DataFrame, sites: DataFrame) -> DataFrame:
    """Per (site, category): counts and score 0..100 (NULL when nothing is scorable)."""
    v = F.col("verdict")
    agg = check_results.groupBy("site", "category").agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(v == "pass").alias("passes"),
        F.count_if(v == "warn").alias("warns"),
        F.count_if(v == "fail").alias("fails"),
        F.count_if(v.isin("na", "unverified")).alias("na_unv"))
    # every site gets the seven categories: a generator, not a join
    grid = sites.select("site", F.inline(_category_rows()))
    j = grid.join(agg, ["site", "category"], "left").fillna(0, ["checks", "passes", "warns", "fails", "na_unv"])
    scorable = F.col("passes") + F.col("warns") + F.col("fails")
    halves = F.col("passes") * 2 + F.col("warns")
    tenths = F.when(scorable > 0, _round_half_up_tenths(halves * 1000, scorable * 2))
    score = (tenths / 10.0).alias("score")
    contribution = F.when(tenths.isNotNull(), tenths * F.col("weight_pct") / 1000.0).alias("contribution")
    return j.select("site", "category", "cat_order", "weight", "weight_pct", "checks", "passes", "warns", "fails",
                    "na_unv", tenths.alias("score_tenths"), score, contribution)


# A2 + A3
def overall_scores(cat_scores: DataFrame) -> DataFrame:
    measured = F.col("score_tenths").isNotNull()
    agg = cat_scores.groupBy("site").agg(
        F.sum(F.when(measured, F.col("score_tenths") * F.col("weight_pct"))).alias("num"),
        F.sum(F.when(measured, F.col("weight_pct"))).alias("den"))
    tenths = F.when(F.coalesce(F.col("den"), F.lit(0)) > 0,
                    _round_half_up_tenths(F.col("num"), F.col("den"))).otherwise(F.lit(0))
    overall = (tenths / 10.0)
    return agg.select("site", overall.alias("overall_score"), letter_grade(overall).alias("letter_grade"))


def top_issue_order() -> Column:
    """A5 sort key: severity, fail before warn, more pages first, registry order."""
    return F.struct(severity_rank("severity").alias("r"),
                    F.when(F.col("verdict") == "fail", 0).otherwise(1).alias("w"),
                    (-F.col("pages_affected")).alias("a"), F.col("check_order").alias("o"))


# A5
def top_issues(check_results: DataFrame) -> DataFrame:
    open_ = check_results.filter(F.col("verdict").isin("fail", "warn"))
    return open_.groupBy("site").agg(F.min_by("check_id", top_issue_order()).alias("top_issue_check_id"))


# A6
def site_scorecard(check_results: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(category_scores, site_scores) for every site."""
    cats = category_scores(check_results, sites)
    overall = overall_scores(cats)
    counts = check_results.groupBy("site").agg(
        F.count_if(F.col("verdict") == "pass").alias("passed"),
        F.count_if(F.col("verdict") == "warn").alias("warned"),
        F.count_if(F.col("verdict") == "fail").alias("failed"))
    scores = sites.select("site").join(overall, "site", "left").join(top_issues(check_results), "site", "left") \
        .join(counts, "site", "left").select(
            "site", F.coalesce("overall_score", F.lit(0.0)).alias("overall_score"),
            F.coalesce("letter_grade", F.lit("F")).alias("letter_grade"),
            F.coalesce("top_issue_check_id", F.lit("")).alias("top_issue_check_id"),
            F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("warned", F.lit(0)).alias("warned"),
            F.coalesce("failed", F.lit(0)).alias("failed"))
    return cats, scores
