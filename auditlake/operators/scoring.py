"""Site scores, pillars and crawl comparison over the findings of the page checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.checks import SEVERITY

#: The check categories of each pillar.
PILLARS = {
    "content": ("content-relevance", "duplicate-content", "social-media"),
    "authority": ("links", "search-traffic"),
    "technicals": ("indexability", "internal", "redirects", "xml-sitemaps", "code-validation", "security", "nextjs"),
    "ux": ("page-speed", "mobile-friendly", "localization"),
}


def severity_weight(severity: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[severity]


def site_scores(pages: DataFrame, site_issues: DataFrame | None = None) -> DataFrame:
    """site, pages, mean_score, weighted_score, site_penalty, impressions_at_risk, score: one row per site.

    pages: site, score and, null counting as 0, page_rank, impressions, sessions.  A page weighs
    1 + 3 * page_rank + 4 * its share of the site's largest impressions + 4 * the same of sessions.
    site_issues: site, severity of failed checks of the whole site.  Sums over a site are
    partial before the shuffle, so a site with most of the pages is no hot group; the two
    maxima go into the sums as factors, so the pages are passed over once.
    """
    have = set(pages.columns)
    given = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    rows = pages.select("site", "score", given("page_rank").alias("r"), given("impressions").alias("i"), given("sessions").alias("s"))
    sums = rows.groupBy("site").agg(
        F.count("*").alias("pages"), F.avg("score").alias("mean_score"), F.max("i").alias("top_i"), F.max("s").alias("top_s"),
        F.sum(1 + 3 * F.col("r")).alias("w"), F.sum("i").alias("w_i"), F.sum("s").alias("w_s"),
        F.sum((1 + 3 * F.col("r")) * F.col("score")).alias("x"), F.sum(F.col("i") * F.col("score")).alias("x_i"), F.sum(F.col("s") * F.col("score")).alias("x_s"),
        F.sum(F.col("i") * (1 - F.col("score") / 100)).alias("impressions_at_risk"),
    )
    part = lambda v, top: F.when(F.col(top) > 0, 4 * F.col(v) / F.col(top)).otherwise(0.0)
    total = F.col("w") + part("w_i", "top_i") + part("w_s", "top_s")
    out = sums.withColumn("weighted_score", (F.col("x") + part("x_i", "top_i") + part("x_s", "top_s")) / total)
    if site_issues is None:
        out = out.withColumn("site_penalty", F.lit(0.0))
    else:
        lost = site_issues.groupBy("site").agg(F.sum(severity_weight(F.col("severity")) / 8).alias("site_penalty"))
        out = out.join(lost, "site", "left").na.fill(0.0, ["site_penalty"])
    out = out.withColumn("score", F.greatest(F.lit(0.0), F.col("weighted_score") - F.col("site_penalty")))
    return out.select("site", "pages", *(F.round(c, 6).alias(c) for c in ("mean_score", "weighted_score", "site_penalty", "impressions_at_risk", "score")))


def pillars(outcomes: DataFrame) -> DataFrame:
    """pillar, score, failed, passed from check outcomes (category, severity, affected, applicable).

    A check weighs its severity + 1; one with no page to apply to is skipped.  A pillar without
    checks scores 100.
    """
    names = F.create_map(*(F.lit(x) for p, cs in PILLARS.items() for c in cs for x in (c, p)))
    weight, failed = severity_weight(F.col("severity")) + 1, F.col("affected") > 0
    rows = outcomes.where("applicable > 0").withColumn("pillar", names[F.col("category")]).where("pillar is not null")
    sums = rows.groupBy("pillar").agg(F.count_if(failed).alias("failed"), F.count_if(~failed).alias("passed"), F.sum(F.when(failed, weight).otherwise(0.0)).alias("lost"), F.sum(weight).alias("all"))
    every = outcomes.sparkSession.createDataFrame([(p,) for p in PILLARS], "pillar string")
    score = F.coalesce(F.floor(100 * (1 - F.col("lost") / F.col("all")) + 0.5), F.lit(100)).cast("long")
    return every.join(sums, "pillar", "left").na.fill(0, ["failed", "passed"]).select("pillar", score.alias("score"), "failed", "passed")


def crawl_diff(before: DataFrame, after: DataFrame, *key: str) -> DataFrame:
    """key..., change: 'fixed' where only before has the key, 'appeared' where only after has it."""
    old = before.select(*key).distinct().withColumn("_old", F.lit(True))
    new = after.select(*key).distinct().withColumn("_new", F.lit(True))
    both = old.join(new, list(key), "full_outer").where("_old is null or _new is null")
    return both.select(*key, F.when(F.col("_new").isNull(), "fixed").otherwise("appeared").alias("change"))
