"""One report of a site: every check of every kind with its outcome, the counts beside them, what is gravest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators import checks, crosspage, sitechecks, traffic
from auditlake.operators.graph import _cut
from auditlake.operators.predicates import PAGE

OUTCOME = ("check_id", "category", "severity", "verdict", "reason", "affected", "applicable", "pages")


def cross_outcomes(records: DataFrame, findings: DataFrame | None = None, named: bool = True, whole: bool = True) -> DataFrame:
    """OUTCOME of the checks across pages.  records: prepared or not, or gathered as of crosspage.findings; findings: what that found in them, if known; named: as of checks.outcomes; whole: as of crosspage.findings."""
    rows = records if "refs" in records.columns else checks.ready(records)
    found = _cut(crosspage.findings(rows, whole=whole) if findings is None else findings)
    scopes = rows.agg(F.count_if(F.col("live") if "refs" in rows.columns else F.expr(PAGE)).alias("live"), F.count_if("has_langs").alias("langs"), F.count("*").alias("every"))
    scope = lambda i: "langs" if i in crosspage.LANG_SCOPE else "every" if i in crosspage.EVERY_SCOPE else "live"
    catalog = found.sparkSession.createDataFrame([(i, c, s, scope(i)) for i, (c, s, _) in crosspage.CHECKS.items()], "check_id string, category string, severity string, scope string")
    sums = found.groupBy("check_id").agg(F.count("*").alias("affected"))
    if named:
        first = Window.partitionBy("check_id").orderBy("page_id")
        names = found.select("check_id", "page_id", F.row_number().over(first).alias("n")).where(F.col("n") <= checks.MOST_NAMED)  # limited before the shuffle
        sums = sums.join(names.groupBy("check_id").agg(F.array_sort(F.collect_list("page_id")).alias("pages")), "check_id")
    else:
        sums = sums.withColumn("pages", F.array().cast("array<long>"))
    out = catalog.join(F.broadcast(scopes)).join(sums, "check_id", "left").na.fill(0, ["affected"])  # one row
    applicable = F.when(F.col("scope") == "live", F.col("live")).when(F.col("scope") == "langs", F.col("langs")).otherwise(F.col("every"))
    verdict = F.when(applicable == 0, "skipped").when(F.col("affected") > 0, "failed").otherwise("passed")
    return out.select("check_id", "category", "severity", verdict.alias("verdict"), F.when(applicable == 0, "no page in scope").alias("reason"), "affected", applicable.alias("applicable"), F.coalesce("pages", F.array().cast("array<long>")).alias("pages"))


def site_outcomes(facts: DataFrame, next_site: Column | None = None) -> DataFrame:
    """OUTCOME of the checks of a site from its one row of facts; those of a framework are skipped where the site is known not to be of it."""
    found = sitechecks.findings(facts).select("check_id", F.lit(1).cast("long").alias("affected"))
    catalog = facts.sparkSession.createDataFrame([(i, c, s) for i, c, s, _ in sitechecks.CHECKS], "check_id string, category string, severity string")
    out = catalog.join(found, "check_id", "left").na.fill(0, ["affected"])
    off = (F.col("category") == "nextjs") & (~next_site if next_site is not None else F.lit(False))
    verdict = F.when(off, "skipped").when(F.col("affected") > 0, "failed").otherwise("passed")
    kept = F.when(off, 0).otherwise(F.col("affected")).cast("long")
    return out.select("check_id", "category", "severity", verdict.alias("verdict"), F.when(off, "framework").alias("reason"), kept.alias("affected"), F.when(off, 0).otherwise(1).cast("long").alias("applicable"), F.array().cast("array<long>").alias("pages"))


def report(records: DataFrame, with_traffic: DataFrame, facts: DataFrame, named: bool = True, whole: bool = True, **known) -> DataFrame:
    """place and OUTCOME of all 332 checks: categories in report order; in each the failed ones by pages affected, then passed and skipped ones, by name.

    records: page records of one site; with_traffic: rows of traffic.with_traffic; facts: the site's row; named, known:
    ignored, platforms and next_site as of checks.outcomes; whole: as of crosspage.findings.  One pass over the records
    finds what fails on a page and gathers what the checks across pages read.
    """
    both = _cut(checks.ready(records).select(*crosspage.gathered(whole), *checks.marked(checks.registry())))
    marks = both.select("page_id", F.col("crawl_order").cast("long").alias("crawl_order"), "scopes", "failed")
    pages = checks.outcomes(marks, checks.registry(), named=named, **known)
    figures = checks.outcomes(_cut(checks.marks(with_traffic, traffic.traffic_checks())), traffic.traffic_checks(), named=named, **{k: v for k, v in known.items() if k == "ignored"})
    all_ = pages.select(*OUTCOME).unionByName(figures.select(*OUTCOME)).unionByName(cross_outcomes(both.drop("scopes", "failed"), named=named, whole=whole)).unionByName(site_outcomes(facts))
    place = F.create_map(*(F.lit(x) for i, c in enumerate(checks.CATEGORIES) for x in (c, i)))[F.col("category")]
    kind = F.create_map(*(F.lit(x) for i, v in enumerate(("failed", "passed", "skipped")) for x in (v, i)))[F.col("verdict")]
    order = Window.orderBy(place, kind, F.desc("affected"), "check_id")  # a row for each check
    return all_.withColumn("place", F.row_number().over(order)).select("place", *OUTCOME)


def severities(outcomes: DataFrame) -> DataFrame:
    """place, severity, failed: how many checks of each severity failed, the gravest first; every severity has a row."""
    known = outcomes.sparkSession.createDataFrame(list(enumerate(checks.SEVERITY, 1)), "place int, severity string")
    failed = outcomes.where("verdict = 'failed'").groupBy("severity").agg(F.count("*").alias("failed"))
    return known.join(failed, "severity", "left").na.fill(0, ["failed"]).select("place", "severity", "failed")


def counts(records: DataFrame, outcomes: DataFrame, orphans: DataFrame | None = None) -> DataFrame:
    """One row: crawled, html_pages, indexable, non_indexable, blocked, orphans (of page_id), checks_total, checks_run, checks_failed, checks_passed, checks_skipped.

    A page is indexable if it is answered with 200, allowed to crawlers and not marked noindex.
    """
    rows = checks.ready(records)
    hidden = F.coalesce(F.col("soft_noindex") | F.contains("x_robots", F.lit("noindex")), F.lit(False))
    html, open_ = F.coalesce("is_html", F.lit(False)), (F.col("status") == 200) & ~hidden & ~F.col("disallowed")
    seen = rows.agg(F.count("*").alias("crawled"), F.count_if(html).alias("html_pages"), F.count_if(html & open_).alias("indexable"), F.count_if(html & ~open_).alias("non_indexable"), F.count_if("disallowed").alias("blocked"))
    lost = (orphans.select("page_id").distinct() if orphans is not None else rows.limit(0).select("page_id")).agg(F.count("*").alias("orphans"))
    of = lambda v: F.count_if(F.col("verdict") == v).alias(f"checks_{v}")
    run = outcomes.agg(F.count("*").alias("checks_total"), F.count_if(F.col("verdict") != "skipped").alias("checks_run"), of("failed"), of("passed"), of("skipped"))
    return seen.join(F.broadcast(lost)).join(F.broadcast(run))  # one row each


def narration(pillars: DataFrame, score: float) -> DataFrame:
    """One row: band of the site's score, best and worst pillar with their scores, drags (the worst one is under 75).  Equal pillars go by name."""
    order = [F.col("score"), F.col("pillar")]
    ends = pillars.agg(F.max_by(F.struct("pillar", "score"), F.struct(*order)).alias("best"), F.min_by(F.struct("pillar", "score"), F.struct(*order)).alias("worst"))
    band = "in good shape" if score >= 75 else "holding, with gaps" if score >= 50 else "under strain"
    return ends.select(F.lit(band).alias("band"), F.col("best.pillar").alias("best"), F.col("best.score").alias("best_score"), F.col("worst.pillar").alias("worst"), F.col("worst.score").alias("worst_score"), (F.col("worst.score") < 75).alias("drags"))
