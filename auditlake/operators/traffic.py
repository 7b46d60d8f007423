"""Search and analytics figures joined to pages, the checks on them, and the addresses with visitors no crawl found.

Pages come with page_id, url, page_key and, as far as known, status, noindex, disallowed,
in_sitemap, is_orphan, canonical_key, title, titles, h1s, description, ttfb_ms, timed_out,
client_shell (the markup has no content before its scripts ran), rendered, text_units, poor_lcp,
gtm_codes, is_html and html; a column that is missing or null is unknown, and what is unknown fails
no check.  A page counts as HTML unless it is known not to be; only HTML pages are in scope.
Both joins are on grouped sides, so no page is multiplied; Catalyst picks how to join them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.urls import absolute_key, analytics_path
from auditlake.operators.checks import Check
from auditlake.operators.history import top_decile

#: Columns of a page that these checks use and that may be missing.
KNOWN = {
    "status": "int", "noindex": "boolean", "disallowed": "boolean", "in_sitemap": "boolean", "is_orphan": "boolean", "canonical_key": "string", "title": "string", "titles": "int",
    "h1s": "int", "description": "string", "ttfb_ms": "int", "timed_out": "boolean", "client_shell": "boolean", "poor_lcp": "boolean", "gtm_codes": "array<string>", "html": "string", "is_html": "boolean", "rendered": "boolean", "text_units": "int",
}
#: Fixed value: marks of an analytics tag in the markup.
TAG = r"(?i)gtag\s*\(|googletagmanager\.com|google-analytics\.com|G-[A-Z0-9]{8,}"


def search_by_page(search: DataFrame, order: str | None = None) -> DataFrame:
    """page_key, clicks, impressions, ctr, position: of several rows of a page the last by `order` counts (None: the one with most impressions)."""
    figures = F.struct("clicks", "impressions", "ctr", "position")
    last = F.struct(*([order] if order else []), "impressions", "clicks", "position", "ctr")
    keyed = search.where("url is not null").withColumn("page_key", absolute_key(F.col("url")))
    return keyed.groupBy("page_key").agg(F.max_by(figures, last).alias("f")).select("page_key", "f.*")


def search_totals(search: DataFrame) -> DataFrame:
    """clicks, impressions over all rows, repeated pages included."""
    return search.agg(F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"), F.coalesce(F.sum("impressions"), F.lit(0)).alias("impressions"))


def analytics_by_page(analytics: DataFrame) -> DataFrame:
    """path and summed figures; rates are means weighted by sessions, but a path's only row keeps its own."""
    total = F.sum("sessions")
    rate = lambda c: F.when(F.count("*") == 1, F.max(c)).otherwise(F.sum(F.col(c) * F.col("sessions")) / F.greatest(F.lit(1), total)).alias(c)
    keyed = analytics.where("path is not null").withColumn("path", analytics_path(F.col("path")))
    return keyed.groupBy("path").agg(*(F.sum(c).alias(c) for c in ("pageviews", "sessions", "users", "conversions")), rate("bounce_rate"), rate("avg_duration_sec"))


def with_traffic(pages: DataFrame, search: DataFrame | None = None, analytics: DataFrame | None = None) -> DataFrame:
    """pages with their structs `search` and `analytics` (null: no row, or the source is not connected) and `top_sessions`."""
    for name, kind in KNOWN.items():
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    pages = pages.withColumn("_path", analytics_path(F.col("url"))).withColumns({"_known": F.lit(search is not None), "_measured": F.lit(analytics is not None), "_html": F.coalesce("is_html", F.lit(True))})
    if search is None:
        pages = pages.withColumn("search", F.expr("cast(null as struct<clicks:bigint,impressions:bigint,ctr:double,position:double>)"))
    else:
        by = search_by_page(search)
        pages = pages.join(by.select("page_key", F.struct("clicks", "impressions", "ctr", "position").alias("search")), "page_key", "left")
    if analytics is None:
        none = "cast(null as struct<pageviews:bigint,sessions:bigint,users:bigint,conversions:bigint,bounce_rate:double,avg_duration_sec:double>)"
        return pages.withColumn("analytics", F.expr(none)).withColumn("top_sessions", F.lit(False))
    by = analytics_by_page(analytics)
    top = top_decile(by, "path", "sessions").select("path", F.lit(True).alias("top_sessions"))
    by = by.join(top, "path", "left").select(F.col("path").alias("_path"), F.struct(*(c for c in by.columns if c != "path")).alias("analytics"), "top_sessions")
    return pages.join(by, "_path", "left").withColumn("top_sessions", F.coalesce("top_sessions", F.lit(False)))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit("")) == ""


def traffic_checks() -> list[Check]:
    """Checks on rows of with_traffic."""
    clicks, shown, place = (F.col(f"search.{c}") for c in ("clicks", "impressions", "position"))
    status, sessions = F.col("status"), F.col("analytics.sessions")
    fine, seen, clicked = status == 200, shown >= 1, clicks >= 1
    c = lambda i, s, scope, f: Check(i, "search-traffic", s, f, f"_html and {scope}")
    empty = _yes(F.col("rendered") & (F.col("text_units") < 200)) | _yes(~_yes(F.col("rendered")) & F.col("client_shell"))
    stuck = (status >= 400) | _yes(F.col("timed_out")) | empty | _yes(fine & (F.col("titles") == 0))
    gaps = _blank("title") | _yes(F.col("h1s") == 0) | F.col("canonical_key").isNull() | _blank("description") | _yes(F.col("ttfb_ms") > 800)
    tagged = _yes(F.size("gtm_codes") > 0) | _yes(F.col("html").rlike(TAG))
    found, open_, live = "search is not null", "_known", "_measured and status = 200"
    index = "not coalesce(noindex, false)"
    return [
        c("page-zero-impressions", "notice", f"_known and status = 200 and {index} and not coalesce(disallowed, false)", F.coalesce(shown, F.lit(0)) == 0),
        c("page-has-clicks", "notice", found, clicks > 0),
        c("non-indexable-with-impressions", "critical", found, seen & (_yes(F.col("noindex")) | (status != 200))),
        c("blocked-with-impressions", "critical", found, seen & F.col("disallowed")),
        c("4xx-with-clicks", "blocker", open_, clicked & status.between(400, 499)),
        c("3xx-with-clicks", "warning", open_, clicked & status.between(300, 399)),
        c("canonicalized-with-clicks", "warning", found, clicked & (F.col("canonical_key") != F.col("page_key"))),
        c("not-in-sitemap-with-impressions", "warning", f"{found} and status = 200 and {index}", seen & ~F.col("in_sitemap")),
        c("orphan-with-impressions", "critical", found, seen & F.col("is_orphan")),
        c("high-impressions-missing-title", "critical", found, (shown >= 100) & _blank("title")),
        c("high-impressions-low-ctr", "opportunity", found, (shown >= 200) & (place > 0) & (place <= 10) & (clicks / shown < 0.02)),
        c("traffic.ga4.tracking-tag-detected", "critical", live, (sessions >= 1) & ~tagged),
        c("traffic.ga4.high-traffic-with-blocker", "blocker", "_measured", F.col("top_sessions") & (sessions >= 10) & stuck),
        c("traffic.ga4.high-bounce-rate", "opportunity", live, (sessions >= 20) & (F.col("analytics.bounce_rate") > 0.75) & (_yes(F.col("ttfb_ms") > 800) | _yes(F.col("poor_lcp")))),
        c("traffic.ga4.orphaned-with-traffic", "warning", live, (sessions >= 1) & F.col("is_orphan")),
        c("traffic.ga4.converting-page-with-defects", "critical", live, (F.col("analytics.conversions") >= 1) & gaps),
    ]


def never_crawled(pages: DataFrame, search: DataFrame, analytics: DataFrame) -> DataFrame:
    """path, source, amount of paths with 5 sessions or else 10 impressions that no page has; analytics wins over search."""
    a = analytics_by_page(analytics).where("sessions >= 5").select("path", F.lit("analytics").alias("source"), F.col("sessions").alias("amount"))
    s = search_by_page(search).where("impressions >= 10").select(analytics_path(F.col("page_key")).alias("path"), F.lit("search").alias("source"), F.col("impressions").alias("amount"))
    both = a.unionByName(s.groupBy("path", "source").agg(F.max("amount").alias("amount")))
    crawled = pages.select(analytics_path(F.col("url")).alias("path")).distinct()
    first = both.join(crawled, "path", "left_anti").groupBy("path").agg(F.min(F.struct("source", "amount")).alias("f"))  # "analytics" comes before "search"
    return first.select("path", "f.*")
