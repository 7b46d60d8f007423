"""The checks of a whole site, as predicates over one row of facts a site; a predicate that is null counts as passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Facts of a site; any may be missing or null.
FACTS = {
    "not_found_status": "int", "home_allowed": "boolean", "home_indexable": "boolean", "favicon": "boolean", "home_title": "string", "https_redirect": "boolean", "host_redirect": "boolean", "ssl_valid": "boolean", "ssl_days": "int",
    "csp": "string", "x_xss": "string", "x_frame": "string", "x_content_type": "string", "server": "string", "powered_by": "string", "set_cookie": "string", "off_site_redirects": "int", "home_known": "boolean", "home_social": "boolean",
    "lcp": "string", "cls": "string", "inp": "string", "tbt": "string", "pagespeed": "boolean", "mobile_score": "int", "desktop_score": "int", "first_score": "int",
    "robots_found": "boolean", "robots_sitemaps": "int", "sitemap_errors": "int", "sitemap_entries": "bigint", "sitemap_bytes": "bigint",
    "has_search": "boolean", "search_error": "string", "has_analytics": "boolean", "analytics_error": "string", "missing_paths": "int",
    "build_ids": "int", "app_pages": "int", "router_pages": "int", "hybrid_pages": "int", "next_pages": "int", "ssr_pages": "int",
}
#: (id, category, severity, predicate); classes of vitals are GOOD, NEEDS_IMPROVEMENT and POOR.
CHECKS = [
    ("error-page-404-status", "indexability", "critical", "not_found_status <> 404"),
    ("homepage-open-for-scanning", "indexability", "blocker", "not home_allowed"),
    ("homepage-open-for-indexing", "indexability", "blocker", "not home_indexable"),
    ("site-has-favicon", "content-relevance", "notice", "not favicon"),
    ("homepage-title-home", "content-relevance", "critical", "lower(trim(home_title)) in ('home', 'homepage')"),
    ("http-to-https-redirect-works", "duplicate-content", "critical", "not https_redirect"),
    ("preferred-domain-redirect", "duplicate-content", "critical", "not host_redirect"),
    ("ssl-certificate-valid", "security", "blocker", "not ssl_valid"),
    ("ssl-expiry-date", "security", "warning", "ssl_days < 30"),
    ("redirect-to-https-header", "security", "critical", "not https_redirect"),
    ("xss-protection", "security", "warning", "coalesce(csp, '') = '' and coalesce(x_xss, '') = ''"),
    ("clickjacking-protection", "security", "warning", "coalesce(x_frame, '') = '' and not contains(coalesce(csp, ''), 'frame-ancestors')"),
    ("mime-sniffing-protection", "security", "warning", "lower(coalesce(x_content_type, '')) <> 'nosniff'"),
    ("server-hides-version", "security", "notice", "regexp_like(concat(coalesce(server, ''), ' ', coalesce(powered_by, '')), '[0-9]+[.][0-9]+')"),
    ("no-cookies-sent", "security", "notice", "coalesce(set_cookie, '') <> ''"),
    ("site-is-safe", "security", "blocker", "off_site_redirects > 3"),
    ("performance.cwv.lcp", "page-speed", "critical", "lcp <> 'GOOD'"),
    ("performance.cwv.cls", "page-speed", "critical", "cls <> 'GOOD'"),
    ("performance.cwv.inp-tbt", "page-speed", "warning", "coalesce(inp, tbt) <> 'GOOD'"),
    ("performance.lighthouse.score", "page-speed", "warning", "coalesce(mobile_score, first_score) < 90"),
    ("pagespeed-data-available", "page-speed", "notice", "not coalesce(pagespeed, false)"),
    ("homepage-mobile-pagespeed", "page-speed", "notice", "mobile_score < 90"),
    ("homepage-desktop-pagespeed", "page-speed", "notice", "desktop_score < 90"),
    ("homepage-social-links", "social-media", "notice", "home_known and not home_social"),
    ("robots-txt-not-found", "xml-sitemaps", "warning", "not robots_found"),
    ("robots-no-sitemap-link", "xml-sitemaps", "notice", "robots_found and robots_sitemaps = 0"),
    ("sitemap-format-errors", "xml-sitemaps", "critical", "sitemap_errors > 0"),
    ("sitemap-too-large", "xml-sitemaps", "warning", "sitemap_entries > 50000 or sitemap_bytes > 52428800"),
    ("connect-gsc-ga", "search-traffic", "opportunity", "not coalesce(has_search, false)"),
    ("gsc-fetch-failed", "search-traffic", "warning", "search_error is not null"),
    ("ga4-not-connected", "search-traffic", "opportunity", "not coalesce(has_analytics, false)"),
    ("ga4-fetch-failed", "search-traffic", "warning", "analytics_error is not null"),
    ("track-keywords", "search-traffic", "opportunity", "true"),
    ("traffic.uncrawlable-urls-with-traffic", "search-traffic", "critical", "missing_paths > 0"),
    ("next.build.drift-during-crawl", "nextjs", "notice", "next_pages > 0 and build_ids > 1"),
    ("next.router.mixed", "nextjs", "opportunity", "next_pages > 0 and ((app_pages > 0 and router_pages > 0) or hybrid_pages > 0)"),
    ("next.render.strategy-summary", "nextjs", "critical", "next_pages >= 3 and ssr_pages = next_pages"),
]


def findings(sites: DataFrame) -> DataFrame:
    """site, check_id, category, severity of every failed check of every site (site and columns of FACTS); one pass, no shuffle."""
    full = sites.withColumns({c: F.lit(None).cast(kind) for c, kind in FACTS.items() if c not in sites.columns})
    rows = [F.struct(F.lit(i).alias("check_id"), F.lit(c).alias("category"), F.lit(s).alias("severity"), F.coalesce(F.expr(p), F.lit(False)).alias("failed")) for i, c, s, p in CHECKS]
    return full.select("site", F.inline_outer(F.filter(F.array(*rows), lambda x: x["failed"]))).where("check_id is not null").drop("failed")


def next_facts(pages: DataFrame) -> DataFrame:
    """site, next_pages, app_pages, router_pages, hybrid_pages, ssr_pages of prepared pages with a column site: live pages of the framework."""
    live = pages.where("is_next and is_html and status = 200")
    of = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return live.groupBy("site").agg(F.count("*").alias("next_pages"), of("router = 'app'", "app_pages"), of("router = 'pages'", "router_pages"), of("router = 'hybrid'", "hybrid_pages"), of("strategy = 'ssr'", "ssr_pages"))
