import pytest
from pyspark.sql import functions as F

from auditlake.functions.urls import absolute_key, analytics_path, page_key
from auditlake.operators import checks, traffic

SITE = "https://site.com"
PAGES = [(1, "/", 200, False, "Home", True), (2, "/money", 200, False, "Money Page", False), (3, "/gone", 404, False, "Gone", False), (4, "/hidden", 200, True, "Hidden", False), (5, "/new", 200, False, "New", True)]
SEARCH = [("/", 40, 3000, 0.013, 6.2), ("/money", 900, 20000, 0.045, 2.1), ("/gone", 25, 800, 0.031, 8.0), ("/hidden/", 3, 450, 0.007, 14.0), ("/orphan", 12, 600, 0.02, 9.5), ("/few", 1, 9, 0.1, 9.0)]
ANALYTICS = [("/", 1200, 900, 800, 5, 0.42, 65.0), ("/money", 9000, 7000, 6000, 220, 0.31, 190.0), ("/Orphan?x=1", 400, 310, 290, 0, 0.5, 80.0), ("/orphan/", 100, 90, 85, 0, 0.6, 40.0), ("gone", 300, 250, 240, 0, 0.88, 12.0), ("/rare", 4, 4, 4, 0, 1.0, 1.0)]


@pytest.fixture(scope="module")
def tables(spark):
    pages = spark.createDataFrame([(i, SITE + u, s, x, t, "gtag('x')" if tag else "<html>") for i, u, s, x, t, tag in PAGES], "page_id long, url string, status int, noindex boolean, title string, html string")
    search = spark.createDataFrame([(SITE + u, *x) for u, *x in SEARCH], "url string, clicks long, impressions long, ctr double, position double")
    analytics = spark.createDataFrame(ANALYTICS, "path string, pageviews long, sessions long, users long, conversions long, bounce_rate double, avg_duration_sec double")
    return pages.withColumn("page_key", absolute_key(F.col("url"))), search, analytics


def test_keys(spark):
    urls = ["HTTPS://Www.A.com:443/x/#f", "http://a.com", "http://a.com/?b=1", "http://a.com:80/b/?", "mailto:x@y", "https://a.com:80/c", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", absolute_key(F.col("u")).alias("k")).collect()
    assert all(r.k == page_key(r.u) for r in got)
    paths = {"https://a.com": "/", "https://a.com/X/y/?q#z": "/x/y", "b/": "/b", "/": "/", "": "/", "/a?b=/": "/a", None: None}
    assert {r.u: r.p for r in spark.createDataFrame([(u,) for u in paths], "u string").select("u", analytics_path(F.col("u")).alias("p")).collect()} == paths


def test_collapse(tables):
    by = {r.path: r for r in traffic.analytics_by_page(tables[2]).collect()}
    assert by["/orphan"].sessions == 400 and by["/orphan"].pageviews == 500
    assert by["/orphan"].bounce_rate == pytest.approx((0.5 * 310 + 0.6 * 90) / 400) and by["/gone"].bounce_rate == 0.88
    twice = tables[1].union(tables[1])
    assert traffic.search_by_page(twice).count() == 6 and traffic.search_totals(twice).first().impressions == 2 * 24859


def test_checks(tables):
    pages, search, analytics = tables
    rows = traffic.with_traffic(pages, search, analytics)
    assert rows.count() == 5
    found = {(r.check_id, r.page_id) for r in checks.evaluate(rows, traffic.traffic_checks()).collect()}
    assert found == {
        ("page-has-clicks", 1), ("page-has-clicks", 2), ("page-has-clicks", 3), ("page-has-clicks", 4), ("page-zero-impressions", 5),
        ("non-indexable-with-impressions", 3), ("non-indexable-with-impressions", 4), ("4xx-with-clicks", 3), ("high-impressions-low-ctr", 1),
        ("traffic.ga4.tracking-tag-detected", 2), ("traffic.ga4.converting-page-with-defects", 1), ("traffic.ga4.converting-page-with-defects", 2),
    }


def test_unconnected_and_empty(tables):
    pages, search, analytics = tables
    assert checks.evaluate(traffic.with_traffic(pages), traffic.traffic_checks()).count() == 0
    assert checks.evaluate(traffic.with_traffic(pages, search.limit(0), analytics.limit(0)), traffic.traffic_checks()).select("check_id").distinct().collect() == [("page-zero-impressions",)]


def test_states(tables):
    pages, search, analytics = tables
    more = pages.withColumns({"is_orphan": F.lit(True), "in_sitemap": F.lit(False), "disallowed": F.lit(True), "canonical_key": F.lit(SITE + "/x"), "client_shell": F.lit(True)})
    found = {(r.check_id, r.page_id) for r in checks.evaluate(traffic.with_traffic(more, search, analytics), traffic.traffic_checks()).collect()}
    assert ("traffic.ga4.high-traffic-with-blocker", 2) in found and ("traffic.ga4.high-traffic-with-blocker", 1) not in found
    assert {p for i, p in found if i == "orphan-with-impressions"} == {1, 2, 3, 4} and {p for i, p in found if i == "traffic.ga4.orphaned-with-traffic"} == {1, 2}
    assert {p for i, p in found if i == "canonicalized-with-clicks"} == {1, 2, 3, 4} and {p for i, p in found if i == "not-in-sitemap-with-impressions"} == {1, 2}


def test_never_crawled(tables):
    got = sorted(map(tuple, traffic.never_crawled(*tables).collect()))
    assert got == [("/orphan", "analytics", 400)]
    assert sorted(map(tuple, traffic.never_crawled(tables[0], tables[1], tables[2].limit(0)).collect())) == [("/orphan", "search", 600)]
