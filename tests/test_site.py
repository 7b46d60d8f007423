from auditlake.operators import robots, sitechecks

FILE = """# all
User-agent: *
Disallow: /private
Allow: /private/open$
Disallow: /*.pdf$
Disallow:
Sitemap: https://a.com/map.xml
User-agent: other
Disallow: /
User-agent: GoogleBot-News
Disallow: /q?x=
Allow: /same
Disallow: /same
no colon
"""


def test_robots(spark):
    rules = robots.rules(spark.createDataFrame([("a.com", FILE), ("b.com", ""), ("c.com", None)], "host string, content string"))
    got = [(r.host, r.allow, r.pattern) for r in rules.collect()]
    assert sorted(got, key=str) == sorted([("a.com", False, "/private"), ("a.com", True, "/private/open$"), ("a.com", False, "/*.pdf$"), ("a.com", None, "https://a.com/map.xml"), ("a.com", False, "/q?x="), ("a.com", True, "/same"), ("a.com", False, "/same")], key=str)
    urls = {"https://a.com/private/x": True, "https://a.com/private/open": False, "https://A.com/private/open2": True, "http://a.com/d/x.pdf": True, "http://a.com/d/x.pdf?y": False, "https://a.com/q?x=1": True, "https://a.com/same/1": False, "https://a.com": False, "https://b.com/private": False, "not a url": False}
    out = robots.disallowed(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()
    assert {r.url: r.disallowed for r in out} == urls


def test_sitemaps(spark):
    files = spark.createDataFrame([("m1", "<urlset><url><loc> https://a.com/x/ </loc></url><url><LOC>https://a.com/y?a=1&amp;b=2</LOC></url></urlset>"), ("m2", "<loc>https://a.com/x</loc>"), ("m3", "")], "sitemap string, content string")
    pages = spark.createDataFrame([("https://a.com/x",), ("https://a.com/y?a=1&b=2",), ("https://a.com/z",)], "page_key string")
    got = {r.page_key: (r.in_sitemap, r.sitemaps) for r in robots.membership(pages, robots.sitemap_entries(files)).collect()}
    assert got == {"https://a.com/x": (True, 2), "https://a.com/y?a=1&b=2": (True, 1), "https://a.com/z": (False, 0)}


def test_site_checks(spark):
    good = dict(site="good", not_found_status=404, home_allowed=True, home_indexable=True, favicon=True, home_title="A site", https_redirect=True, host_redirect=True, ssl_valid=True, ssl_days=90, csp="frame-ancestors 'self'", x_content_type="NoSniff", server="nginx", pagespeed=True, mobile_score=95, has_search=True, has_analytics=True, lcp="GOOD", inp="GOOD", tbt="POOR")
    bad = dict(site="bad", not_found_status=200, home_title=" HOME", server="x/1.2", off_site_redirects=4, lcp="POOR", mobile_score=10, next_pages=3, ssr_pages=3, build_ids=2, robots_found=True, robots_sitemaps=0, sitemap_entries=60000, search_error="e", ssl_days=3)
    schema = "site string, " + ", ".join(f"{c} {k}" for c, k in sitechecks.FACTS.items())
    rows = [tuple(x.get(c) for c in ("site", *sitechecks.FACTS)) for x in (good, bad)]
    got = {}
    for r in sitechecks.findings(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.site, set()).add(r.check_id)
    assert got["good"] == {"track-keywords"}
    assert {"error-page-404-status", "homepage-title-home", "server-hides-version", "site-is-safe", "performance.cwv.lcp", "next.render.strategy-summary", "next.build.drift-during-crawl", "robots-no-sitemap-link", "sitemap-too-large", "gsc-fetch-failed", "ssl-expiry-date", "xss-protection"} <= got["bad"]
    assert len({c[0] for c in sitechecks.CHECKS}) == 37
