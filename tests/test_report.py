import pytest
from pyspark.sql import functions as F

from auditlake.functions.dialect import Duck
from auditlake.operators import checks, crosspage, predicates, report, sitechecks, traffic
from auditlake.plans import rules, standins
from auditlake.sources.html import extract_pages


def test_every_check_has_a_rule_of_its_own(spark):
    assert set(rules.RULES) == {c.id for c in checks.registry()} and set(rules.SITE_RULES) == {c[0] for c in sitechecks.CHECKS}
    kinds = [set(rules.RULES), set(rules.SITE_RULES), set(crosspage.CHECKS), {c.id for c in traffic.traffic_checks()}]
    assert sum(map(len, kinds)) == len(set().union(*kinds)) == 332


def test_rules_and_predicates_agree_and_bite():
    """Check by check over the larger pages, in one engine: what the predicates find is what the rules find, and nearly all find something."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.1/pages.parquet'")
    con.execute(f"CREATE TABLE r AS WITH {standins.sql()} SELECT * FROM r")
    con.execute(f"CREATE TABLE h AS WITH {standins.base_sql()}, {rules.HELP} SELECT * FROM h")
    silent = set()
    for i, _, _, scope, p in predicates.page_checks(Duck()):
        where, rule = rules.RULES[i]
        ours = con.execute(f"SELECT page_id FROM r WHERE ({scope}) AND coalesce(({p}), false) ORDER BY 1").fetchall()
        assert ours == con.execute(f"SELECT page_id FROM h WHERE ({where}) AND coalesce(({rule}), false) ORDER BY 1").fetchall(), i
        silent |= set() if ours else {i}
    assert silent <= {"head-close-missing", "multiple-head-tags", "h1-is-empty", "page-size-over-1-5mb", "page-size-over-2mb", "html-tag-empty", "next.payload.rsc-bloat", "next.payload.props-bloat"}


def test_rules_that_the_given_pages_do_not_show(spark):
    big = "self.__next_f.push([1,\"" + "x" * 120_000 + '"])'
    pages = {
        1: "<html><head><head><body>a</body></html>",  # two heads, none of them closed
        2: "<html><head></head><body>" + "y" * 1_600_000 + "</body></html>",
        3: "<html><head></head><body>" + "y" * 2_100_000 + "</body></html>",
        4: f"<html><head></head><body><script>{big}</script></body></html>",
        5: '<html><head></head><body><script id="__NEXT_DATA__">{"props": {"a": "' + "z" * 130_000 + '"}}</script></body></html>',
        6: "<h1> </h1><h1></h1>",
        7: '<meta name="robots" content="noindex nofollow"><meta name=viewport content="width, initial-scale=">',
        8: '<html lang="x-default"><link rel=alternate hreflang="x-default" href="/8"><a href = "http://www.w3.org/">w</a><!-- [if IE]>' + "c" * 1500 + "<![endif]-->",
        9: '<html lang="en"><link rel=alternate hreflang="de" href="/9"><a href="http://w3.org/">w</a>',
    }
    df = extract_pages(spark.createDataFrame([(i, f"https://s.com/{i}", h) for i, h in pages.items()], "page_id long, url string, html string"))
    got = {}
    for r in checks.evaluate(df, checks.registry()).collect():
        got.setdefault(r.page_id, set()).add(r.check_id)
    assert {"head-close-missing", "multiple-head-tags"} <= got[1] and "page-size-over-1-5mb" in got[2] and "page-size-over-2mb" in got[3]
    assert "next.payload.rsc-bloat" in got[4] and "next.payload.props-bloat" in got[5] and "h1-is-empty" in got[6]
    assert not {"meta-noindex-pages", "meta-nofollow-pages", "viewport-no-width", "viewport-missing-initial-scale", "viewport-initial-scale-incorrect"} & got[7]
    assert "http-link-w3-org" in got[8] and not {"html-lang-invalid", "hreflang-html-lang-mismatch", "excessive-comments"} & got[8]
    assert "hreflang-html-lang-mismatch" in got[9] and "http-link-w3-org" not in got[9]


def test_report_of_a_small_site(spark):
    html = "<!DOCTYPE html><html><head><title>{0}</title></head><body><h1>{0}</h1><a href='/a'>next page</a></body></html>"
    pages = spark.createDataFrame([(1, "https://s.com/", html.format("Same")), (2, "https://s.com/a", html.format("Same")), (3, "https://s.com/b", html.format("Else"))], "page_id long, url string, html string")
    records = extract_pages(pages)
    seen = traffic.with_traffic(records, spark.createDataFrame([("https://s.com/a", 5, 900, 0.01, 3.0)], "url string, clicks long, impressions long, ctr double, position double"))
    facts = spark.createDataFrame([("s", True, False)], "site string, favicon boolean, https_redirect boolean")
    out = report.report(records, seen, facts, ignored=("low-word-count",), next_site=False)
    rows = {r.check_id: r for r in out.collect()}
    assert len(rows) == 332 and [r.place for r in sorted(rows.values(), key=lambda r: r.place)] == list(range(1, 333))
    assert (rows["title-duplicates"].verdict, rows["title-duplicates"].pages, rows["title-duplicates"].applicable) == ("failed", [1, 2], 3)
    assert rows["low-word-count"].reason == "ignored" and rows["next.script.blocking"].reason == "framework" and rows["hreflang-to-noindex"].verdict == "skipped"
    assert rows["page-has-clicks"].pages == [2] and rows["page-has-clicks"].applicable == 1 and rows["high-impressions-low-ctr"].verdict == "failed"
    assert rows["traffic.ga4.orphaned-with-traffic"].verdict == "skipped"  # analytics are not connected
    assert rows["http-to-https-redirect-works"].verdict == "failed" and rows["site-has-favicon"].verdict == "passed"
    order = {"failed": 0, "passed": 1, "skipped": 2}
    listed = [(checks.CATEGORIES.index(r.category), order[r.verdict], -r.affected, r.check_id) for r in sorted(rows.values(), key=lambda r: r.place)]
    assert listed == sorted(listed)
    grave = [(r.severity, r.failed) for r in report.severities(out).orderBy("place").collect()]
    assert [s for s, _ in grave] == list(checks.SEVERITY) and sum(n for _, n in grave) == sum(r.verdict == "failed" for r in rows.values())
    n = report.counts(records, out, spark.createDataFrame([(3,)], "page_id long")).first()
    assert (n.crawled, n.html_pages, n.indexable, n.blocked, n.orphans, n.checks_total) == (3, 3, 3, 0, 1, 332) and n.checks_run + n.checks_skipped == 332


def test_pages_that_are_no_html_have_no_traffic_findings(spark):
    pages = spark.createDataFrame([(1, "https://s.com/a.pdf", "https://s.com/a.pdf", 200, False), (2, "https://s.com/b", "https://s.com/b", 200, True)], "page_id long, url string, page_key string, status int, is_html boolean")
    search = spark.createDataFrame([("https://s.com/a.pdf", 5, 9, 0.5, 1.0), ("https://s.com/b", 5, 9, 0.5, 1.0)], "url string, clicks long, impressions long, ctr double, position double")
    assert {r.page_id for r in checks.evaluate(traffic.with_traffic(pages, search), traffic.traffic_checks()).collect()} == {2}


def test_narration(spark):
    rows = spark.createDataFrame([("content", 80), ("ux", 60), ("authority", 100), ("technicals", 60)], "pillar string, score long")
    assert tuple(report.narration(rows, 74.9).first()) == ("holding, with gaps", "authority", 100, "technicals", 60, True)
    assert report.narration(rows.where("score > 70"), 75).select("band", "drags").first() == ("in good shape", False)
    assert report.narration(rows, 49).select(F.col("band")).first()[0] == "under strain"
