"""A report goes over the records once, and pages that nobody asks for are not put in order."""

from auditlake.operators import crosspage, report, traffic
from auditlake.sources.html import extract_pages


def test_records_are_gone_over_once(spark, monkeypatch):
    html = "<!DOCTYPE html><html><head><title>{0}</title></head><body><h1>{0}</h1><a href='/a'>next page</a></body></html>"
    pages = spark.createDataFrame([(1, "https://s.com/", html.format("Same")), (2, "https://s.com/a", html.format("Same")), (3, "https://s.com/b", html.format("Else"))], "page_id long, url string, html string")
    records = extract_pages(pages)
    seen = traffic.with_traffic(records, spark.createDataFrame([("https://s.com/a", 5, 900, 0.01, 3.0)], "url string, clicks long, impressions long, ctr double, position double"))
    facts = spark.createDataFrame([("s", True, False)], "site string, favicon boolean, https_redirect boolean")
    apart = {repr(tuple(r)) for r in report.cross_outcomes(records).collect()}

    def again(df):
        raise AssertionError("the checks across pages went over the records again")

    monkeypatch.setattr(crosspage.graph, "_cut", again)
    whole = report.report(records, seen, facts)
    few = report.report(records, seen, facts, named=False)
    assert few._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1  # the report's own order of checks
    whole, few = [[tuple(r) for r in x.orderBy("place").collect()] for x in (whole, few)]
    assert apart == {repr(r[1:]) for r in whole if r[1] in crosspage.CHECKS}
    assert [r[:-1] for r in whole] == [r[:-1] for r in few] and any(r[-1] for r in whole) and not any(r[-1] for r in few)
