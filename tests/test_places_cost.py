"""What the search for places costs: markup is searched a page at a time, and only for patterns whose texts it holds."""

import re

from auditlake.operators import places
from auditlake.plans.evidence import FAULTS


def test_matches_hold_what_they_are_looked_up_by():
    assert list(places.HOLDS) == list(places.ELEMENTS)
    texts = [x + y for x in FAULTS for y in ("", "<HEAD></HEAD><APPLET><EMBED></html></body>", "<IMG SRC='x.JPEG' ALT=\"Word\"><a HREF='http://127.0.0.1/'>", "<a href=\"'>x</a><DIV ID='app\"></div><app-root></app-root>Parse ERROR: x")]
    met = set()
    for e, pattern in places.ELEMENTS.items():
        for m in (m for x in texts for m in re.finditer(f"(?i:{pattern})", x, re.ASCII)):
            met.add(e)
            assert all(any(x in m[0].lower() for x in one.split("|")) for one in places.HOLDS[e]), (e, m[0])
    assert met >= set(places.ELEMENTS) - {"title", "html end"}


def test_a_page_is_one_row_until_its_places_are_known(spark):
    pages = spark.createDataFrame([(i, "<html><head><title>a</title></head>\n<body>b</body></html>") for i in range(40)], "page_id long, html string").coalesce(1)
    out = places.finding_places(pages)
    assert "explode(filter" not in out._jdf.queryExecution().optimizedPlan().toString()  # a copy of the markup for every pattern
    assert out.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    lines = places.finding_lines(pages, out)
    assert "collect_list" in lines._jdf.queryExecution().optimizedPlan().toString()  # else a copy of the markup for every place
    assert {(r.line, r.column) for r in lines.where("check_id = 'h1-is-missing'").collect()} == {(2, 1)}


def test_places_that_stand_twice(spark):
    pages = spark.createDataFrame([(1, "<TITLE>ü😀</TITLE>é<title>b</title><title>c</title>"), (2, "<title>a</title><title>"), (3, "<title>a<title>b</title>")], "page_id long, html string")
    got = {(r.page_id, r.offset, r.length) for r in places.finding_places(pages).where("check_id = 'multiple-title-tags'").collect()}
    assert got == {(1, 19, 16)}
