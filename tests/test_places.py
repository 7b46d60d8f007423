import re

import pytest
from pyspark.sql import functions as F

from auditlake.operators import places
from auditlake.plans import evidence

HTML = '<html>\n<head><title>a</title><TITLE>é😀</TITLE>\n</head><body><img src=x><img alt="y" src=z><h1>b<i>c</i></h1>😀<a href="">n</a></body></html> tail'


def frame(spark, *html):
    return spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string")


def found(df):
    return {(r.page_id, r.check_id): (r.offset, r.length) for r in df.collect()}


def test_places_by_hand(spark):
    got = found(places.finding_places(frame(spark, HTML, "", None, "plain text")))
    u = places.in_units(HTML)
    at = lambda i: u[slice(got[0, i][0], sum(got[0, i]))]
    assert at("title-too-long") == "<title>a</title>" and at("multiple-title-tags") == places.in_units("<TITLE>é😀</TITLE>")
    assert at("missing-alt-text") == "<img src=x>" and at("h1-is-empty") == "<h1>b<i>c</i></h1>" and at("empty-href-attribute") == '<a href="">'
    assert at("content-after-html") == " tail" and got[0, "no-doctype"] == (0, 60) and got[0, "content-before-doctype"] == (0, 1)
    assert at("non-indexable-pages") == "<head>" and (0, "multiple-h1") not in got and (0, "text-to-code-ratio-low") not in got
    assert {i for p, i in got if p == 3} == {"no-doctype", "html-tag-missing", "html-close-missing", "body-close-missing", "content-before-doctype"} and not {p for p, _ in got} & {1, 2}
    assert got[3, "html-close-missing"] == (0, 120)


def test_only_what_is_asked_for(spark):
    pages = frame(spark, HTML, HTML)
    asked = spark.createDataFrame([(0, "title-too-long"), (0, "title-is-empty"), (1, "missing-alt-text"), (1, "http-urls"), (9, "h1-is-empty")], "page_id long, check_id string")
    assert set(found(places.finding_places(pages, asked))) == {(0, "title-too-long"), (0, "title-is-empty"), (1, "missing-alt-text")}


def test_every_check_with_a_place_is_known_and_found(spark):
    ids = places.check_ids()
    assert len(ids) == len(set(ids)) == 137
    pages = evidence.faulty(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert {i for _, i in found(places.finding_places(pages))} == set(ids)


def test_against_a_search_of_its_own(spark, sf):
    """Positions in Python's own regular expressions, which have the same look-aheads."""
    pages = evidence.faulty(spark.read.parquet(f"{sf}/pages.parquet"))
    html = {r.page_id: places.in_units(r.html) for r in pages.collect()}
    got = found(places.finding_places(pages))
    want = {}
    for page, text in html.items():
        for name, ids in places.AT.items():
            hit = None
            for part in name.split(" else "):
                n = 1 if part.endswith(" 2") else 0
                ms = list(re.finditer(places.ELEMENTS[part.removesuffix(" 2")].replace("(?-i:", "(?:"), text, re.I))
                hit = hit or (ms[n] if len(ms) > n else None)
            if hit and name != "plain image":  # whose one word in its own case has a flag of its own
                want |= {(page, i): (hit.start(), max(1, min(2000, len(hit[0])))) for i in ids.split()}
    assert {k: v for k, v in got.items() if k[1] not in places.WHOLE and k[1] != "next.image.raw-img-tag"} == want


FLAT = "<!DOCTYPE html><html><head><script>if (a < b) { c('</p>') }</script><style>p > a{}</style></head><body> <p class=x>one\ttwo <b>three</b></p>\n<br><img/><pre>\n keep <i> \n</pre> end </body>" + "<p>word😀</p>" * 300 + "</html> tail "


def test_broken_up():
    html = places.in_units(FLAT)
    assert places.has_no_lines(html) and not places.has_no_lines(html[:1999]) and not places.has_no_lines(html.replace("<p>", "\n<p>"))
    text, map_ = places.broken_up(html)
    assert text.splitlines()[:4] == ["<!DOCTYPE html>", "  <html>", "    <head>", "      <script>if (a < b) { c('</p>') }"]  # the first tag opens as any other
    tags = [m.start() for m in re.finditer("<p>", html)]
    assert all(text[places.moved(map_, o) : places.moved(map_, o) + 3] == "<p>" for o in tags)
    assert places.moved(map_, html.index("keep")) == text.index("keep") and "<pre>\n keep <i> \n" in text
    assert text[places.moved(map_, html.index("{ c(")) :].startswith("{ c(")
    assert re.sub(r"\s", "", text) == re.sub(r"\s", "", html)  # nothing but white space changes
    assert places.moved(map_, len(html) + 5) == 0 and places.moved([], 3) == 0


def test_snippets(spark):
    doc = "one\ntwo\nthree 😀 x\nfour\n" + "y" * 500
    at = places.in_units(doc)
    s = places.Lines(at).snippet(at.index("three"), 1, 5)
    assert (s["line"], s["column"], s["lines"], s["start_line"], s["highlight"], s["total_lines"], s["mark_start"], s["mark_end"]) == (3, 1, ["two", "three 😀 x", "four"], 2, 1, 5, 0, 5)
    assert places.Lines(at).snippet(99_999, 0, 0)["line"] == 5 and places.Lines(at).snippet(-4, 0, 9)["mark_end"] == 3
    assert places.Lines(at).snippet(at.index("x\n"), 0, 50)["mark_end"] == len(places.in_units("three 😀 x"))
    assert places.Lines(at).snippet(len(at) - 1, 0, 1)["lines"] == ["y" * 400 + " …"] and places.Lines("").snippet(0, 3, 1)["lines"] == [""]
    pages = frame(spark, doc, FLAT, None)
    asked = spark.createDataFrame([(1, "text-to-code-ratio-low", FLAT.index("<head>"), 6, "x"), (1, "a", 0, 4, "y"), (0, "a", at.index("x\n"), 1, "z"), (2, "a", 0, 1, "n")], "page_id long, check_id string, offset int, length int, label string")
    rows = {(r.page_id, r.check_id): r for r in places.finding_snippets(pages, asked, 1).collect()}
    assert set(rows) == {(1, "text-to-code-ratio-low"), (1, "a"), (0, "a")}
    assert rows[0, "a"].line == 3 and rows[0, "a"].column == places.in_units("three 😀 x").index("x") + 1 and not rows[0, "a"].reformatted
    r = rows[1, "text-to-code-ratio-low"]
    assert r.reformatted and r.lines[r.highlight].lstrip().startswith("<head>") and r.lines[r.highlight][r.mark_start : r.mark_end].startswith("<head>")


@pytest.mark.parametrize("n", [0, 1, 7])
def test_lines_as_columns(spark, n):
    pages = frame(spark, "a\n" * n + "😀b<title>x</title>")
    place = places.finding_places(pages, spark.createDataFrame([(0, "title-too-long")], "page_id long, check_id string"))
    assert [tuple(r) for r in places.finding_lines(pages, place).select("line", "column").collect()] == [(n + 1, 4)]
    assert [r.lines for r in places.source_lines(pages).select(F.col("lines")).collect()] == [n + 1]
