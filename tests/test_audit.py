import pytest
from pyspark.sql import functions as F

from auditlake.functions.urls import page_key, resolve
from auditlake.operators import checks, crosspage, graph, predicates
from auditlake.plans import catalog
from auditlake.sources.html import extract_pages, parse_page

HOME = """<!DOCTYPE html><html lang="en"><head><title>A page about x</title><meta name=description content="short"><meta name="robots" content="noindex, follow">
<link rel=canonical href="/other/"><meta property="og:title" content="t"><link rel="stylesheet" href="http://cdn.example.com/a.css"></head><body><nav><a href="/a">A one</a></nav>
<h1>Head <u>line</u></h1><p>one two<p>three</p><script>var t = "</p>";</script><a href="/a#f" rel="nofollow">a</a><a href="/b/"><img src="x.png"></a><a href="#">top</a>
<form action="http://x.example.com/"><input type=password></form><footer><a href="https://else.example.org/">else</a></footer></body></html>"""


@pytest.fixture(scope="module")
def records(spark):
    rows = [(1, "https://www.site.com/", HOME), (2, "https://site.com/a", HOME.replace('href="/a"', 'href="/"')), (3, "https://www.site.com/b/", "<html><body>b</body></html>"), (4, "http://site.com/c?page=1&page=2", None), (5, "https://site.com/deep//x_Y", "")]
    return extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_page_key():
    assert page_key("HTTPS://Www.A.com:443/x/#f") == "https://www.a.com/x"
    assert page_key("http://a.com") == "http://a.com/" and page_key("http://a.com/?b=1") == "http://a.com/?b=1"
    assert page_key("mailto:x@y") == "mailto:x@y" and page_key("http://[bad") == "http://[bad" and page_key(None) is None
    assert resolve("https://a.com/x/y", "../z") == "https://a.com/z" and resolve("https://a.com/", "javascript:x()") is None


def test_record():
    r = parse_page("https://www.site.com/", HOME)
    assert r["title"] == "A page about x" and r["titles"] == 1 and r["description"] == "short"
    assert r["canonicals"] == ["https://www.site.com/other"] and r["og"] == {"og:title": "t"}
    assert [x["anchor"] for x in r["links"]] == ["A one", "a", "", "top", "else"] and [x["internal"] for x in r["links"]] == [True, True, True, True, False]
    assert r["links"][2]["wraps_image"] and r["links"][1]["nofollow"] and r["links"][0]["in_nav"] and r["links"][4]["in_footer"]
    assert r["headings"] == [{"level": 1, "text": "Head line", "inner_tags": True}] and r["forms"][0]["has_password"]
    assert "var t" not in r["body_text"] and parse_page(None, None)["word_count"] == 0


def test_findings(records):
    found = checks.evaluate(records, checks.registry())
    by = {}
    for r in found.collect():
        by.setdefault(r.page_id, set()).add(r.check_id)
    assert {"meta-noindex-pages", "noindex-follow-page", "canonical-relative-url", "canonical-not-equal-url", "description-too-short", "https-links-http-css", "https-form-posts-to-http", "missing-alt-text", "low-word-count", "h1-has-other-tags-inside", "anchored-image-no-alt", "empty-links-hash"} <= by[1]
    assert "title-is-missing" not in by[1] and "title-is-missing" in by[3]
    assert {"query-repetitive-parameters", "query-paginated-parameters", "http-urls", "title-is-missing"} <= by[4]
    assert {"double-slash-in-url", "url-underscores", "url-uppercase"} <= by[5]
    rows = {r.check_id: r for r in checks.outcomes(records, checks.registry()).collect()}
    assert len(rows) == len(checks.registry()) and all(rows[c.id].applicable == 5 for c in checks.registry() if c.scope == predicates.PAGE)
    assert rows["next.script.blocking"].verdict == "skipped" and rows["next.script.blocking"].applicable == 0
    assert rows["http-urls"].affected == 1
    scores = {r.page_id: r.score for r in checks.page_scores(found, records).collect()}
    assert len(scores) == 5 and all(0 < s <= 100 for s in scores.values())


def test_fixing_a_page_never_lowers_its_score(spark):
    rows = [(1, "u", s) for s in ()] or [(i, "u") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = spark.createDataFrame([(i, s) for i in range(6) for s in list(checks.SEVERITY)[:i]], "page_id long, severity string")
    got = [r.score for r in checks.page_scores(found, pages).orderBy("page_id").collect()]
    assert got[0] == 100 and got == sorted(got, reverse=True)


def test_graph(spark, records):
    links = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "a"), ("c", "a"), ("c", "c")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    got = {r.node: r.rank for r in graph.pagerank(nodes, links).collect()}
    rank, n = dict.fromkeys("abcd", 0.25), 4
    for _ in range(200):
        spread = 0.15 / n + 0.85 * rank["d"] / n
        rank = {"a": spread + 0.85 * (rank["b"] + rank["c"]), "b": spread + 0.85 * rank["a"] * 2 / 3, "c": spread + 0.85 * rank["a"] / 3, "d": spread}
    top = max(rank.values())
    assert all(abs(got[k] - v / top) < 1e-4 for k, v in rank.items())
    seen = {r.page_key: (r.links, r.sources, r.followed) for r in graph.inbound(records).collect()}
    assert seen["https://www.site.com/a"] == (2, 1, 1)
    # page 2 has a link to /a#f, its own address: a link to itself counts, as only hrefs that begin with "#" do not
    assert {r.page_id for r in graph.orphans(records).collect()} == {4, 5}
    dup = graph.duplicates(records, F.coalesce("title", F.lit("")), "title").collect()
    assert {(r.page_id, r.group_size) for r in dup} == {(1, 2), (2, 2)}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_match_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("events", "pages", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    norm = lambda v: round(v, 4) if isinstance(v, float) else str(v)
    got = sorted(str([norm(x) for x in r]) for r in df.select(*columns).collect())
    c = con.execute(catalog.ORACLES[name])
    at = [[x[0] for x in c.description].index(k) for k in columns]
    assert got == sorted(str([norm(r[i]) for i in at]) for r in c.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_queries_run(spark, sf, name):
    catalog.QUERIES[name](spark, sf).count()


def test_cross_page(spark):
    page = lambda canonical, title, body, head="": f'<html><head><title>{title}</title><link rel=canonical href="{canonical}">{head}</head><body>{body}</body></html>'
    b = "https://s.com"
    alt = '<link rel=alternate hreflang={} href="{}">'
    rows = [
        (1, f"{b}/a", page("/b", "Same", '<a href="/d">Go</a>', alt.format("en", "/d") + alt.format("x-default", "/d"))),
        (2, f"{b}/b", page("/a", "same ", '<a href="/d">go</a>', alt.format("fr", "/d"))),
        (3, f"{b}/c", page("/d", "three", '<a href="/d">GO</a>', '<meta name=robots content=noindex>' + alt.format("de", "/c"))),
        (4, f"{b}/d", page("/e", "four", '<a href="/c">x</a>', "<meta name=robots content=noindex>")),
        (5, f"{b}/e", page("/e", "five", "")),
        (6, f"{b}/E", page("/E", "", "")),
        (7, f"{b}/f", None),
    ]
    got = {}
    for r in crosspage.findings(extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))).where("check_id <> 'less-than-10-internal-backlinks'").collect():
        got.setdefault(r.page_id, set()).add(r.check_id)
    assert got == {
        1: {"canonical-loop", "canonical-points-another-canonicalized-url", "title-duplicates", "orphan-via-canonical", "hreflang-to-noindex", "hreflang-non-canonical", "missing-reciprocal-hreflang"},
        2: {"canonical-loop", "canonical-points-another-canonicalized-url", "title-duplicates", "orphan-via-canonical", "hreflang-to-noindex", "hreflang-non-canonical", "missing-reciprocal-hreflang"},
        3: {"canonical-points-noindex", "canonical-points-another-canonicalized-url", "hreflang-to-noindex", "hreflang-non-canonical"},  # its language names itself
        4: {"incoming-links-same-anchor", "incoming-non-descriptive-anchor", "conflicting-incoming-hreflang", "noindex-has-incoming-hreflang", "canonicalized-has-incoming-hreflang", "missing-hreflang-annotations"},  # "go" says nothing
        5: {"technically-duplicate-urls", "orphan-via-canonical", "missing-hreflang-annotations"},
        6: {"technically-duplicate-urls", "missing-hreflang-annotations"},
        7: {"missing-hreflang-annotations"},  # every page of a site that names languages, also one without markup
    }


def test_repeats_in_a_record(records, spark):
    html = "<body>" + '<a href="/x">same</a>' * 3 + "<h2>T</h2><h2>t</h2><img alt=P src=a><img alt=p src=b></body>"
    found = checks.evaluate(extract_pages(spark.createDataFrame([(1, "https://s.com/", html), (2, "https://s.com/b", '<a href="/x">a</a>' * 2)], "page_id long, url string, html string")), checks.registry())
    got = {(r.page_id, r.check_id) for r in found.collect()}
    assert {(1, "more-than-2-links-same-anchor"), (1, "page-identical-headings"), (1, "page-identical-alt-tags")} <= got
    assert not {(2, "more-than-2-links-same-anchor"), (1, "more-than-100-identical-internal-links"), (1, "multiple-pages-same-language")} & got


def test_checks_by_their_rules(spark):
    """Links to other sites share no anchors, an empty og:url says nothing, addresses are compared as addresses, quoted ids and names are places."""
    head = '<link rel=canonical href="https://S.com/a/"><meta property="og:url" content="{}">'
    bodies = {
        1: head.format("") + '<a href="https://else.org/x">same</a>' * 3,
        2: head.format(" https://s.com:443/a#f "),
        3: head.format("https://s.com/b") + '<a href="/x">same</a>' * 3,
        4: '<p id="one">x</p><a name=two>t</a><a href="#one">a</a>',
        5: '<p id=one>x</p><a href="#one">a</a>',
    }
    pages = extract_pages(spark.createDataFrame([(i, f"https://s.com/{i}", b) for i, b in bodies.items()], "page_id long, url string, html string"))
    got = {}
    for r in checks.evaluate(pages, checks._some("more-than-2-links-same-anchor", "open-graph-url-not-canonical", "broken-jump-link")).collect():
        got.setdefault(r.check_id, set()).add(r.page_id)
    assert got == {"more-than-2-links-same-anchor": {3}, "open-graph-url-not-canonical": {3}, "broken-jump-link": {5}}
