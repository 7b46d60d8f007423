"""Rules of page records that broken or unusual markup must not change."""

import time

import pytest

from auditlake.sources.html import parse_page

URL = "https://www.site.com/dir/page"


def test_broken_markup_never_raises():
    assert parse_page(URL, "<body><![foo[x]]>hello")["body_text"].endswith("hello")
    for html in ("<![if !IE]>a<![endif]>", "<!", "<!-", "</", "<a href='", "<![CDATA[x]]>y", "<p <p <p", "&#xD800;&#0;", "<script>never closed", None, ""):
        parse_page(URL, html)
    assert parse_page(URL, None)["dom_nodes"] == 0


@pytest.mark.parametrize("html", ["<p>" * 40_000, "<div>" * 60_000, "<ul>" + "<li>x" * 60_000, "<table>" + "<tr><td>1<td>2" * 20_000])
def test_time_grows_with_the_length(html):
    began = time.time()
    r = parse_page(URL, html)
    assert time.time() - began < 30 and r["dom_nodes"] > 40_000
    assert r["dom_depth"] <= 6 or "<div>" in html


def test_links():
    html = '<base href="https://else.org/"><a href="">e</a><a>none</a><a href="javascript:x()">j</a><a href="mailto:a@b.c">m</a><a href="../up?q=1#f" rel="UGC nofollow">u</a><a href="http://SITE.com/x/" onclick="go()">s</a><div class="x footer"><a href="/f">f</a></div><header><a href="/n"><img alt="pic"><img alt="two"></a></header><h1>t</h1><a href="/after">z</a>'
    r = parse_page(URL, html)["links"]
    assert [x["href"] for x in r] == [None, None, None, "mailto:a@b.c", "https://www.site.com/up?q=1#f", "http://SITE.com/x/", "https://www.site.com/f", "https://www.site.com/n", "https://www.site.com/after"]
    assert [x["internal"] for x in r] == [False] * 4 + [True] * 5 and not any(x["external"] for x in r)
    assert r[4]["ugc"] and r[4]["nofollow"] and r[4]["key"] == "https://www.site.com/up?q=1" and r[5]["onclick"] == "go()"
    assert r[6]["in_footer"] and r[7]["in_nav"] and r[7]["image_alt"] == "pic" and [x["before_h1"] for x in r] == [True] * 8 + [False]


def test_head_body_and_counts():
    html = '<title>A</title><meta name=robots content="NoIndex"><link rel=canonical href="/c/"><p>one<ul><li>a<li>b</ul><dl><dt>x<dd>y</dl><svg><title>pic</title></svg><link rel=canonical href="/late"><h2>He <b>b</b> <i>i</i></h2><h2>A <a href=x>l</a></h2><table><caption>c</caption><tr><th>h</table><table></table><i id=d></i><i id=d></i><div style="" itemscope></div><script type="application/ld+json">{}</script><img width=10 height=x><img width="">'
    r = parse_page(URL, html)
    assert r["title"] == "A" and r["titles"] == 2 and r["meta_robots"] == ["noindex"] and not r["robots_outside_head"]
    assert r["canonicals"] == ["https://www.site.com/c", "https://www.site.com/late"] and not r["canonical_in_head"]
    assert (r["lists"], r["paragraphs"], r["style_attrs"], r["duplicate_ids"], r["formats"]) == (2, 1, 1, ["d"], ["json-ld", "microdata"])
    assert [h["inner_tags"] for h in r["headings"]] == [False, True] and r["tables"] == [{"caption": True, "th": True}, {"caption": False, "th": False}]
    assert [(i["width"], i["height"]) for i in r["images"]] == [(10.0, None), (0.0, None)] and "pic" not in r["body_text"] and r["body_text"].startswith("one")
