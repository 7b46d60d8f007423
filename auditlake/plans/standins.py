"""Stand-in records: made of pages and page_id by arithmetic, so that checks on parsed pages and responses have a reference in SQL.

The given pages are plain; these rows have every fault that a check looks for.  Markup, titles
and texts of some are those of the given pages, everything else is made by arithmetic.  One list
of expressions is spelled for Spark and for the other engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.dialect import Duck, Spark
from auditlake.operators import predicates

_LONG = "concat('a long text of many words ', repeat('that goes on ', {}), i)"
_SITE = "https://site.example"


def _pick(over: int, *values: str, mul: int = 1) -> str:
    """values by i modulo over; the last one holds for the rest."""
    return f"case (i * {mul}) % {over} " + " ".join(f"when {n} then {v}" for n, v in enumerate(values[:-1])) + f" else {values[-1]} end"


def columns(d) -> list[tuple[str, str]]:
    """(name, expression of page_id i)."""
    t, null = d.text, "cast(null as string)"
    page = f"concat('{_SITE}/p/', {{}})"
    raw = f"case x % 14 when 0 then '' when 1 then '#' when 2 then '#part' when 3 then '#none' when 4 then 'mailto:a@b.example' when 5 then 'http://localhost:80/x' when 6 then {t(chr(92) * 2 + 'server' + chr(92) + 'file')} when 7 then 'a b' when 8 then '::bad' when 9 then 'http://site.example/old' when 10 then 'https://www.other.example/z' else concat('/p/', i % 40 + x % 3) end"
    href = f"case x % 14 when 0 then {null} when 4 then 'mailto:a@b.example' when 5 then 'http://localhost:80/x' when 6 then {null} when 8 then {null} when 9 then 'http://site.example/old' when 10 then 'https://www.other.example/z' when 1 then concat('{_SITE}/p/', i) when 2 then concat('{_SITE}/p/', i) when 3 then concat('{_SITE}/p/', i) when 7 then '{_SITE}/p/a%20b' else concat('{_SITE}/p/', i % 40 + x % 3) end"
    inside, web = "x % 14 not in (0, 4, 5, 6, 8, 10)", "x % 14 in (5, 10)"
    anchor = "case (x + i) % 6 when 0 then '' when 1 then 'Read more»' when 2 then 'here' when 3 then 'One' else concat('words of link ', x % 2) end"
    key = href
    link = d.struct(pos="x", raw_href=raw, href=href, key=key, anchor=anchor, nofollow="(x + i) % 5 = 0", sponsored="(x * i) % 19 = 3", internal=inside, external=web, in_footer="x % 4 = 1", wraps_image="(x + i) % 3 = 0", image_alt=f"case when (x + i) % 12 = 0 then 'alt' when (x + i) % 6 = 3 then '' else {null} end", onclick=f"case when (x + i) % 23 = 1 then 'window.open(1)' else {null} end", before_h1="i % 34 = 6")
    image = d.struct(src="case x % 7 when 0 then concat('http://cdn.example/', x, '.gif') when 1 then 'data:image/png;base64,xx' when 2 then '' when 3 then '/a.JPG?v=1' else '/b.webp' end", key=f"case x % 7 when 3 then '{_SITE}/a.JPG?v=1' when 4 then concat('{_SITE}/p/', i % 30) else '{_SITE}/b.webp' end", alt=f"case (x + i) % 5 when 0 then {null} when 1 then 'Word' when 2 then 'two words' when 3 then {_LONG.format(12).replace(', i)', ')')} else concat('A fine title of middle length ', i % 5) end", has_alt="(x + i) % 5 <> 0", loading=f"case when x % 2 = 0 then 'lazy' else {null} end", width="case when x % 3 = 0 then cast(null as double) else cast(10 as double) end", height="case when (x + i) % 4 = 0 then cast(null as double) else cast(0 as double) end", next="x % 5 = 4")
    heading = d.struct(level="1 + (x * (i % 4) + x) % 4", text="case (x + i) % 6 when 0 then 'A fine title of middle length 2' when 1 then 'same' when 2 then 'Same' when 4 then ' ' when 3 then concat('A fine title of middle length ', i % 5) else concat('lower heading ', x, repeat(' words and', 9)) end", inner_tags="(x + i) % 7 = 0")
    lang = d.struct(lang="case (x + i) % 6 when 0 then 'x-default' when 1 then 'en' when 2 then 'EN_us' when 3 then 'de-DE' else 'fr' end", key=f"concat('{_SITE}/p/', (i + x % 2) % 50)", raw_href=f"case when x % 3 = 0 then '/rel' else concat('{_SITE}/p/', x) end")
    hop = d.struct(url=f"case (x + i) % 4 when 0 then 'https://site.example/Dir/A' when 1 then 'https://site.example/dir/a/' else 'https://site.example/q' end", status="case x % 4 when 0 then 301 when 1 then 302 when 2 then 307 else 308 end", target="case (x + i) % 5 when 0 then 'https://site.example/dir/a' when 1 then 'http://site.example/dir/a' else 'https://other.example/q' end", key="case (x + i) % 4 when 0 then 'k0' when 1 then 'k1' else 'k2' end", to_key="case (x + i) % 5 when 0 then 'k0' when 1 then 'k1' else 'k3' end")
    next_html = """<html><head></head><body><script id="__NEXT_DATA__" type="application/json">{"gssp": true, "props": {"a": 1}}</script><template id="B:1"></template><img data-nimg="fill" src="/_next/image?x"><img data-nimg="1" src="/raw.png" width="500" height="400" loading="lazy"><link rel="stylesheet" href="https://fonts.googleapis.com/x"></body></html>"""
    app_html = """<!doctype html><html><head><!-- x --></head><body><script>self.__next_f.push([1,"abc\\"d"])</script><template id="B:2"></template><script>$RC("B:2","S:2")</script></body></html></body></html>"""
    odd_html = """junk <!DOCTYPE html><html><html ><head><meta http-equiv="refresh" content="1"></head></head><body>GTM-ABCD1 GTM-ABCD2 <a href="http://www.w3.org/x"> <a href='http://ogp.me/'> hcaptcha Warning: x in /a/b.php on line 3 </body> text </body></html> after it"""
    shell_html = """<!DOCTYPE html><html><head><script src="/a.js"></script></head><body><div id="root"> </div></body></html>"""
    loose_html = f"""<!doctypehtml><html><body><!-- [if IE]>{'c' * 1200}<![endif]--><a href = "http://www.w3.org/z">x</a><a href="http://w3.org/">y</a><a href='https://schema.org/http://schema.org'>z</a></body></html>"""
    own_title, own_text = d.part("own_html", "(?s)<title>([^<]*)</title>", 1), f"trim({d.sub(d.sub('own_html', '(?s)<(script|style).*?</(script|style)>|<[^>]*>', ' '), r'[ ]+', ' ')})"
    bare_html = """some text <a href="http://schema.org/x"> with no tags"""
    twice_html = """<html><head></head><body><body><html><p>a</p></html><p>between</p></html>"""
    plain = f"concat('<!DOCTYPE html><html><head></head><body>', repeat('<p>some text here</p>', i % 60), '<!-- ', repeat('c', (i % 5) * 300), ' --></body></html>')"
    return [
        ("page_id", "i"),
        ("url", _pick(13, "concat('http://site.example/Dir_', i, '/x//y?page=', i % 3, '&page=2&sort=a&q=b')", "concat('https://www.site.example/a%20b/b/b/', i)", "concat('https://site.example/%C3%A9/', i, '.pdf')", "'https://site.example/x.css'", f"concat('{_SITE}/', repeat('long-', 25), i)", page.format("i"))),
        ("crawl_order", "i"), ("status", _pick(17, "404", "500", "301", "302", "308", "200")), ("fetch_error", _pick(29, "'reset'", null)), ("timed_out", "i % 31 = 3"), ("subresource", "i % 19 = 2"),
        ("content_type", _pick(12, "''", "'application/pdf'", "'text/css'", "'text/html; charset=utf-8'", "'text/html'", mul=5)), ("is_html", f"{_pick(12, 'false', 'false', 'false', 'true', mul=5)}"),
        ("ttfb_ms", "(i * 37) % 1200"), ("in_sitemap", "i % 3 = 0"), ("sitemaps", "i % 4"), ("disallowed", "i % 14 = 5"), ("rendered", "i % 5 = 1"), ("js_errors", "i % 3"), ("client_shell", "case when i % 9 = 0 then true else cast(null as boolean) end"), ("server_text_length", "case when i % 10 < 5 then i % 300 else cast(null as int) end"),
        ("as_of", "cast('2026-01-15' as date)"), ("last_modified", _pick(6, "'Wed, 21 Oct 2015 07:28:00 GMT'", "'Thu, 1 Jan 2026 00:00:00 GMT'", "'bad'", null)), ("x_robots", _pick(7, "'noindex, nofollow'", "'index'", "'none'", "''")), ("canonical_header", _pick(8, page.format("i"), page.format("1"), null)),
        ("headers", _pick(6, d.pairs(("cache-control", "'no-store'"), ("x-powered-by", "'Next.js'")), d.pairs(("cache-control", "'public, s-maxage=60'"), ("x-nextjs-cache", "'HIT'")), d.pairs(("cache-control", "'public'"), ("x-vercel-cache", "'BYPASS'")))),
        ("redirect_chain", d.upto("i % 6 - 2", 3, hop)),
        ("page_key", _pick(13, "concat('http://site.example/Dir_', i, '/x//y?page=', i % 3, '&page=2&sort=a&q=b')", "concat('https://www.site.example/a%20b/b/b/', i)", "concat('https://site.example/%C3%A9/', i, '.pdf')", "'https://site.example/x.css'", f"concat('{_SITE}/', repeat('long-', 25), i)", page.format("i"))),
        ("home_key", f"'{_SITE}/p/7'"),
        ("title", _pick(10, own_title, null, "''", "'short'", "'2019: a report on things that were'", _LONG.format(4), "'lower case title of thirty letters'", "'A fine title of middle length 2'", "'ADMIN of things'", "concat('A fine title of middle length ', i % 5)")), ("titles", "i % 4"),
        ("description", _pick(7, null, "' '", "'A fine title of middle length 2'", "'brief'", _LONG.format(14), "'a description that is long enough for a result page but not longer than that'")), ("descriptions", "i % 3"),
        ("html_lang", _pick(7, "''", "'en'", "'EN'", "'de-DE'", "'x-default'", null)), ("charset", _pick(3, "'utf-8'", null)),
        ("viewports", _pick(8, d.array("'width=device-width, initial-scale=1'"), d.array("'width=320,initial-scale=2.0'", "'x=1'"), d.array("'user-scalable=no, maximum-scale=1'"), d.array("'minimum-scale=1, width=device-width, user-scalable=0'"), d.array("'width, initial-scale=, maximum-scale, =3'"), d.empty("string"))),
        ("canonicals", _pick(7, d.array(page.format("i")), d.array(page.format("i % 20 + 1")), d.array(f"'{_SITE}/p/7'"), d.array(page.format("i"), "'http://www.other.example/x'"), d.array("'http://www.other.example/x'"), d.array("''"), d.empty("string"))),
        ("canonical_raw", _pick(7, d.array("'/p'"), d.array(page.format("i")), d.array("''"), d.empty("string"))), ("canonical_in_head", "i % 5 <> 2"),
        ("meta_robots", _pick(11, d.array("'noindex nofollow'"), d.array("'follow , nofollow'"), d.array("'noindex,follow'"), d.array("'none'"), d.array("'noindex'", "'noindex, nofollow'"), d.array("'index, follow'"), d.array("'max-snippet:noindexes'"), d.empty("string"))), ("robots_outside_head", "i % 10 = 4"),
        ("base_hrefs", _pick(6, d.array("''"), d.array("'/a'", "'/b'"), d.array("'/a'", "'/a'"), d.array("'http:///'"), d.empty("string"))), ("favicon", null), ("noscript_bad", "i % 12 = 1"),
        ("headings", d.upto("i % 6", 5, heading)), ("links", d.upto("case when i % 34 = 6 then 2000 when i % 17 = 8 then 130 else (i * 5) % 14 end", 2000, link)), ("images", d.upto("i % 8", 7, image)),
        ("scripts", _pick(4, d.array(d.struct(url="'http://cdn.example/a.js'", key="'http://cdn.example/a.js'", is_async="false", is_defer="false", in_head="true")), d.array(d.struct(url="'/_next/static/a.js'", key=page.format("i % 30"), is_async="true", is_defer="false", in_head="true")), d.array(d.struct(url="''", key=null, is_async="false", is_defer="false", in_head="false")))),
        ("stylesheets", _pick(3, d.array(d.struct(url="'http://cdn.example/a.css'", key=page.format("i % 25"))), d.array(d.struct(url="'/a.css'", key=page.format("3"))))),
        ("forms", _pick(3, d.array(d.struct(method="'get'", has_password="true", posts_to_http="true")), d.array(d.struct(method="'post'", has_password="false", posts_to_http="false")))),
        ("tables", _pick(4, d.array(d.struct(caption="true", th="false")), d.array(d.struct(caption="false", th="true")), d.array(d.struct(caption="true", th="true")))),
        ("hreflang", d.upto("i % 5 - 1", 3, lang)),
        ("og", _pick(4, d.pairs(("og:title", "'t'"), ("og:image", "'/rel.png'")), d.pairs(("og:title", "'t'"), ("og:description", "'d'"), ("og:image", "'https://x.example/i.png'"), ("og:url", page.format("i"))), d.pairs(("og:url", "'https://site.example/else/'")), "map()" if type(d) is Spark else "CAST(MAP {} AS MAP(VARCHAR, VARCHAR))")),
        ("twitter", _pick(3, d.pairs(("twitter:card", "'c'"), ("twitter:description", _LONG.format(16))), d.pairs(("twitter:card", "'c'"), ("twitter:title", "'t'")), "map()" if type(d) is Spark else "CAST(MAP {} AS MAP(VARCHAR, VARCHAR))")),
        ("formats", _pick(3, d.array("'json-ld'", "'rdfa'"), d.array("'json-ld'"), d.empty("string"))),
        ("body_text", _pick(7, own_text, "'Lorem ipsum and more'", "'written by: admin on it'", "''", "repeat('word and text ', i % 80)")), ("word_count", "(i * 53) % 700"), ("paragraphs", "i % 3"), ("lists", "i % 2"), ("strongs", "i % 4"),
        ("dom_nodes", "(i * 91) % 3000"), ("dom_depth", "i % 40"), ("dom_width", "i % 90"), ("ids", d.array("'part'", "'x'")), ("duplicate_ids", _pick(5, d.array("'x'"), d.empty("string"))), ("empty_src", "i % 6"), ("style_attrs", "i % 2"), ("maps", "i % 9"), ("plugins", "i % 8"),
        ("html", _pick(13, t(next_html), t(app_html), t(odd_html), t(shell_html), t(bare_html), t(twice_html), t(loose_html), f"case when i % 2 = 0 then own_html else {plain} end")),
    ]


_CLASS = "case (c_custkey + {}) % 5 when 0 then 'GOOD' when 1 then 'POOR' when 2 then 'NEEDS_IMPROVEMENT' when 3 then 'GOOD' end"
#: Facts of a site, of a customer's key; spelled alike in both engines.
SITE = {
    "site": "c_custkey", "not_found_status": "case c_custkey % 3 when 0 then 404 when 1 then 200 end", "home_allowed": "c_custkey % 11 <> 0", "home_indexable": "c_custkey % 7 <> 0", "favicon": "c_custkey % 4 <> 1",
    "home_title": "case c_custkey % 5 when 0 then ' Home ' when 1 then 'HOMEPAGE' when 2 then 'A site' end", "https_redirect": "c_custkey % 6 <> 2", "host_redirect": "c_custkey % 6 <> 3", "ssl_valid": "c_custkey % 9 <> 4", "ssl_days": "c_custkey % 100",
    "csp": "case c_custkey % 4 when 0 then 'frame-ancestors x' when 1 then 'default-src x' when 2 then '' end", "x_xss": "case when c_custkey % 3 = 0 then '1' end", "x_frame": "case when c_custkey % 5 = 0 then 'DENY' end", "x_content_type": "case c_custkey % 3 when 0 then 'NoSniff' when 1 then 'x' end",
    "server": "case c_custkey % 4 when 0 then 'nginx' when 1 then 'a/1.25' end", "powered_by": "case when c_custkey % 13 = 2 then 'lang/8.1' end", "set_cookie": "case c_custkey % 3 when 0 then 'a=b' when 1 then '' end", "off_site_redirects": "c_custkey % 8", "home_known": "c_custkey % 10 <> 0", "home_social": "c_custkey % 2 = 0",
    "lcp": _CLASS.format(0), "cls": _CLASS.format(1), "inp": _CLASS.format(2), "tbt": _CLASS.format(3), "pagespeed": "case c_custkey % 3 when 0 then true when 1 then false end", "mobile_score": "case when c_custkey % 4 <> 0 then (c_custkey * 7) % 101 end", "desktop_score": "(c_custkey * 3) % 101", "first_score": "(c_custkey * 11) % 101",
    "robots_found": "c_custkey % 5 <> 0", "robots_sitemaps": "c_custkey % 3", "sitemap_errors": "c_custkey % 4", "sitemap_entries": "c_custkey * 1000", "sitemap_bytes": "case when c_custkey % 6 = 5 then 60000000 else 1 end",
    "has_search": "case c_custkey % 3 when 0 then true when 1 then false end", "search_error": "case when c_custkey % 12 = 5 then 'e' end", "has_analytics": "c_custkey % 2 = 1", "analytics_error": "case when c_custkey % 15 = 5 then 'e' end", "missing_paths": "c_custkey % 3",
    "build_ids": "c_custkey % 3", "app_pages": "c_custkey % 2", "router_pages": "c_custkey % 5", "hybrid_pages": "case when c_custkey % 17 = 0 then 1 else 0 end", "next_pages": "c_custkey % 6", "ssr_pages": "c_custkey % 4",
}


def rows(pages: DataFrame) -> DataFrame:
    """The stand-in records of pages (page_id, html) with the derived names."""
    out = pages.select(F.col("page_id").cast("bigint").alias("i"), F.coalesce("html", F.lit("")).alias("own_html"))
    out = out.select(*(F.expr(e).alias(name) for name, e in columns(Spark())))
    for layer in predicates.derived(Spark()):
        out = out.withColumns({name: F.expr(e) for name, e in layer})
    return out


def base_sql() -> str:
    """The common table expression `r0` of the same rows without the derived names, for the other engine."""
    return "r0 AS MATERIALIZED (SELECT " + ", ".join(f"{e} AS {name}" for name, e in columns(Duck())) + " FROM (SELECT CAST(page_id AS BIGINT) AS i, coalesce(html, '') AS own_html FROM pages))"


def sql() -> str:
    """The common table expression `r` of the same rows, with the derived names."""
    ctes = [base_sql()]
    for n, layer in enumerate(predicates.derived(Duck())):
        ctes.append(f"r{n + 1} AS MATERIALIZED (SELECT *, " + ", ".join(f"{e} AS {name}" for name, e in layer) + f" FROM r{n})")
    return ", ".join(ctes) + ", r AS (SELECT * FROM r3)"
