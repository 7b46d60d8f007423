"""Queries on where things stand in the markup of the given pages, and their SQL.

The given pages are plain.  So that every rule has something to find, `planted` puts signatures
of platforms and faulty markup, chosen by page_id, into each page's own markup; everything else
is the page as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.urls import bare_host
from auditlake.operators import checks, places, platform, predicates
from auditlake.operators.facts import prepared

_GENERATORS = list(dict.fromkeys(x for *_, signals in platform.rules() for _, places in signals for place, x in places if place == "generator"))
#: Put before the end of a page's head.
SIGNATURES = [
    *(f"<i data-x='{x}'></i>" for x, _ in platform.literals()),
    *(f'<meta name="generator" content="{x.capitalize()} 5.1">' if n % 2 else f"<meta content='{x.upper()}' name='generator'>" for n, x in enumerate(_GENERATORS)),
    '<meta name="generator" content="handmade with care and a very long name that goes on and on, past sixty characters">',
]
#: Headers of a page's response.
HEADERS = [
    None, ("Link", '</wp-json/>; rel="api"'), ("set-cookie", "woocommerce_x=1"), ("x-shopid", "7"), ("X-Drupal-Cache", "HIT"), ("set-cookie", "craftsessionid=1"), ("x-wix-a", "1"), ("set-cookie", "mage-cache=1"), ("set-cookie", "xsrf-token=1"),
    ("set-cookie", "csrftoken=1"), ("set-cookie", "_session_id=1"), ("x-aspnet-version", "4"), ("x-powered-by", "Next.js"), ("x-shopify-stage", ""),
]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def planted(pages: DataFrame) -> DataFrame:
    """page_id, url, html, headers, crawl_order: pages with signatures in their markup; one of four is as it is."""
    mark = lambda i: F.get(F.array(*map(F.lit, SIGNATURES)), (i % len(SIGNATURES)).cast("int"))
    i = F.col("page_id")
    html = F.when(i % 4 == 0, F.col("html")).otherwise(F.replace("html", F.lit("</head>"), F.concat(mark(i), mark(i * 7 + 3), F.lit("</head>"))))
    maps = [F.create_map(*(F.lit(x) for x in h)) if h else F.create_map().cast("map<string,string>") for h in HEADERS]
    return pages.select("page_id", "url", html.alias("html"), F.get(F.array(*maps), (i % len(HEADERS)).cast("int")).alias("headers"), i.alias("crawl_order"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(_pages(spark, sf_dir))
    known = rows.withColumn("headers", F.transform_keys("headers", lambda k, _: F.lower(k)))
    return platform.page_platforms(prepared(known).select("page_id", "url", "crawl_order", "html", "headers", "is_next"))


def platform_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every platform that speaks from a page, surest first."""
    rows = _verdicts(spark, sf_dir).select("page_id", F.posexplode("matches").alias("n", "m"))
    return rows.select("page_id", (F.col("n") + 1).alias("rank"), "m.platform", "m.kind", F.round("m.confidence", 6).alias("confidence"), F.array_join("m.evidence", "; ").alias("evidence"))


def page_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("page_id", "platform", "label", "kind", F.round("confidence", 6).alias("confidence"))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return platform.site_platforms(_verdicts(spark, sf_dir), bare_host(F.col("url")))


def site_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(spark, sf_dir).select("site", "platform", "label", "kind", F.round("confidence", 6).alias("confidence"), "pages", F.array_join("present", ",").alias("present"), "runs_php")


def platform_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks that a site skips for what it is built with."""
    return platform.gates(_sites(spark, sf_dir), predicates.SELECTORS)


def _q(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_SIGNALS = ", ".join(
    f"({n}, {_q(p)}, {_q(label)}, {_q(kind)}, {s}, CAST({w} AS DOUBLE), {_q(place.split(' ')[0])}, {_q(place.split(' ')[-1])}, {_q(x)}, {_q(platform.said(places))})"
    for n, (p, label, kind, signals) in enumerate(platform.rules())
    for s, (w, places) in enumerate(signals)
    for place, x in places
)
_GEN = [x.replace("'", "''") for x in platform.GENERATOR]
PLANTED = f"""
sg AS (SELECT [{', '.join(map(_q, SIGNATURES))}] AS marks, [{', '.join(_q(h and h[0].lower()) for h in HEADERS)}] AS names, [{', '.join(_q(h and h[1]) for h in HEADERS)}] AS vals),
g0 AS MATERIALIZED (SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN html ELSE replace(html, '</head>', marks[page_id % {len(SIGNATURES)} + 1] || marks[(page_id * 7 + 3) % {len(SIGNATURES)} + 1] || '</head>') END AS html, names[page_id % {len(HEADERS)} + 1] AS hname, vals[page_id % {len(HEADERS)} + 1] AS hvalue FROM pages, sg),
g AS MATERIALIZED (SELECT *, lower(html) AS low, lower(CASE WHEN regexp_matches(html, '{_GEN[0]}') AND regexp_extract(html, '{_GEN[0]}', 1) <> '' THEN regexp_extract(html, '{_GEN[0]}', 1) ELSE coalesce(regexp_extract(html, '{_GEN[1]}', 1), '') END) AS gen,
  regexp_matches(html, '(?is)<script[^>]+id=["'']__NEXT_DATA__["''][^>]*>.+?</script>') OR regexp_matches(html, 'self\\.__next_f\\s*\\.\\s*push\\s*\\(') OR contains(html, '/_next/static/') OR (hname = 'x-powered-by' AND regexp_matches(lower(hvalue), 'next\\.js')) IS TRUE AS is_next FROM g0 WHERE html <> '')"""
_MATCHED = f"""{PLANTED},
sn AS (SELECT * FROM (VALUES {_SIGNALS}) v(place, platform, label, kind, signal, weight, field, name, literal, why)),
ht AS (SELECT DISTINCT page_id, place, platform, label, kind, signal, weight, why FROM g JOIN sn ON CASE field WHEN 'page' THEN contains(low, literal) WHEN 'source' THEN contains(html, literal) WHEN 'generator' THEN contains(gen, literal)
  WHEN 'header' THEN coalesce(hname = name AND contains(hvalue, literal), false) WHEN 'sent' THEN coalesce(hname = literal AND hvalue <> '', false) ELSE coalesce(starts_with(hname, literal), false) END),
m0 AS (SELECT page_id, place, platform, label, kind, least(1.0, sum(weight ORDER BY signal)) AS confidence, string_agg(why, '; ' ORDER BY signal) AS evidence FROM ht GROUP BY ALL),
m1 AS MATERIALIZED (SELECT page_id, place, platform, label, kind, confidence, evidence FROM m0 WHERE NOT (platform = 'nextjs' AND page_id IN (SELECT page_id FROM g WHERE is_next))
  UNION ALL SELECT g.page_id, 1000, 'nextjs', 'Next.js', 'framework', 1.0, concat_ws('; ', 'fingerprint of the framework', m0.evidence) FROM g LEFT JOIN m0 ON m0.page_id = g.page_id AND platform = 'nextjs' WHERE is_next),
mt AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, place) AS rank FROM m1)"""
_VERDICT = f"""{_MATCHED},
fv AS (SELECT page_id, platform, label, kind, confidence FROM mt QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN platform IN ('react', 'vue') THEN 1 ELSE 0 END, rank) = 1),
vd AS MATERIALIZED (SELECT p.page_id, p.url, coalesce(fv.platform, 'unknown') AS platform, coalesce(fv.label, CASE WHEN gen <> '' THEN upper(gen[1]) || gen[2:40] ELSE 'Unknown' END) AS label, coalesce(fv.kind, 'unknown') AS kind, coalesce(fv.confidence, CASE WHEN gen <> '' THEN 0.4 ELSE 0 END) AS confidence
  FROM pages p LEFT JOIN g ON g.page_id = p.page_id LEFT JOIN fv ON fv.page_id = p.page_id)"""
_SITE = f"""{_VERDICT},
sv AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '') AS site FROM vd WHERE confidence > 0),
sb AS (SELECT site, platform, count(*) AS pages, max(confidence) AS confidence, arg_max({{'label': label, 'kind': kind}}, (confidence, -page_id)) AS best, min(page_id) AS seen FROM sv GROUP BY site, platform),
sw AS (SELECT * FROM sb QUALIFY row_number() OVER (PARTITION BY site ORDER BY pages DESC, confidence DESC, seen) = 1),
sm AS (SELECT site, list(DISTINCT m.platform) AS ms, list(DISTINCT m.kind) AS ks FROM sv JOIN mt m ON m.page_id = sv.page_id GROUP BY site),
st AS MATERIALIZED (SELECT sw.site, platform, best.label AS label, best.kind AS kind, round(confidence, 6) AS confidence, pages, coalesce(list_has_any(ms, ['{"', '".join(platform.PHP)}']), false) AS runs_php,
  CASE WHEN platform <> 'unknown' AND confidence >= {platform.SURE} THEN list_sort(list_distinct([platform, best.kind] || ms || ks || CASE WHEN list_has_any(ms, ['{"', '".join(platform.PHP)}']) THEN ['php'] ELSE [] END)) END AS present FROM sw LEFT JOIN sm ON sm.site = sw.site)"""

QUERIES = {f.__name__: f for f in (platform_matches, page_platform, site_platform, platform_gates)}
ORACLES = {
    "platform_matches": f"WITH {_MATCHED} SELECT page_id, rank, platform, kind, round(confidence, 6) AS confidence, evidence FROM mt",
    "page_platform": f"WITH {_VERDICT} SELECT page_id, platform, label, kind, round(confidence, 6) AS confidence FROM vd",
    "site_platform": f"WITH {_SITE} SELECT site, platform, label, kind, confidence, pages, array_to_string(present, ',') AS present, runs_php FROM st",
    "platform_gates": f"WITH {_SITE} "
    + " UNION ALL ".join(f"SELECT site, '{i}' AS check_id, '{'does not apply to ' if only else 'normal on '}' || label AS reason FROM st WHERE present IS NOT NULL AND list_has_any(present, [{', '.join(map(_q, names))}]) <> {only}" for i, (names, only) in predicates.SELECTORS.items()),
}


#: Faulty markup that stands at the beginning of a page's body, and what replaces something else in a page.
FAULTS = [
    "<title>two</title>", '<meta name="description" content="a">', "<meta name='description' content='a'><META NAME=\"description\" x>", '<link rel="canonical" href="/x">', "<link href=a rel='canonical'><link rel='canonical' href=b>", '<meta name="robots" content="noindex"><meta name="robots">',
    '<meta name="viewport" content="x"><meta name="viewport">', "<h1>more\nlines</h1><h2>t</h2>", "<base href='a'><base href='b'><noscript>n</noscript>", "<map name=m>", "<object data=x>", "<img src=a><img alt='x' src=b>", '<img src="http://a.b/c.jpg" alt="Word" width=1>', f"<img alt='{'long ' * 25}' src='a.gif'>",
    '<img data-nimg="fill" sizes=1><img data-nimg="fill">', '<img src="/_next/image?x"><img src="/_NEXT/image?x">', '<script src=""></script>', '<a href="">x</a><a href="#">y</a>', "<a onclick=go href='http://localhost:1/'>x</a>", '<a href="a b" rel="x nofollow">x</a>', "<a href='q'> \n </a><a rel='sponsored'>s</a>",
    '<meta property="og:url" content="u"><meta property="og:image" content="i">', "<meta name='twitter:description' content='d'>", '<p style="x">é😀 y</p><table></table>', "Warning: it broke in /a.php on line 3", "Lorem  ipsum dolor", "<meta http-equiv=refresh content=1>", '<form action="http://x.y/"><input type="password"></form>',
    '<link rel=x href="http://a.b/c.css"><script src="http://a.b/c.js"></script>', "<script async src=a></script><script src=b></script>", "<link href='https://fonts.googleapis.com/css'>", '<i a="http://www.w3.org/x" b="http://schema.org/y" c=\'http://ogp.me/z\'></i>', "<script>self.__next_f . push([1])</script>",
    '<script id="__NEXT_DATA__" type=x>{}</script><template id="B:1"></template>', '<div class=x id="root"> </div>', "GTM-ABCDEF1 and GTM-2", "</html> tail </HTML> after it", "<html lang=x><head><body></head></body></head></body></html>",
]


def faulty(pages: DataFrame) -> DataFrame:
    """page_id, html: pages with a fault in the body of each; one of five without its doctype, one of seven without its head's start tag, one of 13 with something after its end, one of three by lines."""
    i, of = F.col("page_id"), lambda cond, x: F.when(cond, x).otherwise("")
    # each step names the one before once, as its markup would be made again for every mention; an empty text is replaced by nothing
    html = F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), F.get(F.array(*map(F.lit, FAULTS)), (i % len(FAULTS)).cast("int"))))
    html = F.replace(html, of(i % 5 == 2, "<!DOCTYPE html>"), F.lit(""))
    html = F.replace(html, of(i % 7 == 3, "<head>"), F.lit("x <!doctype y>"))
    html = F.concat(html, of(i % 13 == 6, " tail of it"))
    html = F.replace(html, of(i % 3 == 1, "><"), F.lit(">\n<"))
    return pages.select("page_id", html.alias("html"))


def finding_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place that a finding could have on each page."""
    return places.finding_places(faulty(_pages(spark, sf_dir)))


def finding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = faulty(_pages(spark, sf_dir))
    return places.finding_lines(rows, places.finding_places(rows))


def finding_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines around the findings of the checks on markup, on pages as they are."""
    rows = _pages(spark, sf_dir)
    found = checks.evaluate(rows, checks.markup_checks())
    return places.finding_snippets(rows, places.finding_places(rows, found.select("page_id", "check_id"))).withColumn("lines", F.array_join("lines", "\n"))


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.source_lines(faulty(_pages(spark, sf_dir)))


def _units(s: str) -> str:
    """UTF-16 units: characters, and one more for each beyond U+FFFF."""
    return f"(length({s}) + length(regexp_replace({s}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


#: Patterns that look ahead, as tags that have or lack something else.
_LACKS = {
    "image without alt": (r"<img\b[^>]*>", r"NOT regexp_matches(x, '(?i)\salt\s*=')"),
    "image without width": (r"<img\b[^>]*>", r"NOT regexp_matches(x, '(?i)\swidth\s*=')"),
    "image that fills": (r"<img[^>]*>", r"""regexp_matches(x, '(?i)data-nimg=["'']fill["'']') AND NOT regexp_matches(x, '(?i)\ssizes=')"""),
    "plain image": (r"<img\b[^>]*>", "NOT regexp_matches(x, '(?i)data-nimg') AND NOT contains(x, '/_next/image?')"),
    "blocking script": (r"<script[^>]+src=[^>]*>", r"NOT regexp_matches(x, '(?i)\b(?:async|defer)\b')"),
}


def _place_sql(name: str) -> str:
    """The text of an element's match and the characters before it."""
    if " else " in name:
        one, two = name.split(" else ")
        return f"coalesce({_place_sql(one)}, {_place_sql(two)})"
    n = 2 if name.endswith(" 2") else 1
    element = name.removesuffix(" 2")
    pattern, keep = _LACKS.get(element, (places.ELEMENTS[element], ""))
    all_ = f"regexp_extract_all(html, {_q('(?i)' + pattern)})"
    all_ = f"list_filter({all_}, lambda x: {keep})" if keep else all_
    if n == 1:
        return f"(SELECT CASE WHEN m IS NOT NULL THEN {{'at': instr(html, m) - 1, 'm': m}} END FROM (SELECT {all_}[1] AS m))"
    return f"(SELECT CASE WHEN b IS NOT NULL THEN {{'at': instr(html, a) + length(a) - 1 + instr(substring(html, instr(html, a) + length(a)), b) - 1, 'm': b}} END FROM (SELECT l[1] AS a, l[2] AS b FROM (SELECT {all_} AS l)))"


_WHOLE_SQL = {
    "no-doctype": "(0, least(60, n))", "html-tag-missing": "(0, least(80, n))", "html-close-missing": "(greatest(0, n - 120), 120)", "body-close-missing": "(greatest(0, n - 120), 120)",
    "content-before-doctype": "(0, greatest(1, instr(lower(html), '<!doctype') - 1))",
    "content-after-html": f"(CASE WHEN contains(lower(html), '</html>') THEN n - {_units('list_last(string_split(lower(html), $$</html>$$))')} END, least(120, {_units('list_last(string_split(lower(html), $$</html>$$))')}))",
    "gtm-in-body": f"(CASE WHEN instr(lower(html), '<body') > 0 AND contains(substring(html, instr(lower(html), '<body')), 'GTM-') THEN {_units('substring(html, 1, instr(lower(html), $$<body$$) - 1)')} + {_units('string_split(substring(html, instr(lower(html), $$<body$$)), $$GTM-$$)[1]')} END, 14)",
}
_FAULTY = f"""
fl AS (SELECT [{', '.join(map(_q, FAULTS))}] AS faults),
f0 AS (SELECT page_id, replace(html, '<body>', '<body>' || faults[page_id % {len(FAULTS)} + 1]) AS html FROM pages, fl),
f1 AS (SELECT page_id, CASE WHEN page_id % 5 = 2 THEN replace(html, '<!DOCTYPE html>', '') ELSE html END AS html FROM f0),
f2 AS (SELECT page_id, CASE WHEN page_id % 7 = 3 THEN replace(html, '<head>', 'x <!doctype y>') ELSE html END AS html FROM f1),
f3 AS (SELECT page_id, CASE WHEN page_id % 13 = 6 THEN html || ' tail of it' ELSE html END AS html FROM f2),
f AS MATERIALIZED (SELECT *, {_units('html')} AS n FROM (SELECT page_id, CASE WHEN page_id % 3 = 1 THEN replace(html, '><', '>' || chr(10) || '<') ELSE html END AS html FROM f3) WHERE html <> '')"""
_PLACES_SQL = (
    f"WITH {_FAULTY}, pl AS MATERIALIZED ("
    + " UNION ALL ".join(f"SELECT page_id, html, n, unnest([{', '.join(map(_q, ids.split()))}]) AS check_id, {_units('substring(html, 1, p.at)')} AS o, {_units('p.m')} AS l, {_q(name.removesuffix(' 2'))} AS label FROM (SELECT *, {_place_sql(name)} AS p FROM f) WHERE p IS NOT NULL" for name, ids in places.AT.items())
    + "".join(f" UNION ALL SELECT page_id, html, n, '{i}', p[1], p[2], 'document' FROM (SELECT *, {e} AS p FROM f) WHERE p[1] IS NOT NULL" for i, e in _WHOLE_SQL.items())
    + "), ok AS (SELECT * FROM pl WHERE o >= 0 AND o < n)"
)
# places begin after whole characters; those beyond U+FFFF before a place are two units
_BEFORE = "list_first(list_filter(range(greatest(0, o - 40), o + 1), lambda k: {} = o))".format(_units("substring(html, 1, k)"))
QUERIES |= {f.__name__: f for f in (finding_places, finding_lines, finding_snippets, source_lines)}
ORACLES |= {
    "finding_places": f"{_PLACES_SQL} SELECT page_id, check_id, CAST(o AS INTEGER) AS offset, CAST(greatest(1, least(2000, l)) AS INTEGER) AS length, label FROM ok",
    "finding_lines": f"{_PLACES_SQL}, b AS (SELECT page_id, check_id, string_split(substring(html, 1, {_BEFORE}), chr(10)) AS s FROM ok) SELECT page_id, check_id, CAST(len(s) AS BIGINT) AS line, {_units('list_last(s)')} + 1 AS column FROM b",
    "source_lines": f"WITH {_FAULTY} SELECT page_id, n AS units, CAST(len(string_split(html, chr(10))) AS BIGINT) AS lines, n >= 2000 AND len(string_split(html, chr(10))) - 1 <= n / 200.0 AS flat FROM f",
}
