"""Queries on the framework's marks, robots rules, saved pages and capped scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.urls import bare_host, host
from auditlake.operators import checks, framework, robots, stores
from auditlake.operators.facts import prepared
from auditlake.plans import rules, sql, standins
from auditlake.plans.insights import ROBOTS


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Put before the end of a page's head, by its number; headers likewise.
MARKS = (
    "", '<script id="__NEXT_DATA__" type="application/json">{"buildId":"b1","gsp":true,"props":{}}</script>', "<script src=\"/_next/static/b2/_buildManifest.js\" defer></script><script src='/_next/static/b2/_ssgManifest.js'></script>", '<img src="/_next/image?url=a" data-nimg="fill"><img data-nimg="1" src="/x.png"><img srcset="/_next/image?u 1x" sizes="1px">',
    '<link rel="stylesheet" href="https://fonts.googleapis.com/css?x"><link rel=preload as="font" href=https://use.typekit.net/a><link rel="stylesheet" href="/own.css">', '<style>@font-face{src:a}@font-face { font-display: swap }</style><i class="__className_ab12 __variable_9 __className_ab12"></i><link href="/_next/static/media/a.woff2"><link href="/_next/static/media/b.ttf">',
    '<script src="/a.js?dpl=dpl_12_x"></script><script async src="/b.js"></script><script src="/c.js" defer></script><script>x</script>', "<script>self.__next_f.push([1,\"a\"])</script><template id=\"B:1\"></template>", "<script>self.__next_f.push([1,\"a\"])</script>",
)
HEADERS = (
    {}, {"x-nextjs-deployment-id": "d9"}, {"x-nextjs-version": "15.1", "age": "77"}, {"cache-control": "public, s-maxage=9, stale-while-revalidate=60"}, {"x-middleware-rewrite": "/to"}, {"x-matched-path": "/at", "x-middleware-set-cookie": "1"}, {"cache-control": "private, stale-while-revalidate", "age": "old"}, {"x-middleware-next": "1", "x-powered-by": "Next.js"},
)


def _marked(pages: DataFrame) -> DataFrame:
    """page_id, url, html, headers: pages with marks of the framework in their heads."""
    i = F.col("page_id")
    mark = F.get(F.array(*map(F.lit, MARKS)), (i % len(MARKS)).cast("int"))
    maps = [F.create_map(*(F.lit(x) for kv in h.items() for x in kv)) if h else F.create_map().cast("map<string,string>") for h in HEADERS]
    return pages.select("page_id", "url", F.replace("html", F.lit("</head>"), F.concat(mark, F.lit("</head>"))).alias("html"), F.get(F.array(*maps), (i % len(HEADERS)).cast("int")).alias("headers"))


def framework_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds, fonts, pictures, scripts and middleware of every page."""
    return framework.fingerprints(_marked(_t(spark, sf_dir, "pages"))).drop("url")


def framework_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routers, strategies and builds of every site."""
    rows = _marked(_t(spark, sf_dir, "pages"))
    builds = framework.fingerprints(rows).select("page_id", "build_id")
    known = prepared(rows).select("page_id", "url", "is_next", "router", "strategy").join(builds, "page_id")
    return framework.site_framework(known, bare_host(F.col("url")))


def robots_disallowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages, and which places under them, the robots files of their hosts exclude."""
    pages = _t(spark, sf_dir, "pages")
    sites = pages.select(host(F.col("url")).alias("host")).distinct()
    extra = "User-agent: *\nDisallow: /en/*1\nAllow: /en/*11$\nDisallow: /*.html$\nDisallow: /fr\nAllow: /fr/\nUser-agent: x\nDisallow: /"
    files = sites.select("host", F.get(F.array(*(F.lit(x).cast("string") for x in (*ROBOTS, extra, extra))), (F.length("host") % (len(ROBOTS) + 2)).cast("int")).alias("content")).where("content is not null")
    return robots.disallowed(pages.select("page_id", "url"), robots.rules(files)).select("page_id", "disallowed")


def snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What seven crawls would save of the pages."""
    rows = _t(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("crawl"), "page_id", "url", F.when(F.col("page_id") % 17 != 3, F.col("html")).alias("html"))
    return stores.snapshot_stats(stores.saved(rows))


def report_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page scores as a report has them: of the findings of the first 500 pages of each check."""
    rows = standins.rows(_t(spark, sf_dir, "pages"))
    found = checks.evaluate(rows, checks.registry(), keep=("page_id", "crawl_order"))
    return checks.page_scores(checks.capped(found), rows).drop("url")


QUERIES = {f.__name__: f for f in (framework_marks, framework_sites, robots_disallowed, snapshot_stats, report_page_scores)}


def _q(x: str | None) -> str:
    return "NULL" if x is None else " || chr(10) || ".join("'" + y.replace("'", "''") + "'" for y in x.split("\n"))


_attr = rules._attr
_MAPS = ", ".join("MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in h.items()) + "}" if h else "CAST(MAP {} AS MAP(VARCHAR, VARCHAR))" for h in HEADERS)
_TAGS = lambda n: f"regexp_extract_all(html, '(?i)<{n}[^>]*>')"
_SRC = f"coalesce({_attr('g', 'src')}, '')"
_OPT = f"(contains({_SRC}, '/_next/image?') OR contains(coalesce({_attr('g', 'srcset')}, ''), '/_next/image?'))"
_NIMG = _attr("g", "data-nimg")
_MARKED = f"""mk AS MATERIALIZED (SELECT page_id, url, replace(html, '</head>', [{', '.join(map(_q, MARKS))}][page_id % {len(MARKS)} + 1] || '</head>') AS html, [{_MAPS}][page_id % {len(HEADERS)} + 1] AS hd FROM pages),
fw AS MATERIALIZED (SELECT page_id, url, html, hd, regexp_matches(html, '{rules._DATA}') AS has_data, regexp_extract(html, '{rules._DATA}', 1) AS data, coalesce(hd['cache-control'], '') AS cc, regexp_extract(html, '(?is)<head[^>]*>(.*?)</head>', 1) AS head FROM mk),
bd AS MATERIALIZED (SELECT *, coalesce(nullif(CASE WHEN data <> '' THEN json_extract_string(data, '$.buildId') END, ''), nullif(hd['x-nextjs-deployment-id'], ''), nullif(regexp_extract(html, '/_next/static/([^/"'']+)/_(?:build|ssg)Manifest\\.js', 1), ''), nullif(regexp_extract(html, '[?&]dpl=(dpl_[A-Za-z0-9_]+|[A-Za-z0-9_-]{{8,}})', 1), '')) AS build_id FROM fw)"""
_HOSTED = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_EXTRA = "User-agent: *\nDisallow: /en/*1\nAllow: /en/*11$\nDisallow: /*.html$\nDisallow: /fr\nAllow: /fr/\nUser-agent: x\nDisallow: /"
_WEIGHT = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in checks.SEVERITY.items()) + " END"
ORACLES = {
    "framework_marks": f"""WITH {_MARKED} SELECT page_id, build_id, nullif(hd['x-nextjs-version'], '') AS version, TRY_CAST(nullif(regexp_extract(cc, 'stale-while-revalidate=([0-9]+)', 1), '') AS BIGINT) AS swr, TRY_CAST(hd['age'] AS BIGINT) AS age, CAST(len(list_distinct(regexp_extract_all(html, '(?i)__(?:className|variable)_[a-z0-9]+'))) AS INTEGER) AS font_classes,
  CAST(len(list_distinct(regexp_extract_all(html, '(?i)/_next/static/media/[^"'')\\s]+\\.(?:woff2?|ttf|otf)'))) AS INTEGER) AS font_files, CAST(len(list_filter({_TAGS('link')}, lambda g: (regexp_matches(g, '(?i)rel\\s*=\\s*["'']?stylesheet') OR regexp_matches(g, '(?i)as\\s*=\\s*["'']?(font|style)')) AND regexp_matches(coalesce({_attr('g', 'href')}, ''), '(?i)fonts\\.googleapis\\.com|fonts\\.gstatic\\.com|use\\.typekit\\.net|fast\\.fonts\\.net|@fontsource'))) AS INTEGER) AS hosted_fonts,
  CAST(len(list_filter(regexp_extract_all(html, '(?i)@font-face\\s*\\{{[^}}]*\\}}'), lambda g: NOT regexp_matches(g, '(?i)font-display\\s*:'))) AS INTEGER) AS faces_without_display, CAST(len(list_filter({_TAGS('img')}, lambda g: {_OPT} OR {_NIMG} IS NOT NULL)) AS INTEGER) AS pictures, CAST(len(list_filter({_TAGS('img')}, lambda g: {_NIMG} IS NOT NULL AND NOT {_OPT})) AS INTEGER) AS unoptimized,
  CAST(len(list_filter({_TAGS('img')}, lambda g: {_NIMG} = 'fill' AND coalesce({_attr('g', 'sizes')}, '') = '')) AS INTEGER) AS unsized, CAST(len(list_filter({_TAGS('script')}, lambda g: {_SRC} <> '' AND NOT contains({_SRC}, '/_next/static/') AND contains(head, g) AND NOT regexp_matches(g, '(?i)\\s(defer|async)(\\s|=|>|/)'))) AS INTEGER) AS blocking_scripts,
  CAST(len(list_distinct(list_filter(list_transform({_TAGS('script')}, lambda g: {_SRC}), lambda s: contains(s, '/_next/static/')))) AS INTEGER) AS route_scripts, len(list_filter(map_keys(hd), lambda k: k IN ('x-middleware-rewrite', 'x-middleware-next', 'x-middleware-set-cookie', 'x-matched-path'))) > 0 AS middleware, list_contains(map_keys(hd), 'x-middleware-rewrite') AS rewrote, coalesce(hd['x-matched-path'], hd['x-middleware-rewrite']) AS matched_path, list_contains(map_keys(hd), 'x-middleware-set-cookie') AS sets_cookie FROM bd""",
    "framework_sites": f"""WITH {_MARKED}, nx AS (SELECT *, regexp_matches(html, '{rules._PUSH}') AS app, {rules._u(rules._body_text())} AS seen, len(list_filter(list_distinct({rules._OPENED}), lambda x: NOT list_contains({rules._CLOSED}, x))) AS waits, TRY_CAST(nullif(regexp_extract(cc, 's-maxage=([0-9]+)', 1), '') AS BIGINT) AS kept FROM bd),
ns AS (SELECT regexp_replace({_HOSTED}, '^www\\.', '') AS site, build_id, CASE WHEN app AND has_data THEN 'hybrid' WHEN app THEN 'app' WHEN has_data THEN 'pages' ELSE 'unknown' END AS router, CASE WHEN contains(data, '"gsp":true') THEN CASE WHEN kept > 0 THEN 'isr' ELSE 'static' END WHEN waits > 0 THEN 'streaming' WHEN regexp_matches(cc, 'no-store|private') THEN 'ssr' WHEN (app OR has_data) AND seen < 200 THEN 'client' WHEN kept > 0 THEN 'isr' ELSE 'unknown' END AS how
  FROM nx WHERE app OR has_data OR contains(html, '/_next/static/') OR contains(lower(coalesce(hd['x-powered-by'], '')), 'next.js')),
rt AS (SELECT site, router FROM ns GROUP BY site, router QUALIFY row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, router) = 1)
SELECT ns.site, count(*) AS pages, any_value(rt.router) AS router, count(DISTINCT build_id) AS build_ids, """
    + ", ".join(f"count(*) FILTER (WHERE how = '{s}') AS {s}" for s in ("ssr", "static", "isr", "streaming", "client", "unknown"))
    + " FROM ns JOIN rt ON rt.site = ns.site GROUP BY ns.site",
    "robots_disallowed": f"""WITH hs AS (SELECT DISTINCT {_HOSTED} AS host FROM pages), ln AS (SELECT host, unnest(string_split(c, chr(10))) AS l, unnest(range(len(string_split(c, chr(10))))) AS no FROM (SELECT host, [{', '.join(map(_q, (*ROBOTS, _EXTRA, _EXTRA)))}][length(host) % {len(ROBOTS) + 2} + 1] AS c FROM hs) WHERE c IS NOT NULL),
kv AS (SELECT host, no, lower(trim(string_split(regexp_replace(l, '#.*$', ''), ':')[1])) AS k, trim(substring(regexp_replace(l, '#.*$', ''), instr(l, ':') + 1)) AS v FROM ln WHERE contains(regexp_replace(l, '#.*$', ''), ':')),
ru AS MATERIALIZED (SELECT host, k = 'allow' AS ok, v, '^' || replace(regexp_replace(v, '([.+?^{{}}()|\\[\\]\\\\])', '\\\\\\1', 'g'), '*', '.*') AS rx FROM (SELECT *, (SELECT arg_max(a.v = '*' OR contains(lower(a.v), 'googlebot'), a.no) FROM kv a WHERE a.host = kv.host AND a.k = 'user-agent' AND a.no < kv.no) AS mine FROM kv) WHERE mine AND (k = 'allow' OR (k = 'disallow' AND v <> ''))),
pt AS (SELECT page_id, {_HOSTED} AS host, CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS p FROM (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)', 1) AS p FROM pages))
SELECT page_id, NOT coalesce((SELECT arg_max(ok, (length(v), ok)) FROM ru WHERE ru.host = pt.host AND regexp_matches(pt.p, rx)), true) AS disallowed FROM pt""",
    "snapshot_stats": """WITH k AS (SELECT page_id % 7 AS crawl, page_id, octet_length(encode(html)) AS b, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') AS u FROM pages WHERE page_id % 17 <> 3),
f AS (SELECT * FROM k WHERE b BETWEEN 1 AND 4194304 QUALIFY row_number() OVER (PARTITION BY crawl, u ORDER BY page_id) = 1) SELECT crawl, count(*) AS pages, CAST(sum(b) AS BIGINT) AS raw_bytes FROM f GROUP BY crawl""",
    "report_page_scores": f"{sql._found()}, c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY check_id ORDER BY page_id) <= 500), s AS (SELECT page_id, CAST(sum({_WEIGHT}) AS DOUBLE) AS penalty, count(*) AS issues FROM c GROUP BY page_id) SELECT h.page_id, coalesce(penalty, 0) AS penalty, coalesce(issues, 0) AS issues, round(100 * exp(-coalesce(penalty, 0) / 100), 6) AS score FROM h LEFT JOIN s ON s.page_id = h.page_id",
}
