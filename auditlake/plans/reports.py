"""The whole report, checks on traffic, counts and severities over stand-in records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import checks, crosspage, report, sitechecks, traffic
from auditlake.plans import rules, sql, standins
from auditlake.sources.html import spread

#: Search and analytics rows of a page i, spelled alike in both engines.
SEARCH = {"clicks": "cast(i % 5 * (i % 3) as bigint)", "impressions": "cast(i * 13 % 700 as bigint)", "ctr": "(i % 7) / 100.0", "position": "cast(i % 14 as double)"}
ANALYTICS = {"pageviews": "cast(i % 90 as bigint)", "sessions": "cast(i * 7 % 60 as bigint)", "users": "cast(i % 50 as bigint)", "conversions": "cast(i % 6 as bigint)", "bounce_rate": "cast(i % 10 as double) / 10", "avg_duration_sec": "cast(i as double)"}
#: The customer whose facts are the site's.
SITE = 7


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _with_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.rows(_pages(spark, sf_dir))
    i = F.col("page_id")
    known = rows.select(
        "page_id", "crawl_order", "url", "page_key", "status", (F.col("soft_noindex") | F.contains("x_robots", F.lit("noindex"))).alias("noindex"), "disallowed", "in_sitemap", (i % 5 == 1).alias("is_orphan"), F.col("canon").alias("canonical_key"), "title", "titles", F.size("h1s").alias("h1s"), "description",
        "ttfb_ms", "timed_out", F.col("shell").alias("client_shell"), "rendered", F.col("text_units").cast("int").alias("text_units"), (i % 6 == 2).alias("poor_lcp"), F.col("gtm").alias("gtm_codes"), "html", "is_html",
    )
    base = known.select(i.alias("i"), "page_key", "url")
    twice = base.select("*", F.explode(F.when(F.col("i") % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("more")).withColumn("i", F.col("i") + F.col("more") * 31)
    search = twice.where("(i - more * 31) % 4 <> 0").selectExpr("page_key as url", *(f"{e} as {c}" for c, e in SEARCH.items()))
    analytics = base.where("i % 3 <> 1").selectExpr("url as path", *(f"{e} as {c}" for c, e in ANALYTICS.items()))
    return traffic.with_traffic(known, search, analytics)


def record_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks on search and analytics figures, over stand-in records with a row of figures for most."""
    return checks.evaluate(_with_traffic(spark, sf_dir), traffic.traffic_checks()).select("page_id", "check_id", "severity")


def _report(spark: SparkSession, sf_dir: str, named: bool = True, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    records = standins.rows(_pages(spark, sf_dir))
    facts = spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.col("c_custkey") == SITE).selectExpr(*(f"{e} as {c}" for c, e in standins.SITE.items()))
    return report.report(records, _with_traffic(spark, sf_dir), facts, named, whole), records


def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 332 checks with their outcomes, as a report lists them."""
    return _report(spark, sf_dir)[0].withColumn("pages", F.array_join("pages", ","))


def report_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.severities(_report(spark, sf_dir, named=False)[0])


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, records = _report(spark, sf_dir, named=False, whole=False)  # as its SQL
    return report.counts(records, out, records.where("page_id % 5 = 1"))


QUERIES = {f.__name__: f for f in (record_traffic, full_report, report_severities, report_counts)}

_PATH = "lower('/' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}), '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '^/', ''), '/$', ''))"
_FIGURES = f"""
sr AS (SELECT page_key, {', '.join(f'{e} AS {c}' for c, e in SEARCH.items())} FROM (SELECT page_key, page_id AS i FROM h WHERE page_id % 4 <> 0 UNION ALL SELECT page_key, page_id + 31 FROM h WHERE page_id % 4 <> 0 AND page_id % 9 = 0)),
sg AS MATERIALIZED (SELECT page_key, clicks, impressions, position FROM sr QUALIFY row_number() OVER (PARTITION BY page_key ORDER BY impressions DESC, clicks DESC, position DESC, ctr DESC) = 1),
ar AS (SELECT {_PATH.format('url')} AS path, {', '.join(f'{e} AS {c}' for c, e in ANALYTICS.items())} FROM (SELECT url, page_id AS i FROM h WHERE page_id % 3 <> 1)),
ap AS MATERIALIZED (SELECT path, sum(sessions) AS sessions, sum(conversions) AS conversions, CASE WHEN count(*) = 1 THEN max(bounce_rate) ELSE sum(bounce_rate * sessions) / greatest(1, sum(sessions)) END AS bounce FROM ar GROUP BY path),
td AS (SELECT min(sessions) AS least FROM (SELECT sessions, row_number() OVER (ORDER BY sessions DESC) AS n, count(*) OVER () AS a FROM ap WHERE sessions > 0) WHERE n <= greatest(1, ceil(0.1 * a))),
tp AS MATERIALIZED (SELECT h.*, sg.clicks, sg.impressions, sg.position AS spot, ap.sessions, ap.conversions, ap.bounce, coalesce(ap.sessions >= td.least, false) AS top, len(list_filter(meta_robots, lambda r: contains(r, 'noindex'))) > 0 OR contains(x_robots, 'noindex') AS out_of_index, page_id % 5 = 1 AS lonely, sg.page_key IS NOT NULL AS shown,
  len(tags_of_gtm) > 0 OR regexp_matches(html, '(?i)gtag\\s*\\(|googletagmanager\\.com|google-analytics\\.com|G-[A-Z0-9]{{8,}}') AS tagged FROM h LEFT JOIN sg ON sg.page_key = h.page_key LEFT JOIN ap ON ap.path = {_PATH.format('h.url')} CROSS JOIN td)"""
_BLANK = "coalesce(trim({}), '') = ''"
#: The checks on figures: severity, scope and what holds where one fails.
FIGURES = {
    "page-zero-impressions": ("notice", "status = 200 AND NOT out_of_index AND NOT disallowed", "coalesce(impressions, 0) = 0"), "page-has-clicks": ("notice", "shown", "clicks > 0"), "non-indexable-with-impressions": ("critical", "shown", "impressions >= 1 AND (out_of_index OR status <> 200)"),
    "blocked-with-impressions": ("critical", "shown", "impressions >= 1 AND disallowed"), "4xx-with-clicks": ("blocker", "true", "status >= 400 AND status < 500 AND clicks >= 1"), "3xx-with-clicks": ("warning", "true", "status >= 300 AND status < 400 AND clicks >= 1"), "canonicalized-with-clicks": ("warning", "shown", "elsewhere AND clicks >= 1"),
    "not-in-sitemap-with-impressions": ("warning", "shown AND status = 200 AND NOT out_of_index", "NOT in_sitemap AND impressions >= 1"), "orphan-with-impressions": ("critical", "shown", "lonely AND impressions >= 1"), "high-impressions-missing-title": ("critical", "shown", f"impressions >= 100 AND {_BLANK.format('title')}"),
    "high-impressions-low-ctr": ("opportunity", "shown", "impressions >= 200 AND spot BETWEEN 1e-9 AND 10 AND clicks / impressions < 0.02"), "traffic.ga4.tracking-tag-detected": ("critical", "status = 200", "sessions >= 1 AND NOT tagged"),
    "traffic.ga4.high-traffic-with-blocker": ("blocker", "true", "top AND sessions >= 10 AND (status >= 400 OR timed_out OR (rendered AND text_length < 200) OR (NOT rendered AND is_shell) OR (status = 200 AND titles = 0))"),
    "traffic.ga4.high-bounce-rate": ("opportunity", "status = 200", "sessions >= 20 AND bounce > 0.75 AND (ttfb_ms > 800 OR page_id % 6 = 2)"), "traffic.ga4.orphaned-with-traffic": ("warning", "status = 200", "sessions >= 1 AND lonely"),
    "traffic.ga4.converting-page-with-defects": ("critical", "status = 200", f"conversions >= 1 AND ({_BLANK.format('title')} OR len(one) = 0 OR first_canonical IS NULL OR {_BLANK.format('description')} OR ttfb_ms > 800)"),
}
_TF = " UNION ALL ".join(f"SELECT page_id, '{i}' AS check_id, '{s}' AS severity FROM tp WHERE is_html AND {scope} AND coalesce({e}, false)" for i, (s, scope, e) in FIGURES.items())


def _all(whole: bool = True) -> str:
    """u: every check with its outcome; whole: as of sql.tables."""
    facts = ", ".join(f"{e} AS {c}" for c, e in standins.SITE.items())
    scoped = " UNION ALL ".join(f"SELECT '{i}' AS check_id, 'search-traffic' AS category, '{s}' AS severity, (SELECT count(*) FROM tp WHERE is_html AND {scope}) AS applicable" for i, (s, scope, _) in FIGURES.items())
    crossed = " UNION ALL ".join(f"SELECT '{i}' AS check_id, '{c}' AS category, '{s}' AS severity, (SELECT count(*) FROM pg p WHERE {'p.has_langs' if i in sql.LANG_SCOPE else 'true' if i == 'missing-hreflang-annotations' else 'p.live'}) AS applicable" for i, (c, s, _) in crosspage.CHECKS.items())
    found = " UNION ALL ".join(f"SELECT page_id, '{i}' AS check_id FROM pg p WHERE {'p.has_langs' if i in sql.LANG_SCOPE else 'true' if i == 'missing-hreflang-annotations' else 'p.live'} AND coalesce({q}, false)" for i, q in sql.CROSS.items())
    site = " UNION ALL ".join(f"SELECT '{i}' AS check_id, '{c}' AS category, '{s}' AS severity, coalesce({rules.SITE_RULES[i]}, false) AS hit FROM sf" for i, c, s, _ in sitechecks.CHECKS)
    order = "CASE category " + " ".join(f"WHEN '{c}' THEN {n}" for n, c in enumerate(checks.CATEGORIES)) + " END"
    return f"""WITH {standins.sql()}, {rules.HELP}, f AS MATERIALIZED ({rules.findings(sql.LABELS)}), {sql._scopes()}, {sql.tables(whole)}, {_FIGURES}, sf AS (SELECT {facts} FROM customer WHERE c_custkey = {SITE}),
m AS MATERIALIZED (SELECT page_id, check_id FROM ({_TF}) UNION ALL {found}), ms AS (SELECT check_id, count(*) AS affected, array_to_string(list(page_id ORDER BY page_id)[1:500], ',') AS pages FROM m GROUP BY check_id),
u0 AS (SELECT check_id, category, severity, verdict, reason, affected, applicable, array_to_string(pages, ',') AS pages FROM o
  UNION ALL SELECT k.check_id, category, severity, CASE WHEN applicable = 0 THEN 'skipped' WHEN affected > 0 THEN 'failed' ELSE 'passed' END, CASE WHEN applicable = 0 THEN 'no page in scope' END, coalesce(affected, 0), applicable, coalesce(pages, '') FROM ({scoped} UNION ALL {crossed}) k LEFT JOIN ms ON ms.check_id = k.check_id
  UNION ALL SELECT check_id, category, severity, CASE WHEN hit THEN 'failed' ELSE 'passed' END, NULL, CASE WHEN hit THEN 1 ELSE 0 END, 1, '' FROM ({site})),
u AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY {order}, CASE verdict WHEN 'failed' THEN 0 WHEN 'passed' THEN 1 ELSE 2 END, affected DESC, check_id) AS INTEGER) AS place, check_id, category, severity, verdict, reason, CAST(affected AS BIGINT) AS affected, CAST(applicable AS BIGINT) AS applicable, pages FROM u0)"""


_LEVELS = ", ".join(f"({n}, '{s}')" for n, s in enumerate(checks.SEVERITY, 1))
_OPEN = "status = 200 AND NOT disallowed AND NOT (len(list_filter(meta_robots, lambda r: contains(r, 'noindex'))) > 0 OR contains(x_robots, 'noindex'))"
ORACLES = {
    "record_traffic": f"WITH {standins.base_sql()}, {rules.HELP}, {_FIGURES} {_TF}",
    "full_report": f"{_all()} SELECT * FROM u",
    "report_severities": f"{_all()} SELECT CAST(l.place AS INTEGER) AS place, l.severity, count(u.check_id) AS failed FROM (VALUES {_LEVELS}) l(place, severity) LEFT JOIN u ON u.severity = l.severity AND verdict = 'failed' GROUP BY ALL",
    "report_counts": f"{_all(whole=False)} SELECT (SELECT count(*) FROM h) AS crawled, (SELECT count(*) FROM h WHERE is_html) AS html_pages, (SELECT count(*) FROM h WHERE is_html AND {_OPEN}) AS indexable, (SELECT count(*) FROM h WHERE is_html AND NOT ({_OPEN})) AS non_indexable, (SELECT count(*) FROM h WHERE disallowed) AS blocked, (SELECT count(*) FROM h WHERE page_id % 5 = 1) AS orphans, count(*) AS checks_total, count(*) FILTER (WHERE verdict <> 'skipped') AS checks_run, count(*) FILTER (WHERE verdict = 'failed') AS checks_failed, count(*) FILTER (WHERE verdict = 'passed') AS checks_passed, count(*) FILTER (WHERE verdict = 'skipped') AS checks_skipped FROM u",
}
