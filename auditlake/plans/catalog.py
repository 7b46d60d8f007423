"""Registered queries of the audit engine and their SQL.

The driver's tables stand in for the history tables: `events` for polls (user_id: site,
value: response), `orders` for snapshots of a customer's rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions.urls import bare_host
from auditlake.operators import checks, crosspage, graph, history, locations, scoring, sitechecks
from auditlake.plans import evidence, given, insights, ledgers, lists, more, reports, sql, standins
from auditlake.sources.html import extract_pages


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark, sf_dir):
    return extract_pages(_t(spark, sf_dir, "pages"))


def page_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's penalty, number of failed checks and score."""
    return checks.scored(_records(spark, sf_dir), checks.registry())


def _marks(spark, sf_dir):
    """Pages parsed and checked once; what is left are a few numbers a page."""
    return graph._cut(checks.marks(_records(spark, sf_dir), checks.registry()))


def _named(outcomes: DataFrame) -> DataFrame:
    return outcomes.withColumn("pages", F.array_join("pages", ","))


def check_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(checks.outcomes(_marks(spark, sf_dir), checks.registry()))


def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.category_summary(_marks(spark, sf_dir), checks.registry())


def record_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks on one page, over stand-in records."""
    return checks.evaluate(standins.rows(_t(spark, sf_dir, "pages")), checks.registry())


def record_cross_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks across pages, over stand-in records."""
    return crosspage.findings(standins.rows(_t(spark, sf_dir, "pages")))


def record_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(checks.outcomes(graph._cut(checks.marks(standins.rows(_t(spark, sf_dir, "pages")), checks.registry())), checks.registry()))


def record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.category_summary(graph._cut(checks.marks(standins.rows(_t(spark, sf_dir, "pages")), checks.registry())), checks.registry())


def record_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.scored(standins.rows(_t(spark, sf_dir, "pages")), checks.registry()).drop("url")


def site_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of a site, over stand-in facts of one site a customer."""
    return sitechecks.findings(_t(spark, sf_dir, "customer").selectExpr(*(f"{e} as {c}" for c, e in standins.SITE.items())))


def record_pillars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pillars(record_outcomes(spark, sf_dir))


def url_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.evaluate(_t(spark, sf_dir, "pages"), checks.url_checks()).select("page_id", "check_id", "severity")


def markup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.evaluate(_t(spark, sf_dir, "pages"), checks.markup_checks()).select("page_id", "check_id", "severity")


def link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = graph.link_rows(_records(spark, sf_dir))
    return links.groupBy("from_page").agg(F.count("*").alias("links"), F.count_if("internal").alias("internal"), F.count_if("nofollow").alias("nofollow"), F.count_distinct("key").alias("targets"))


def inbound_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.inbound(_records(spark, sf_dir))


def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphans(_records(spark, sf_dir))


def _slim(spark, sf_dir):
    """Keys and links of the pages, parsed once."""
    links = F.transform("links", lambda x: F.struct(*(x[c].alias(c) for c in ("key", "internal", "nofollow", "raw_href"))))
    return graph._cut(_records(spark, sf_dir).select("page_id", "url", "page_key", links.alias("links")))


def page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _slim(spark, sf_dir)
    return graph.pagerank(records.select(F.col("page_key").alias("node")), graph.edges(records))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages parsed once, one row for each text that could be shared, one aggregation joined back."""
    clean = lambda c: F.trim(F.lower(F.coalesce(c, F.lit(""))))
    body = F.when(F.length("body_text") > 200, F.substring(F.trim(F.regexp_replace(F.lower("body_text"), r"(?U)\s+", " ")), 1, 2000)).otherwise("")
    h1 = F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))["text"]
    kinds = (("title", clean(F.col("title"))), ("description", clean(F.col("description"))), ("h1", clean(h1)), ("content", body))
    texts = F.inline(F.array(*(F.struct(F.lit(name).alias("kind"), key.alias("k")) for name, key in kinds)))
    return graph.shared(graph._cut(_records(spark, sf_dir).select("page_id", texts).where("k <> ''")))


def uptime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks, failures and mean response of every site; a poll of type 'error' or without a value is down."""
    e = _t(spark, sf_dir, "events")
    down = F.coalesce((F.col("event_type") == "error") | F.col("value").isNull(), F.lit(True))
    return e.groupBy("user_id").agg(F.count("*").alias("checks"), F.count_if(down).alias("failures"), F.round(100 * F.count_if(~down) / F.count("*"), 6).alias("uptime_pct"), F.round(F.avg("value"), 6).alias("mean_response"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive slow polls (value over 50) of a site: gaps and islands by a running count of good polls."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.coalesce(F.col("value") > 50, F.lit(True)).alias("bad"))
    return history.incidents(e).withColumnRenamed("site", "user_id")


def latest_and_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest and previous snapshot of every customer and the movement between them."""
    # two rows a customer are kept before the shuffle, however many it has
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.row_number().over(w).alias("rn")).where("rn <= 2")
    o = o.groupBy("o_custkey").agg(F.max(F.when(F.col("rn") == 1, F.col("o_totalprice"))).alias("latest"), F.max(F.when(F.col("rn") == 2, F.col("o_totalprice"))).alias("previous"))
    return o.withColumn("movement", F.round(F.col("previous") - F.col("latest"), 4))


def first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    key = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy("o_custkey").agg(F.count("*").alias("crawls"), F.min_by("o_totalprice", key).alias("first_score"), F.max_by("o_totalprice", key).alias("last_score"))


def monthly_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("provider"), F.date_format("ts", "yyyy-MM").alias("period")).agg(F.count("*").alias("used"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.agg(F.count("*").alias("total"), *(F.count_if(F.col("o_orderstatus") == s).alias(f"status_{s.lower()}") for s in "FOP"), F.count_distinct("o_custkey").alias("hosts"))


def top_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 customers with the largest sums: a top-k report."""
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return o.orderBy(F.desc("total"), "o_custkey").limit(25)


def never_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a pending order: the anti join of analytics URLs never crawled."""
    return _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _t(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type")
    return out.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def cross_page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspage.findings(_records(spark, sf_dir))


def site_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every host; pages weigh by PageRank.  Pages are parsed once for their scores and once for their links."""
    records = _slim(spark, sf_dir)
    ranks = graph.pagerank(records.select(F.col("page_key").alias("node")), graph.edges(records)).withColumnRenamed("rank", "page_rank")
    audit = page_audit(spark, sf_dir).select("page_id", "score", bare_host(F.col("url")).alias("site"))
    return scoring.site_scores(audit.join(records.select("page_id", F.col("page_key").alias("node")), "page_id").join(ranks, "node", "left"))


def pillar_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pillars(check_outcomes(spark, sf_dir))


def location_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of three fixed locations by every page."""
    return locations.coverage(_records(spark, sf_dir), [{"label": "Austin, Texas", "city": "Austin", "region": "Texas"}, {"label": "Oslo"}, {"label": "York", "region": "Yorkshire"}])


def quota_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call with its running number in its provider's month, and whether it is within 100."""
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("provider"), "ts")
    return history.quota_ledger(e, 100).select("id", "provider", "period", "n", "allowed")


def uptime_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("value") <= 50).alias("ok"))
    return history.uptime_transitions(e).select("site", "id", "transition")


def content_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("body_hash"))
    return history.content_changes(e).select("site", "id", "body_hash", "previous")


def rank_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions stand in as key modulo 120, over 100 as not found."""
    at = F.col("o_orderkey") % 120
    return history.rank_kpis(_t(spark, sf_dir, "orders").select(F.when(at <= 100, at).alias("position")))


def analytics_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("value", F.coalesce("value", F.lit(0.0)))
    at = F.concat(F.lit("/"), F.upper("event_type"), F.lit("/"), F.col("user_id"), F.when(F.col("event_id") % 2 == 0, "/").otherwise("?q=1"))
    rows = e.select(at.alias("path"), F.lit(1).cast("long").alias("pageviews"), (F.col("event_id") % 3).alias("sessions"), F.col("value").alias("bounce_rate"), (F.col("value") * 2).alias("avg_duration_sec"))
    return history.by_path(rows).select("path", "pageviews", "sessions", F.round("bounce_rate", 9).alias("bounce_rate"))


def top_traffic_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.top_decile(_t(spark, sf_dir, "customer"), "c_custkey", "c_acctbal")


def crawl_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with finished orders only ('fixed') and with open orders only ('appeared')."""
    o = _t(spark, sf_dir, "orders")
    return scoring.crawl_diff(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey")


FLAGSHIP = "page_audit"
QUERIES = {f.__name__: f for f in (record_findings, record_cross_page, record_outcomes, record_summary, record_scores, record_pillars, site_findings, page_audit, check_outcomes, category_summary, url_findings, markup_findings, link_summary, inbound_links, orphan_pages, page_rank, duplicate_groups, uptime, incidents, latest_and_previous, first_and_last, monthly_quota, status_counts, top_landing, never_seen, daily_events, cross_page_findings, site_score, pillar_rollup, location_coverage, quota_ledger, uptime_transitions, content_changes, rank_kpis, analytics_by_path, top_traffic_decile, crawl_diff)}

_MARKUP = " UNION ALL ".join(
    f"SELECT page_id, '{t}-tag-missing' AS check_id, 'critical' AS severity FROM m WHERE {t}_o = 0 UNION ALL SELECT page_id, '{t}-close-missing', 'warning' FROM m WHERE {t}_o > 0 AND {t}_c = 0 UNION ALL SELECT page_id, 'multiple-{t}-tags', 'critical' FROM m WHERE {t}_o > 1"
    for t in ("html", "head", "body")
)
_COUNTS = ", ".join(f"len(regexp_extract_all(html, '(?i)<{t}[\\s>]')) AS {t}_o, len(regexp_extract_all(html, '(?i)</{t}\\s*>')) AS {t}_c" for t in ("html", "head", "body"))
_NAMED = "len(list_filter(keys, lambda k: lower(k) IN ({}))) > 0"
ORACLES = {
    "url_findings": r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
  list_filter(list_transform(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: string_split(x, '=')[1]), lambda k: k <> '') AS keys FROM pages),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM u)
SELECT page_id, 'long-urls' AS check_id, 'notice' AS severity FROM s WHERE length(url) > 115
UNION ALL SELECT page_id, 'url-uppercase', 'warning' FROM s WHERE regexp_matches(path, '[A-Z]')
UNION ALL SELECT page_id, 'url-underscores', 'notice' FROM s WHERE contains(path, '_')
UNION ALL SELECT page_id, 'url-whitespace', 'warning' FROM s WHERE regexp_matches(path, '%20|\+| ')
UNION ALL SELECT page_id, 'url-repetitive-elements', 'notice' FROM s WHERE len(list_filter(range(2, len(seg) + 1), lambda i: seg[i] = seg[i - 1])) > 0
UNION ALL SELECT page_id, 'double-slash-in-url', 'warning' FROM s WHERE contains(path, '//')
UNION ALL SELECT page_id, 'more-than-three-parameters', 'notice' FROM s WHERE len(keys) > 3
UNION ALL SELECT page_id, 'query-question-mark', 'notice' FROM s WHERE len(keys) > 0
UNION ALL SELECT page_id, 'query-repetitive-parameters', 'warning' FROM s WHERE len(keys) <> len(list_distinct(keys))
UNION ALL SELECT page_id, 'query-paginated-parameters', 'notice' FROM s WHERE """
    + _NAMED.format("'page', 'p', 'pg', 'offset', 'start'")
    + " UNION ALL SELECT page_id, 'query-search-filter-parameters', 'notice' FROM s WHERE "
    + _NAMED.format("'q', 's', 'search', 'query', 'filter', 'f', 'color', 'size', 'brand'")
    + " UNION ALL SELECT page_id, 'http-urls', 'critical' FROM s WHERE starts_with(url, 'http://')",
    "markup_findings": f"""
WITH m AS (SELECT page_id, octet_length(CAST(html AS BLOB)) AS size, {_COUNTS}, len(list_distinct(regexp_extract_all(html, 'GTM-[A-Z0-9]{{4,10}}'))) AS codes,
  len(list_filter(refs, lambda x: contains(x, 'www.w3.org'))) AS w3, len(list_filter(refs, lambda x: contains(x, 'schema.org'))) AS so FROM (SELECT page_id, html, encode(html) AS b, regexp_extract_all(html, '(?i)\\b(?:src|href)\\s*=\\s*["''](http://[^"'']+)["'']', 1) AS refs FROM pages))
{_MARKUP} UNION ALL SELECT page_id, 'page-code-under-500', 'critical' FROM m WHERE size < 500
UNION ALL SELECT page_id, 'page-size-over-1-5mb', 'warning' FROM m WHERE size > 1572864 AND size <= 2097152
UNION ALL SELECT page_id, 'page-size-over-2mb', 'critical' FROM m WHERE size > 2097152
UNION ALL SELECT page_id, 'no-gtm-code', 'notice' FROM m WHERE codes = 0 UNION ALL SELECT page_id, 'multiple-gtm-codes', 'warning' FROM m WHERE codes > 1
UNION ALL SELECT page_id, 'http-link-w3-org', 'notice' FROM m WHERE w3 > 0 UNION ALL SELECT page_id, 'http-link-schema-org', 'notice' FROM m WHERE so > 0""".replace("octet_length(CAST(html AS BLOB))", "octet_length(b)"),
    "uptime": "SELECT user_id, count(*) AS checks, count(*) FILTER (WHERE coalesce(event_type = 'error' OR value IS NULL, true)) AS failures, round(100.0 * count(*) FILTER (WHERE NOT coalesce(event_type = 'error' OR value IS NULL, true)) / count(*), 6) AS uptime_pct, round(avg(value), 6) AS mean_response FROM events GROUP BY user_id",
    "incidents": "WITH e AS (SELECT *, coalesce(value > 50, true) AS bad, sum(CASE WHEN coalesce(value > 50, true) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events) SELECT user_id, CAST(island AS BIGINT) AS island, min(ts) AS started_at, max(ts) AS last_at, count(*) AS failure_count FROM e WHERE bad GROUP BY user_id, island",
    "latest_and_previous": "WITH r AS (SELECT o_custkey, o_totalprice, lead(o_totalprice) OVER w AS previous, row_number() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)) SELECT o_custkey, o_totalprice AS latest, previous, round(previous - o_totalprice, 4) AS movement FROM r WHERE rn = 1",
    "first_and_last": "SELECT o_custkey, count(*) AS crawls, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_score, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_score FROM orders GROUP BY o_custkey",
    "monthly_quota": "SELECT event_type AS provider, strftime(ts, '%Y-%m') AS period, count(*) AS used FROM events GROUP BY 1, 2",
    "status_counts": "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS status_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS status_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS status_p, count(DISTINCT o_custkey) AS hosts FROM orders",
    "top_landing": "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 25",
    "never_seen": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "daily_events": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
    "quota_ledger": "WITH e AS (SELECT event_id AS id, event_type AS provider, strftime(ts, '%Y-%m') AS period, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY provider, period ORDER BY ts, id) AS n FROM e) SELECT id, provider, period, n, n <= 100 AS allowed FROM r",
    "uptime_transitions": "WITH e AS (SELECT user_id AS site, ts, event_id AS id, coalesce(value <= 50, false) AS ok FROM events), r AS (SELECT *, coalesce(lag(ok) OVER (PARTITION BY site ORDER BY ts, id), true) AS was FROM e) SELECT site, id, CASE WHEN ok AND was THEN 'none' WHEN ok THEN 'recovered' WHEN was THEN 'went-down' ELSE 'still-down' END AS transition FROM r",
    "content_changes": "WITH r AS (SELECT user_id AS site, event_id AS id, event_type AS body_hash, lag(event_type) OVER w AS previous, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT site, id, body_hash, previous FROM r WHERE n > 1 AND previous IS DISTINCT FROM body_hash",
    "rank_kpis": "SELECT count(*) AS keywords, count(p) AS ranked, count(*) FILTER (WHERE p <= 10) AS top_10, round(avg(p), 4) AS mean_position FROM (SELECT CASE WHEN o_orderkey % 120 <= 100 THEN o_orderkey % 120 END AS p FROM orders)",
    "analytics_by_path": "WITH e AS (SELECT '/' || lower(event_type) || '/' || user_id AS path, event_id % 3 AS s, coalesce(value, 0) AS value FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL) SELECT path, count(*) AS pageviews, CAST(sum(s) AS BIGINT) AS sessions, round(CASE WHEN count(*) = 1 THEN max(value) ELSE sum(value * s) / greatest(sum(s), 1) END, 9) AS bounce_rate FROM e GROUP BY path",
    "top_traffic_decile": "WITH a AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC) AS n, greatest(1, ceil(count(*) OVER () / 10.0)) AS place FROM customer WHERE c_acctbal > 0) SELECT c_custkey, c_acctbal FROM a WHERE c_acctbal >= (SELECT max(c_acctbal) FROM a WHERE n >= place)",
    "crawl_diff": "WITH f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') SELECT o_custkey, 'fixed' AS change FROM f WHERE o_custkey NOT IN (SELECT o_custkey FROM o) UNION ALL SELECT o_custkey, 'appeared' FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM f)",
    "record_findings": sql.record_findings(),
    "site_findings": sql.site_findings(),
    "record_cross_page": sql.cross_page(crosspage.SEVERITIES),
    "record_outcomes": sql.outcomes(),
    "record_summary": sql.summary(),
    "record_scores": sql.scores(),
    "record_pillars": sql.pillars(scoring.PILLARS),
}

QUERIES |= evidence.QUERIES | ledgers.QUERIES | insights.QUERIES | reports.QUERIES | lists.QUERIES | more.QUERIES
ORACLES |= evidence.ORACLES | ledgers.ORACLES | insights.ORACLES | reports.ORACLES | given.ORACLES | lists.ORACLES | more.ORACLES
