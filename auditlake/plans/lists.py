"""Queries of the lists a user looks at, and their SQL.  Orders stand for crawls and snapshots of a customer's site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.urls import host
from auditlake.operators import tables
from auditlake.plans.insights import ROBOTS


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("score"))


def project_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site with its crawls, first and latest, also those without any."""
    return tables.projects(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site")), _crawls(spark, sf_dir).where("site % 7 <> 3"))


def score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.score_history(_crawls(spark, sf_dir), 5)


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderkey") % 120
    shots = _t(spark, sf_dir, "orders").where("o_custkey % 5 <> 2").select(F.col("o_custkey").alias("keyword"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.when(at <= 100, at).alias("position"))
    return tables.keyword_table(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("keyword"), F.col("c_name").alias("phrase")), shots)


def keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every keyword with its latest position, the one before and the movement."""
    return _keywords(spark, sf_dir)


def keywords_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 keywords of the table as it is shown."""
    return tables.keywords_first(_keywords(spark, sf_dir), 200)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda n, *values: F.get(F.array(*(F.lit(v).cast("string") for v in values)), (n % len(values)).cast("int"))
    i = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("site"), i.alias("link"), pick(i, "active", "active", "lost", "broken", "unverified").alias("status"), pick(i * 3, "dofollow", "nofollow", "ugc", None, "sponsored", "dofollow", "dofollow").alias("rel"), F.concat(F.lit("h"), (F.col("o_custkey") % 90).cast("string")).alias("host"), F.when(i % 11 != 0, F.col("o_orderdate")).alias("last_checked"))


def backlink_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 links to look at."""
    return tables.backlinks_first(_links(spark, sf_dir), 100).select("place", "link", "status", "last_checked")


def verify_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 links that are verified next."""
    return tables.to_verify(_links(spark, sf_dir)).select("place", "link", "last_checked")


def backlink_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.backlink_totals(_links(spark, sf_dir))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    return _t(spark, sf_dir, "pages").select("page_id", "url", (i % 12 != 5).alias("is_html"), (i * 31 % 97 / 97.0).alias("page_rank"), (i % 6).alias("depth"), (i * 7 % 101).cast("double").alias("score"), (i % 23).alias("issues"), F.when(i % 8 != 1, i % 5).alias("in_degree"), (i % 4 != 2).alias("indexable"))


def explorer_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the quarter of pages with highest rank, the first 40 with "en" in their address, worst score first."""
    return tables.explorer(_pages(spark, sf_dir), "top25", " EN ", "score", True, 40).select("place", "page_id", "score")


def explorer_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 60 pages without links to them that have most issues."""
    return tables.explorer(_pages(spark, sf_dir), "orphans", sort="issues", most=60).select("place", "page_id", "issues")


def robots_tidied(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages")
    sites = pages.select(host(F.col("url")).alias("host")).distinct()
    text = F.get(F.array(*(F.lit(x).cast("string") for x in ROBOTS)), (F.length("host") % len(ROBOTS)).cast("int"))
    files = sites.select("host", F.concat(text, F.lit("\n  \r\nuser-AGENT: *\r\n DISALLOW: / \n")).alias("content")).where("content is not null")
    return tables.tidied_robots(files, pages.where("page_id % 3 = 0").select(host(F.col("url")).alias("host"), F.concat(F.lit("https://"), host(F.col("url")), F.lit("/m"), (F.col("page_id") % 2).cast("string")).alias("url")))


QUERIES = {f.__name__: f for f in (project_list, score_history, keyword_table, keywords_first, backlink_list, verify_batch, backlink_totals, explorer_top, explorer_orphans, robots_tidied)}


def _q(x: str | None) -> str:
    return "NULL" if x is None else " || chr(10) || ".join("'" + y.replace("'", "''") + "'" for y in x.split("\n"))


_KEYWORDS = """kw AS MATERIALIZED (SELECT c_custkey AS keyword, c_name AS phrase, (SELECT CASE WHEN o_orderkey % 120 <= 100 THEN o_orderkey % 120 END FROM orders WHERE o_custkey = c_custkey AND o_custkey % 5 <> 2 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS position,
  (SELECT CASE WHEN o_orderkey % 120 <= 100 THEN o_orderkey % 120 END FROM orders WHERE o_custkey = c_custkey AND o_custkey % 5 <> 2 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1 OFFSET 1) AS previous FROM customer)"""
_LINKS = "ln AS (SELECT o_custkey % 40 AS site, o_orderkey AS link, ['active', 'active', 'lost', 'broken', 'unverified'][o_orderkey % 5 + 1] AS status, ['dofollow', 'nofollow', 'ugc', NULL, 'sponsored', 'dofollow', 'dofollow'][o_orderkey * 3 % 7 + 1] AS rel, 'h' || (o_custkey % 90) AS host, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS last_checked FROM orders)"
_HTML = "pg AS MATERIALIZED (SELECT page_id, url, page_id * 31 % 97 / 97.0 AS page_rank, CAST(page_id * 7 % 101 AS DOUBLE) AS score, page_id % 23 AS issues, CASE WHEN page_id % 8 <> 1 THEN page_id % 5 ELSE 0 END AS in_degree FROM pages WHERE page_id % 12 <> 5)"
_HOSTED = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
ORACLES = {
    "project_list": """SELECT c_custkey AS site, coalesce(n, 0) AS crawls, f.o_totalprice AS first_score, f.o_orderdate AS first_at, l.o_orderkey AS latest_id, l.o_totalprice AS latest_score, l.o_orderdate AS latest_at FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey % 7 <> 3 GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT * FROM orders WHERE o_custkey % 7 <> 3 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) f ON f.o_custkey = c_custkey
LEFT JOIN (SELECT * FROM orders WHERE o_custkey % 7 <> 3 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) l ON l.o_custkey = c_custkey""",
    "score_history": "WITH b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders) SELECT o_custkey AS site, CAST(least(5, (SELECT count(*) FROM orders x WHERE x.o_custkey = b.o_custkey)) - back + 1 AS INTEGER) AS n, o_orderkey AS id, o_orderdate AS at, o_totalprice AS score FROM b WHERE back <= 5",
    "keyword_table": f"WITH {_KEYWORDS} SELECT keyword, phrase, position, previous, previous - position AS movement FROM kw",
    "keywords_first": f"WITH {_KEYWORDS} SELECT keyword, phrase, position, previous, previous - position AS movement, CAST(row_number() OVER (ORDER BY position NULLS LAST, phrase, keyword) AS INTEGER) AS place FROM kw QUALIFY place <= 200",
    "backlink_list": f"WITH {_LINKS} SELECT CAST(row_number() OVER (ORDER BY (status = 'lost') DESC, last_checked ASC NULLS FIRST, link) AS INTEGER) AS place, link, status, last_checked FROM ln QUALIFY place <= 100",
    "verify_batch": f"WITH {_LINKS} SELECT CAST(row_number() OVER (ORDER BY last_checked ASC NULLS FIRST, link) AS INTEGER) AS place, link, last_checked FROM ln QUALIFY place <= 50",
    "backlink_totals": f"WITH {_LINKS} SELECT site, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("active", "lost", "broken", "unverified"))
    + ", count(*) FILTER (WHERE rel = 'dofollow' AND status = 'active') AS dofollow, count(*) FILTER (WHERE rel IN ('nofollow', 'ugc', 'sponsored') AND status = 'active') AS nofollow, count(DISTINCT host) AS hosts FROM ln GROUP BY site",
    "explorer_top": f"WITH {_HTML}, th AS (SELECT min(page_rank) AS least FROM (SELECT page_rank, row_number() OVER (ORDER BY page_rank DESC) AS n, count(*) OVER () AS a FROM pg) WHERE n <= greatest(1, ceil(a * 0.25))) SELECT CAST(row_number() OVER (ORDER BY score, url) AS INTEGER) AS place, page_id, score FROM pg, th WHERE page_rank >= least AND contains(lower(url), 'en') QUALIFY place <= 40",
    "explorer_orphans": f"WITH {_HTML} SELECT CAST(row_number() OVER (ORDER BY issues DESC, url) AS INTEGER) AS place, page_id, issues FROM pg WHERE in_degree = 0 QUALIFY place <= 60",
    "robots_tidied": f"""WITH hs AS (SELECT DISTINCT {_HOSTED} AS host FROM pages), fl AS (SELECT host, [{', '.join(map(_q, ROBOTS))}][length(host) % {len(ROBOTS)} + 1] || chr(10) || '  ' || chr(13) || chr(10) || 'user-AGENT: *' || chr(13) || chr(10) || ' DISALLOW: / ' || chr(10) AS c FROM hs),
sm AS (SELECT host, list_sort(list(DISTINCT 'Sitemap: https://' || host || '/m' || (page_id % 2))) AS found FROM (SELECT *, {_HOSTED} AS host FROM pages WHERE page_id % 3 = 0) GROUP BY host),
li AS (SELECT host, unnest(range(len(s))) AS no, trim(unnest(s)) AS l FROM (SELECT host, string_split(replace(c, chr(13), ''), chr(10)) AS s FROM fl WHERE c IS NOT NULL)),
fi AS (SELECT *, row_number() OVER (PARTITION BY host, lower(l) ORDER BY no) AS nth FROM li WHERE l <> ''),
su AS (SELECT host, string_agg(l, chr(10) ORDER BY no) FILTER (WHERE nth = 1) AS kept, count(*) FILTER (WHERE nth > 1) AS repeated, bool_or(lower(l) LIKE 'user-agent:%') AS agent, bool_or(lower(l) LIKE 'sitemap:%') AS named FROM fi GROUP BY host)
SELECT su.host, CASE WHEN agent THEN '' ELSE 'User-agent: *' || chr(10) END || kept || CASE WHEN named OR found IS NULL THEN '' ELSE chr(10) || array_to_string(found, chr(10)) END || chr(10) AS body, true AS blank, NOT agent AS no_agent, NOT named AS no_sitemap, CAST(repeated AS INTEGER) AS repeated, NOT named AND found IS NOT NULL AS added FROM su LEFT JOIN sm ON sm.host = su.host""",
}
