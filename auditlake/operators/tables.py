"""The lists a user looks at: projects, score histories, keywords, backlinks, pages by segment, tidied robots files.

A list is ordered for its reader; what is per site or per keyword is limited before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Crawls of a history, links that are verified at a time.
HISTORY, VERIFIED = 60, 50


def projects(sites: DataFrame, crawls: DataFrame) -> DataFrame:
    """site, crawls, first_score, first_at, latest_id, latest_score, latest_at of every site; one without crawls has 0 and nulls.

    crawls: site, id, at, score.  One aggregation, not a look into the crawls for each of the three.
    """
    key = F.struct("at", "id")
    sums = crawls.groupBy("site").agg(F.count("*").alias("crawls"), F.min_by(F.struct("score", "at"), key).alias("f"), F.max_by(F.struct("id", "score", "at"), key).alias("l"))
    out = sites.join(sums, "site", "left")
    return out.select("site", F.coalesce("crawls", F.lit(0)).alias("crawls"), F.col("f.score").alias("first_score"), F.col("f.at").alias("first_at"), F.col("l.id").alias("latest_id"), F.col("l.score").alias("latest_score"), F.col("l.at").alias("latest_at"))


def score_history(crawls: DataFrame, most: int = HISTORY) -> DataFrame:
    """site, n, id, at, score: the last `most` crawls of every site, the oldest of them first (n from 1)."""
    last = Window.partitionBy("site").orderBy(F.desc("at"), F.desc("id"))
    rows = crawls.withColumn("back", F.row_number().over(last)).where(F.col("back") <= most)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("back")))).select("site", "n", "id", "at", "score")


def keyword_table(keywords: DataFrame, snapshots: DataFrame) -> DataFrame:
    """keyword, phrase, position, previous, movement of every keyword: its latest position and the one before; without a snapshot, or not found, null.

    keywords: keyword, phrase; snapshots: keyword, at, id, position.  movement: places gained since.
    """
    last = Window.partitionBy("keyword").orderBy(F.desc("at"), F.desc("id"))
    two = snapshots.withColumn("n", F.row_number().over(last)).where("n <= 2")
    at = two.groupBy("keyword").agg(F.max(F.when(F.col("n") == 1, F.col("position"))).alias("position"), F.max(F.when(F.col("n") == 2, F.col("position"))).alias("previous"))
    return keywords.join(at, "keyword", "left").select("keyword", "phrase", "position", "previous", (F.col("previous") - F.col("position")).alias("movement"))


def listed(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first `most` rows in this order, with their place; each task keeps as many before they meet."""
    top = rows.orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # `most` rows


def keywords_first(table: DataFrame, most: int) -> DataFrame:
    """keyword_table's first rows: found ones by position, then the others, each by phrase."""
    return listed(table, most, F.col("position").isNull(), F.col("position"), F.col("phrase"), F.col("keyword"))


def backlinks_first(links: DataFrame, most: int) -> DataFrame:
    """Links (link, status, last_checked) to look at: lost ones first, never checked ones before those checked longest ago."""
    return listed(links, most, F.col("status") != "lost", F.asc_nulls_first("last_checked"), F.col("link"))


def to_verify(links: DataFrame, most: int = VERIFIED) -> DataFrame:
    """The links that are verified next: never checked ones, then those checked longest ago."""
    return listed(links, most, F.asc_nulls_first("last_checked"), F.col("link"))


def backlink_totals(links: DataFrame) -> DataFrame:
    """site, total, active, lost, broken, unverified, dofollow, nofollow, hosts of every site's links (site, status, rel, host); rel counts of active links only."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    active = F.col("status") == "active"
    return links.groupBy("site").agg(
        F.count("*").alias("total"), of("active"), of("lost"), of("broken"), of("unverified"), F.count_if(active & (F.col("rel") == "dofollow")).alias("dofollow"), F.count_if(active & F.col("rel").isin("nofollow", "ugc", "sponsored")).alias("nofollow"), F.count_distinct("host").alias("hosts")
    )


def share_threshold(rows: DataFrame, value: str, share: float) -> DataFrame:
    """One row, least: the value at place max(1, ceil(share * n)) from the top.  Counts by value stand in for the rows, summed up in slots of values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    slot = F.floor(F.col(value) * 4096)
    counts = counts.withColumn("slot", slot)
    sums = counts.groupBy("slot").agg(F.sum("c").alias("s"))
    down = Window.orderBy(F.desc("slot"))  # 4,096 slots for each whole step of the value
    all_ = F.sum("s").over(Window.partitionBy(F.lit(0)))
    sums = sums.select("slot", (F.sum("s").over(down) - F.col("s")).alias("before"), F.greatest(F.lit(1), F.ceil(all_ * share)).alias("place"), "s").where("before < place and before + s >= place")
    inside = counts.join(F.broadcast(sums), "slot")  # one row
    reach = F.col("before") + F.sum("c").over(Window.partitionBy("slot").orderBy(F.desc(value)))
    return inside.withColumn("reach", reach).where("reach >= place").agg(F.max(value).alias("least"))


#: Segments of the explorer: the share of pages of highest rank, or a condition.
SEGMENTS = {"all": None, "top10": 0.1, "top25": 0.25, "indexable": "indexable", "orphans": "coalesce(in_degree, 0) = 0"}
SORTS = {"importance": "page_rank", "depth": "depth", "score": "score", "issues": "issues", "inDegree": "in_degree", "url": "url"}


def explorer(pages: DataFrame, segment: str = "all", pattern: str = "", sort: str = "importance", ascending: bool = False, most: int = 100) -> DataFrame:
    """The first `most` HTML pages of a segment whose address holds the pattern in any case, by one of SORTS, with their place; equal ones by address.

    pages: url, is_html, page_rank, depth, score, issues, in_degree, indexable.
    """
    html = pages.where("is_html")
    rule = SEGMENTS[segment]
    if isinstance(rule, float):
        html = html.join(F.broadcast(share_threshold(html, "page_rank", rule)), F.col("page_rank") >= F.col("least")).drop("least")  # one row
    elif rule:
        html = html.where(rule)
    if pattern.strip():
        html = html.where(F.contains(F.lower("url"), F.lit(pattern.strip().lower())))
    by = F.col(SORTS[sort])
    return listed(html, most, by.asc() if ascending else by.desc(), F.col("url"))


def tidied_robots(files: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """host, body, blank, no_agent, no_sitemap, repeated, added: robots files (host, content) as a clean list of lines, and what was wrong.

    Lines are trimmed, empty and repeated ones (in any case) go, the first of each stays; an agent line is put
    in front if there is none, the sitemaps (host, url) that were found are added if none is named.
    """
    found = sitemaps.groupBy("host").agg(F.array_sort(F.collect_set(F.concat(F.lit("Sitemap: "), "url"))).alias("found"))
    lines = F.transform(F.split("content", r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rows = files.join(found, "host", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>"))).withColumn("lines", lines)
    full = F.filter("lines", lambda x: x != "")
    rows = rows.withColumn("full", full).withColumn("low", F.transform("full", lambda x: F.lower(x)))
    first = F.filter("full", lambda x, i: F.array_position("low", F.lower(x)) == i + 1)
    agent, named = F.exists("full", lambda x: x.rlike("(?i)^user-agent:")), F.exists("full", lambda x: x.rlike("(?i)^sitemap:"))
    rows = rows.withColumns({"first": first, "agent": agent, "named": named})
    none = F.array().cast("array<string>")
    body = F.concat(F.when(~F.col("agent"), F.array(F.lit("User-agent: *"))).otherwise(none), "first", F.when(~F.col("named"), F.col("found")).otherwise(none))
    return rows.select(
        "host", F.concat(F.array_join(body, "\n"), F.lit("\n")).alias("body"), (F.size("full") != F.size("lines")).alias("blank"), (~F.col("agent")).alias("no_agent"), (~F.col("named")).alias("no_sitemap"), (F.size("full") - F.size("first")).alias("repeated"), (~F.col("named") & (F.size("found") > 0)).alias("added")
    )
