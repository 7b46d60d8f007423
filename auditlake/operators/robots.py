"""Robots rules and sitemaps: files of many hosts to rules and addresses, and which addresses the rules exclude."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.urls import absolute_key, host


def rules(files: DataFrame) -> DataFrame:
    """host, allow, pattern, regex of the rules for every agent and for search crawlers, and rows with allow null for sitemaps (pattern: address).

    files: host, content.  Each agent line decides anew whether the rules after it count; an empty disallow line is no rule.
    """
    lines = F.posexplode(F.split("content", r"\r?\n")).alias("no", "raw")
    line = files.select("host", lines).withColumn("line", F.trim(F.regexp_replace("raw", "#.*$", ""))).where("instr(line, ':') > 0")
    line = line.select("host", "no", F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value"))
    packed = line.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("no", "field", "value"))).alias("lines"))  # one file
    empty = "cast(array() as array<struct<kind:string,pattern:string>>)"
    walk = f"""aggregate(lines, named_struct('on', false, 'out', {empty}), (s, x) -> case
      when x.field = 'user-agent' then named_struct('on', x.value = '*' or lower(x.value) like '%googlebot%', 'out', s.out)
      when x.field = 'sitemap' then named_struct('on', s.on, 'out', concat(s.out, array(named_struct('kind', 'sitemap', 'pattern', x.value))))
      when s.on and (x.field = 'allow' or (x.field = 'disallow' and x.value <> '')) then named_struct('on', s.on, 'out', concat(s.out, array(named_struct('kind', x.field, 'pattern', x.value))))
      else s end, s -> s.out)"""
    out = packed.select("host", F.inline(F.expr(walk)))
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("pattern", r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*"))
    return out.select("host", F.when(F.col("kind") != "sitemap", F.col("kind") == "allow").alias("allow"), "pattern", regex.alias("regex"))


def disallowed(urls: DataFrame, found: DataFrame) -> DataFrame:
    """urls (url, ...) with disallowed: the longest rule of the host that matches path and query decides, and an allowing one among equals.

    A host's rules are one row, joined by host, so a host with most addresses is split like any join.
    """
    own = found.where("allow is not null").groupBy("host").agg(F.collect_list(F.struct("allow", "pattern", "regex")).alias("_rules"))
    place = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    place = F.when(F.startswith(place, F.lit("/")), place).otherwise(F.concat(F.lit("/"), place))
    hits = F.expr("filter(_rules, r -> rlike(_place, r.regex))")
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    out = urls.withColumn("_host", host(F.col("url"))).withColumn("_place", place).join(own.withColumnRenamed("host", "_host"), "_host", "left")
    return out.withColumn("disallowed", F.coalesce(~best["allow"], F.lit(False))).drop("_host", "_place", "_rules")


def sitemap_entries(files: DataFrame) -> DataFrame:
    """sitemap, url, key of every address in sitemap files (sitemap, content)."""
    found = files.select("sitemap", F.explode(F.regexp_extract_all("content", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)).alias("url"))
    return found.withColumn("url", F.replace("url", F.lit("&amp;"), F.lit("&"))).withColumn("key", absolute_key(F.col("url")))


def membership(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """pages (page_key, ...) with in_sitemap and sitemaps, the number of files that name the page."""
    named = entries.groupBy(F.col("key").alias("page_key")).agg(F.count_distinct("sitemap").cast("int").alias("sitemaps"))
    return pages.join(named, "page_key", "left").na.fill(0, ["sitemaps"]).withColumn("in_sitemap", F.col("sitemaps") > 0)
