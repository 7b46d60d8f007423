"""Sitemaps of many sites: what robots files declare or where they are by custom, followed through indexes of indexes.

Each round takes the next addresses of every site at once.  An address is read once a site,
however often and in whatever circle it is named (an anti join with those read before).  The
guards are those of the crawler: a site gets MOST_FILES files at most, and an index that comes
after MOST_NAMED named files is not followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.urls import absolute_key
from auditlake.operators.graph import _cut

#: Files of a site that count, files that indexes name until they are no longer followed, addresses by custom.
MOST_FILES, MOST_NAMED = 60, 50
BY_CUSTOM = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml")
#: Fixed value: an address in a sitemap.
LOC = r"(?i)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]]+?)\s*(?:\]\]>)?\s*</loc>"


def parsed(status: Column, body: Column) -> Column:
    """is_index, urls and error of a file; a file that could not be read has status 0 or null."""
    text = F.ltrim(F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+", ""))
    status = F.coalesce(status, F.lit(0))
    error = F.when(status == 0, "could not be fetched").when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"))).when((text != "") & ~F.startswith(text, F.lit("<")), "not XML").when(F.startswith(text, F.lit("<")) & ~text.rlike(r"(?i)<(urlset|sitemapindex)\b"), "missing <urlset> or <sitemapindex> root")
    urls = F.filter(F.transform(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(LOC), F.lit(1)), lambda u: F.trim(u)), lambda u: u != "")
    return F.struct(F.coalesce(body, F.lit("")).rlike(r"(?i)<sitemapindex\b").alias("is_index"), urls.alias("urls"), error.alias("error"))


def sitemap_tree(sites: DataFrame, declared: DataFrame, files: DataFrame) -> DataFrame:
    """site, n (order of reading), depth, url, status, bytes, is_index, urls, error of every file that counts.

    sites: site, origin.  declared: site, place, url, from robots files, in their order.  files: url, status,
    body of what can be read.  A file by custom or named by an index that is missing does not count; a
    declared one counts with its error.  Rounds end as each names files that no round before has read.
    """
    given = declared.select("site", "place", "url").groupBy("site", "url").agg(F.min("place").alias("pos")).withColumn("declared", F.lit(True))
    custom = sites.join(declared.select("site").distinct(), "site", "left_anti")
    custom = custom.select("site", F.posexplode(F.array(*(F.concat("origin", F.lit(p)) for p in BY_CUSTOM))).alias("pos", "url")).select("site", "url", F.col("pos").cast("long").alias("pos"), F.lit(False).alias("declared"))
    said = _cut(given.select("site", "url"))
    frontier = _cut(given.select("site", "url", F.col("pos").cast("long"), "declared").unionByName(custom))
    known = files.select("url", "status", "body")
    seen = tally = out = None
    depth = 0
    while not frontier.isEmpty():
        first = frontier.groupBy("site", "url").agg(F.min("pos").alias("pos"))
        if seen is not None:
            first = first.join(seen, ["site", "url"], "left_anti").join(tally, "site", "left").na.fill(0, ["had", "named"])
        else:
            first = first.withColumns({"had": F.lit(0).cast("long"), "named": F.lit(0).cast("long")})
        first = first.join(said.withColumn("declared", F.lit(True)), ["site", "url"], "left").na.fill(False, ["declared"])
        read = first.join(known, "url", "left").withColumn("f", parsed(F.col("status"), F.col("body"))).withColumn("status", F.coalesce("status", F.lit(0)))
        read = read.withColumn("counts", F.col("declared") | F.col("status").between(1, 399))
        order = Window.partitionBy("site").orderBy("pos", "url")  # the addresses that one site has at one depth
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        read = read.withColumn("so_far", F.col("had") + F.coalesce(F.sum(F.col("counts").cast("int")).over(before), F.lit(0))).where(F.col("so_far") < MOST_FILES)
        read = _cut(read.withColumn("at", F.row_number().over(order)).select("site", "url", "at", "had", "named", "so_far", "counts", "status", F.octet_length(F.coalesce("body", F.lit(""))).alias("bytes"), "f.*"))
        kept = read.where("counts").select("site", (F.col("so_far") + 1).alias("n"), F.lit(depth).alias("depth"), "url", "status", "bytes", "is_index", "urls", "error")
        out = kept if out is None else out.unionByName(kept)
        own = read.select("site", "url")
        seen_before, seen = seen, own if seen is None else _cut(seen.unionByName(own))
        index = read.where("counts and is_index").select("site", F.col("at").alias("of"), "named", F.posexplode("urls").alias("no", "url"))
        if seen_before is not None:
            index = index.join(seen_before, ["site", "url"], "left_anti")
        index = index.join(read.select("site", "url", "at"), ["site", "url"], "left").where("at is null or at > of")
        sizes = index.groupBy("site", "of").agg(F.first("named").alias("named"), F.count("*").alias("names"))
        so_far = F.coalesce(F.sum("names").over(Window.partitionBy("site").orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        followed = _cut(sizes.withColumn("so_far", F.col("named") + so_far).where(F.col("so_far") < MOST_NAMED).select("site", "of", "names"))  # at most MOST_FILES a site
        added = read.groupBy("site").agg(F.max("had").alias("had0"), F.max("named").alias("named0"), F.count_if("counts").alias("new")).join(followed.groupBy("site").agg(F.sum("names").alias("more")), "site", "left")
        added = added.select("site", (F.col("had0") + F.col("new")).alias("had"), (F.col("named0") + F.coalesce("more", F.lit(0))).alias("named"))
        tally = _cut(added)
        frontier = _cut(index.join(followed, ["site", "of"]).select("site", "url", (F.col("of").cast("long") * (1 << 32) + F.col("no")).alias("pos")))
        depth += 1
    if out is None:
        none = frontier.select("site", F.lit(0).cast("long").alias("n"), F.lit(0).alias("depth"), "url", F.lit(0).alias("status"), F.lit(0).alias("bytes"), F.lit(False).alias("is_index"), F.array().cast("array<string>").alias("urls"), F.lit("").alias("error"))
        return none.where("false")
    return out


def tree_membership(tree: DataFrame) -> DataFrame:
    """site, key, sitemaps: in how many of its files that are no index each address is."""
    named = tree.where("not is_index").select("site", F.col("url").alias("sitemap"), F.explode("urls").alias("u")).select("site", "sitemap", absolute_key(F.col("u")).alias("key"))
    return named.groupBy("site", "key").agg(F.count_distinct("sitemap").alias("sitemaps"))
