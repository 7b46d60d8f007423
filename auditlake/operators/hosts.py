"""Addresses that belong to a site: its host, or one below it.

"a equals b or ends with .b" is no equality, and comparing every address with every site grows
with both.  An address has as many suffixes as its host has labels, so each is sent under all of
its suffixes and meets the sites by equality.  Suffixes that no site has (above all "com") fall
out before the join where the sites are few, and are spread by their host where they are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.urls import bare_host

#: Labels of a host that are looked at; longer names are looked at by their last ones.
LABELS = 32
#: Sites that are broadcast at most.
FEW = 100_000


def suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]; an empty host has none."""
    parts = F.slice(F.reverse(F.split(host, r"\.")), 1, LABELS)
    return F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.reverse(F.slice(parts, F.lit(1), n)), "."))).otherwise(F.array().cast("array<string>"))


def on_site(rows: DataFrame, url: str, sites: DataFrame) -> DataFrame:
    """rows with every site (site, origin) that the address `url` belongs to: one row for each."""
    own = sites.select("site", bare_host(F.col("origin")).alias("_suffix")).where("_suffix <> ''")
    few = own.limit(FEW + 1).count() <= FEW
    hosts = rows.select("*", F.explode(suffixes(bare_host(F.col(url)))).alias("_suffix"))
    return hosts.join(F.broadcast(own) if few else own, "_suffix").drop("_suffix")


def rank_hits(results: DataFrame, keywords: DataFrame, sites: DataFrame) -> DataFrame:
    """keyword, site, position, url: where each keyword's own site (keywords: keyword, site) is first in its results (keyword, position, url); position null where it is not."""
    hits = on_site(results, "url", sites).join(keywords.select("keyword", "site"), ["keyword", "site"])
    best = hits.groupBy("keyword", "site").agg(F.min(F.struct("position", "url")).alias("b"))
    return keywords.select("keyword", "site").join(best, ["keyword", "site"], "left").select("keyword", "site", "b.position", "b.url")


def rel_kind(rel: Column) -> Column:
    """dofollow, nofollow, sponsored or ugc, in the order in which they outrank each other."""
    words = F.split(F.lower(F.coalesce(rel, F.lit(""))), r"\s+")
    has = lambda w: F.array_contains(words, w)
    return F.when(has("nofollow"), "nofollow").when(has("sponsored"), "sponsored").when(has("ugc"), "ugc").otherwise("dofollow")


def backlink_targets(links: DataFrame, sites: DataFrame) -> DataFrame:
    """page_id, site, links, rel, anchor of every page outside a site with links to it: its first link that is followed, else its last one.

    links: page_id, url (of the page), pos, href (absolute), rel, anchor, page_nofollow (the page's robots tag
    forbids following, which makes a link nofollow whose own rel says nothing).
    """
    found = on_site(links, "href", sites)
    found = found.join(sites.select("site", F.concat(F.lit("."), bare_host(F.col("origin"))).alias("_of")), "site").where(~F.endswith(F.concat(F.lit("."), bare_host(F.col("url"))), F.col("_of")))
    own = rel_kind(F.col("rel"))
    kind = F.when(F.coalesce("page_nofollow", F.lit(False)) & (own == "dofollow"), "nofollow").otherwise(own)
    found = found.withColumn("kind", kind)
    followed = F.col("kind") == "dofollow"
    first = F.struct(F.when(followed, 0).otherwise(1).alias("late"), F.when(followed, F.col("pos")).otherwise(-F.col("pos")).alias("pos"))
    best = F.min_by(F.struct("kind", "anchor"), first)
    return found.groupBy("page_id", "site").agg(F.count("*").alias("links"), best.alias("f")).select("page_id", "site", "links", F.col("f.kind").alias("rel"), "f.anchor")
