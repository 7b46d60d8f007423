"""Checks that need other pages: targets of canonicals, links, assets and languages, incoming links, equal texts and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators import graph, predicates
from auditlake.operators.checks import ready

#: Category and severity of each check, and what it asks of the columns of `wide`.
CHECKS = {
    "canonical-to-non-200": ("indexability", "blocker", "canon_not_ok"),
    "canonical-points-redirect": ("indexability", "critical", "canon_redirect"),
    "canonical-points-noindex": ("indexability", "critical", "canon_noindex"),
    "canonical-points-disallowed": ("indexability", "critical", "canon_blocked"),
    "canonical-points-another-canonicalized-url": ("indexability", "critical", "moved and canon_moved"),
    "canonical-loop": ("duplicate-content", "critical", "moved and canon_back"),
    "disallowed-css-files": ("indexability", "critical", "css_blocked"),
    "disallowed-js-files": ("indexability", "critical", "js_blocked"),
    "disallowed-images": ("indexability", "warning", "img_blocked"),
    "incoming-non-descriptive-anchor": ("links", "notice", "in_empty > 0"),
    "incoming-links-same-anchor": ("links", "notice", "in_named >= 3 and one_anchor"),
    "internal-links-to-4xx": ("links", "critical", "link_4xx"),
    "internal-links-to-3xx": ("links", "warning", "link_3xx"),
    "broken-links-to-external": ("links", "warning", "out_broken"),
    "less-than-10-internal-backlinks": ("links", "notice", "coalesce(sources, 0) < 10"),
    "only-nofollow-incoming-links": ("links", "warning", "inbound > 0 and followed = 0"),
    "follow-and-nofollow-incoming": ("links", "notice", "followed > 0 and followed < inbound"),
    "orphan-sitemap-only": ("links", "critical", "orphan and in_sitemap"),
    "orphan-via-canonical": ("links", "critical", "orphan and not in_sitemap and by_canonical"),
    "orphan-via-redirect": ("links", "critical", "orphan and not in_sitemap and by_redirect"),
    "orphan-isolated-cluster": ("links", "critical", "inbound > 0 and from_orphans = inbound"),
    "title-duplicates": ("duplicate-content", "critical", "same_title"),
    "h1-duplicates": ("duplicate-content", "warning", "same_h1"),
    "description-duplicates": ("duplicate-content", "warning", "same_description"),
    "duplicate-pages-without-canonical": ("content-relevance", "critical", "same_content and not coalesce(moved, false)"),
    "technically-duplicate-urls": ("duplicate-content", "critical", "twin"),
    "url-resolves-http-and-https": ("internal", "critical", "both_schemes"),
    "page-broken-images": ("internal", "warning", "img_broken"),
    "page-broken-css": ("internal", "critical", "css_broken"),
    "page-broken-javascript": ("internal", "critical", "js_broken"),
    "image-size-over-100kb": ("page-speed", "warning", "img_large"),
    "css-file-over-15kb": ("page-speed", "notice", "css_large"),
    "js-file-over-25kb": ("page-speed", "notice", "js_large"),
    "efficient-cache-policy": ("page-speed", "opportunity", "short_cache"),
    "asset-linked-via-redirect": ("redirects", "notice", "asset_redirect"),
    "missing-reciprocal-hreflang": ("localization", "critical", "no_return"),
    "hreflang-to-broken-url": ("localization", "critical", "lang_broken"),
    "hreflang-to-redirect": ("localization", "warning", "lang_redirect"),
    "hreflang-to-noindex": ("localization", "critical", "lang_noindex"),
    "hreflang-to-disallowed": ("localization", "critical", "lang_blocked"),
    "hreflang-non-canonical": ("localization", "critical", "lang_moved"),
    "hreflang-group-not-crawled": ("localization", "notice", "lang_keys > coalesce(lang_known, 0)"),
    "invalid-incoming-hreflang": ("localization", "warning", "in_bad_lang"),
    "conflicting-incoming-hreflang": ("localization", "critical", "in_langs_differ"),
    "noindex-has-incoming-hreflang": ("localization", "critical", "soft_noindex and in_lang"),
    "canonicalized-has-incoming-hreflang": ("localization", "critical", "moved and in_lang"),
    "disallowed-has-incoming-hreflang": ("localization", "critical", "disallowed and in_lang"),
    "missing-hreflang-annotations": ("localization", "notice", "any_langs and lang_keys = 0"),
}
SEVERITIES = {i: s for i, (_, s, _) in CHECKS.items()}
#: Checks whose scope is pages with languages, whatever their status.
LANG_SCOPE = ("missing-reciprocal-hreflang", "hreflang-to-broken-url", "hreflang-to-redirect", "hreflang-to-noindex", "hreflang-to-disallowed", "hreflang-non-canonical", "hreflang-group-not-crawled")
#: Checks whose scope is every page.
EVERY_SCOPE = ("missing-hreflang-annotations",)
#: Bytes an asset may have.
LARGE = {"img": 102_400, "css": 15_360, "js": 25_600}
#: Fixed value: characters of a text that are compared where whole texts are not asked for.
BEGINNING = 2000


def _empty_anchor(anchor: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(anchor)), "[.!:>»→]+$", "")).isin(*predicates.EMPTY_ANCHORS)


def _keys(array: str, kind: str, where=lambda x: F.lit(True)) -> Column:
    """The distinct keys of an array's structs, as references of a kind."""
    own = F.array_distinct(F.transform(F.filter(array, lambda x: x["key"].isNotNull() & where(x)), lambda x: x["key"]))
    return F.transform(own, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))


def gathered(whole: bool = False) -> list[Column]:
    """What findings reads of a page, from the columns of `checks.ready`; whole: as of findings."""
    canon = F.when(F.col("canon").isNotNull(), F.array(F.struct(F.lit("canon").alias("kind"), F.col("canon").alias("key")))).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))
    real = lambda x: x["href"].isNotNull()
    refs = F.concat(canon, _keys("links", "link", lambda x: x["internal"] & real(x)), _keys("links", "out", lambda x: x["external"] & real(x)), _keys("images", "img", lambda x: x["src"] != ""), _keys("stylesheets", "css"), _keys("scripts", "js", lambda x: x["url"] != ""), _keys("hreflang", "lang"))
    links = F.transform(F.filter("links", lambda x: x["internal"] & real(x) & ~F.startswith(x["raw_href"], F.lit("#"))), lambda x: F.struct(x["key"].alias("key"), x["anchor"].alias("anchor"), x["nofollow"].alias("nofollow")))
    langs = F.transform(F.filter("hreflang", lambda x: x["key"].isNotNull()), lambda x: F.struct(x["key"].alias("key"), x["lang"].alias("lang")))
    text = F.trim(F.regexp_replace(F.lower("body_text"), r"(?U)\s+", " "))
    same = F.sha2(F.nullif(text, F.lit("")), 256) if whole else F.substring(text, 1, BEGINNING)  # a digest of the whole text: long ones are neither kept nor shuffled
    body = F.when(F.col("text_units") > 200, same).otherwise("")
    age = F.coalesce(F.expr("try_cast(regexp_extract(coalesce(try_element_at(headers, 'cache-control'), ''), 'max-age=([0-9]+)', 1) as bigint)"), F.lit(0))
    return [
        F.col("page_id"), F.col("crawl_order"), F.col("page_key").alias("key"), F.col("url"), F.col("canon"), F.coalesce("moved", F.lit(False)).alias("moved"), *map(F.col, ("noindex", "soft_noindex", "disallowed", "status", "in_sitemap", "has_langs")), F.coalesce(F.expr(predicates.PAGE), F.lit(False)).alias("live"), (F.col("page_key") == F.col("home_key")).alias("home"),
        F.col("title_l").alias("title"), F.col("h1_l").alias("h1"), F.col("description_l").alias("description"), body.alias("content"), F.col("size").alias("bytes"), age.alias("age"), refs.alias("refs"), links.alias("links"), langs.alias("langs"), F.transform("redirect_chain", lambda h: h["to_key"]).alias("redirects"),
    ]


def findings(records: DataFrame, blocked: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """page_id, check_id, severity of every failed check of CHECKS.

    records: page records, or rows of `gathered` that are cut off with a checkpoint.
    blocked: key of addresses that robots rules exclude, crawled or not (None: what the crawled pages say of themselves).
    whole: pages have one text if all of it is equal, else if its first BEGINNING characters are; records that are gathered say it there.

    Pages are parsed once: what the checks need is cut off with a checkpoint.  All references of a page (canonical, links,
    assets, languages) are one exploded table that meets the targets once and comes back as one row a page; what is gathered
    for an address is aggregated before it meets the pages, so an address that most pages link to is one row there.  Of
    pages with one key the last in crawl order stands for it as a target.  Nulls and empty texts match nothing.
    """
    p = records if "refs" in records.columns else graph._cut(ready(records).select(*gathered(whole)))
    pages = p.drop("refs", "links", "langs", "redirects")
    top = lambda c, order: F.max_by(c, order)
    target = pages.groupBy("key").agg(top(F.struct("status", "noindex", "soft_noindex", "disallowed", "canon", F.col("key").alias("self"), "bytes", "age"), F.struct("crawl_order", "page_id")).alias("t"))
    named = p.select("page_id", F.col("key").alias("src"), F.inline("refs"))
    hit = named.join(target, "key").select("page_id", "src", "kind", "key", "t.*")
    kind = lambda *k: F.col("kind").isin(*k)
    some = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    between = lambda a, b: F.col("status").between(a, b)
    asset = kind("img", "css", "js")
    seen = hit.groupBy("page_id").agg(
        some(kind("canon") & (F.col("status") != 200), "canon_not_ok"), some(kind("canon") & between(300, 399), "canon_redirect"), some(kind("canon") & F.col("noindex"), "canon_noindex"), some(kind("canon") & (F.col("canon") != F.col("self")), "canon_moved"), some(kind("canon") & (F.col("canon") == F.col("src")), "canon_back"),
        some(kind("link") & between(400, 499), "link_4xx"), some(kind("link") & between(300, 399), "link_3xx"), some(kind("out") & (F.col("status") >= 400), "out_broken"), some(asset & between(300, 399), "asset_redirect"), some(kind("css", "js") & (F.col("age") < 86_400), "short_cache"),
        *(some(kind(k) & (F.col("status") >= 400), f"{k}_broken") for k in LARGE), *(some(kind(k) & (F.col("bytes") > most), f"{k}_large") for k, most in LARGE.items()),
        some(kind("lang") & (F.col("status") >= 400), "lang_broken"), some(kind("lang") & between(300, 399), "lang_redirect"), some(kind("lang") & F.col("soft_noindex"), "lang_noindex"), some(kind("lang") & (F.col("canon") != F.col("self")), "lang_moved"), F.count_if(kind("lang")).alias("lang_known"),
    )
    shut = (hit.where("disallowed") if blocked is None else named.join(blocked.select("key").distinct(), "key")).groupBy("page_id").agg(*(some(kind(k), f"{k}_blocked") for k in ("canon", "css", "js", "img", "lang")))
    tongue = named.where("kind = 'lang' and key <> src")
    back = tongue.select(F.col("key").alias("src"), F.col("src").alias("key"))
    lonely = tongue.join(target.select("key"), "key", "left_semi").join(back, ["src", "key"], "left_anti").select("page_id").distinct().withColumn("no_return", F.lit(True))

    edge = p.where("live").select(F.col("key").alias("src"), F.inline("links"))
    orphan = pages.where("live and not home").select("key").distinct().join(edge.select("key").distinct(), "key", "left_anti").withColumn("orphan", F.lit(True))
    edge = edge.join(orphan.select(F.col("key").alias("src"), F.lit(1).alias("lost")), "src", "left")
    name = F.when(F.col("anchor") != "", F.lower("anchor"))
    inbound = edge.groupBy("key").agg(F.count("*").alias("inbound"), F.count_distinct("src").alias("sources"), F.count_if(~F.col("nofollow")).alias("followed"), F.count_if(~F.col("nofollow") & _empty_anchor(F.col("anchor"))).alias("in_empty"), F.count(name).alias("in_named"), (F.min(name) == F.max(name)).alias("one_anchor"), F.count("lost").alias("from_orphans"))
    tongues = p.select(F.col("key").alias("src"), F.inline("langs")).where("key <> src")
    lang = F.when(F.col("lang") != "x-default", F.col("lang"))
    tongues = tongues.groupBy("key").agg(F.lit(True).alias("in_lang"), (F.min(lang) != F.max(lang)).alias("in_langs_differ"), some(~lang.rlike(predicates.LANG_TAG), "in_bad_lang"))
    yes = lambda df, c, flag: df.select(F.col(c).alias("key")).where("key is not null").distinct().withColumn(flag, F.lit(True))
    by_canonical, by_redirect = yes(pages.where("moved"), "canon", "by_canonical"), yes(p.select(F.explode("redirects").alias("to")), "to", "by_redirect")
    plain = F.regexp_replace(F.lower("key"), "/$", "")
    twins = pages.groupBy(plain.alias("plain")).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("plain", F.lit(True).alias("twin"))
    open_http = target.where("t.status = 200").select(F.col("key").alias("http_key"), F.lit(True).alias("both_schemes"))
    same = [graph.duplicates(pages.where("live"), F.col(c), c).select("page_id", F.lit(True).alias(f"same_{c}")) for c in ("title", "h1", "description", "content")]

    wide = p.withColumn("lang_keys", F.size(F.array_distinct(F.transform("langs", lambda x: x["key"])))).drop("refs", "links", "langs", "redirects", "title", "h1", "description", "content")
    wide = wide.withColumns({"plain": plain, "http_key": F.when(F.startswith("key", F.lit("https:")), F.concat(F.lit("http:"), F.substring("key", 7, 1 << 30)))})
    wide = wide.join(F.broadcast(wide.agg((F.max("lang_keys") > 0).alias("any_langs"))))  # one row
    for side in (seen, shut, lonely, *same):
        wide = wide.join(side, "page_id", "left")
    for side in (inbound, orphan, tongues, by_canonical, by_redirect):
        wide = wide.join(side, "key", "left")
    wide = wide.join(twins, "plain", "left").join(open_http, "http_key", "left")
    rows = F.array(*(F.struct(F.lit(i).alias("check_id"), F.lit(s).alias("severity"), F.coalesce(F.expr(f"({'lang_keys > 0' if i in LANG_SCOPE else 'true' if i in EVERY_SCOPE else 'live'}) and ({e})"), F.lit(False)).alias("failed")) for i, (_, s, e) in CHECKS.items()))
    return wide.select("page_id", F.inline(F.filter(rows, lambda x: x["failed"]))).drop("failed").distinct()
