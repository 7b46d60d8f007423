"""What the markup and headers of a page say of the framework that made it: builds, caching, fonts, pictures, scripts, middleware."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.predicates import FONT_HOSTS

#: Where a build is named, and the marks of fonts.
MANIFEST = r"""/_next/static/([^/"']+)/_(?:build|ssg)Manifest\.js"""
DEPLOYMENT = r"[?&]dpl=(dpl_[A-Za-z0-9_]+|[A-Za-z0-9_-]{8,})"
NEXT_DATA = r"""(?is)<script[^>]+id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""
FONT_CLASS = r"(?i)__(?:className|variable)_[a-z0-9]+"
FONT_FILE = r"""(?i)/_next/static/media/[^"')\s]+\.(?:woff2?|ttf|otf)"""
FONT_FACE = r"(?i)@font-face\s*\{[^}]*\}"


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or bare; null without one."""
    p = rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
    return F.when(tag.rlike(p), F.trim(F.concat(*(F.regexp_extract(tag, p, i) for i in (1, 2, 3)))))


def tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(f"(?i)<{name}[^>]*>"), F.lit(0))


def _header(name: str) -> Column:
    return F.nullif(F.try_element_at("headers", F.lit(name)), F.lit(""))


def fingerprints(pages: DataFrame) -> DataFrame:
    """page_id, url, build_id, version, swr, age, font_classes, font_files, hosted_fonts, faces_without_display, pictures, unoptimized, unsized, blocking_scripts, route_scripts, middleware, rewrote, matched_path, sets_cookie.

    pages: page_id, url, html, headers (names in lower case).  A build is named by the page data, a header, a
    manifest's address or a deployment's mark, in this order.
    """
    html, count = F.col("html"), lambda p: F.size(F.array_distinct(F.regexp_extract_all(html, F.lit(p), F.lit(0))))
    data = F.get_json_object(F.nullif(F.regexp_extract(html, NEXT_DATA, 1), F.lit("")), "$.buildId")
    found = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    build = F.coalesce(F.nullif(data, F.lit("")), _header("x-nextjs-deployment-id"), found(MANIFEST), found(DEPLOYMENT))
    style = lambda t: t.rlike(r"""(?i)rel\s*=\s*["']?stylesheet""") | t.rlike(r"""(?i)as\s*=\s*["']?(font|style)""")
    hosted = F.filter(tags(html, "link"), lambda t: style(t) & F.coalesce(attribute(t, "href"), F.lit("")).rlike(FONT_HOSTS))
    faces = F.filter(F.regexp_extract_all(html, F.lit(FONT_FACE), F.lit(0)), lambda t: ~t.rlike(r"(?i)font-display\s*:"))
    optimized = lambda t: F.contains(F.coalesce(attribute(t, "src"), F.lit("")), F.lit("/_next/image?")) | F.contains(F.coalesce(attribute(t, "srcset"), F.lit("")), F.lit("/_next/image?"))
    mark = lambda t: attribute(t, "data-nimg")
    own = F.filter(tags(html, "img"), lambda t: optimized(t) | mark(t).isNotNull())
    head = F.regexp_extract(html, r"(?is)<head[^>]*>(.*?)</head>", 1)
    src = lambda t: F.coalesce(attribute(t, "src"), F.lit(""))
    routes = F.filter(F.transform(tags(html, "script"), lambda t: src(t)), lambda s: F.contains(s, F.lit("/_next/static/")))
    blocking = F.filter(tags(html, "script"), lambda t: (src(t) != "") & ~F.contains(src(t), F.lit("/_next/static/")) & F.contains(F.col("_head"), t) & ~t.rlike(r"(?i)\s(?:defer|async)(?:\s|=|>|/)"))
    has = lambda n: F.coalesce(F.map_contains_key("headers", n), F.lit(False))
    cache = F.coalesce(F.try_element_at("headers", F.lit("cache-control")), F.lit(""))
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    rows = pages.withColumns({"html": F.coalesce("html", F.lit("")), "_cc": cache, "_age": F.coalesce(_header("age"), F.lit(""))}).withColumn("_head", head)
    return rows.select(
        "page_id", "url", build.alias("build_id"), _header("x-nextjs-version").alias("version"), number("nullif(regexp_extract(_cc, 'stale-while-revalidate=([0-9]+)', 1), '')").alias("swr"), number("_age").alias("age"), count(FONT_CLASS).alias("font_classes"), count(FONT_FILE).alias("font_files"), F.size(hosted).alias("hosted_fonts"),
        F.size(faces).alias("faces_without_display"), F.size(own).alias("pictures"), F.size(F.filter(own, lambda t: mark(t).isNotNull() & ~optimized(t))).alias("unoptimized"), F.size(F.filter(own, lambda t: (mark(t) == "fill") & (F.coalesce(attribute(t, "sizes"), F.lit("")) == ""))).alias("unsized"),
        F.size(blocking).alias("blocking_scripts"), F.size(F.array_distinct(routes)).alias("route_scripts"), (has("x-middleware-rewrite") | has("x-middleware-next") | has("x-middleware-set-cookie") | has("x-matched-path")).alias("middleware"), has("x-middleware-rewrite").alias("rewrote"),
        F.coalesce(F.try_element_at("headers", F.lit("x-matched-path")), F.try_element_at("headers", F.lit("x-middleware-rewrite"))).alias("matched_path"), has("x-middleware-set-cookie").alias("sets_cookie"),
    )


def site_framework(pages: DataFrame, site: Column) -> DataFrame:
    """site, pages, router (the most usual; equal ones by name), build_ids, ssr, static, isr, streaming, client, unknown of the pages that the framework made.

    pages: url, is_next, router, strategy, build_id.
    """
    own = pages.where("is_next").withColumn("site", site)
    of = lambda s: F.count_if(F.col("strategy") == s).alias(s)
    sums = own.groupBy("site").agg(F.count("*").alias("pages"), F.count_distinct("build_id").alias("build_ids"), *(of(s) for s in ("ssr", "static", "isr", "streaming", "client", "unknown")))
    routers = own.groupBy("site", "router").agg(F.count("*").alias("n"))
    usual = routers.groupBy("site").agg(F.min_by("router", F.struct(-F.col("n"), F.col("router"))).alias("router"))
    return sums.join(usual, "site").select("site", "pages", "router", "build_ids", "ssr", "static", "isr", "streaming", "client", "unknown")
