"""PageSpeed payloads as VARIANT: figures of users before figures of the laboratory, of the page before those of its origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Good up to the first, poor beyond the second.
LIMITS = {"lcp": (2500, 4000), "cls": (0.1, 0.25), "inp": (200, 500), "tbt": (200, 600), "fcp": (1800, 3000), "speed_index": (3400, 5800)}
#: Names of a figure among users' and among the laboratory's.
FIELD = {"lcp": "LARGEST_CONTENTFUL_PAINT_MS", "cls": "CUMULATIVE_LAYOUT_SHIFT_SCORE", "inp": "INTERACTION_TO_NEXT_PAINT", "fcp": "FIRST_CONTENTFUL_PAINT_MS"}
LAB = {"lcp": "largest-contentful-paint", "cls": "cumulative-layout-shift", "tbt": "total-blocking-time", "fcp": "first-contentful-paint", "speed_index": "speed-index"}
CLASSES = {"FAST": "GOOD", "AVERAGE": "NEEDS_IMPROVEMENT", "SLOW": "POOR"}
#: Audits that may save time, the least saving that counts, and how many are named.
SAVINGS = (
    "render-blocking-resources", "unused-javascript", "unused-css-rules", "modern-image-formats", "offscreen-images", "unminified-javascript", "efficient-animated-content", "server-response-time", "uses-responsive-images",
)
LEAST_MS, MOST = 100, 5


def classify(value: Column, name: str) -> Column:
    good, poor = LIMITS[name]
    return F.when(value <= good, "GOOD").when(value <= poor, "NEEDS_IMPROVEMENT").otherwise("POOR")


def _get(v: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(v), f"$.{path}", kind)


def _known(v: str, path: str) -> Column:
    """An object is there, if only an empty one."""
    found = F.try_variant_get(F.col(v), f"$.{path}", "variant")
    return found.isNotNull() & ~F.is_variant_null(found)


def metrics(payloads: DataFrame) -> DataFrame:
    """payloads (body, ...) with error, score, a struct (value, class, source) for each of LIMITS, field, origin_fallback, lcp_element and opportunities.

    body: a response as JSON; one that is no JSON, or an error, has no figures but error.  A figure of users
    counts if it has a percentile; its own class counts before its value's.  Without one, the laboratory's
    counts, 0 where there is none; only inp has none at all then.
    """
    v = payloads.withColumn("_v", F.try_parse_json("body"))
    v = v.withColumn("error", F.when(F.col("_v").isNull(), "no JSON").otherwise(F.when(_known("_v", "error"), F.coalesce(_get("_v", "error.message", "string"), F.lit("error")))))
    v = v.withColumns({"_page": _known("_v", "loadingExperience.metrics"), "_origin": _known("_v", "originLoadingExperience.metrics")})
    field = F.when(F.col("_page"), _get("_v", "loadingExperience.metrics", "variant")).when(F.col("_origin"), _get("_v", "originLoadingExperience.metrics", "variant"))
    v = v.withColumn("_field", field)
    ok, out = F.col("error").isNull(), {}
    for name in LIMITS:
        lab = F.coalesce(_get("_v", f'lighthouseResult.audits["{LAB[name]}"].numericValue', "double"), F.lit(0.0)) if name in LAB else F.lit(None).cast("double")
        users = _get("_field", f"{FIELD[name]}.percentile", "double") / (100 if name == "cls" else 1) if name in FIELD else F.lit(None).cast("double")
        said = _get("_field", f"{FIELD[name]}.category", "string") if name in FIELD else F.lit(None).cast("string")
        own = F.create_map(*(F.lit(x) for kv in CLASSES.items() for x in kv))[said]
        value = F.coalesce(users, lab)
        kind = F.when(users.isNotNull(), F.coalesce(own, classify(users, name))).otherwise(classify(lab, name))
        out[name] = F.when(ok & value.isNotNull(), F.struct(value.alias("value"), kind.alias("class"), F.when(users.isNotNull(), "field").otherwise("lab").alias("source")))
    audit = lambda i, what, kind: _get("_v", f'lighthouseResult.audits["{i}"].{what}', kind)
    # savings are a column of their own, read once; titles are read of those that count only
    v = v.withColumn("_ms", F.array(*(audit(i, "details.overallSavingsMs", "double") for i in SAVINGS)))
    ms = lambda n: F.get("_ms", F.lit(n))
    saved = F.array(*(F.when(ms(n) >= LEAST_MS, F.struct((-F.floor(ms(n) + 0.5)).alias("less"), F.lit(n).alias("n"), F.lit(i).alias("id"), F.coalesce(audit(i, "title", "string"), F.lit(i)).alias("title"))) for n, i in enumerate(SAVINGS)))
    saved = F.filter(saved, lambda x: x.isNotNull())
    named = F.transform(F.slice(F.array_sort(saved), 1, MOST), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), (-x["less"]).cast("long").alias("savings_ms")))
    node = 'lighthouseResult.audits["largest-contentful-paint-element"].details.items[0].items[0].node'
    out |= {
        "score": F.when(ok, F.floor(F.coalesce(_get("_v", "lighthouseResult.categories.performance.score", "double"), F.lit(0.0)) * 100 + 0.5).cast("int")),
        "field": ok & F.col("_field").isNotNull(),
        "origin_fallback": ok & ((~F.col("_page") & F.col("_origin")) | F.coalesce(_get("_v", "loadingExperience.origin_fallback", "boolean"), F.lit(False))),
        "lcp_element": F.when(ok, F.coalesce(_get("_v", f"{node}.selector", "string"), _get("_v", f"{node}.snippet", "string"))),
        "opportunities": F.when(ok, named),
    }
    return v.withColumns(out).drop("_v", "_page", "_origin", "_field", "_ms")


def site_facts(rows: DataFrame) -> DataFrame:
    """site and the facts of sitechecks that payloads tell: classes of the home page's figures on mobile, its scores, whether there are any.  rows: metrics with site, strategy, place (order of asking)."""
    ok = F.col("error").isNull()
    mobile = ok & (F.col("strategy") == "mobile")
    of = lambda c, cond: F.min_by(c, F.when(cond, F.col("place")))
    return rows.groupBy("site").agg(
        *(of(f"{n}.class", mobile).alias(n) for n in ("lcp", "cls", "inp", "tbt")), of("score", mobile).alias("mobile_score"), of("score", ok & (F.col("strategy") == "desktop")).alias("desktop_score"), of("score", ok).alias("first_score"), F.bool_or(ok).alias("pagespeed")
    )
