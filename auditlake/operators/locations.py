"""How well each page covers each of a site's locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.urls import path

#: Points of each signal; body counts in full from three mentions on.
POINTS = {"in_title": 22, "in_h1": 20, "in_description": 12, "in_headings": 12, "in_url": 10, "in_body": 12, "has_local_schema": 8, "has_address": 4}
#: Fixed patterns of an address, a postcode and local markup.
ADDRESS = r"(?i)\b\d{1,6}\s+[A-Z][A-Za-z.'-]+\s+(?:st|street|ave|avenue|rd|road|blvd|boulevard|ln|lane|dr|drive|way|suite|ste|unit)\b"
POSTCODE = r"\b(?:\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2})\b"
SCHEMA = r"""(?i)"@type"\s*:\s*"(?:LocalBusiness|PostalAddress|[A-Za-z]*(?:Store|Restaurant|Service))"|itemtype=["'][^"']*(?:LocalBusiness|PostalAddress)"""


def terms(label: str, city: str | None = None, region: str | None = None) -> list[str]:
    """Ways in which a page may name the location, in lower case."""
    found = [x.strip().lower() for x in (city, region, label, label.split(",")[0]) if x]
    return list(dict.fromkeys(x for x in found if len(x) > 1))


def coverage(records: DataFrame, locations: list[dict]) -> DataFrame:
    """page_id, label, the signals, coverage (0 to 100), gaps, of each page and location.

    locations: a site's own short list of {label, city, region}; it is part of the plan and
    exploded beside each record, so there is neither a join nor a shuffle.  Null fields count as empty.
    """
    listed = F.array(*(F.struct(F.lit(x["label"]).alias("label"), F.array(*map(F.lit, terms(**x))).cast("array<string>").alias("terms")) for x in locations))
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    h1 = F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))["text"]
    fields = dict(_title=text(F.col("title")), _h1=text(h1), _description=text(F.col("description")), _body=text(F.col("body_text")), _url=text(path(F.col("url"))))
    below = F.transform(F.filter("headings", lambda h: h["level"].isin(2, 3)), lambda h: F.lower(h["text"]))
    local = dict(has_local_schema=F.coalesce(F.rlike("html", F.lit(SCHEMA)), F.lit(False)), has_address=F.coalesce(F.rlike("body_text", F.lit(ADDRESS)) | F.rlike("body_text", F.lit(POSTCODE)), F.lit(False)))
    rows = records.select("page_id", *(c.alias(n) for n, c in fields.items()), below.alias("_below"), *(c.alias(n) for n, c in local.items()), F.inline(listed))
    named = lambda c: F.exists("terms", lambda t: F.contains(c, t))
    mentions = F.aggregate("terms", F.lit(0), lambda n, t: n + ((F.length("_body") - F.length(F.replace(F.col("_body"), t, F.lit("")))) / F.length(t)).cast("int"))
    rows = rows.select(
        "page_id", "label", named(F.col("_title")).alias("in_title"), named(F.col("_h1")).alias("in_h1"), named(F.col("_description")).alias("in_description"),
        F.exists("_below", lambda h: F.exists("terms", lambda t: F.contains(h, t))).alias("in_headings"), mentions.alias("in_body"),
        F.exists("terms", lambda t: F.contains(F.col("_url"), F.regexp_replace(t, r"\s+", "-"))).alias("in_url"), "has_local_schema", "has_address",
    )
    points: Column = F.least(F.lit(1.0), F.col("in_body") / 3) * POINTS["in_body"]
    for name, worth in POINTS.items():
        if name != "in_body":
            points = points + F.when(F.col(name), worth).otherwise(0)
    missing = F.array_compact(F.array(*(F.when(F.col(n) == 0 if n == "in_body" else ~F.col(n), F.lit(n)) for n in POINTS)))
    return rows.withColumns({"coverage": F.floor(F.least(F.lit(100.0), points) + 0.5).cast("long"), "gaps": missing})
