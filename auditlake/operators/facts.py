"""What a check may read: a page's record, what its response says, and names derived from both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.functions.dialect import Spark
from auditlake.functions.urls import absolute_key
from auditlake.operators.predicates import derived
from auditlake.sources.html import SCHEMA

HOP = "struct<url:string,status:int,location:string>"
#: Columns of a response that may be missing: type and what counts then.
RESPONSE = {
    "status": ("int", "200"), "fetch_error": ("string", "null"), "content_type": ("string", "'text/html'"), "headers": ("map<string,string>", "map()"), "redirect_chain": (f"array<{HOP}>", "array()"),
    "ttfb_ms": ("int", "null"), "timed_out": ("boolean", "false"), "subresource": ("boolean", "false"), "in_sitemap": ("boolean", "false"), "sitemaps": ("int", "0"), "disallowed": ("boolean", "false"),
    "rendered": ("boolean", "false"), "js_errors": ("int", "0"), "client_shell": ("boolean", "null"), "server_text_length": ("int", "null"), "as_of": ("date", "current_date()"), "crawl_order": ("long", "page_id"),
}


def hops(chain):
    """A redirect chain (url, status, location) with the address each hop leads to and the keys of both."""

    def hop(x):
        to, url = x["location"], x["url"]
        origin = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
        folder = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"(://[^/]+.*/)[^/]*$", "$1")
        full = F.when(to.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), to).when(F.startswith(to, F.lit("//")), F.concat(F.regexp_extract(url, "^[^:]*:", 0), to)).when(F.startswith(to, F.lit("/")), F.concat(origin, to)).otherwise(F.concat(folder, to))
        return F.struct(url.alias("url"), x["status"].alias("status"), full.alias("target"), absolute_key(url).alias("key"), absolute_key(full).alias("to_key"))

    return F.transform(chain, hop)


def prepared(pages: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """pages with every column of a record and of a response (responses: by page_id; what is missing counts as in RESPONSE), and the derived names.

    Names that no check asks for are pruned by Catalyst.
    """
    if responses is not None:
        pages = pages.join(responses.select("page_id", *(c for c in RESPONSE if c in responses.columns)), "page_id", "left")
    have = set(pages.columns)
    kinds: StructType = pages.sparkSession.createDataFrame([], SCHEMA + ", html string").schema
    new = {f.name: F.lit(None).cast(f.dataType) for f in kinds if f.name not in have}
    if "page_key" not in have:
        new["page_key"] = absolute_key(F.col("url"))
    for name, (kind, default) in RESPONSE.items():
        own = F.expr(f"cast({default} as {kind})")
        new[name] = F.coalesce(F.col(name).cast(kind) if not kind.startswith("array") else F.col(name), own) if name in have else own
    out = pages.withColumns(new)
    header = lambda name: F.try_element_at("headers", F.lit(name))
    out = out.withColumns({
        "is_html": F.expr("content_type like '%text/html%' or content_type like '%application/xhtml%'"),
        "x_robots": F.coalesce(F.lower(header("x-robots-tag")), F.lit("")), "last_modified": header("last-modified"),
        "canonical_header": absolute_key(F.nullif(F.regexp_extract(F.coalesce(header("link"), F.lit("")), r'<([^>]*)>;\s*rel="?canonical', 1), F.lit(""))),
        "home_key": F.concat(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0), F.lit("/")),
        "redirect_chain": hops(F.col("redirect_chain")) if "redirect_chain" not in have or "target" not in str(pages.schema["redirect_chain"].dataType.simpleString()) else F.col("redirect_chain"),
    })
    for layer in derived(Spark()):
        out = out.withColumns({name: F.expr(e) for name, e in layer})
    return out
