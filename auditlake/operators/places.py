"""Where in a page's markup a finding is, and the lines around it.

Checks carry no positions.  Each check that has a place in the source has a pattern; its first (or
second) match is the place.  Positions and lengths count UTF-16 units, as browsers do.  A page is
searched for the checks that are asked for only, each pattern once however many checks share it
and only where the texts that it needs are in the page, in Columns.  Snippets of a page share one index of its line ends, which every offset is looked up
in by bisection; markup without line breaks is broken into a line a tag first, once a page, with a
map from old offsets to new ones.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.sources.html import spread

_Q = "[\"']"
#: Patterns of the elements that places are named by.
ELEMENTS = {
    "title": r"<title\b[^>]*>[\s\S]*?</title>",
    "description": f"<meta[^>]+name={_Q}description{_Q}[^>]*>",
    "canonical": f"<link[^>]+rel={_Q}canonical{_Q}[^>]*>",
    "robots": f"<meta[^>]+name={_Q}robots{_Q}[^>]*>",
    "viewport": f"<meta[^>]+name={_Q}viewport{_Q}[^>]*>",
    "head": r"<head\b[^>]*>",
    "body": r"<body\b[^>]*>",
    "html": r"<html\b[^>]*>",
    "html end": r"</html\s*>",
    "head end": r"</head\s*>",
    "body end": r"</body\s*>",
    "base": r"<base\b[^>]*>",
    "h1": r"<h1\b[^>]*>[\s\S]*?</h1>",
    "h1 start": r"<h1\b[^>]*>",
    "h2": r"<h2\b[^>]*>[\s\S]*?</h2>",
    "heading": r"<h[1-6]\b[^>]*>",
    "noscript": r"<noscript\b[^>]*>",
    "map": r"<map\b[^>]*>",
    "plugin": r"<(?:applet|embed|object)\b[^>]*>",
    "image without alt": r"<img\b(?![^>]*\salt\s*=)[^>]*>",
    "image without width": r"<img\b(?![^>]*\swidth\s*=)[^>]*>",
    "image, one word": rf"<img[^>]+alt={_Q}[^\"'\s]+{_Q}[^>]*>",
    "image, long text": f"<img[^>]+alt={_Q}[^\"']{{100,}}{_Q}[^>]*>",
    "image by http": f"<img[^>]+src={_Q}http://[^\"']+{_Q}[^>]*>",
    "image, old format": rf"<img[^>]+src={_Q}[^\"']+\.(?:jpe?g|png)[^\"']*{_Q}[^>]*>",
    "image, animated": rf"<img[^>]+src={_Q}[^\"']+\.gif[^\"']*{_Q}[^>]*>",
    "image that fills": rf"<img(?=[^>]*data-nimg={_Q}fill{_Q})(?![^>]*\ssizes=)[^>]*>",
    "framework image": r"<img[^>]+data-nimg[^>]*>",
    "plain image": r"<img\b(?![^>]*(?:data-nimg|(?-i:/_next/image\?)))[^>]*>",
    "empty src": f"<[a-z]+[^>]+src={_Q}{_Q}[^>]*>",
    "empty link": rf"<a\b[^>]*\shref={_Q}{_Q}[^>]*>",
    "link to #": rf"<a\b[^>]*\shref={_Q}#{_Q}[^>]*>",
    "link with onclick": r"<a\b[^>]*\sonclick=[^>]*>",
    "link to localhost": rf"<a\b[^>]*href={_Q}[^\"']*(?:localhost|127\.0\.0\.1)[^\"']*{_Q}[^>]*>",
    "link with space": rf"<a\b[^>]*href={_Q}[^\"']*\s[^\"']*{_Q}[^>]*>",
    "nofollow link": rf"<a\b[^>]*rel={_Q}[^\"']*nofollow[^\"']*{_Q}[^>]*>",
    "link without text": r"<a\b[^>]*>\s*</a>",
    "sponsored link": rf"<a\b[^>]*rel={_Q}[^\"']*sponsored[^\"']*{_Q}[^>]*>",
    "og tag": f"<meta[^>]+property={_Q}og:[^\"']*{_Q}[^>]*>",
    "og:url": f"<meta[^>]+property={_Q}og:url{_Q}[^>]*>",
    "og:image": f"<meta[^>]+property={_Q}og:image{_Q}[^>]*>",
    "twitter tag": f"<meta[^>]+name={_Q}twitter:[^\"']*{_Q}[^>]*>",
    "twitter:description": f"<meta[^>]+name={_Q}twitter:description{_Q}[^>]*>",
    "style attribute": rf"<[a-z][a-z0-9]*\b[^>]*\sstyle={_Q}[^\"']*{_Q}[^>]*>",
    "table": r"<table\b[^>]*>",
    "php error": r"(?:Fatal error|Parse error|Warning):[^<\n]{0,160}",
    "lorem ipsum": r"lorem\s+ipsum",
    "meta refresh": f"<meta[^>]+http-equiv={_Q}?refresh{_Q}?[^>]*>",
    "form": r"<form\b[^>]*>",
    "form by http": f"<form[^>]+action={_Q}http://[^\"']+{_Q}[^>]*>",
    "password field": f"<input[^>]+type={_Q}password{_Q}[^>]*>",
    "stylesheet by http": f"<link[^>]+href={_Q}http://[^\"']+{_Q}[^>]*>",
    "script by http": f"<script[^>]+src={_Q}http://[^\"']+{_Q}[^>]*>",
    "blocking script": r"<script(?![^>]*\b(?:async|defer)\b)[^>]+src=[^>]*>",
    "hosted font": rf"<link[^>]+href={_Q}[^\"']*fonts\.googleapis\.com[^\"']*{_Q}[^>]*>",
    "w3.org": rf"{_Q}http://[^\"']*w3\.org[^\"']*{_Q}",
    "schema.org": rf"{_Q}http://[^\"']*schema\.org[^\"']*{_Q}",
    "ogp.me": rf"{_Q}http://[^\"']*ogp\.me[^\"']*{_Q}",
    "flight payload": r"self\.__next_f\s*\.\s*push\s*\(",
    "page data": f"<script[^>]+id={_Q}__NEXT_DATA__{_Q}[^>]*>",
    "script": r"<script\b[^>]*>",
    "open boundary": rf"<template\s+id={_Q}B:[0-9]+{_Q}[^>]*>",
    "empty mount": rf"<(?:div[^>]+id={_Q}(?:root|app|__next|__nuxt|svelte){_Q}|app-root)[^>]*>\s*</(?:div|app-root)>",
    "mount": f"<(?:div[^>]+id={_Q}(?:root|app|__next|__nuxt|svelte){_Q}|app-root)[^>]*>",
}
#: The element a check's finding stands at; "2" asks for its second one, "else" for another one where there is none.
AT = {
    "title": "title-too-long title-too-short title-is-empty title-starts-lowercase title-outdated title-duplicates",
    "title 2": "multiple-title-tags",
    "description": "description-too-long description-too-short description-is-empty description-duplicates description-equals-title",
    "description 2": "multiple-description-tags",
    "h1": "h1-too-long h1-too-short h1-is-empty h1-duplicates h1-starts-lowercase h1-equals-title h1-equals-description h1-has-other-tags-inside",
    "h1 start 2": "multiple-h1",
    "h2": "h2-starts-lowercase h2-has-other-tags-inside",
    "heading": "headings-hierarchy-broken",
    "canonical": "canonical-not-equal-url canonical-is-empty canonical-relative-url canonical-to-non-200 canonical-points-redirect canonical-points-noindex canonical-points-disallowed canonical-points-external-url"
    " canonical-points-homepage canonical-loop canonical-outside-head canonical-from-http-to-https canonical-from-https-to-http canonical-points-another-canonicalized-url canonicalized-url-noindex-nofollow",
    "canonical 2": "multiple-canonical-tags",
    "robots": "meta-noindex-pages meta-nofollow-pages noindex-follow-page meta-robots-outside-head",
    "robots 2": "multiple-noindex-directives",
    "robots else head": "non-indexable-pages",
    "head": "title-is-missing description-is-missing canonical-is-missing head-close-missing no-character-encoding viewport-missing open-graph-tags-missing twitter-card-missing",
    "body": "h1-is-missing",
    "html": "head-tag-missing body-tag-missing html-tag-empty html-lang-missing html-lang-invalid hreflang-defined-html-lang-missing",
    "html 2": "multiple-html-tags",
    "head 2": "multiple-head-tags",
    "body 2": "multiple-body-tags",
    "html end 2": "multiple-html-close",
    "head end 2": "multiple-head-close",
    "body end 2": "multiple-body-close",
    "noscript": "noscript-head-invalid",
    "base": "base-url-malformed-empty",
    "base 2": "multiple-base-urls multiple-mismatched-base-urls",
    "viewport": "viewport-no-width viewport-specific-width viewport-missing-initial-scale viewport-initial-scale-incorrect viewport-maximum-scale viewport-minimum-scale viewport-prevents-scaling",
    "viewport 2": "viewport-multiple",
    "map": "image-map-tags",
    "plugin": "unsupported-browser-plugins",
    "image without alt": "missing-alt-text",
    "image without width": "add-dimensions-to-images",
    "image, one word": "alt-text-one-word",
    "image, long text": "alt-text-too-long",
    "image by http": "https-page-links-http-image",
    "image, old format": "serve-images-next-gen",
    "image, animated": "use-video-for-animated",
    "image that fills": "next.image.fill-without-sizes",
    "framework image": "next.image.unoptimized next.image.lcp-not-prioritised",
    "plain image": "next.image.raw-img-tag",
    "empty src": "empty-src-attributes",
    "empty link": "empty-href-attribute",
    "link to #": "empty-links-hash",
    "link with onclick": "link-url-in-onclick",
    "link to localhost": "link-localhost",
    "link with space": "link-whitespace-href",
    "nofollow link": "nofollow-outgoing-internal-links",
    "link without text": "internal-link-no-anchor-text",
    "sponsored link": "page-contains-rel-sponsored",
    "og tag": "open-graph-tags-incomplete",
    "og:url": "open-graph-url-not-canonical",
    "og:image": "og-image-relative next.metadata.relative-og-image",
    "twitter tag": "twitter-card-incomplete",
    "twitter:description": "twitter-description-too-long",
    "style attribute": "tags-with-style-attributes",
    "table": "table-no-caption table-no-th",
    "php error": "php-fatal-error",
    "lorem ipsum": "lorem-ipsum",
    "meta refresh": "meta-refresh-redirect",
    "form": "form-with-get-method",
    "form by http": "https-form-posts-to-http",
    "password field": "http-url-password-field",
    "stylesheet by http": "https-links-http-css",
    "script by http": "https-links-http-javascript",
    "blocking script": "next.script.blocking",
    "hosted font": "next.font.external-blocking",
    "w3.org": "http-link-w3-org",
    "schema.org": "http-link-schema-org",
    "ogp.me": "http-link-ogp-me",
    "flight payload": "next.payload.rsc-bloat",
    "page data": "next.payload.props-bloat",
    "flight payload else script": "text-to-code-ratio-low",
    "open boundary": "next.render.unresolved-suspense",
    "empty mount": "spa.client-rendering-detected",
    "mount": "js.empty-root-fallback",
}
#: Findings at a place of the document as a whole, and how much of it is marked.
WHOLE = {"no-doctype": 60, "html-tag-missing": 80, "html-close-missing": 120, "body-close-missing": 120, "content-after-html": 120, "gtm-in-body": 14, "content-before-doctype": 0}
#: Fixed value: units that are marked at most.
MOST = 2000


def check_ids() -> list[str]:
    """The checks whose findings have a place."""
    return [*(i for ids in AT.values() for i in ids.split()), *WHOLE]


def units(c: Column) -> Column:
    """Length in UTF-16 units."""
    return F.octet_length(F.encode(c, "UTF-16LE")) / 2


#: What every match of an element's pattern holds, in lower case, beside what it is the first of; "|" parts alternatives.
#: Pages without it are not searched for the pattern.
HOLDS = {
    "title": ("<title", "</title>"), "description": ("description", "<meta"), "canonical": ("canonical", "<link"), "robots": ("robots", "<meta"), "viewport": ("viewport", "<meta"),
    "head": ("<head",), "body": ("<body",), "html": ("<html",), "html end": ("</html",), "head end": ("</head",), "body end": ("</body",), "base": ("<base",),
    "h1": ("<h1", "</h1>"), "h1 start": ("<h1",), "h2": ("<h2", "</h2>"), "heading": ("<h1|<h2|<h3|<h4|<h5|<h6",), "noscript": ("<noscript",), "map": ("<map",), "plugin": ("<applet|<embed|<object",),
    "image without alt": ("<img",), "image without width": ("<img",), "image, one word": ("<img", "alt="), "image, long text": ("<img", "alt="), "image by http": ("<img", "http://"), "image, old format": ("<img", ".jpg|.jpeg|.png"), "image, animated": ("<img", ".gif"),
    "image that fills": ("<img", "data-nimg=", "fill"), "framework image": ("<img", "data-nimg"), "plain image": ("<img",),
    "empty src": ("src=\"\"|src=\"'|src='\"|src=''",), "empty link": ("href=\"\"|href=\"'|href='\"|href=''",), "link to #": ("href=\"#|href='#",), "link with onclick": ("onclick=",), "link to localhost": ("localhost|127.0.0.1",), "link with space": ("<a", "href="),
    "nofollow link": ("nofollow", "<a"), "link without text": ("<a", "</a>"), "sponsored link": ("sponsored", "<a"),
    "og tag": ("og:", "<meta"), "og:url": ("og:url", "<meta"), "og:image": ("og:image", "<meta"), "twitter tag": ("twitter:", "<meta"), "twitter:description": ("twitter:description", "<meta"),
    "style attribute": ("style=",), "table": ("<table",), "php error": ("fatal error:|parse error:|warning:",), "lorem ipsum": ("lorem", "ipsum"), "meta refresh": ("refresh", "<meta"), "form": ("<form",), "form by http": ("<form", "http://"), "password field": ("<input", "password"),
    "stylesheet by http": ("<link", "http://"), "script by http": ("<script", "http://"), "blocking script": ("<script", "src="), "hosted font": ("fonts.googleapis.com", "<link"), "w3.org": ("w3.org", "http://"), "schema.org": ("schema.org", "http://"), "ogp.me": ("ogp.me", "http://"),
    "flight payload": ("self.__next_f",), "page data": ("__next_data__", "<script"), "script": ("<script",), "open boundary": ("<template", "b:"),
    "empty mount": ("<div|<app-root", "id=|<app-root", "</div|</app-root"), "mount": ("<div|<app-root", "id=|<app-root"),
}


def _data(rows: list[dict], kind: str) -> Column:
    """Rows as one literal: one expression serves them all, which plans and compiles far faster than one for each."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")


def _elements() -> Column:
    """A row of data for every one of ELEMENTS: its pattern p, the checks it is searched for, what its matches hold, and, if a second match is asked for, the pattern `rest` of what follows the first."""
    rows = []
    for e, pattern in ELEMENTS.items():
        names = [name for name in AT if e in name.removesuffix(" 2").split(" else ")]
        again = any(name.endswith(" 2") for name in names)
        rows.append(dict(p=f"(?i:{pattern})", ids=[i for name in names for i in AT[name].split()], holds=[x.split("|") for x in HOLDS[e]], rest=rf"(?>(?i:{pattern}))([\s\S]*)" if again else None))
    return _data(rows, "p:string,ids:array<string>,holds:array<array<string>>,rest:string")


def _entries() -> Column:
    """A row of data for every entry of AT: label, checks, the places in ELEMENTS of its element and of the other one (null: none), whether the second match is asked for."""
    rows, names = [], list(ELEMENTS)
    for name, ids in AT.items():
        label = name.removesuffix(" 2")
        element, _, other = label.partition(" else ")
        rows.append(dict(label=label, ids=ids.split(), k=names.index(element), q=names.index(other) if other else None, again=label != name))
    return _data(rows, "label:string,ids:array<string>,k:int,q:int,again:boolean")


_UNITS = "octet_length(encode({}, 'UTF-16LE')) div 2"
_HELD = "forall(e.holds, any_ -> exists(any_, x -> contains({}, x)))"
#: Columns, in their order, by element: start of the first match (from 1; 0 where there is none), its size, what follows it where the page may have another, the second match's start in that.
_STEPS = (
    {"start": f"transform(_elements, e -> if((asked is null or arrays_overlap(e.ids, asked)) and {_HELD.format('low')}, regexp_instr(html, e.p), 0))"},
    {
        "size": f"transform(_elements, (e, k) -> if(start[k] > 0, {_UNITS.format('regexp_extract(html, e.p, 0)')}, 0))",
        "rest": "transform(_elements, (e, k) -> if(e.rest is not null and start[k] > 0 and exists(e.holds[0], x -> substring_index(low, x, 2) <> low), regexp_extract(html, e.rest, 1), null))",
    },
    {"next": f"transform(_elements, (e, k) -> if(rest[k] is not null and {_HELD.format('lower(rest[k])')}, regexp_instr(rest[k], e.p), 0))"},
    {"second": f"transform(_elements, (e, k) -> if(next[k] > 0, named_struct('offset', cast(n - {_UNITS.format('rest[k]')} + next[k] - 1 as int), 'length', cast({_UNITS.format('regexp_extract(rest[k], e.p, 0)')} as int)), null))"},
)
_FIRST = "if(start[{0}] > 0, named_struct('offset', start[{0}] - 1, 'length', cast(size[{0}] as int)), null)"
_PLACES = f"transform(_entries, s -> named_struct('label', s.label, 'ids', s.ids, 'at', case when s.again then second[s.k] else coalesce({_FIRST.format('s.k')}, if(s.q is null, null, {_FIRST.format('s.q')})) end))"


def _whole(check: str) -> Column:
    """offset and length of a finding of WHOLE in html, which is not empty; low: in lower case, n: its units."""
    html, low, n, most = F.col("html"), F.col("low"), F.col("n"), F.lit(WHOLE[check])
    zero = F.lit(0)
    if check == "content-before-doctype":
        pair = zero, F.greatest(F.lit(1), F.regexp_instr(html, F.lit("(?i)<!doctype")) - 1)
    elif check == "content-after-html":
        at = F.when(F.contains(low, F.lit("</html>")), units(F.regexp_extract(html, r"(?is)\A(.*</html>)", 1)))
        pair = F.when(at > 0, at), F.least(most, n - at)
    elif check == "gtm-in-body":
        at = F.when(F.contains(html, F.lit("GTM-")) & F.contains(low, F.lit("<body")), units(F.regexp_extract(html, r"(?s)\A(.*?(?i:<body).*?)GTM-", 1)))
        pair = F.when(at > 0, at), most
    elif check.endswith("-close-missing"):
        pair = F.greatest(zero, n - most), most
    else:
        pair = zero, F.least(most, n)
    return F.when(pair[0].isNotNull(), F.struct(pair[0].cast("int").alias("offset"), pair[1].cast("int").alias("length")))


def finding_places(pages: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """page_id, check_id, offset, length, label: where the findings (page_id, check_id) are in pages (page_id, html).

    Findings without a place have no row.  Without findings, every check that has a place is asked for.
    The findings of a page meet its markup as one list, so the markup is shuffled or read once.
    A page stays one row until its places are known; each step is a column of its own, as Spark would
    otherwise search the markup again wherever a place is named.
    """
    if findings is None:
        asked = pages.select("page_id", "html").withColumn("asked", F.lit(None).cast("array<string>"))
    else:
        lists = findings.where(F.col("check_id").isin(*check_ids())).groupBy("page_id").agg(F.collect_set("check_id").alias("asked"))
        asked = pages.select("page_id", "html").join(lists, "page_id")
    rows = spread(asked.where("html <> ''")).select("page_id", "html", "asked", F.lower("html").alias("low"), units(F.col("html")).cast("int").alias("n"))
    for step in _STEPS:
        rows = rows.withColumn("_elements", _elements()).withColumns({name: F.expr(e) for name, e in step.items()})
    whole = [F.struct(F.lit("document").alias("label"), F.array(F.lit(i)).alias("ids"), _whole(i).alias("at")) for i in WHOLE]
    places = F.concat(F.expr(_PLACES), F.array(*whole))
    out = rows.withColumn("_entries", _entries()).select("page_id", "asked", "n", F.inline_outer(places)).where("at.offset >= 0 and at.offset < n")
    ids = F.when(F.col("asked").isNull(), F.col("ids")).otherwise(F.array_intersect("ids", "asked"))
    return out.select("page_id", F.explode(ids).alias("check_id"), "at.offset", F.greatest(F.lit(1), F.least(F.lit(MOST), "at.length")).alias("length"), "label")


#: Units of a line that are shown, and what a document without line breaks is.
LINE, LEAST_UNITS, UNITS_A_BREAK = 400, 2000, 200
#: Elements whose text is no markup, elements without an end, the deepest indent.
RAW = ("script", "style", "pre", "textarea")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
DEEPEST = 12
_SPACE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def in_units(text: str) -> str:
    """The text with every character beyond U+FFFF as its two halves, so that places in it count UTF-16 units."""
    return re.sub("[\U00010000-\U0010ffff]", lambda m: chr(0xD800 + (ord(m[0]) - 0x10000 >> 10)) + chr(0xDC00 + (ord(m[0]) - 0x10000 & 0x3FF)), text)


def from_units(text: str) -> str:
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def has_no_lines(text: str) -> bool:
    """Whether a document has too few line breaks to be shown by lines."""
    return len(text) >= LEAST_UNITS and text.count("\n") <= len(text) / UNITS_A_BREAK


def broken_up(html: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """html with a line for each tag and each text between tags, and the map of offsets: (from, to, new place, whether places inside go on)."""
    out, size, map_, depth, lower = [], 0, [], 0, html.lower()

    def line() -> None:
        nonlocal size
        if size:
            out.append("\n" + "  " * min(depth, DEEPEST))
            size += len(out[-1])

    def put(text: str, start: int, end: int) -> None:
        nonlocal size
        map_.append((start, end, size, 1))
        out.append(text)
        size += len(text)

    at = 0
    while at < len(html):
        tag = html.find("<", at)
        text_end = len(html) if tag < 0 else tag
        if text_end > at:
            text = html[at:text_end].strip(_SPACE)
            if text:
                line()
                put(text, at, text_end)
            elif tag >= 0:
                map_.append((at, text_end, size, 0))
        if tag < 0:
            break
        end = html.find(">", tag) + 1
        if not end:
            line()
            put(html[tag:], tag, len(html))
            break
        name = re.match(r"</?[\s\ufeff]*([a-zA-Z][a-zA-Z0-9-]*)", html[tag:end])
        name = name[1].lower() if name else ""
        closes, opens = html.startswith("</", tag), not (html[end - 2 : end] == "/>" or name in VOID)
        depth -= closes and depth > 0
        line()
        put(html[tag:end], tag, end)
        at = end
        if opens and not closes:
            if name in RAW:
                stop = lower.find("</" + name, at)
                stop = len(html) if stop < 0 else stop
                if stop > at:
                    put(html[at:stop], at, stop)
                at = stop
            else:
                depth += 1
    return "".join(out), map_


def moved(map_: list[tuple[int, int, int, int]], offset: int) -> int:
    """Where an offset has gone; 0 where it is in nothing that was kept."""
    i = bisect_right(map_, (offset, len(map_) and map_[-1][1] + 1, 0, 0)) - 1
    if i < 0 or not map_[i][0] <= offset < map_[i][1]:
        return 0
    start, _, new, goes_on = map_[i]
    return new + (offset - start) * goes_on


class Lines:
    """A document by lines: its line ends are found once, offsets are looked up in them."""

    def __init__(self, text: str):
        self.text, self.ends = text, [m.start() for m in re.finditer("\n", text)]

    def line(self, n: int) -> str:
        return self.text[self.ends[n - 1] + 1 if n else 0 : self.ends[n] if n < len(self.ends) else len(self.text)]

    def snippet(self, offset: int, context: int, length: int) -> dict:
        offset = max(0, min(offset, len(self.text)))
        n = bisect_left(self.ends, offset)
        column = offset - (self.ends[n - 1] + 1 if n else 0)
        first, last = max(0, n - context), min(len(self.ends), n + context)
        shown = [from_units(x[:LINE]) + (" …" if len(x) > LINE else "") for x in map(self.line, range(first, last + 1))]
        wide = len(self.line(n))
        start = min(column, wide)
        return dict(line=n + 1, column=column + 1, start_line=first + 1, lines=shown, highlight=n - first, total_lines=len(self.ends) + 1, mark_start=start if length > 0 else None, mark_end=min(start + length, wide) if length > 0 else None)


SNIPPET = "page_id long, check_id string, label string, offset int, reformatted boolean, line int, column int, start_line int, lines array<string>, highlight int, total_lines int, mark_start int, mark_end int"


def _snippets(context: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page, html, found in zip(*(c.to_pylist() for c in batch.columns)):  # a page at a time, as its text is the largest thing
            text = in_units(html)
            flat, map_ = has_no_lines(text), []
            if flat:
                text, map_ = broken_up(text)
            lines = Lines(text)
            rows = [dict(page_id=page, check_id=f["check_id"], label=f["label"], offset=f["offset"], reformatted=flat) | lines.snippet(moved(map_, f["offset"]) if flat else f["offset"], context, f["length"]) for f in found]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def finding_snippets(pages: DataFrame, places: DataFrame, context: int = 6) -> DataFrame:
    """The lines around each place (page_id, check_id, offset, length, label) in pages (page_id, html), `context` on both sides (0 to 40)."""
    from functools import partial

    from pyspark.sql.pandas.types import to_arrow_schema

    by = places.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("check_id", "offset", "length", "label"))).alias("found"))  # at most one a check
    rows = pages.where("html is not null").select("page_id", "html").join(by, "page_id")
    schema = to_arrow_schema(pages.sparkSession.createDataFrame([], SNIPPET).schema)
    return rows.mapInArrow(partial(_snippets, max(0, min(40, context)), schema), SNIPPET)


def source_lines(pages: DataFrame) -> DataFrame:
    """page_id, units, lines, flat (without the line breaks to be shown by lines) of every page."""
    n, breaks = units(F.col("html")), F.length("html") - F.length(F.replace("html", F.lit("\n"), F.lit("")))
    out = pages.where("html is not null").select("page_id", n.cast("long").alias("units"), (breaks + 1).cast("long").alias("lines"))
    return out.withColumn("flat", (F.col("units") >= LEAST_UNITS) & ((F.col("lines") - 1) <= F.col("units") / UNITS_A_BREAK))


def finding_lines(pages: DataFrame, places: DataFrame) -> DataFrame:
    """page_id, check_id, line, column of each place in the markup as it is served, in Columns.

    The places of a page meet its markup as one list; places that many checks share are looked up once.
    """
    by = places.groupBy("page_id").agg(F.collect_list(F.struct("check_id", "offset")).alias("found"))
    # a place never begins inside a character, so units and characters before it agree but for those of two units
    rows = pages.select("page_id", "html").join(by, "page_id").select("page_id", "found", F.encode("html", "UTF-16LE").alias("raw"))
    rows = rows.select("page_id", "found", "raw", F.explode(F.array_distinct("found.offset")).alias("offset"))
    rows = rows.select("page_id", "found", "offset", F.decode(F.substring("raw", F.lit(1), F.col("offset") * 2), "UTF-16LE").alias("before"))
    breaks = F.octet_length("before") - F.octet_length(F.replace("before", F.lit("\n"), F.lit("")))
    rows = rows.select("page_id", "found", "offset", (breaks + 1).cast("long").alias("line"), (units(F.substring_index("before", "\n", -1)) + 1).cast("long").alias("column"))
    return rows.select("page_id", F.explode(F.filter("found", lambda x: x["offset"] == F.col("offset"))["check_id"]).alias("check_id"), "line", "column")
