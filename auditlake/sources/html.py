"""Page records from raw HTML: one nested row per page, parsed by the standard library inside Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.urls import page_key, resolve

LINK = (
    "struct<pos:int,raw_href:string,href:string,key:string,anchor:string,nofollow:boolean,sponsored:boolean,ugc:boolean,internal:boolean,external:boolean,in_footer:boolean,in_nav:boolean,"
    "wraps_image:boolean,image_alt:string,onclick:string,before_h1:boolean>"
)
IMAGE = "struct<raw_src:string,src:string,key:string,alt:string,has_alt:boolean,loading:string,width:double,height:double,next:boolean,in_link:boolean>"
HEADING = "struct<level:int,text:string,inner_tags:boolean>"
FORM = "struct<method:string,action:string,has_password:boolean,posts_to_http:boolean>"
LANG = "struct<lang:string,href:string,key:string,raw_href:string>"
SCRIPT = "struct<url:string,key:string,is_async:boolean,is_defer:boolean,in_head:boolean>"
STYLE = "struct<url:string,key:string>"
TABLE = "struct<caption:boolean,th:boolean>"
SCHEMA = (
    "page_id long, url string, page_key string, title string, titles int, description string, descriptions int, html_lang string, charset string, viewports array<string>,"
    f" canonicals array<string>, canonical_raw array<string>, canonical_in_head boolean, meta_robots array<string>, robots_outside_head boolean, base_hrefs array<string>, favicon string, noscript_bad boolean,"
    f" headings array<{HEADING}>, links array<{LINK}>, images array<{IMAGE}>, scripts array<{SCRIPT}>, stylesheets array<{STYLE}>, forms array<{FORM}>, tables array<{TABLE}>,"
    f" hreflang array<{LANG}>, og map<string,string>, twitter map<string,string>, json_ld array<string>, formats array<string>, body_text string, word_count int, paragraphs int, lists int, strongs int,"
    " iframes int, dom_nodes int, dom_depth int, dom_width int, ids array<string>, duplicate_ids array<string>, empty_src int, style_attrs int, maps int, plugins int, bytes int"
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "noscript", "template", "svg"}
_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
_PLAIN = {"b", "i", "em", "strong", "span", "br"}
_BLOCKS = set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: A start tag -> (the open elements it ends, those that keep it from looking further up).
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
_SCHEME = re.compile(r"(?i)[a-z][a-z0-9+.-]*:")
_KEYS: dict[str | None, str | None] = {}


def _key(url: str | None) -> str | None:
    """page_key, remembered: a site's pages link to the same addresses."""
    if url not in _KEYS:
        if len(_KEYS) >= 1 << 16:
            _KEYS.clear()
        _KEYS[url] = page_key(url)
    return _KEYS[url]


def _number(text: str | None) -> float | None:
    """A dimension: none where it is missing or no number, 0 where it is empty."""
    if text is None:
        return None
    try:
        return float(text.strip() or 0)
    except ValueError:
        return None


class _Page(HTMLParser):
    """Elements as they open and close.  Elements whose end tag may be left out end where another one begins; head and body
    need no tags; which ancestors are open is counted, so a page takes time in proportion to its length however deep it is."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.stack, self.children, self.open = url, [], [0], Counter()
        self.site = re.sub(r"^www\.", "", urlsplit(_key(url) or "").netloc) if "://" in url else ""
        self.row = dict(title=None, titles=0, description=None, descriptions=0, html_lang=None, charset=None, viewports=[], canonicals=[], canonical_raw=[], canonical_in_head=True, meta_robots=[], robots_outside_head=False, base_hrefs=[], favicon=None, noscript_bad=False, headings=[], links=[], images=[], scripts=[], stylesheets=[], forms=[], tables=[], hreflang=[], og={}, twitter={}, json_ld=[], formats=[], paragraphs=0, lists=0, strongs=0, iframes=0, dom_nodes=0, dom_depth=0, dom_width=0, empty_src=0, style_attrs=0, maps=0, plugins=0)
        self.text, self.title_text, self.heading, self.link, self.ld, self.in_body, self.ids, self.names, self.tables, self.formats, self.h1_at = [], None, None, None, None, False, Counter(), set(), [], set(), None

    def full(self, href: str) -> str | None:
        """The absolute address, on this page's own address whatever a base element says; other schemes as they are."""
        found = resolve(self.url, href)
        return found if found or not _SCHEME.match(href) or re.match("(?i)https?:", href) else href

    def push(self, tag, marks):
        self.stack.append((tag, marks))
        self.children.append(0)
        self.open.update((tag, *marks))

    def pop(self) -> str:
        tag, marks = self.stack.pop()
        self.children.pop()
        self.open.subtract((tag, *marks))
        if tag == "table":
            self.tables.pop()
        return tag

    def pop_to(self, tag):
        while self.pop() != tag:
            pass

    def implied(self, tag):
        """Close what this start tag ends."""
        if tag in _BLOCKS and self.open["p"] > 0:
            self.pop_to("p")
        if tag in _ENDS:
            ends, stops = _ENDS[tag]
            if any(self.open[x] > 0 for x in ends):
                for own, _ in reversed(self.stack):
                    if own in stops:
                        break
                    if own in ends:
                        self.pop_to(own)
                        break

    def handle_starttag(self, tag, attrs):
        r, a = self.row, {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        r["style_attrs"] += "style" in a
        r["empty_src"] += a.get("src") == ""
        if "id" in a:
            self.ids[a["id"]] += 1
        if "name" in a:
            self.names.add(a["name"])
        self.formats.update(f for f, of in (("microdata", ("itemscope",)), ("rdfa", ("typeof", "vocab"))) if any(x in a for x in of))
        if tag in ("html", "head", "body"):
            if tag == "html":
                r["html_lang"] = r["html_lang"] or a.get("lang")
            self.in_body |= tag == "body"
            return
        if not self.in_body and self.open["noscript"] > 0:
            r["noscript_bad"] |= tag not in ("link", "style", "meta")
        elif tag not in _HEAD:
            self.in_body = True
        head = not self.in_body
        self.implied(tag)
        r["dom_nodes"] += 1
        self.children[-1] += 1
        r["dom_width"] = max(r["dom_width"], self.children[-1])
        r["dom_depth"] = max(r["dom_depth"], len(self.stack) + 3)
        if self.heading is not None and tag not in _PLAIN:
            self.heading["inner_tags"] = True
        if tag == "title":
            r["titles"] += 1
            self.title_text = [] if r["titles"] == 1 else None
        elif tag == "meta":
            self.meta(a, head)
        elif tag == "base" and "href" in a:
            r["base_hrefs"].append(a["href"])
        elif tag == "link":
            self.relation(a, head)
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.end_heading()
            self.heading = dict(level=int(tag[1]), text="", inner_tags=False)
            if tag == "h1" and self.h1_at is None:
                self.h1_at = len(r["links"])
        elif tag == "a":
            self.anchor(a)
        elif tag == "img":
            raw = a.get("src", "").strip()
            src = self.full(raw) or raw
            r["images"].append(dict(raw_src=raw, src=src, key=_key(src), alt=a.get("alt"), has_alt="alt" in a, loading=a.get("loading"), width=_number(a.get("width")), height=_number(a.get("height")), next="data-nimg" in a or "/_next/image?" in raw, in_link=self.open["a"] > 0))
            if self.link is not None and not self.link["wraps_image"]:
                self.link |= dict(wraps_image=True, image_alt=a.get("alt"))
        elif tag == "script":
            raw = a.get("src", "").strip()
            src = self.full(raw) or raw if raw else ""
            r["scripts"].append(dict(url=src, key=_key(src) if src else None, is_async="async" in a, is_defer="defer" in a, in_head=head))
            if a.get("type") == "application/ld+json":
                self.formats.add("json-ld")
                self.ld = []
        elif tag == "form":
            r["forms"].append(dict(method=(a.get("method") or "get").lower(), action=a.get("action"), has_password=False, posts_to_http=((a.get("action") and self.full(a["action"])) or "").startswith("http://")))
        elif tag == "input" and a.get("type", "").lower() == "password" and r["forms"]:
            r["forms"][-1]["has_password"] = True
        elif tag == "table":
            r["tables"].append(dict(caption=False, th=False))
        elif tag in ("caption", "th"):
            for t in self.tables:
                t[tag] = True
        for name, tags in (("paragraphs", ("p",)), ("lists", ("ul", "ol", "dl")), ("strongs", ("strong", "b")), ("iframes", ("iframe",)), ("maps", ("map",))):
            r[name] += tag in tags
        r["plugins"] += tag in ("applet", "embed") or tag == "object" and "classid" in a
        if tag not in _VOID:
            classes, marks = a.get("class", "").split(), []
            if tag == "footer" or a.get("role") == "contentinfo" or "footer" in classes or a.get("id") == "footer":
                marks.append("*footer")
            if tag in ("nav", "header") or a.get("role") == "navigation":
                marks.append("*nav")
            if tag in _SILENT:
                marks.append("*silent")
            self.push(tag, marks)
            if tag == "table":
                self.tables.append(r["tables"][-1])

    def anchor(self, a):
        raw, rel = a.get("href", "").strip(), a.get("rel", "").lower().split()
        full = self.full(raw) if raw and not raw.startswith("javascript:") else None
        web = bool(full) and bool(re.match("(?i)https?:", full))
        key = _key(full) if web else full
        there = re.sub(r"^www\.", "", urlsplit(key).netloc) if web else None
        self.link = dict(pos=len(self.row["links"]), raw_href=raw, href=full, key=key, anchor="", nofollow="nofollow" in rel, sponsored="sponsored" in rel, ugc="ugc" in rel, internal=web and there == self.site, external=web and there != self.site, in_footer=self.open["*footer"] > 0, in_nav=self.open["*nav"] > 0, wraps_image=False, image_alt=None, onclick=a.get("onclick"), before_h1=False)
        self.row["links"].append(self.link)

    def meta(self, a, head):
        r, name, content = self.row, a.get("name", "").lower(), a.get("content", "")
        if "charset" in a:
            r["charset"] = r["charset"] or a["charset"]
        elif a.get("http-equiv", "").lower() == "content-type" and (m := re.search(r"(?i)charset=([\w-]+)", content)):
            r["charset"] = r["charset"] or m[1]
        if name == "description":
            r["descriptions"] += 1
            r["description"] = content.strip() if r["description"] is None else r["description"]
        elif name in ("robots", "googlebot"):
            r["meta_robots"].append(content.lower())
            r["robots_outside_head"] |= not head
        elif name == "viewport":
            r["viewports"].append(content)
        elif name.startswith("twitter:"):
            r["twitter"].setdefault(name, content.strip())
        if a.get("property", "").lower().startswith("og:"):
            r["og"].setdefault(a["property"].lower(), content.strip())

    def relation(self, a, head):
        r, rel, href = self.row, a.get("rel", "").lower().strip(), a.get("href", "").strip()
        if rel == "canonical":
            r["canonical_raw"].append(href)
            r["canonicals"].append(_key(resolve(self.url, href)) or href)
            r["canonical_in_head"] &= head
        elif rel == "stylesheet":
            full = self.full(href) or href
            r["stylesheets"].append(dict(url=full, key=_key(full)))
        elif rel == "alternate" and "hreflang" in a:
            full = resolve(self.url, href)
            r["hreflang"].append(dict(lang=a["hreflang"].strip(), href=full, key=_key(full), raw_href=href))
        if "icon" in rel.split() and r["favicon"] is None:
            r["favicon"] = href

    def end_heading(self):
        if self.heading is not None:
            self.heading["text"] = " ".join(self.heading["text"].split())
            self.row["headings"].append(self.heading)
            self.heading = None

    def end_link(self):
        if self.link is not None:
            self.link["anchor"] = " ".join(self.link["anchor"].split())
            self.link = None

    def handle_endtag(self, tag):
        if tag == "title" and self.title_text is not None:
            self.row["title"], self.title_text = " ".join("".join(self.title_text).split()), None
        elif self.heading is not None and tag == f"h{self.heading['level']}":
            self.end_heading()
        elif tag == "a":
            self.end_link()
        elif tag == "script" and self.ld is not None:
            self.row["json_ld"].append("".join(self.ld))
            self.ld = None
        if self.open[tag] > 0:
            self.pop_to(tag)

    def handle_data(self, data):
        if self.title_text is not None:
            self.title_text.append(data)
            return
        if self.ld is not None:
            self.ld.append(data)
        if self.heading is not None:
            self.heading["text"] += data
        if self.link is not None:
            self.link["anchor"] += data
        if self.open["*silent"] <= 0:
            self.in_body |= not data.isspace()
            if self.in_body:
                self.text.append(data)

    def record(self) -> dict:
        r = self.row
        if self.title_text is not None:
            r["title"] = " ".join("".join(self.title_text).split())
        self.end_heading()
        self.end_link()
        for link in r["links"][: self.h1_at or 0]:
            link["before_h1"] = True
        known = list(dict.fromkeys((*self.ids, *sorted(self.names))))
        return r | dict(ids=known, duplicate_ids=[x for x, n in self.ids.items() if n > 1], formats=sorted(self.formats))


def parse_page(url: str | None, html: str | None) -> dict:
    """The record of one page; broken markup never raises, a page without markup has an empty record."""
    p = _Page(url or "")
    try:
        # marked sections are no part of HTML: browsers read them as comments up to the next ">"
        p.feed(re.sub(r"<!\[[^>]*>", "", html or ""))
        p.close()
    except AssertionError:  # what the standard parser has no answer to ends the page there
        pass
    r = p.record()
    if html:
        r["dom_nodes"], r["dom_depth"], r["dom_width"] = r["dom_nodes"] + 3, max(2, r["dom_depth"]), max(2, r["dom_width"])
    text = " ".join("".join(p.text).split())
    return r | dict(body_text=text, word_count=len(text.split()), bytes=len((html or "").encode()))


#: Pages that are made into records at a time.
AT_ONCE = 256


#: Fixed value: parts for each core that pages are dealt into.
PARTS = 4


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt out evenly into several parts for each core: what is done with a row takes far longer than sending it.

    The parts of a file say little, as one of them may hold all rows: a file is only cut between its row groups.
    """
    return rows.repartition(max(PARTS * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as wide records of SCHEMA plus html; one pass, after they are dealt out."""
    from pyspark.sql.pandas.types import to_arrow_schema

    full = F.col("html")
    kind = pages.sparkSession.createDataFrame([], SCHEMA + ", html string").schema
    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            rows = [dict(page_id=i, url=u, page_key=page_key(u), html=h) | parse_page(u, h) for i, u, h in zip(*(c.to_pylist() for c in batch.columns))]
            for r in rows:
                r["og"], r["twitter"] = list(r["og"].items()), list(r["twitter"].items())
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spread(pages.select("page_id", "url", full)).mapInArrow(run, kind)
