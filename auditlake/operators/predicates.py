"""The checks of one page as predicates over its record and what its response says.

`derived(d)` names what several predicates share, in layers that build on each other;
`page_checks(d)` lists the checks: identifier, category, severity, scope, predicate, selectors of platforms.  d spells
functions as an engine does (functions.dialect).  A predicate that is null counts as passed.
"""

from __future__ import annotations

#: Patterns.
LANG_TAG = r"^([a-z]{2,3})(-[A-Z][a-z]{3})?(-([A-Z]{2}|[0-9]{3}))?$"
LOREM = r"(?i)\blorem\s+ipsum\b|\bdolor\s+sit\s+amet\b"
PHP_ERROR = r"(?i)(Fatal error|Parse error|Warning):\s*.{0,80}\bin\b\s+/?\w[^\s<]*\.php\s+on line [0-9]+"
CAPTCHA = "(?i)recaptcha|hcaptcha|g-recaptcha|cf-turnstile|are you a robot"
GTM = "GTM-[A-Z0-9]{4,10}"
FONT_HOSTS = r"(?i)fonts\.googleapis\.com|fonts\.gstatic\.com|use\.typekit\.net|fast\.fonts\.net|@fontsource"
#: Anchors that say nothing.
EMPTY_ANCHORS = (
    "click here", "here", "read more", "more", "link", "this", "this page", "learn more", "continue", "continue reading", "go", "download", "view", "see more", "details",
)
#: Mount points that are empty until scripts run.
MOUNTS = (
    r"""(?i)<div[^>]+id=["']root["'][^>]*>\s*</div>""", r"""(?i)<div[^>]+id=["']app["'][^>]*>\s*</div>""", r"(?i)<app-root[^>]*>\s*</app-root>",
    r"""(?i)<div[^>]+id=["']__next["'][^>]*>\s*</div>""", r"""(?i)<div[^>]+id=["']svelte["'][^>]*>\s*</div>""", r"""(?i)<div[^>]+id=["']__nuxt["'][^>]*>\s*</div>""",
)
#: Scopes of checks.
PAGE = "is_html and status = 200 and fetch_error is null"
HTML, EVERY, MAPPED, LANGS = "is_html", "true", "in_sitemap", "has_langs"
FOUND, NAVIGATED = "status = 200", "status = 200 and not subresource"
RAW, RENDERED, NEXT = "not rendered and is_html and status = 200", "rendered and is_html and status = 200", "is_next and is_html and status = 200"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def path(d, url: str) -> str:
    return d.part(url, _PATH, 1)


def bare_host(d, url: str) -> str:
    return d.sub(f"lower({d.part(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)})", r"^www\.", "")


def directive(d, name: str, header: bool = True) -> str:
    """A robots directive stands among those that commas part, in the page's tags (or the header)."""
    own = d.any("meta_robots", d.like("x", _among(name)))
    return f"({own} or {in_header(d, name)})" if header else f"({own})"


def _among(name: str) -> str:
    return rf"(^|,)\s*{name}\s*(,|$)"


def in_header(d, name: str) -> str:
    return f"({d.like('x_robots', _among(name))})"


def _closers(d, tag: str) -> str:
    """End tags of an element; those with nothing but scripts, comments and more end tags between them are one."""
    rest = d.part("html", rf"(?is)</{tag}\s*>(.*)</{tag}\s*>", 1)
    for p in (r"(?is)<script.*?</script>", r"(?s)<!--.*?-->", r"(?i)</?(html|body|div|template)[^>]*>", r"\s+"):
        rest = d.sub(rest, p, "")
    n = d.times("html", rf"(?i)</{tag}\s*>")
    return f"case when {n} > 1 and {rest} = '' then 1 else {n} end"


def raw_text(d, html: str = "html") -> str:
    """Visible text by patterns alone."""
    t = f"coalesce(nullif({d.part(html, '(?is)<body[^>]*>(.*?)</body>', 1)}, ''), {html})"
    for tag in ("script", "style", "noscript", "template", "svg"):
        t = d.sub(t, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    for p in (r"(?s)<!--.*?-->", "<[^>]+>", r"\s+"):
        t = d.sub(t, p, " ")
    return f"trim({t})"


#: Fixed value: where a quoted id or name stands that a link to a place on the page may mean.
MARK = r"""\s{}=["']([^"']+)["']"""


def same_address(d, url: str) -> str:
    """An absolute address as addresses are compared: scheme and host in lower case, no fragment, no default port, no slash at the end of a longer path."""
    whole = d.sub(f"trim({url})", "#.*$", "")
    part = lambda i: d.part(whole, r"^([a-zA-Z]+)://([^/?]*)([^?]*)(\?.+)?", i)
    place = d.sub(d.sub(f"concat(lower({part(1)}), '://', lower({part(2)}))", "^(http://[^/]*):80$", D1[type(d).__name__]), "^(https://[^/]*):443$", D1[type(d).__name__])
    return f"case when {d.like(whole, '(?i)^https?://')} then concat({place}, coalesce(nullif({d.sub(part(3), '/$', '')}, ''), '/'), {part(4)}) else {url} end"


#: How each engine names the first group in a replacement.
D1 = {"Spark": "$1", "Duck": r"\1"}


#: A string in double quotes.  In Spark without a way back, as the JVM's matcher would call itself once a character and end the executor on a long one.
QUOTED = {"Spark": r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "Duck": r'"(?:[^"\\]|\\.)*"'}


def derived(d) -> list[list[tuple[str, str]]]:
    """Layers of (name, expression); each may use those before it."""
    clean = lambda c: f"lower(trim(coalesce({c}, '')))"
    h1s = d.each(d.pick("headings", "x.level = 1"), "x.text")
    one = [
        ("way", path(d, "url")),
        ("query", d.pick(d.each(d.split(d.part("url", r"\?([^#]*)", 1), "&"), d.first(d.split("x", "="))), "x <> ''")),
        ("secure", d.starts("url", "https://")),
        ("canon", f"nullif({d.first('canonicals')}, '')"),
        ("noindex", f"({directive(d, 'noindex')} or {directive(d, 'none')})"),
        ("nofollow", f"({directive(d, 'nofollow')} or {directive(d, 'none')})"),
        ("soft_noindex", d.any("meta_robots", d.has("x", "noindex"))),
        ("title_l", clean("title")), ("description_l", clean("description")), ("h1s", h1s), ("h2s", d.each(d.pick("headings", "x.level = 2"), "x.text")),
        ("html_open", d.times("html", r"(?i)<html[\s>]")), ("head_open", d.times("html", r"(?i)<head[\s>]")), ("body_open", d.times("html", r"(?i)<body[\s>]")),
        ("html_close", _closers(d, "html")), ("head_close", d.times("html", r"(?i)</head\s*>")), ("body_close", _closers(d, "body")),
        ("gtm", d.distinct(d.all("html", GTM))),
        ("in_body", f"coalesce(nullif({d.part('html', r'(?is)<body[^>]*>(.*)$', 1)}, ''), html)"),
        ("size", d.bytes("html")),
        ("text_units", d.units("coalesce(body_text, '')")),
        ("comments", d.total(d.each(d.pick(d.all("html", r"(?s)<!--.*?-->"), f"not ({d.like('x', r'^<!--\s*(\[if|\$)|^<!--/?\$')})"), f"cast({d.units('x')} as bigint)"))),
        ("scale", f"concat(',', lower({d.sub(d.first('viewports'), r'\s+', '')}), ',')"),
        ("anchors", d.sort(d.each(d.pick("links", "x.internal and x.key is not null and x.anchor <> ''"), "concat(x.key, ' ', lower(x.anchor))"))),
        ("marked", f"concat({d.all('html', MARK.format('id'), 1)}, {d.all('html', MARK.format('name'), 1)})"),
        ("targets", d.sort(d.each(d.pick("links", "x.internal"), "x.key"))),
        ("head_texts", d.each(d.pick("headings", "x.text <> ''"), "lower(x.text)")),
        ("alts", d.each(d.pick("images", "trim(x.alt) <> ''"), "lower(trim(x.alt))")),
        ("has_langs", f"{d.n('hreflang')} > 0"),
        ("default_key", f"{d.first(d.pick('hreflang', "x.lang = 'x-default'"))}.key"),
        ("named_langs", d.pick("hreflang", "x.lang <> 'x-default'")),
        ("raw_words", raw_text(d)),
        ("mounted", " or ".join(f"({d.like('html', m)})" for m in MOUNTS)),
        ("next_data", d.part("html", r"""(?is)<script[^>]+id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>""", 1)),
        ("flight", d.like("html", r"self\.__next_f\s*\.\s*push\s*\(")),
        ("waiting", d.n(d.minus(d.distinct(d.all("html", r"""(?i)<template[^>]+id=["']B:([0-9]+)["']""", 1)), d.all("html", r"""\$RC\s*\(\s*["']B:([0-9]+)["']""", 1)))),
        ("flight_units", d.total(d.each(d.all("html", r"self\.__next_f\s*\.\s*push\s*\(\s*\[\s*[0-9]+\s*,\s*(" + QUOTED[type(d).__name__] + ")", 1), f"cast({d.units('x')} as bigint)"))),
        ("tags_img", d.pick(d.all("html", "(?i)<img[^>]*>"), f"{d.like('x', '(?i)data-nimg')} or {d.has('x', '/_next/image?')}")),
        ("urgent", f"({d.like('html', r"""(?i)<img[^>]*fetchpriority\s*=\s*["']?high""")} or {d.like('html', r"""(?i)<link[^>]*rel\s*=\s*["']?preload[^>]*as\s*=\s*["']?image""")})"),
        ("fresh", d.whole(d.part("coalesce(" + d.value("headers", "cache-control") + ", '')", r"s-maxage=([0-9]+)", 1))),
        ("cached", f"upper(coalesce({d.value('headers', 'x-nextjs-cache')}, ''))"), ("edge", f"upper(coalesce({d.value('headers', 'x-vercel-cache')}, ''))"),
        ("kept_private", d.like(f"coalesce({d.value('headers', 'cache-control')}, '')", "no-store|private")),
        ("prerendered", f"coalesce({d.value('headers', 'x-nextjs-prerender')}, '') = '1'"),
        ("by_next", d.like(f"lower(coalesce({d.value('headers', 'x-powered-by')}, ''))", r"next\.js")),
    ]
    area = f"coalesce({d.whole(d.part('x', r"""(?i)\swidth\s*=\s*["']?([0-9]+)""", 1))}, 0) * coalesce({d.whole(d.part('x', r"""(?i)\sheight\s*=\s*["']?([0-9]+)""", 1))}, 0)"
    two = [
        ("moved", "canon <> page_key"),
        ("h1_l", clean(d.first("h1s"))),
        ("router", "case when next_data <> '' and flight then 'hybrid' when flight then 'app' when next_data <> '' then 'pages' else 'unknown' end"),
        ("shell", f"coalesce(client_shell, case when mounted then {d.units('raw_words')} < 200 else {d.like('html', '(?i)<script[^>]+src=')} and {d.units('raw_words')} < 100 end)"),
        ("server_units", f"coalesce(server_text_length, {d.units('raw_words')})"),
        ("main_img", f"coalesce({d.first(d.pick('tags_img', f'{area} > 40000'))}, {d.first(d.pick('tags_img', d.like('x', r"""(?i)data-nimg\s*=\s*["']?fill""")))})"),
        ("loading", d.part(f"coalesce({d.first(d.pick('tags_img', f'{area} > 40000'))}, {d.first(d.pick('tags_img', d.like('x', r"""(?i)data-nimg\s*=\s*["']?fill""")))})", r"""(?i)\sloading\s*=\s*["']?([a-z]+)""", 1)),
    ]
    three = [
        ("is_next", f"(router <> 'unknown' or by_next or {d.has('html', '/_next/static/')})"),
        ("strategy", "case when " + d.like("next_data", r'"gssp"\s*:\s*true') + " then 'ssr' when " + d.like("next_data", r'"gsp"\s*:\s*true') + " then case when fresh > 0 then 'isr' else 'static' end when waiting > 0 then 'streaming'"
         " when prerendered or cached in ('HIT', 'STALE') or edge in ('PRERENDER', 'HIT', 'STALE', 'REVALIDATED') then case when fresh > 0 or cached = 'STALE' or edge = 'STALE' then 'isr' else 'static' end"
         f" when kept_private or cached = 'BYPASS' or edge = 'BYPASS' then 'ssr' when router <> 'unknown' and {d.units('raw_words')} < 200 then 'client' when fresh > 0 then 'isr' else 'unknown' end"),
    ]
    return [one, two, three]


def page_checks(d) -> list[tuple[str, str, str, str, str]]:
    """(id, category, severity, scope, predicate) of every check that needs one page alone."""
    out: list[tuple] = []
    any_, n, like, starts, has, count, units = d.any, d.n, d.like, d.starts, d.has, d.count, d.units

    def pack(category):
        def add(i, severity, predicate, scope=PAGE, category=category):
            out.append((i, category, severity, scope, predicate))

        return add

    blank = lambda c: f"trim(coalesce({c}, '')) = ''"
    relative = lambda c: f"not ({like(c, '(?i)^https?://')})"

    c = pack("indexability")
    c("canonical-is-missing", "warning", f"{n('canonicals')} = 0 and canonical_header is null")
    c("canonical-is-empty", "critical", any_("canonicals", "trim(x) = ''"))
    c("canonical-not-equal-url", "warning", "moved")
    c("canonical-relative-url", "warning", any_("canonical_raw", f"x <> '' and {relative('x')}"))
    c("canonical-outside-head", "critical", f"{n('canonicals')} > 0 and not canonical_in_head")
    c("multiple-canonical-tags", "warning", f"{n('canonicals')} + case when canonical_header is null then 0 else 1 end > 1")
    c("mismatched-canonical-html-header", "critical", "canon <> canonical_header")
    c("canonical-tag-html-and-header", "notice", "canon <> '' and canonical_header <> ''", category="duplicate-content")
    c("canonicalized-url-noindex-nofollow", "critical", "moved and noindex")
    c("canonical-from-http-to-https", "notice", f"{starts('url', 'http://')} and {starts('canon', 'https://')}")
    c("canonical-from-https-to-http", "critical", f"secure and {starts('canon', 'http://')}")
    c("canonical-points-external-url", "critical", f"{bare_host(d, 'canon')} <> {bare_host(d, 'url')}", category="duplicate-content")
    c("canonical-points-homepage", "critical", "page_key <> home_key and canon = home_key", category="duplicate-content")
    c("meta-noindex-pages", "critical", "noindex")
    c("meta-nofollow-pages", "critical", "nofollow")
    c("noindex-follow-page", "warning", "noindex and not nofollow")
    for word, follow in (("noindex", "index"), ("nofollow", "follow")):
        own, other = directive(d, word, False), in_header(d, word)
        c(f"{word}-html-and-header", "warning", f"{own} and {other}")
        c(f"mismatched-{word}-html-header", "critical", f"{own} <> {other} and ({directive(d, follow, False)} or {in_header(d, follow)})")
    c("multiple-noindex-directives", "warning", count("meta_robots", has("x", "noindex")) + " > 1")
    c("meta-robots-outside-head", "critical", "robots_outside_head")
    c("disallowed-by-robots-txt", "critical", "disallowed", HTML)
    c("non-indexable-pages", "warning", "status <> 200 or disallowed or noindex or moved", HTML)
    c("page-contains-rel-sponsored", "notice", any_("links", "x.sponsored"))
    for tag in ("html", "head", "body"):
        c(f"{tag}-tag-missing", "critical", f"{tag}_open = 0")
        c(f"{tag}-close-missing", "warning", f"{tag}_open > 0 and {tag}_close = 0")
        c(f"multiple-{tag}-tags", "critical", f"{tag}_open > 1")
        c(f"multiple-{tag}-close", "critical", f"{tag}_close > 1")
    c("content-after-html", "warning", f"trim({d.sub(d.part('html', r'(?is)^.*</html>(.*)$', 1), r'\s+', ' ')}) <> ''")
    c("content-before-doctype", "critical", f"{like('html', r'(?i)<!doctype\s+[^>]*>')} and trim({d.sub(d.part('html', r'(?is)^(.*?)<!doctype', 1), r'\s+', ' ')}) <> ''")
    c("no-character-encoding", "critical", f"charset is null and not ({has('content_type', 'charset=')})")
    c("noscript-head-invalid", "warning", "noscript_bad")
    c("multiple-base-urls", "warning", f"{n('base_hrefs')} > 1")
    c("multiple-mismatched-base-urls", "warning", f"{n(d.distinct('base_hrefs'))} > 1")
    c("base-url-malformed-empty", "warning", any_("base_hrefs", f"trim(x) = '' or {like('x', r'(?i)^https?:/*([?#].*)?$|^https?://[^/]*[\s<>^|]')}"))
    c("h1-has-other-tags-inside", "notice", any_("headings", "x.level = 1 and x.inner_tags"))
    c("h2-has-other-tags-inside", "notice", any_("headings", "x.level = 2 and x.inner_tags"))
    c("double-slash-in-url", "warning", has("way", "//"), HTML)
    c("more-than-three-parameters", "notice", f"{n('query')} > 3", HTML)
    c("form-with-get-method", "notice", any_("forms", "x.method = 'get'"))
    c("content-type-not-html", "notice", "not is_html", NAVIGATED)

    c = pack("content-relevance")
    c("title-is-missing", "blocker", "titles = 0")
    c("title-is-empty", "blocker", f"titles > 0 and {blank('title')}")
    c("title-too-long", "warning", f"{units('title')} > 60")
    c("title-too-short", "warning", f"{units('trim(title)')} between 1 and 29")
    c("multiple-title-tags", "warning", "titles > 1")
    c("title-starts-lowercase", "notice", like("title", "^[a-z]"))
    c("title-outdated", "notice", f"{d.whole(d.part('title', r'\b(?:19|20)[0-9]{2}\b'))} < year(as_of)")
    c("description-is-missing", "warning", "descriptions = 0")
    c("description-is-empty", "warning", f"descriptions > 0 and {blank('description')}")
    c("description-too-long", "warning", f"{units('description')} > 160")
    c("description-too-short", "notice", f"{units('trim(description)')} between 1 and 69")
    c("multiple-description-tags", "warning", "descriptions > 1")
    c("description-equals-title", "warning", "title_l <> '' and title_l = description_l")
    c("h1-is-missing", "critical", f"{n('h1s')} = 0")
    c("h1-is-empty", "critical", f"{n('h1s')} > 0 and {count('h1s', "trim(x) <> ''")} = 0")
    c("h1-too-long", "notice", any_("h1s", f"{units('x')} > 70"))
    c("h1-too-short", "notice", any_("h1s", f"{units('trim(x)')} between 1 and 9"))
    c("multiple-h1", "warning", f"{n('h1s')} > 1", category="duplicate-content")
    c("h1-starts-lowercase", "notice", any_("h1s", like("x", "^[a-z]")))
    c("h2-is-missing", "notice", f"word_count > 300 and {n('h2s')} = 0")
    c("h2-starts-lowercase", "notice", any_("h2s", like("x", "^[a-z]")))
    c("low-word-count", "warning", "word_count < 300")
    c("text-to-code-ratio-low", "warning", "size = 0 or text_units * 10 < size")
    c("page-code-under-500", "critical", "size < 500")
    c("paragraphs-are-missing", "notice", "word_count > 100 and paragraphs = 0")
    c("no-list-markdown", "notice", "word_count > 300 and lists = 0")
    c("no-strong-importance-elements", "notice", "word_count > 300 and strongs = 0")
    c("lorem-ipsum", "critical", like("body_text", LOREM))
    c("author-box-admin", "warning", like("body_text", r"(?i)(?:by|author)[:\s]+admin\b"))
    c("page-not-updated-1-year", "notice", f"{d.days('as_of', d.day('last_modified'))} > 365")
    c("html-lang-missing", "warning", "coalesce(html_lang, '') = ''")
    c("missing-alt-text", "warning", any_("images", f"not x.has_alt and x.src <> '' and not {starts('x.src', 'data:')}"))
    c("alt-text-one-word", "notice", any_("images", f"trim(x.alt) <> '' and not {has('trim(x.alt)', ' ')}"))
    c("alt-text-too-long", "notice", any_("images", f"{units('x.alt')} > 100"))
    c("images-present", "notice", f"word_count > 300 and {n('images')} = 0")
    c("https-page-links-http-image", "critical", f"secure and {any_('images', starts('x.src', 'http://'))}")
    c("non-html-urls", "notice", "not is_html", NAVIGATED)
    c("pdf-files", "notice", f"{has('content_type', 'pdf')} or {like('url', r'(?i)\.pdf($|\?)')}", NAVIGATED)

    c = pack("links")
    inside, outside = count("links", "x.internal"), count("links", "x.external")
    c("page-has-no-outgoing-links", "critical", count("links", "x.href is not null") + " = 0")
    c("only-one-followed-internal-link", "warning", n(d.distinct(d.each(d.pick("links", f"x.internal and not x.nofollow and not {starts('x.raw_href', '#')}"), "x.key"))) + " = 1")
    c("more-than-100-internal-links", "warning", f"{inside} > 100")
    c("more-than-100-external-links", "warning", f"{outside} > 100")
    c("more-than-10-external-links", "notice", f"{outside} > 10")
    c("more-than-100-identical-internal-links", "warning", d.later("targets", 100))
    c("more-than-2-links-same-anchor", "notice", d.later("anchors", 2))
    c("more-than-100-links-before-h1", "notice", count("links", "x.before_h1") + " > 100")
    c("nofollow-outgoing-internal-links", "warning", any_("links", "x.internal and x.nofollow"))
    c("footer-links-nofollow", "opportunity", any_("links", "x.in_footer and x.nofollow and x.internal"))
    c("internal-link-no-anchor-text", "warning", any_("links", "x.internal and x.anchor = '' and not (x.wraps_image and coalesce(x.image_alt, '') <> '')"))
    c("outgoing-one-word-anchor", "notice", any_("links", f"x.internal and x.anchor <> '' and not {has('x.anchor', ' ')}"))
    plain = ", ".join(d.text(a) for a in EMPTY_ANCHORS)
    c("outgoing-non-descriptive-anchor", "notice", any_("links", f"not x.nofollow and trim({d.sub('lower(trim(x.anchor))', '[.!:>»→]+$', '')}) in ({plain})"))
    c("anchored-image-no-alt", "warning", any_("links", "x.wraps_image and x.anchor = '' and coalesce(x.image_alt, '') = ''"))
    c("broken-jump-link", "warning", any_("links", f"{like('x.raw_href', '^#.')} and not {d.among('marked', d.decode('substr(x.raw_href, 2)'))}"))
    c("empty-href-attribute", "warning", any_("links", "x.raw_href = ''"))
    c("empty-links-hash", "notice", any_("links", "x.raw_href = '#'"))
    c("malformed-href-data", "warning", any_("links", f"x.raw_href <> '' and x.href is null and not ({like('x.raw_href', '(?i)^(#|(javascript|mailto|tel|sms):)')})"))
    c("link-whitespace-href", "warning", any_("links", like("trim(x.raw_href)", r"\s")))
    c("link-non-http-protocol", "notice", any_("links", like("x.raw_href", "(?i)^(ftp|mailto|tel|sms|file|news):")))
    c("link-localhost", "critical", any_("links", like("x.raw_href", r"(?i)localhost|127\.0\.0\.1|0\.0\.0\.0")), category="internal")
    c("link-local-unc-path", "critical", any_("links", like("x.raw_href", r"(?i)^(file://|\\\\|[a-z]:\\)")), category="internal")
    c("link-url-in-onclick", "notice", any_("links", like("x.onclick", r"(?i)https?:|location|window\.open")))
    c("http-page-links-to-https", "notice", f"{starts('url', 'http://')} and {any_('links', f'x.internal and {starts("x.href", "https://")}')}")

    c = pack("duplicate-content")
    c("page-identical-headings", "notice", f"{n('head_texts')} > {n(d.distinct('head_texts'))}")
    c("page-identical-alt-tags", "notice", f"{n('alts')} > {n(d.distinct('alts'))}")
    c("h1-equals-title", "notice", "h1_l <> '' and h1_l = title_l")
    c("h1-equals-description", "notice", "h1_l <> '' and h1_l = description_l")
    c("h1-equals-alt", "notice", f"h1_l <> '' and {d.among('alts', 'h1_l')}")
    c("title-equals-alt", "notice", f"title_l <> '' and {d.among('alts', 'title_l')}")

    c = pack("security")
    c("http-urls", "critical", starts("url", "http://"), HTML)
    c("https-page-internal-links-http", "critical", f"secure and {any_('links', f'x.internal and {starts("x.href", "http://")}')}")
    c("https-links-http-css", "critical", f"secure and {any_('stylesheets', starts('x.url', 'http://'))}")
    c("https-links-http-javascript", "critical", f"secure and {any_('scripts', starts('x.url', 'http://'))}")
    c("https-form-posts-to-http", "critical", f"secure and {any_('forms', 'x.posts_to_http')}")
    c("http-url-password-field", "blocker", f"{starts('url', 'http://')} and {any_('forms', 'x.has_password')}", category="internal")
    for name, host in (("w3-org", r"www\.w3\.org"), ("schema-org", r"schema\.org"), ("ogp-me", r"ogp\.me")):
        c(f"http-link-{name}", "notice", like("html", r"""(?i:\b(?:src|href)\s*=\s*["']http://)[^"']*""" + host + r"""[^"']*["']"""))
    c("requires-captcha", "notice", like("html", CAPTCHA))

    c = pack("internal")
    c("4xx-client-errors", "blocker", "status between 400 and 499", EVERY)
    c("5xx-server-errors", "blocker", "status >= 500", EVERY)
    c("timed-out", "blocker", "timed_out", EVERY)
    c("long-urls", "notice", f"{units('url')} > 115", HTML)
    c("url-uppercase", "warning", like("way", "[A-Z]"), HTML)
    c("url-non-ascii", "warning", like(d.decode("way"), r"[^\x20-\x7E]"), HTML)
    c("url-whitespace", "warning", like("way", r"%20|\s|\+"), HTML)
    c("url-repetitive-elements", "notice", d.twins(d.pick(d.split("way", "/"), "x <> ''")), HTML)
    c("url-underscores", "notice", has("way", "_"), HTML)
    c("query-question-mark", "notice", f"{n('query')} > 0", HTML)
    c("query-repetitive-parameters", "warning", f"{n('query')} <> {n(d.distinct('query'))}", HTML)
    c("query-sort-parameters", "notice", any_("query", like("x", "(?i)^(sort|order|orderby|sort_by|dir)$")), HTML)
    c("query-search-filter-parameters", "notice", any_("query", like("x", "(?i)^(q|s|search|query|filter|f|color|size|brand)$")), HTML)
    c("query-paginated-parameters", "notice", any_("query", like("x", "(?i)^(page|p|pg|offset|start)$")), HTML)
    c("empty-src-attributes", "warning", "empty_src > 0")
    c("invalid-content-type", "warning", f"content_type = '' or ({like('url', r'(?i)\.css($|\?)')} and not {has('content_type', 'css')}) or ({like('url', r'(?i)\.js($|\?)')} and not {like('content_type', 'javascript|ecmascript')})", FOUND)
    c("no-gtm-code", "notice", f"{n('gtm')} = 0")
    c("multiple-gtm-codes", "warning", f"{n('gtm')} > 1")

    c = pack("page-speed")
    c("page-size-over-1-5mb", "warning", "size > 1572864 and size <= 2097152")
    c("page-size-over-2mb", "critical", "size > 2097152")
    c("slow-load-speed", "warning", "ttfb_ms > 800")
    c("defer-offscreen-images", "opportunity", any_(d.after("images", 3), "coalesce(x.loading, '') <> 'lazy'"))
    c("add-dimensions-to-images", "warning", any_("images", f"(x.width is null or x.height is null) and not {starts('x.src', 'data:')}"))
    c("serve-images-next-gen", "opportunity", any_("images", f"{like('x.src', r'(?i)\.(jpe?g|png)($|\?)')} and not x.next"))
    c("use-video-for-animated", "opportunity", any_("images", like("x.src", r"(?i)\.gif($|\?)")))
    c("avoid-excessive-dom-size", "warning", "dom_nodes > 1500")
    c("avoid-excessive-dom-depth", "notice", "dom_depth > 32")
    c("avoid-excessive-dom-width", "notice", "dom_width > 60")
    c("excessive-comments", "notice", "comments > 1000")

    c = pack("mobile-friendly")
    some = f"{n('viewports')} > 0 and "
    c("viewport-missing", "critical", f"{n('viewports')} = 0")
    c("viewport-multiple", "warning", f"{n('viewports')} > 1")
    c("viewport-no-width", "critical", some + f"not {like('scale', ',width[=,]')}")
    c("viewport-specific-width", "critical", f"{d.part('scale', '.*,width=([^,]*)', 1)} not in ('', 'device-width')")
    c("viewport-missing-initial-scale", "warning", some + f"not {like('scale', ',initial-scale[=,]')}")
    c("viewport-initial-scale-incorrect", "warning", f"{d.part('scale', '.*,initial-scale=([^,]*)', 1)} not in ('', '1', '1.0')")
    c("viewport-maximum-scale", "warning", like("scale", ",maximum-scale[=,]"))
    c("viewport-minimum-scale", "notice", like("scale", ",minimum-scale[=,]"))
    c("viewport-prevents-scaling", "warning", f"{d.part('scale', '.*,user-scalable=([^,]*)', 1)} in ('no', '0')")
    c("image-map-tags", "notice", "maps > 0")
    c("unsupported-browser-plugins", "critical", "plugins > 0")

    c = pack("redirects")
    c("301-redirects", "notice", f"status = 301 or {any_('redirect_chain', 'x.status = 301')}", EVERY)
    c("302-redirects", "warning", f"status = 302 or {any_('redirect_chain', 'x.status = 302')}", EVERY)
    odd = "{0} between 300 and 399 and {0} not in (301, 302)"
    c("3xx-other-redirects", "notice", f"({odd.format('status')}) or {any_('redirect_chain', odd.format('x.status'))}", EVERY)
    c("redirect-chains", "critical", f"{n('redirect_chain')} > 1", EVERY)
    c("redirect-loop", "blocker", f"{n(d.distinct(d.each('redirect_chain', 'x.key')))} < {n('redirect_chain')}", EVERY)
    c("redirect-to-itself", "blocker", any_("redirect_chain", "x.to_key = x.key"), EVERY)
    c("broken-redirect", "critical", f"{n('redirect_chain')} > 0 and status >= 400", EVERY)
    old, new = path(d, "x.url"), path(d, "x.target")
    c("redirect-trailing-slash", "critical", any_("redirect_chain", f"{old} <> {new} and {d.sub(old, '/$', '')} = {d.sub(new, '/$', '')}"), EVERY)
    c("redirect-case-normalization", "critical", any_("redirect_chain", f"{old} <> {new} and lower({old}) = lower({new})"), EVERY)
    c("https-to-http-redirect", "blocker", any_("redirect_chain", f"{starts('x.url', 'https://')} and {starts('x.target', 'http:')}"), EVERY)
    c("meta-refresh-redirect", "warning", like("html", r"""(?i)<meta[^>]+http-equiv=["']?refresh"""))

    c = pack("social-media")
    c("open-graph-tags-missing", "warning", f"{d.keys('og')} = 0")
    lacking = lambda m, names: " or ".join(blank(d.value(m, x)) for x in names)
    c("open-graph-tags-incomplete", "notice", f"{d.keys('og')} > 0 and ({lacking('og', ('og:title', 'og:description', 'og:image', 'og:url'))})")
    shared = d.value("og", "og:url")
    c("open-graph-url-not-canonical", "notice", f"not ({blank(shared)}) and not ({blank('canon')}) and {same_address(d, shared)} <> {same_address(d, 'canon')}")
    c("og-image-relative", "warning", f"{d.value('og', 'og:image')} <> '' and {relative(d.value('og', 'og:image'))}")
    c("twitter-card-missing", "notice", f"{d.keys('twitter')} = 0")
    c("twitter-card-incomplete", "notice", f"{d.keys('twitter')} > 0 and ({lacking('twitter', ('twitter:card', 'twitter:title'))})")
    c("twitter-description-too-long", "notice", f"{units(d.value('twitter', 'twitter:description'))} > 200")

    c = pack("code-validation")
    c("no-doctype", "critical", f"not {like('html', r'(?i)<!doctype\s+[^>]*>')}")
    c("html-tag-empty", "blocker", "false")  # a parser always makes head and body
    c("php-fatal-error", "blocker", like("html", PHP_ERROR))
    c("gtm-in-body", "warning", f"{n('gtm')} > 0 and {like('in_body', GTM + r'|googletagmanager\.com/gtm\.js')}")
    c("headings-hierarchy-broken", "notice", d.jumps("headings", "level"))
    c("identical-html-ids", "critical", f"{n('duplicate_ids')} > 0")
    c("different-structured-data-formats", "notice", f"{n('formats')} > 1")
    c("table-no-caption", "notice", any_("tables", "not x.caption"))
    c("table-no-th", "notice", any_("tables", "not x.th"))
    c("tags-with-style-attributes", "notice", "style_attrs > 0")

    c = pack("xml-sitemaps")
    c("sitemap-4xx", "critical", "status between 400 and 499", MAPPED)
    c("sitemap-5xx", "critical", "status >= 500", MAPPED)
    c("sitemap-3xx", "warning", "status between 300 and 399", MAPPED)
    c("sitemap-noindex", "critical", f"soft_noindex or {has('x_robots', 'noindex')}", MAPPED)
    c("sitemap-disallowed", "critical", "disallowed", MAPPED)
    c("sitemap-canonicalized", "critical", "moved", MAPPED)
    c("sitemap-timed-out", "warning", "timed_out", MAPPED)
    c("sitemap-multiple", "notice", "sitemaps > 1", MAPPED)

    c = pack("localization")
    c("html-lang-invalid", "warning", f"html_lang not in ('', 'x-default') and not {like('html_lang', LANG_TAG)}")
    c("hreflang-annotation-invalid", "critical", any_("named_langs", f"not {like('x.lang', LANG_TAG)}"), LANGS)
    c("hreflang-relative-urls", "critical", any_("hreflang", relative("x.raw_href")), LANGS)
    c("self-reference-hreflang-missing", "critical", count("hreflang", "x.key = page_key") + " = 0", LANGS)
    main = lambda x: d.part(f"lower({x})", "^[^-]*")
    c("hreflang-html-lang-mismatch", "warning", f"{d.first(d.pick('hreflang', 'x.key = page_key'))}.lang <> 'x-default' and {main(d.first(d.pick('hreflang', 'x.key = page_key')) + '.lang')} <> {main('html_lang')}", LANGS + " and html_lang <> ''")
    c("hreflang-defined-html-lang-missing", "warning", "coalesce(html_lang, '') = ''", LANGS)
    c("x-default-missing", "notice", count("hreflang", "x.lang = 'x-default'") + " = 0", LANGS)
    c("hreflang-also-x-default", "notice", any_("named_langs", "x.key = default_key"), LANGS)
    pair, pages, langs = (n(d.distinct(d.each(a, e))) for a, e in (("hreflang", "concat(x.lang, ' ', x.key)"), ("named_langs", "x.key"), ("hreflang", "x.lang")))
    c("multiple-pages-same-language", "critical", f"{pair} > {langs}", LANGS)
    c("page-referenced-multiple-languages", "critical", n(d.distinct(d.each("named_langs", "concat(x.lang, ' ', x.key)"))) + f" > {pages}", LANGS)

    c = pack("nextjs")
    c("next.render.unresolved-suspense", "blocker", "waiting > 0", NEXT)
    c("next.render.client-only-content", "blocker", f"{units('raw_words')} < 200", NEXT)
    c("next.render.unexpectedly-dynamic", "critical", f"strategy = 'ssr' and {n('query')} = 0", NEXT)
    c("next.image.raw-img-tag", "warning", any_("images", f"not x.next and x.src <> '' and not {starts('x.src', 'data:')}"), NEXT)
    c("next.image.lcp-not-prioritised", "warning", "main_img is not null and not urgent and loading in ('', 'lazy')", NEXT)
    fill = like("x", r"""(?i)data-nimg\s*=\s*["']?fill""")
    c("next.image.fill-without-sizes", "warning", any_("tags_img", f"{fill} and not {like('x', r"""(?i)\ssizes\s*=\s*["']?[^"'\s>]""")}"), NEXT)
    c("next.image.unoptimized", "opportunity", any_("tags_img", f"{like('x', '(?i)data-nimg')} and not {has('x', '/_next/image?')}"), NEXT)
    sheet = like("x", r"""(?i)rel\s*=\s*["']?stylesheet|as\s*=\s*["']?(font|style)""")
    c("next.font.external-blocking", "warning", any_(d.all("html", "(?i)<link[^>]*>"), f"({sheet}) and {like('x', FONT_HOSTS)}"), NEXT)
    c("next.payload.rsc-bloat", "warning", "flight_units >= 100000 and flight_units * 100 >= 45 * size", NEXT)
    c("next.payload.props-bloat", "warning", f"{units(d.json("nullif(next_data, '')", '$.props'))} >= 128000", NEXT)
    c("next.script.blocking", "warning", any_("scripts", f"x.in_head and x.url <> '' and not {has('x.url', '/_next/static/')} and not x.is_async and not x.is_defer"), NEXT)
    c("next.metadata.relative-og-image", "warning", f"router = 'app' and {d.value('og', 'og:image')} <> '' and {relative(d.value('og', 'og:image'))}", NEXT)

    c = pack("content-relevance")
    c("spa.client-rendering-detected", "notice", "shell", RAW)
    c("js.empty-root-fallback", "blocker", "text_units < 200", RENDERED)
    c("js.console-errors-present", "warning", "js_errors > 0", RENDERED, "code-validation")
    c("js.client-injected-meta", "notice", f"shell and (title_l <> '' or {n('canonicals')} > 0 or description_l <> '')", RENDERED, "indexability")
    c("js.hydration-content-gap", "critical", "text_units >= 200 and server_units * 2 < text_units", RENDERED)
    return out


#: Checks that a platform of the site switches on or off: (kinds or names, whether they switch it on).
SELECTORS = {
    "author-box-admin": (("cms",), True),
    "php-fatal-error": (("php",), True),
    "tags-with-style-attributes": (("site-builder",), False),
}
