"""The checks of one page and of a site once more, in SQL of their own: the reference that the predicates are held against.

Nothing here is made from `operators.predicates` or `operators.sitechecks`: neither their derived
names nor their patterns.  The expressions read the columns of a parsed record (r0) as they are
and follow the rules' wording: tokens of a directive by its commas, the last of equal keys of a
viewport, attributes of a tag one by one.
"""

from __future__ import annotations

_WS = r"[\s]+"


def _attr(tag: str, name: str) -> str:
    """The value of an attribute with a value, quoted or bare; null without one."""
    p = rf"""(?i)\s{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)"""
    return f"CASE WHEN regexp_matches({tag}, '{p}') THEN trim(regexp_replace(regexp_extract({tag}, '{p}', 1), '^[\"'']|[\"'']$', '', 'g')) END"


def _u(s: str) -> str:
    return f"(length({s}) + length(regexp_replace({s}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def _some(a: str, cond: str) -> str:
    return f"len(list_filter({a}, lambda x: coalesce({cond}, false))) > 0"


def _count(a: str, cond: str) -> str:
    return f"len(list_filter({a}, lambda x: coalesce({cond}, false)))"


def _most(a: str) -> str:
    """How often the most frequent element of a list stands in it."""
    return f"coalesce(list_max(list_transform({a}, lambda v: len(list_filter({a}, lambda w: w = v)))), 0)"


def _vp(key: str) -> str:
    return f"list_last(list_filter(vp, lambda x: x.k = '{key}')).v"


def _has_vp(key: str) -> str:
    return f"len(list_filter(vp, lambda x: x.k = '{key}')) > 0"


def _closing(tag: str) -> str:
    """How often an end tag counts: once if nothing but scripts, comments and wrappers is between the first and the last."""
    n = rf"len(regexp_extract_all(html, '(?i)</{tag}\s*>'))"
    between = rf"regexp_extract(html, '(?is)(</{tag}\s*>.*)</{tag}\s*>', 1)"
    for p in (r"(?is)<script.*?</script>", r"(?s)<!--.*?-->", "(?i)</?(html|body|div|template)[^>]*>"):
        between = f"regexp_replace({between}, '{p}', '', 'g')"
    return rf"CASE WHEN {n} > 1 AND trim(regexp_replace({between}, '\s+', ' ', 'g')) = '' THEN 1 ELSE {n} END"


def _body_text() -> str:
    """What a reader without scripts sees of the markup."""
    t = "CASE WHEN regexp_matches(html, '(?is)<body[^>]*>.*?</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE html END"
    for tag in ("script", "style", "noscript", "template", "svg"):
        t = f"regexp_replace({t}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    for p in ("(?s)<!--.*?-->", "<[^>]+>", _WS):
        t = f"regexp_replace({t}, '{p}', ' ', 'g')"
    return f"trim({t})"


_STATE = "'HIT', 'MISS', 'STALE', 'BYPASS', 'PRERENDER', 'REVALIDATED'"
_OPENED = """regexp_extract_all(html, '(?i)<template[^>]+id=["'']B:([0-9]+)["'']', 1)"""
_CLOSED = """regexp_extract_all(html, '\\$RC\\s*\\(\\s*["'']B:([0-9]+)["'']', 1)"""
_DATA = """(?is)<script[^>]+id=["'']__NEXT_DATA__["''][^>]*>(.*?)</script>"""
_PUSH = r"self\.__next_f\s*\.\s*push\s*\("
_MOUNT = """(?i)<div[^>]+id=["''](root|app|__next|svelte|__nuxt)["''][^>]*>\\s*</div>|<app-root[^>]*>\\s*</app-root>"""
#: What several rules speak of, in two steps over r0.
HELP = f"""
h0 AS MATERIALIZED (SELECT *, flatten(list_transform(meta_robots, lambda r: list_transform(string_split(r, ','), lambda s: trim(s)))) AS own_words, list_transform(string_split(lower(coalesce(x_robots, '')), ','), lambda s: trim(s)) AS header_words,
  nullif(canonicals[1], '') AS first_canonical, list_transform(list_filter(headings, lambda x: x.level = 1), lambda x: x.text) AS one, list_transform(list_filter(headings, lambda x: x.level = 2), lambda x: x.text) AS two, lower(trim(coalesce(title, ''))) AS t, lower(trim(coalesce(description, ''))) AS d,
  list_transform(images, lambda x: lower(trim(coalesce(x.alt, '')))) AS said, octet_length(encode(html)) AS weight, {_u("coalesce(body_text, '')")} AS text_length, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS pathname, regexp_extract(url, '\\?([^#]*)', 1) AS search,
  list_filter(list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: string_split(p, '=')[1]), lambda k: k <> '') AS keys, list_distinct(regexp_extract_all(html, 'GTM-[A-Z0-9]{{4,10}}')) AS tags_of_gtm,
  list_filter(list_transform(string_split(coalesce(viewports[1], ''), ','), lambda p: {{'k': lower(trim(string_split(p, '=')[1])), 'v': lower(trim(coalesce(string_split(p, '=')[2], '')))}}), lambda x: x.k <> '') AS vp,
  list_concat(regexp_extract_all(html, '\\sid=["'']([^"'']+)["'']', 1), regexp_extract_all(html, '\\sname=["'']([^"'']+)["'']', 1)) AS marks, regexp_extract_all(html, '(?i)\\b(?:src|href)\\s*=\\s*["''](http://[^"'']+)["'']', 1) AS plain_refs, {_body_text()} AS seen,
  regexp_matches(html, '{_DATA}') AS has_data, regexp_extract(html, '{_DATA}', 1) AS data, regexp_matches(html, '{_PUSH}') AS has_push, len(list_filter(list_distinct({_OPENED}), lambda x: NOT list_contains({_CLOSED}, x))) AS open_boundaries,
  list_transform(regexp_extract_all(html, '(?i)<img[^>]*>'), lambda g: {{'src': coalesce({_attr('g', 'src')}, ''), 'srcset': coalesce({_attr('g', 'srcset')}, ''), 'nimg': {_attr('g', 'data-nimg')}, 'w': TRY_CAST({_attr('g', 'width')} AS DOUBLE), 'h': TRY_CAST({_attr('g', 'height')} AS DOUBLE), 'sizes': {_attr('g', 'sizes')}, 'loading': {_attr('g', 'loading')}, 'fp': {_attr('g', 'fetchpriority')}}}) AS pics,
  coalesce(headers['cache-control'], '') AS cc, CASE WHEN upper(trim(headers['x-nextjs-cache'])) IN ({_STATE}) THEN upper(trim(headers['x-nextjs-cache'])) ELSE '' END AS nc, CASE WHEN upper(trim(headers['x-vercel-cache'])) IN ({_STATE}) THEN upper(trim(headers['x-vercel-cache'])) ELSE '' END AS vc FROM r0),
h1 AS MATERIALIZED (SELECT *, list_has_any(own_words, ['noindex', 'none']) OR list_has_any(header_words, ['noindex', 'none']) AS no_index, list_has_any(own_words, ['nofollow', 'none']) OR list_has_any(header_words, ['nofollow', 'none']) AS no_follow, coalesce(first_canonical <> page_key, false) AS elsewhere, lower(trim(coalesce(one[1], ''))) AS heading,
  CASE WHEN has_data AND data <> '' AND has_push THEN 'hybrid' WHEN has_push THEN 'app' WHEN has_data THEN 'pages' ELSE 'unknown' END AS kind_of_router, coalesce(TRY_CAST(regexp_extract(cc, 's-maxage=([0-9]+)', 1) AS BIGINT), 0) AS kept,
  list_filter(pics, lambda x: contains(x.src, '/_next/image?') OR contains(x.srcset, '/_next/image?') OR x.nimg IS NOT NULL) AS framed, {_u('seen')} AS seen_length, try(json_extract_string(data, '$.gssp')) AS gssp, try(json_extract_string(data, '$.gsp')) AS gsp FROM h0),
h AS MATERIALIZED (SELECT *, kind_of_router <> 'unknown' OR contains(lower(coalesce(headers['x-powered-by'], '')), 'next.js') OR contains(html, '/_next/static/') AS framework,
  CASE WHEN gssp = 'true' THEN 'ssr' WHEN gsp = 'true' THEN CASE WHEN kept > 0 THEN 'isr' ELSE 'static' END WHEN open_boundaries > 0 THEN 'streaming' WHEN coalesce(headers['x-nextjs-prerender'], '') = '1' OR vc IN ('PRERENDER', 'HIT', 'STALE', 'REVALIDATED') OR nc IN ('HIT', 'STALE') THEN CASE WHEN kept > 0 OR 'STALE' IN (nc, vc) THEN 'isr' ELSE 'static' END
    WHEN regexp_matches(cc, 'no-store|private') OR 'BYPASS' IN (nc, vc) THEN 'ssr' WHEN kind_of_router <> 'unknown' AND seen_length < 200 THEN 'client' WHEN kept > 0 THEN 'isr' ELSE 'unknown' END AS how,
  coalesce(client_shell, CASE WHEN regexp_matches(html, '{_MOUNT}') THEN seen_length < 200 ELSE regexp_matches(html, '(?i)<script[^>]+src=') AND seen_length < 100 END) AS is_shell, coalesce(server_text_length, seen_length) AS served, coalesce(list_filter(framed, lambda x: coalesce(x.w, 0) * coalesce(x.h, 0) > 40000)[1], list_filter(framed, lambda x: x.nimg = 'fill')[1]) AS candidate FROM h1)"""

PAGE, HTML, EVERY, MAPPED = "is_html AND status = 200 AND fetch_error IS NULL", "is_html", "true", "in_sitemap"
LANGS, FOUND, ASKED = "len(hreflang) > 0", "status = 200", "status = 200 AND NOT subresource"
RAW, RENDERED, FRAMED = "NOT rendered AND is_html AND status = 200", "rendered AND is_html AND status = 200", "framework AND is_html AND status = 200"
_IN = _count("links", "x.internal")
_OUT = _count("links", "x.external")
_LANG = r"^([a-z]{2,3})(-[A-Z][a-z]{3})?(-([A-Z]{2}|[0-9]{3}))?$"
_VALID = f"(x.lang = 'x-default' OR regexp_matches(x.lang, '{_LANG}'))"
_SAYS_NOTHING = "'click here', 'here', 'read more', 'more', 'link', 'this', 'this page', 'learn more', 'continue', 'continue reading', 'go', 'download', 'view', 'see more', 'details'"
_HOST = "regexp_replace(lower(regexp_extract({}, '^[a-zA-Z]+://([^/:?#]*)', 1)), '^www\\.', '')"
_PATHNAME = "regexp_extract({}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_FROM, _TO = _PATHNAME.format("x.url"), _PATHNAME.format("x.target")
_OPENS = "len(regexp_extract_all(html, '(?i)<{}[\\s>]'))"
_ABSOLUTE = "regexp_matches({}, '(?i)^https?://')"
_PLAIN = "CASE WHEN length(regexp_replace({0}, '^https?://[^/]*', '')) > 1 THEN regexp_replace(regexp_replace({0}, '#.*$', ''), '/$', '') ELSE regexp_replace({0}, '#.*$', '') END"
_LINK_TAGS = "regexp_extract_all(html, '(?i)<link[^>]*>')"
_STYLE_LINK = "(regexp_matches(x, '(?i)rel\\s*=\\s*[\"'']?stylesheet') OR regexp_matches(x, '(?i)as\\s*=\\s*[\"'']?(font|style)'))"

#: The page checks: scope and what holds where one fails.
RULES: dict[str, tuple[str, str]] = {}


def _add(scope: str, **rules: str) -> None:
    RULES.update({name.replace("__", ".").replace("_", "-"): (scope, e) for name, e in rules.items()})


_add(
    PAGE, canonical_is_missing="len(canonicals) = 0 AND canonical_header IS NULL", canonical_is_empty="list_contains(list_transform(canonicals, lambda c: trim(c)), '')", canonical_not_equal_url="elsewhere", canonical_relative_url=_some("canonical_raw", f"x <> '' AND NOT {_ABSOLUTE.format('x')}"),
    canonical_outside_head="len(canonicals) > 0 AND NOT canonical_in_head", multiple_canonical_tags="len(canonicals) + (canonical_header IS NOT NULL)::INT > 1", mismatched_canonical_html_header="first_canonical IS NOT NULL AND canonical_header IS NOT NULL AND first_canonical <> canonical_header",
    canonical_tag_html_and_header="first_canonical IS NOT NULL AND coalesce(canonical_header, '') <> ''", canonicalized_url_noindex_nofollow="elsewhere AND no_index", canonical_from_http_to_https="starts_with(url, 'http://') AND starts_with(first_canonical, 'https://')",
    canonical_from_https_to_http="starts_with(url, 'https://') AND starts_with(first_canonical, 'http://')", canonical_points_external_url=f"{_HOST.format('first_canonical')} <> {_HOST.format('url')}", canonical_points_homepage="page_key <> home_key AND first_canonical = home_key",
    meta_noindex_pages="no_index", meta_nofollow_pages="no_follow", noindex_follow_page="no_index AND NOT no_follow", noindex_html_and_header="list_contains(own_words, 'noindex') AND list_contains(header_words, 'noindex')", nofollow_html_and_header="list_contains(own_words, 'nofollow') AND list_contains(header_words, 'nofollow')",
    mismatched_noindex_html_header="list_contains(own_words, 'noindex') <> list_contains(header_words, 'noindex') AND (list_contains(own_words, 'index') OR list_contains(header_words, 'index'))",
    mismatched_nofollow_html_header="list_contains(own_words, 'nofollow') <> list_contains(header_words, 'nofollow') AND (list_contains(own_words, 'follow') OR list_contains(header_words, 'follow'))",
    multiple_noindex_directives=_count("meta_robots", "contains(x, 'noindex')") + " > 1", meta_robots_outside_head="robots_outside_head", page_contains_rel_sponsored=_some("links", "x.sponsored"),
    **{f"{t}_tag_missing": f"{_OPENS.format(t)} = 0" for t in ("html", "head", "body")}, **{f"multiple_{t}_tags": f"{_OPENS.format(t)} > 1" for t in ("html", "head", "body")},
    html_close_missing=f"{_OPENS.format('html')} > 0 AND {_closing('html')} = 0", body_close_missing=f"{_OPENS.format('body')} > 0 AND {_closing('body')} = 0", head_close_missing=f"{_OPENS.format('head')} > 0 AND NOT regexp_matches(html, '(?i)</head\\s*>')",
    multiple_html_close=f"{_closing('html')} > 1", multiple_body_close=f"{_closing('body')} > 1", multiple_head_close="len(regexp_extract_all(html, '(?i)</head\\s*>')) > 1",
    content_after_html="contains(lower(html), '</html>') AND trim(regexp_replace(list_last(string_split(lower(html), '</html>')), '\\s+', ' ', 'g')) <> ''", content_before_doctype="regexp_matches(html, '(?i)<!doctype\\s+[^>]*>') AND trim(regexp_replace(string_split(lower(html), '<!doctype')[1], '\\s+', ' ', 'g')) <> ''",
    no_character_encoding="charset IS NULL AND NOT regexp_matches(content_type, 'charset=')", noscript_head_invalid="noscript_bad", multiple_base_urls="len(base_hrefs) > 1", multiple_mismatched_base_urls="len(list_distinct(base_hrefs)) > 1",
    base_url_malformed_empty=_some("base_hrefs", "trim(x) = '' OR regexp_matches(x, '(?i)^https?:/*$')"), h1_has_other_tags_inside=_some("headings", "x.level = 1 AND x.inner_tags"), h2_has_other_tags_inside=_some("headings", "x.level = 2 AND x.inner_tags"), form_with_get_method=_some("forms", "x.method = 'get'"),
)
_add(
    HTML, disallowed_by_robots_txt="disallowed", non_indexable_pages="status <> 200 OR disallowed OR no_index OR elsewhere", double_slash_in_url="contains(pathname, '//')", more_than_three_parameters="len(keys) > 3", http_urls="starts_with(url, 'http://')", long_urls=f"{_u('url')} > 115", url_uppercase="pathname <> lower(pathname) AND regexp_matches(pathname, '[A-Z]')",
    url_non_ascii="regexp_matches(url_decode(pathname), '[^\\x20-\\x7E]')", url_whitespace="contains(pathname, '%20') OR contains(pathname, '+') OR regexp_matches(pathname, '\\s')", url_repetitive_elements="(SELECT bool_or(a = b) FROM (SELECT s AS a, lead(s) OVER (ORDER BY n) AS b FROM (SELECT unnest(list_filter(string_split(pathname, '/'), lambda y: y <> '')) AS s, generate_subscripts(list_filter(string_split(pathname, '/'), lambda y: y <> ''), 1) AS n)))",
    url_underscores="contains(pathname, '_')", query_question_mark="len(keys) > 0", query_repetitive_parameters="len(list_distinct(keys)) < len(keys)", query_sort_parameters="list_has_any(list_transform(keys, lambda k: lower(k)), ['sort', 'order', 'orderby', 'sort_by', 'dir'])",
    query_search_filter_parameters="list_has_any(list_transform(keys, lambda k: lower(k)), ['q', 's', 'search', 'query', 'filter', 'f', 'color', 'size', 'brand'])", query_paginated_parameters="list_has_any(list_transform(keys, lambda k: lower(k)), ['page', 'p', 'pg', 'offset', 'start'])",
)
_add(ASKED, content_type_not_html="NOT is_html", non_html_urls="NOT is_html", pdf_files="contains(content_type, 'pdf') OR regexp_matches(url, '(?i)\\.pdf($|\\?)')")
_add(
    PAGE, title_is_missing="titles = 0", title_is_empty="titles > 0 AND t = ''", title_too_long=f"{_u('title')} > 60", title_too_short=f"{_u('trim(title)')} > 0 AND {_u('trim(title)')} < 30", multiple_title_tags="titles > 1", title_starts_lowercase="title[1] BETWEEN 'a' AND 'z'",
    title_outdated="CAST(nullif(regexp_extract(title, '\\b(19|20)[0-9]{2}\\b'), '') AS INTEGER) < year(as_of)", description_is_missing="descriptions = 0", description_is_empty="descriptions > 0 AND d = ''", description_too_long=f"{_u('description')} > 160", description_too_short=f"{_u('trim(description)')} > 0 AND {_u('trim(description)')} < 70",
    multiple_description_tags="descriptions > 1", description_equals_title="coalesce(title, '') <> '' AND coalesce(description, '') <> '' AND t = d", h1_is_missing="len(one) = 0", h1_is_empty="len(one) > 0 AND " + _count("one", "trim(x) <> ''") + " = 0", h1_too_long=_some("one", f"{_u('x')} > 70"),
    h1_too_short=_some("one", f"trim(x) <> '' AND {_u('trim(x)')} < 10"), multiple_h1="len(one) > 1", h1_starts_lowercase=_some("one", "regexp_matches(x, '^[a-z]')"), h2_is_missing="word_count > 300 AND len(two) = 0", h2_starts_lowercase=_some("two", "regexp_matches(x, '^[a-z]')"), low_word_count="word_count < 300",
    text_to_code_ratio_low="CASE WHEN weight > 0 THEN text_length / weight ELSE 0 END < 0.1", page_code_under_500="weight < 500", paragraphs_are_missing="word_count > 100 AND paragraphs = 0", no_list_markdown="word_count > 300 AND lists = 0", no_strong_importance_elements="word_count > 300 AND strongs = 0",
    lorem_ipsum="regexp_matches(body_text, '(?i)\\blorem\\s+ipsum\\b') OR regexp_matches(body_text, '(?i)\\bdolor\\s+sit\\s+amet\\b')", author_box_admin="regexp_matches(body_text, '(?i)(by|author)[:\\s]+admin\\b')",
    page_not_updated_1_year="date_diff('day', CAST(try_strptime(last_modified, '%a, %d %b %Y %H:%M:%S GMT') AS DATE), as_of) > 365", html_lang_missing="coalesce(html_lang, '') = ''", missing_alt_text=_some("images", "NOT x.has_alt AND x.src <> '' AND x.src NOT LIKE 'data:%'"),
    alt_text_one_word=_some("images", "trim(x.alt) <> '' AND NOT contains(trim(x.alt), ' ')"), alt_text_too_long=_some("images", f"{_u('x.alt')} > 100"), images_present="word_count > 300 AND len(images) = 0", https_page_links_http_image="starts_with(url, 'https://') AND " + _some("images", "x.src LIKE 'http://%'"),
)
_add(
    PAGE, page_has_no_outgoing_links=_count("links", "coalesce(x.href, '') <> ''") + " = 0", only_one_followed_internal_link="len(list_distinct(list_transform(list_filter(links, lambda x: x.internal AND NOT x.nofollow AND NOT starts_with(x.raw_href, '#')), lambda x: x.key))) = 1",
    more_than_100_internal_links=f"{_IN} > 100", more_than_100_external_links=f"{_OUT} > 100", more_than_10_external_links=f"{_OUT} > 10", more_than_100_identical_internal_links=_most("list_transform(list_filter(links, lambda x: x.internal AND x.href IS NOT NULL), lambda x: x.key)") + " > 100",
    more_than_2_links_same_anchor=_most("list_transform(list_filter(links, lambda x: x.internal AND x.href IS NOT NULL AND x.anchor <> ''), lambda x: x.key || '|' || lower(x.anchor))") + " > 2", more_than_100_links_before_h1=_count("links", "x.before_h1") + " > 100",
    nofollow_outgoing_internal_links=_some("links", "x.internal AND x.nofollow"), footer_links_nofollow=_some("links", "x.in_footer AND x.nofollow AND x.internal"), internal_link_no_anchor_text=_some("links", "x.internal AND x.anchor = '' AND (NOT x.wraps_image OR coalesce(x.image_alt, '') = '')"),
    outgoing_one_word_anchor=_some("links", "x.internal AND x.anchor <> '' AND instr(x.anchor, ' ') = 0"), outgoing_non_descriptive_anchor=_some("links", f"NOT x.nofollow AND trim(rtrim(lower(trim(x.anchor)), '.!:>»→')) IN ({_SAYS_NOTHING})"), anchored_image_no_alt=_some("links", "x.wraps_image AND x.anchor = '' AND coalesce(x.image_alt, '') = ''"),
    broken_jump_link=_some("links", "x.raw_href[1] = '#' AND length(x.raw_href) > 1 AND NOT list_contains(marks, url_decode(x.raw_href[2:]))"), empty_href_attribute=_some("links", "x.raw_href = ''"), empty_links_hash=_some("links", "x.raw_href = '#'"),
    malformed_href_data=_some("links", "x.raw_href <> '' AND x.href IS NULL AND x.raw_href NOT LIKE '#%' AND NOT regexp_matches(x.raw_href, '(?i)^(javascript|mailto|tel|sms):')"), link_whitespace_href=_some("links", "regexp_matches(trim(x.raw_href), '\\s')"), link_non_http_protocol=_some("links", "lower(string_split(x.raw_href, ':')[1]) IN ('ftp', 'mailto', 'tel', 'sms', 'file', 'news') AND contains(x.raw_href, ':')"),
    link_localhost=_some("links", "contains(lower(x.raw_href), 'localhost') OR contains(x.raw_href, '127.0.0.1') OR contains(x.raw_href, '0.0.0.0')"), link_local_unc_path=_some("links", "lower(x.raw_href) LIKE 'file://%' OR starts_with(x.raw_href, chr(92) || chr(92)) OR regexp_matches(x.raw_href, '(?i)^[a-z]:\\\\')"),
    link_url_in_onclick=_some("links", "regexp_matches(x.onclick, '(?i)https?:|location|window\\.open')"), http_page_links_to_https="starts_with(url, 'http://') AND " + _some("links", "x.internal AND x.href LIKE 'https://%'"),
    page_identical_headings=_most("list_transform(list_filter(headings, lambda x: x.text <> ''), lambda x: lower(x.text))") + " > 1", page_identical_alt_tags=_most("list_filter(said, lambda a: a <> '')") + " > 1", h1_equals_title="t <> '' AND t = heading", h1_equals_description="d <> '' AND d = heading",
    h1_equals_alt="heading <> '' AND list_contains(said, heading)", title_equals_alt="t <> '' AND list_contains(said, t)", https_page_internal_links_http="starts_with(url, 'https://') AND " + _some("links", "x.internal AND x.href LIKE 'http://%'"), https_links_http_css="starts_with(url, 'https://') AND " + _some("stylesheets", "x.url LIKE 'http://%'"),
    https_links_http_javascript="starts_with(url, 'https://') AND " + _some("scripts", "x.url LIKE 'http://%'"), https_form_posts_to_http="starts_with(url, 'https://') AND " + _some("forms", "x.posts_to_http"), http_url_password_field="starts_with(url, 'http://') AND " + _some("forms", "x.has_password"),
    http_link_w3_org=_some("plain_refs", "contains(x, 'www.w3.org')"), http_link_schema_org=_some("plain_refs", "contains(x, 'schema.org')"), http_link_ogp_me=_some("plain_refs", "contains(x, 'ogp.me')"), requires_captcha="regexp_matches(lower(html), 'recaptcha|hcaptcha|cf-turnstile|are you a robot')",
)
RULES["4xx-client-errors"] = (EVERY, "status BETWEEN 400 AND 499")
RULES["5xx-server-errors"] = (EVERY, "status >= 500")
_add(EVERY, timed_out="timed_out")
_add(FOUND, invalid_content_type="content_type = '' OR (regexp_matches(url, '(?i)\\.css($|\\?)') AND NOT contains(content_type, 'css')) OR (regexp_matches(url, '(?i)\\.js($|\\?)') AND NOT (contains(content_type, 'javascript') OR contains(content_type, 'ecmascript')))")
_add(
    PAGE, empty_src_attributes="empty_src > 0", no_gtm_code="len(tags_of_gtm) = 0", multiple_gtm_codes="len(tags_of_gtm) > 1", page_size_over_1_5mb="weight > 1.5 * 1024 * 1024 AND weight <= 2 * 1024 * 1024", page_size_over_2mb="weight > 2 * 1024 * 1024", slow_load_speed="ttfb_ms > 800",
    defer_offscreen_images=_some("images[4:]", "x.loading IS DISTINCT FROM 'lazy'"), add_dimensions_to_images=_some("images", "(x.width IS NULL OR x.height IS NULL) AND x.src NOT LIKE 'data:%'"), serve_images_next_gen=_some("images", "regexp_matches(x.src, '(?i)\\.(jpe?g|png)($|\\?)') AND NOT x.next"),
    use_video_for_animated=_some("images", "regexp_matches(x.src, '(?i)\\.gif($|\\?)')"), avoid_excessive_dom_size="dom_nodes > 1500", avoid_excessive_dom_depth="dom_depth > 32", avoid_excessive_dom_width="dom_width > 60",
    excessive_comments=f"list_sum(list_transform(list_filter(regexp_extract_all(html, '(?s)<!--.*?-->'), lambda x: NOT regexp_matches(x, '^<!--\\s*\\[if|^<!--\\s*\\$|^<!--/?\\$')), lambda x: {_u('x')})) > 1000", viewport_missing="len(viewports) = 0", viewport_multiple="len(viewports) > 1",
    viewport_no_width=f"len(viewports) > 0 AND NOT {_has_vp('width')}", viewport_specific_width=f"{_vp('width')} NOT IN ('', 'device-width')", viewport_missing_initial_scale=f"len(viewports) > 0 AND NOT {_has_vp('initial-scale')}", viewport_initial_scale_incorrect=f"{_vp('initial-scale')} NOT IN ('', '1', '1.0')",
    viewport_maximum_scale=_has_vp("maximum-scale"), viewport_minimum_scale=_has_vp("minimum-scale"), viewport_prevents_scaling=f"{_vp('user-scalable')} IN ('no', '0')", image_map_tags="maps > 0", unsupported_browser_plugins="plugins > 0", meta_refresh_redirect="regexp_matches(html, '(?i)<meta[^>]+http-equiv=[\"'']?refresh[\"'']?[^>]*>')",
)
for _code in (301, 302):
    RULES[f"{_code}-redirects"] = (EVERY, f"status = {_code} OR list_contains(list_transform(redirect_chain, lambda x: x.status), {_code})")
RULES["3xx-other-redirects"] = (EVERY, _some("list_prepend(CAST(status AS BIGINT), list_transform(redirect_chain, lambda x: CAST(x.status AS BIGINT)))", "x >= 300 AND x < 400 AND x <> 301 AND x <> 302"))
_add(
    EVERY, redirect_chains="len(redirect_chain) > 1", redirect_loop=_most("list_transform(redirect_chain, lambda x: x.key)") + " > 1", redirect_to_itself=_some("redirect_chain", "x.key = x.to_key"), broken_redirect="len(redirect_chain) > 0 AND status >= 400",
    redirect_trailing_slash=_some("redirect_chain", f"{_FROM} <> {_TO} AND rtrim({_FROM}, '/') = rtrim({_TO}, '/')"), redirect_case_normalization=_some("redirect_chain", f"{_FROM} <> {_TO} AND lower({_FROM}) = lower({_TO})"), https_to_http_redirect=_some("redirect_chain", "x.url LIKE 'https://%' AND x.target LIKE 'http:%'"),
)
_add(
    PAGE, open_graph_tags_missing="cardinality(og) = 0", open_graph_tags_incomplete="cardinality(og) > 0 AND len(list_filter(['og:title', 'og:description', 'og:image', 'og:url'], lambda k: coalesce(og[k], '') = '')) > 0",
    open_graph_url_not_canonical=f"coalesce(og['og:url'], '') <> '' AND first_canonical IS NOT NULL AND {_PLAIN.format('''og['og:url']''')} <> {_PLAIN.format('first_canonical')}", og_image_relative=f"og['og:image'] <> '' AND NOT {_ABSOLUTE.format('''og['og:image']''')}", twitter_card_missing="cardinality(twitter) = 0",
    twitter_card_incomplete="cardinality(twitter) > 0 AND (coalesce(twitter['twitter:card'], '') = '' OR coalesce(twitter['twitter:title'], '') = '')", twitter_description_too_long="{} > 200".format(_u("twitter['twitter:description']")),
    no_doctype="NOT regexp_matches(html, '(?i)<!doctype\\s+[^>]*>')", html_tag_empty="false", php_fatal_error="regexp_matches(html, '(?i)(Fatal error|Parse error|Warning):\\s*.{0,80}\\bin\\b\\s+/?\\w[^\\s<]*\\.php\\s+on line [0-9]+')",
    gtm_in_body="len(tags_of_gtm) > 0 AND regexp_matches(CASE WHEN regexp_matches(html, '(?i)<body') THEN regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1) ELSE html END, 'GTM-[A-Z0-9]{4,10}|googletagmanager\\.com/gtm\\.js')",
    headings_hierarchy_broken="(SELECT bool_or(b > a + 1) FROM (SELECT l AS a, lead(l) OVER (ORDER BY n) AS b FROM (SELECT unnest(list_transform(headings, lambda x: x.level)) AS l, generate_subscripts(headings, 1) AS n)))", identical_html_ids="len(duplicate_ids) > 0", different_structured_data_formats="len(formats) > 1",
    table_no_caption=_some("tables", "NOT x.caption"), table_no_th=_some("tables", "NOT x.th"), tags_with_style_attributes="style_attrs > 0", html_lang_invalid=f"coalesce(html_lang, '') <> '' AND html_lang <> 'x-default' AND NOT regexp_matches(html_lang, '{_LANG}')",
)
RULES |= {f"sitemap-{n}xx": (MAPPED, f"status >= {n}00" + (f" AND status < {n + 1}00" if n < 5 else "")) for n in (3, 4, 5)}
_add(
    MAPPED, sitemap_noindex=_some("meta_robots", "contains(x, 'noindex')") + " OR contains(x_robots, 'noindex')", sitemap_disallowed="disallowed", sitemap_canonicalized="elsewhere", sitemap_timed_out="timed_out", sitemap_multiple="sitemaps > 1",
)
_add(
    LANGS, hreflang_annotation_invalid=_some("hreflang", f"NOT {_VALID}"), hreflang_relative_urls=_some("hreflang", f"NOT {_ABSOLUTE.format('x.raw_href')}"), self_reference_hreflang_missing=_count("hreflang", "x.key = page_key") + " = 0", hreflang_defined_html_lang_missing="coalesce(html_lang, '') = ''",
    x_default_missing=_count("hreflang", "x.lang = 'x-default'") + " = 0", hreflang_also_x_default="list_contains(list_transform(list_filter(hreflang, lambda x: x.lang <> 'x-default'), lambda x: x.key), list_filter(hreflang, lambda x: x.lang = 'x-default')[1].key)",
    multiple_pages_same_language="(SELECT max(n) > 1 FROM (SELECT count(DISTINCT y.key) AS n FROM (SELECT unnest(hreflang) AS y) GROUP BY y.lang))", page_referenced_multiple_languages="(SELECT max(n) > 1 FROM (SELECT count(DISTINCT y.lang) AS n FROM (SELECT unnest(hreflang) AS y) WHERE y.lang <> 'x-default' GROUP BY y.key))",
)
RULES["hreflang-html-lang-mismatch"] = (LANGS + " AND coalesce(html_lang, '') <> ''", "list_filter(hreflang, lambda x: x.key = page_key)[1].lang <> 'x-default' AND string_split(lower(list_filter(hreflang, lambda x: x.key = page_key)[1].lang), '-')[1] <> string_split(lower(html_lang), '-')[1]")
_add(
    FRAMED, next__render__unresolved_suspense="open_boundaries > 0", next__render__client_only_content="seen_length < 200", next__render__unexpectedly_dynamic="how = 'ssr' AND search = ''", next__image__raw_img_tag=_some("images", "NOT x.next AND x.src <> '' AND x.src NOT LIKE 'data:%'"),
    next__image__lcp_not_prioritised="candidate IS NOT NULL AND " + _count("framed", "x.fp = 'high'") + f" = 0 AND {_count(_LINK_TAGS, '''regexp_matches(x, '(?i)rel\\s*=\\s*[\"'']?preload') AND regexp_matches(x, '(?i)as\\s*=\\s*[\"'']?image')''')} = 0 AND coalesce(candidate.loading, 'lazy') = 'lazy'",
    next__image__fill_without_sizes=_some("framed", "x.nimg = 'fill' AND coalesce(x.sizes, '') = ''"), next__image__unoptimized=_some("framed", "x.nimg IS NOT NULL AND NOT contains(x.src, '/_next/image?') AND NOT contains(x.srcset, '/_next/image?')"),
    next__font__external_blocking=_some(_LINK_TAGS, f"{_STYLE_LINK} AND regexp_matches({_attr('x', 'href')}, '(?i)fonts\\.googleapis\\.com|fonts\\.gstatic\\.com|use\\.typekit\\.net|fast\\.fonts\\.net|@fontsource')"),
    next__payload__rsc_bloat="(SELECT sum(length(f)) >= 100000 AND sum(length(f)) >= 0.45 * w FROM (SELECT weight AS w, unnest(regexp_extract_all(html, 'self\\.__next_f\\s*\\.\\s*push\\s*\\(\\s*\\[\\s*[0-9]+\\s*,\\s*(\"(?:[^\"\\\\]|\\\\.)*\")', 1)) AS f) GROUP BY w)", next__payload__props_bloat="length(CAST(try(json_extract(data, '$.props')) AS VARCHAR)) >= 128000",
    next__script__blocking=_some("scripts", "x.in_head AND x.url <> '' AND NOT contains(x.url, '/_next/static/') AND NOT x.is_async AND NOT x.is_defer"), next__metadata__relative_og_image=f"kind_of_router = 'app' AND og['og:image'] <> '' AND NOT {_ABSOLUTE.format('''og['og:image']''')}",
)
_add(RAW, spa__client_rendering_detected="is_shell")
_add(
    RENDERED, js__empty_root_fallback="text_length < 200", js__console_errors_present="js_errors > 0", js__client_injected_meta="is_shell AND (coalesce(title, '') <> '' OR first_canonical IS NOT NULL OR coalesce(description, '') <> '')", js__hydration_content_gap="text_length >= 200 AND served < text_length * 0.5",
)

#: The checks of a site, over its facts.
SITE_RULES = {
    "error-page-404-status": "not_found_status IS NOT NULL AND not_found_status <> 404", "homepage-open-for-scanning": "home_allowed = false", "homepage-open-for-indexing": "home_indexable = false", "site-has-favicon": "favicon = false", "homepage-title-home": "list_contains(['home', 'homepage'], lower(trim(home_title)))",
    "http-to-https-redirect-works": "https_redirect = false", "redirect-to-https-header": "https_redirect = false", "preferred-domain-redirect": "host_redirect = false", "ssl-certificate-valid": "ssl_valid = false", "ssl-expiry-date": "ssl_days IS NOT NULL AND ssl_days <= 29",
    "xss-protection": "length(coalesce(csp, '') || coalesce(x_xss, '')) = 0", "clickjacking-protection": "coalesce(length(x_frame), 0) = 0 AND strpos(coalesce(csp, ''), 'frame-ancestors') = 0", "mime-sniffing-protection": "upper(coalesce(x_content_type, '-')) <> 'NOSNIFF'",
    "server-hides-version": "regexp_matches(coalesce(server, '') || ' ' || coalesce(powered_by, ''), '\\d+\\.\\d+')", "no-cookies-sent": "length(set_cookie) > 0", "site-is-safe": "off_site_redirects >= 4", "performance.cwv.lcp": "lcp IN ('POOR', 'NEEDS_IMPROVEMENT')", "performance.cwv.cls": "cls IN ('POOR', 'NEEDS_IMPROVEMENT')",
    "performance.cwv.inp-tbt": "CASE WHEN inp IS NOT NULL THEN inp ELSE tbt END IN ('POOR', 'NEEDS_IMPROVEMENT')", "performance.lighthouse.score": "CASE WHEN mobile_score IS NOT NULL THEN mobile_score ELSE first_score END <= 89", "pagespeed-data-available": "pagespeed IS DISTINCT FROM true", "homepage-mobile-pagespeed": "mobile_score <= 89", "homepage-desktop-pagespeed": "desktop_score <= 89",
    "homepage-social-links": "home_known AND home_social = false", "robots-txt-not-found": "robots_found = false", "robots-no-sitemap-link": "robots_found AND robots_sitemaps = 0", "sitemap-format-errors": "sitemap_errors >= 1", "sitemap-too-large": "greatest(sitemap_entries / 50000.0, sitemap_bytes / (50.0 * 1024 * 1024)) > 1",
    "connect-gsc-ga": "has_search IS DISTINCT FROM true", "gsc-fetch-failed": "length(search_error) >= 0", "ga4-not-connected": "has_analytics IS DISTINCT FROM true", "ga4-fetch-failed": "length(analytics_error) >= 0", "track-keywords": "true", "traffic.uncrawlable-urls-with-traffic": "missing_paths >= 1",
    "next.build.drift-during-crawl": "next_pages >= 1 AND build_ids >= 2", "next.router.mixed": "next_pages >= 1 AND (least(app_pages, router_pages) >= 1 OR hybrid_pages >= 1)", "next.render.strategy-summary": "next_pages > 2 AND ssr_pages = next_pages",
}


def findings(labels: dict[str, tuple[str, str]]) -> str:
    """page_id, check_id, category, severity of every failed page check over r0.  labels: category and severity by check."""
    return " UNION ALL ".join(f"SELECT page_id, '{i}' AS check_id, '{labels[i][0]}' AS category, '{labels[i][1]}' AS severity FROM h WHERE ({scope}) AND coalesce({e}, false)" for i, (scope, e) in RULES.items())
