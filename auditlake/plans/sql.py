"""SQL over the stand-in records: the references of the checks across pages and of the reports made of findings."""

from __future__ import annotations

from auditlake.functions.dialect import Duck
from auditlake.operators import predicates, sitechecks
from auditlake.operators.checks import CATEGORIES, SEVERITY
from auditlake.plans import rules, standins

#: Category and severity of the page checks, in their order.
LABELS = {i: (c, s) for i, c, s, _, _ in predicates.page_checks(Duck())}

_REF = "EXISTS (SELECT 1 FROM ref x JOIN tg t ON t.key = x.key WHERE x.page_id = p.page_id AND x.kind IN ({}) AND ({}))"
_IN = "(SELECT {} FROM lk l WHERE l.key = p.key)"
_TONGUE = "EXISTS (SELECT 1 FROM lang g WHERE g.key = p.key AND g.src <> p.key)"
_BARE = "trim(regexp_replace(lower(trim(l.anchor)), '[.!:>»→]+$', '')) IN (" + ", ".join(f"'{a}'" for a in predicates.EMPTY_ANCHORS) + ")"
_ORPHAN = "p.key IN (SELECT key FROM orphan)"
_SAME = "p.live AND p.{0} <> '' AND (SELECT count(*) FROM pg o WHERE o.live AND o.{0} = p.{0}) > 1"


def _ref(kinds: str, condition: str) -> str:
    return _REF.format(", ".join(f"'{k}'" for k in kinds.split()), condition)


#: Of a page p: what holds where the check fails.
CROSS = {
    "canonical-to-non-200": _ref("canon", "t.status <> 200"),
    "canonical-points-redirect": _ref("canon", "t.status BETWEEN 300 AND 399"),
    "canonical-points-noindex": _ref("canon", "t.noindex"),
    "canonical-points-disallowed": _ref("canon", "t.disallowed"),
    "canonical-points-another-canonicalized-url": "p.moved AND " + _ref("canon", "t.canon <> t.key"),
    "canonical-loop": "p.moved AND " + _ref("canon", "t.canon = p.key"),
    "disallowed-css-files": _ref("css", "t.disallowed"),
    "disallowed-js-files": _ref("js", "t.disallowed"),
    "disallowed-images": _ref("img", "t.disallowed"),
    "incoming-non-descriptive-anchor": f"EXISTS (SELECT 1 FROM lk l WHERE l.key = p.key AND NOT l.nofollow AND {_BARE})",
    "incoming-links-same-anchor": "(SELECT count(*) >= 3 AND count(DISTINCT lower(l.anchor)) = 1 FROM lk l WHERE l.key = p.key AND l.anchor <> '')",
    "internal-links-to-4xx": _ref("link", "t.status BETWEEN 400 AND 499"),
    "internal-links-to-3xx": _ref("link", "t.status BETWEEN 300 AND 399"),
    "broken-links-to-external": _ref("out", "t.status >= 400"),
    "less-than-10-internal-backlinks": _IN.format("count(DISTINCT l.src) < 10"),
    "only-nofollow-incoming-links": _IN.format("count(*) > 0 AND bool_and(l.nofollow)"),
    "follow-and-nofollow-incoming": _IN.format("count(*) FILTER (WHERE l.nofollow) > 0 AND count(*) FILTER (WHERE NOT l.nofollow) > 0"),
    "orphan-sitemap-only": f"{_ORPHAN} AND p.in_sitemap",
    "orphan-via-canonical": f"{_ORPHAN} AND NOT p.in_sitemap AND EXISTS (SELECT 1 FROM pg o WHERE o.canon = p.key AND o.key <> p.key)",
    "orphan-via-redirect": f"{_ORPHAN} AND NOT p.in_sitemap AND p.key IN (SELECT h.to_key FROM (SELECT unnest(redirect_chain) AS h FROM r))",
    "orphan-isolated-cluster": _IN.format("count(*) > 0 AND bool_and(l.src IN (SELECT key FROM orphan))"),
    "title-duplicates": _SAME.format("title_l"),
    "h1-duplicates": _SAME.format("h1_l"),
    "description-duplicates": _SAME.format("description_l"),
    "duplicate-pages-without-canonical": _SAME.format("content") + " AND NOT p.moved",
    "technically-duplicate-urls": "EXISTS (SELECT 1 FROM pg o WHERE regexp_replace(lower(o.key), '/$', '') = regexp_replace(lower(p.key), '/$', '') AND o.key <> p.key)",
    "url-resolves-http-and-https": "EXISTS (SELECT 1 FROM tg t WHERE starts_with(p.key, 'https:') AND t.key = 'http:' || substring(p.key, 7) AND t.status = 200)",
    "page-broken-images": _ref("img", "t.status >= 400"),
    "page-broken-css": _ref("css", "t.status >= 400"),
    "page-broken-javascript": _ref("js", "t.status >= 400"),
    "image-size-over-100kb": _ref("img", "t.bytes > 102400"),
    "css-file-over-15kb": _ref("css", "t.bytes > 15360"),
    "js-file-over-25kb": _ref("js", "t.bytes > 25600"),
    "efficient-cache-policy": _ref("css js", "t.age < 86400"),
    "asset-linked-via-redirect": _ref("img css js", "t.status BETWEEN 300 AND 399"),
    "missing-reciprocal-hreflang": "EXISTS (SELECT 1 FROM lang g JOIN tg t ON t.key = g.key WHERE g.page_id = p.page_id AND g.key <> p.key AND NOT EXISTS (SELECT 1 FROM lang b WHERE b.src = g.key AND b.key = p.key))",
    "hreflang-to-broken-url": _ref("lang", "t.status >= 400"),
    "hreflang-to-redirect": _ref("lang", "t.status BETWEEN 300 AND 399"),
    "hreflang-to-noindex": _ref("lang", "t.soft_noindex"),
    "hreflang-to-disallowed": _ref("lang", "t.disallowed"),
    "hreflang-non-canonical": _ref("lang", "t.canon <> t.key"),
    "hreflang-group-not-crawled": "EXISTS (SELECT 1 FROM lang g WHERE g.page_id = p.page_id AND g.key NOT IN (SELECT key FROM tg))",
    "invalid-incoming-hreflang": f"EXISTS (SELECT 1 FROM lang g WHERE g.key = p.key AND g.src <> p.key AND g.lang <> 'x-default' AND NOT regexp_matches(g.lang, '{predicates.LANG_TAG}'))",
    "conflicting-incoming-hreflang": "(SELECT count(DISTINCT g.lang) > 1 FROM lang g WHERE g.key = p.key AND g.src <> p.key AND g.lang <> 'x-default')",
    "noindex-has-incoming-hreflang": f"p.soft_noindex AND {_TONGUE}",
    "canonicalized-has-incoming-hreflang": f"p.moved AND {_TONGUE}",
    "disallowed-has-incoming-hreflang": f"p.disallowed AND {_TONGUE}",
    "missing-hreflang-annotations": "EXISTS (SELECT 1 FROM lang) AND p.page_id NOT IN (SELECT page_id FROM lang)",
}
_TEXT = r"trim(regexp_replace(lower(body_text), '\s+', ' ', 'g'))"
_TABLES = r"""
pg AS MATERIALIZED (SELECT page_id, crawl_order, page_key AS key, canon, coalesce(moved, false) AS moved, noindex, soft_noindex, disallowed, status, in_sitemap, has_langs, coalesce(is_html AND status = 200 AND fetch_error IS NULL, false) AS live, page_key = home_key AS home, title_l, h1_l, description_l,
  CASE WHEN text_units > 200 THEN {content} ELSE '' END AS content, size AS bytes, coalesce(TRY_CAST(regexp_extract(coalesce(headers['cache-control'], ''), 'max-age=([0-9]+)', 1) AS BIGINT), 0) AS age FROM r),
tg AS MATERIALIZED (SELECT * FROM pg QUALIFY row_number() OVER (PARTITION BY key ORDER BY crawl_order DESC, page_id DESC) = 1),
ul AS (SELECT page_id, page_key AS src, unnest(links) AS l FROM r),
ref AS MATERIALIZED (SELECT page_id, 'canon' AS kind, canon AS key FROM r UNION SELECT page_id, 'link', l.key FROM ul WHERE l.internal AND l.href IS NOT NULL UNION SELECT page_id, 'out', l.key FROM ul WHERE l.external AND l.href IS NOT NULL
  UNION SELECT page_id, 'img', i.key FROM (SELECT page_id, unnest(images) AS i FROM r) WHERE i.src <> '' UNION SELECT page_id, 'css', c.key FROM (SELECT page_id, unnest(stylesheets) AS c FROM r) UNION SELECT page_id, 'js', c.key FROM (SELECT page_id, unnest(scripts) AS c FROM r) WHERE c.url <> ''
  UNION SELECT page_id, 'lang', g.key FROM (SELECT page_id, unnest(hreflang) AS g FROM r)),
lang AS MATERIALIZED (SELECT page_id, src, g.key, g.lang FROM (SELECT page_id, page_key AS src, unnest(hreflang) AS g FROM r) WHERE g.key IS NOT NULL),
lk AS MATERIALIZED (SELECT u.src, l.key, l.anchor, l.nofollow FROM ul u JOIN pg p ON p.page_id = u.page_id WHERE p.live AND l.internal AND l.href IS NOT NULL AND NOT starts_with(l.raw_href, '#')),
orphan AS MATERIALIZED (SELECT DISTINCT key FROM pg WHERE live AND NOT home AND key NOT IN (SELECT key FROM lk))
"""
LANG_SCOPE = ("missing-reciprocal-hreflang", "hreflang-to-broken-url", "hreflang-to-redirect", "hreflang-to-noindex", "hreflang-to-disallowed", "hreflang-non-canonical", "hreflang-group-not-crawled")


def tables(whole: bool = False) -> str:
    """The tables that CROSS reads; whole: texts are compared to their end, not by their first 2,000 characters."""
    return _TABLES.format(content=_TEXT if whole else f"substring({_TEXT}, 1, 2000)")


def cross_page(severities: dict[str, str]) -> str:
    found = " UNION ALL ".join(f"SELECT page_id, '{i}' AS check_id, '{severities[i]}' AS severity FROM pg p WHERE {'p.has_langs' if i in LANG_SCOPE else 'true' if i == 'missing-hreflang-annotations' else 'p.live'} AND coalesce({q}, false)" for i, q in CROSS.items())
    return f"WITH {standins.sql()}, {tables()} {found}"


def _found() -> str:
    return f"WITH {standins.base_sql()}, {rules.HELP}, f AS MATERIALIZED ({rules.findings(LABELS)})"


def _scopes() -> str:
    scopes = sorted({scope for scope, _ in rules.RULES.values()})
    rows = ", ".join(f"({n}, '{i}', '{c}', '{s}', {scopes.index(rules.RULES[i][0])})" for n, (i, (c, s)) in enumerate(LABELS.items()))
    counts = " UNION ALL ".join(f"SELECT {n} AS scope, count(*) FILTER (WHERE {scope}) AS applicable FROM h" for n, scope in enumerate(scopes))
    return f"c AS (SELECT * FROM (VALUES {rows}) v(place, check_id, category, severity, scope)), n AS ({counts}), a AS (SELECT check_id, count(*) AS affected, list(page_id ORDER BY page_id)[1:500] AS pages FROM f GROUP BY check_id)," + """
o AS MATERIALIZED (SELECT c.place, c.check_id, c.category, c.severity, CASE WHEN n.applicable = 0 THEN 'skipped' WHEN a.affected > 0 THEN 'failed' ELSE 'passed' END AS verdict, CASE WHEN n.applicable = 0 THEN 'no page in scope' END AS reason, coalesce(a.affected, 0) AS affected, n.applicable, coalesce(a.pages, []) AS pages
  FROM c JOIN n ON n.scope = c.scope LEFT JOIN a ON a.check_id = c.check_id)"""


def record_findings() -> str:
    return _found() + " SELECT page_id, check_id, category, severity FROM f"


def outcomes() -> str:
    return f"{_found()}, {_scopes()} SELECT place, check_id, category, severity, verdict, reason, affected, applicable, array_to_string(pages, ',') AS pages FROM o"


_WEIGHT = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY.items()) + " END"


def scores() -> str:
    return f"""{_found()}, s AS (SELECT page_id, CAST(sum({_WEIGHT.format('severity')}) AS DOUBLE) AS penalty, count(*) AS issues FROM f GROUP BY page_id)
SELECT h.page_id, coalesce(penalty, 0) AS penalty, coalesce(issues, 0) AS issues, round(100 * exp(-coalesce(penalty, 0) / 100), 6) AS score FROM h LEFT JOIN s ON s.page_id = h.page_id"""


def summary() -> str:
    order = "CASE category " + " ".join(f"WHEN '{c}' THEN {n}" for n, c in enumerate(CATEGORIES)) + " END"
    counts = ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in ("failed", "passed", "skipped"))
    return f"""{_found()}, {_scopes()}, t AS (SELECT category, count(DISTINCT page_id) AS touched FROM f GROUP BY category)
SELECT CAST({order.replace('category', 'g.category')} AS INTEGER) AS place, g.category, failed, passed, skipped, coalesce(touched, 0) AS touched, round(coalesce(touched, 0) / (SELECT count(*) FROM h), 6) AS share FROM (SELECT category, {counts} FROM o GROUP BY category) g LEFT JOIN t ON t.category = g.category"""


def pillars(of: dict[str, tuple[str, ...]]) -> str:
    names = ", ".join(f"('{p}', '{c}')" for p, cs in of.items() for c in cs)
    weight = _WEIGHT.format("severity")
    return f"""{_found()}, {_scopes()}, p AS (SELECT * FROM (VALUES {names}) v(pillar, category)),
q AS (SELECT pillar, verdict, {weight} + 1 AS w FROM o JOIN p ON p.category = o.category WHERE verdict <> 'skipped')
SELECT x.pillar, CAST(coalesce(floor(100 * (1 - sum(w) FILTER (WHERE verdict = 'failed') / sum(w)) + 0.5), 100) AS BIGINT) AS score, count(*) FILTER (WHERE verdict = 'failed') AS failed, count(*) FILTER (WHERE verdict = 'passed') AS passed
FROM (SELECT DISTINCT pillar FROM p) x LEFT JOIN q ON q.pillar = x.pillar GROUP BY x.pillar"""


def site_findings() -> str:
    facts = ", ".join(f"{e} AS {c}" for c, e in standins.SITE.items())
    found = " UNION ALL ".join(f"SELECT site, '{i}' AS check_id, '{c}' AS category, '{s}' AS severity FROM s WHERE coalesce({rules.SITE_RULES[i]}, false)" for i, c, s, _ in sitechecks.CHECKS)
    return f"WITH s AS MATERIALIZED (SELECT {facts} FROM customer) {found}"
