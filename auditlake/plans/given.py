"""SQL of the queries on the given pages' own markup.

Their markup is plain (double quotes, no attributes but href on links, four entities), so patterns
read from it what the parser does; that the parser reads other markup rightly is for its tests.
"""

from __future__ import annotations

#: The key of an address without special characters, and of a link on its page.
_KEY = "CASE WHEN regexp_matches(u, '^https?://[^/?]*/?$') THEN regexp_replace(u, '/?$', '/') ELSE regexp_replace(regexp_replace(u, '/$', ''), '/\\?', '?') END"
_PATH = "replace(replace(url_encode(href), '%2F', '/'), '%2C', ',')"
_TABLES = f"""
pk AS MATERIALIZED (SELECT page_id, html, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, {_KEY} AS page_key FROM (SELECT *, regexp_replace(url, '#.*$', '') AS u FROM pages)),
lk AS MATERIALIZED (SELECT page_id, page_key AS src, origin || regexp_replace({_PATH}, '(.)/$', '\\1') AS key FROM (SELECT page_id, page_key, origin, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pk))"""
_PLAIN = "replace(replace(replace(replace(regexp_replace({}, '&amp;?', '&', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<')"
_BODY = "regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style).*?</(script|style)>', '', 'g'), '<[^>]*>', '', 'g')"
ORACLES = {
    "link_summary": f"WITH {_TABLES} SELECT page_id AS from_page, count(*) AS links, count(*) AS internal, CAST(0 AS BIGINT) AS nofollow, count(DISTINCT key) AS targets FROM lk GROUP BY page_id",
    "inbound_links": f"WITH {_TABLES} SELECT key AS page_key, count(*) AS links, count(DISTINCT src) AS sources, count(*) AS followed FROM lk GROUP BY key",
    "orphan_pages": f"WITH {_TABLES} SELECT page_id, page_key FROM pk WHERE NOT regexp_matches(page_key, '^https?://[^/]+/?$') AND page_key NOT IN (SELECT key FROM lk)",
    "duplicate_groups": f"""WITH {_TABLES}, t AS (SELECT page_id, trim(lower({_PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")})) AS title, trim(lower({_PLAIN.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")})) AS h1, trim(regexp_replace({_PLAIN.format(_BODY)}, '\\s+', ' ', 'g')) AS body FROM pk),
k AS MATERIALIZED (SELECT page_id, 'title' AS kind, title AS k FROM t UNION ALL SELECT page_id, 'h1', h1 FROM t UNION ALL SELECT page_id, 'content', substring(lower(body), 1, 2000) FROM t WHERE length(body) > 200)
SELECT page_id, kind, group_size FROM (SELECT *, count(*) OVER (PARTITION BY kind, k) AS group_size FROM k WHERE k <> '') WHERE group_size > 1""",
}
