"""Queries on sitemaps, hosts, histories and merged tables, and their SQL.

Their inputs are made by Spark from the given tables: sitemap files and robots declarations from
the addresses in `pages`, links between pages from the pages themselves, histories from `orders`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.urls import absolute_key, bare_host, host
from auditlake.operators import graph, hosts, merge, sitemaps, slots


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Sitemap files of a site by what its index names: pages by eights, itself again, an index below it, one that is missing, and for some sites very many.
_WIDE = 70


def _sitemap_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sites, declared, files (see sitemaps.sitemap_tree)."""
    pages = _t(spark, sf_dir, "pages").select("page_id", "url", host(F.col("url")).alias("site"))
    sites = pages.select("site").distinct().select("site", F.concat(F.lit("https://"), "site").alias("origin"))
    n = F.length("site")
    at = lambda name: F.concat("origin", F.lit(f"/{name}.xml"))
    declared = sites.where(n % 3 == 0).select("site", F.posexplode(F.array(at("sitemap"), at("gone"), at("sitemap"), at("sitemap_index"))).alias("place", "url"))
    child = F.concat(F.lit("https://"), "site", F.lit("/s"), F.col("k").cast("string"), F.lit(".xml"))
    eights = pages.withColumn("k", F.expr("page_id div 8"))
    sets = eights.groupBy("site", "k").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<url><loc> "), "url", F.lit(" </loc></url>")))), "").alias("locs"))  # eight at most
    body = F.when(F.col("k") % 6 == 5, F.col("locs")).when(F.col("k") % 6 == 4, F.concat(F.lit("<html>"), "locs")).otherwise(F.concat(F.lit("\n<?xml?><urlset>"), "locs", F.lit("</urlset>")))
    files = sets.select(child.alias("url"), F.when(F.col("k") % 7 == 6, 500).otherwise(200).alias("status"), F.when(F.col("k") % 6 == 5, F.concat(F.lit("text "), "locs")).otherwise(body).alias("body"))
    named = sets.groupBy("site").agg(F.array_sort(F.collect_list("k")).alias("ks")).join(sites, "site")  # an index names 50,000 files at most
    loc = lambda x: F.concat(F.lit("<sitemap><loc><![CDATA["), x, F.lit("]]></loc></sitemap>"))
    kids = F.array_join(F.transform("ks", lambda k: loc(F.concat("origin", F.lit("/s"), k.cast("string"), F.lit(".xml")))), "")
    wide = F.when(n % 5 == 0, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(_WIDE)), lambda i: loc(F.concat("origin", F.lit("/x"), i.cast("string"), F.lit(".xml")))), "")).otherwise("")
    top = F.concat(F.lit("<sitemapindex>"), loc(at("deep")), loc(at("sitemap")), kids, loc(at("missing")), wide, F.lit("</sitemapindex>"))
    deep = F.concat(F.lit("<SITEMAPINDEX>"), loc(at("s0")), loc(at("sitemap")), loc(at("deeper")), F.lit("</SITEMAPINDEX>"))
    deeper = F.concat(F.lit("<sitemapindex>"), loc(at("deep")), loc(at("x1")), loc(at("y")), F.lit("</sitemapindex>"))
    many = lambda prefix, k: F.array(*(F.struct(at(f"{prefix}{i}").alias("url"), F.lit("<urlset></urlset>").alias("body")) for i in range(1, k + 1)))
    rest = named.select(F.inline(F.concat(F.array(F.struct(at("sitemap").alias("url"), top.alias("body")), F.struct(at("deep").alias("url"), deep.alias("body")), F.struct(at("deeper").alias("url"), deeper.alias("body")), F.struct(at("y").alias("url"), F.lit("").alias("body"))), F.when(n % 5 == 0, many("x", _WIDE)).otherwise(F.array().cast("array<struct<url:string,body:string>>")))))
    return sites, declared, files.unionByName(rest.select("url", F.lit(200).alias("status"), "body"))


def sitemap_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that counts of every site's sitemaps, in the order of reading."""
    out = sitemaps.sitemap_tree(*_sitemap_inputs(spark, sf_dir))
    return out.select("site", F.col("n").cast("long"), "url", F.col("status").cast("long"), F.col("bytes").cast("long"), "is_index", F.size("urls").cast("long").alias("entries"), "error")


def sitemap_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemaps.tree_membership(sitemaps.sitemap_tree(*_sitemap_inputs(spark, sf_dir)))


def _sites(pages: DataFrame) -> DataFrame:
    """Hosts of the pages and the domains above them, down to the last two labels, as sites."""
    names = pages.select(F.explode(hosts.suffixes(bare_host(F.col("url")))).alias("site")).where("instr(site, '.') > 0").distinct()
    return names.select("site", F.concat(F.lit("https://www."), "site", F.lit("/")).alias("origin"))


def rank_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every page as a keyword of its site: where the site is among eight pages on from it, as results."""
    pages = _t(spark, sf_dir, "pages").select("page_id", "url")
    keywords = pages.select(F.col("page_id").alias("keyword"), bare_host(F.col("url")).alias("site"))
    results = pages.select("page_id", "url", F.posexplode(F.sequence(F.lit(1), F.lit(8))).alias("p", "step")).select((F.col("page_id") - F.col("step") * F.col("step")).alias("keyword"), F.col("step").alias("position"), "url")
    return hosts.rank_hits(results, keywords, _sites(pages))


def backlink_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page to the pages 0, 1, 3 and 6 places on, by the sites they lead to."""
    pages = _t(spark, sf_dir, "pages").select("page_id", "url")
    steps = F.array(*(F.lit(x) for x in (0, 1, 3, 6, 1)))
    to = pages.select(F.col("url").alias("href"), "page_id", F.posexplode(steps).alias("pos", "step")).select("href", "pos", (F.col("page_id") - F.col("step")).alias("page_id"))
    rels = F.array(F.lit("noopener"), F.lit("UGC nofollow"), F.lit("sponsored"), F.lit("ugc"), F.lit(None).cast("string"), F.lit(""))
    mark = (F.col("page_id") + F.col("pos") * 5) % 6
    links = to.join(pages, "page_id").select("page_id", "url", "pos", "href", F.get(rels, mark.cast("int")).alias("rel"), F.concat(F.lit("a"), F.col("pos").cast("string")).alias("anchor"), (F.col("page_id") % 9 == 4).alias("page_nofollow"))
    return hosts.backlink_targets(links, _sites(pages))


def previous_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of a customer before each of its orders, as a site's crawls."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = slots.as_of(o, o, ["o_custkey"], "o_orderdate", lambda at: F.date_trunc("year", at), ["o_orderkey", "o_totalprice"], ["o_orderkey"])
    return out.select("o_orderkey", F.col("as_of.o_orderkey").alias("previous"), F.round(F.col("o_totalprice") - F.col("as_of.o_totalprice"), 4).alias("change"))


def price_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event of a user at or before each whole day, as the state of a monitored site by then."""
    e = _t(spark, sf_dir, "events")
    days = e.select("user_id", F.date_trunc("day", "ts").alias("ts")).distinct()
    out = slots.as_of(days, e.select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", lambda at: F.date_trunc("week", at), ["event_id", "event_type"], ["event_id"], strict=False)
    return out.select("user_id", F.to_date("ts").alias("day"), F.col("as_of.event_id").alias("event_id"), F.col("as_of.event_type").alias("event_type"))


#: Columns of the merged table and how they are merged.
RULES = {"active": "new", "language": "new", "draft": "filled", "created_at": "keep", "used": "add"}


def merged_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as keywords that are added again and again: keys with and without a country, every rule of merging."""
    o = _t(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 500).alias("site"), F.col("o_orderpriority").alias("phrase"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")).alias("country"), (F.col("o_orderkey") % 2).alias("active"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("l"), (F.col("o_orderkey") % 7).cast("string"))).alias("language"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey")).alias("draft"),
        F.col("o_orderdate").alias("created_at"), F.lit(1).cast("long").alias("used"), "o_orderkey",
    )
    keys = ["site", "phrase", "country"]
    old = o.where("o_orderkey % 4 = 0 and country is not null").groupBy(*keys).agg(*(F.max_by(F.struct(c), "o_orderkey")[c].alias(c) for c in RULES))
    return merge.merged(old, o.where("o_orderkey % 4 <> 0"), keys, RULES, ["created_at", "o_orderkey"])


def merged_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page saved of every address: pages of even ids are there, the others are added if absent."""
    p = _t(spark, sf_dir, "pages").select(absolute_key(F.col("url")).alias("url_key"), "page_id", F.octet_length("html").cast("long").alias("raw_bytes"))
    old = p.where("page_id % 2 = 0").groupBy("url_key").agg(F.min(F.struct("page_id", "raw_bytes")).alias("x")).select("url_key", "x.*")
    return merge.absent_added(old, p.where("page_id % 2 = 1").withColumn("at", F.col("page_id")), ["url_key"], ["at"])


def graph_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 300 customers with most orders as nodes, and the links between customers whose orders follow one another."""
    o = _t(spark, sf_dir, "orders")
    nodes = o.groupBy(F.col("o_custkey").alias("node")).agg((F.count("*") / 64).alias("rank"))
    step = o.select("o_orderkey", "o_custkey").join(o.select((F.expr("o_orderkey div 8")).alias("o_orderkey"), F.col("o_custkey").alias("dst")), "o_orderkey")
    return graph.top_graph(nodes, step.select(F.col("o_custkey").alias("src"), "dst"))


QUERIES = {f.__name__: f for f in (sitemap_tree, sitemap_members, rank_hits, backlink_targets, previous_crawl, price_as_of, merged_keywords, merged_snapshots, graph_top)}

_HOST = "lower(regexp_extract({}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_BARE = f"regexp_replace({_HOST}, '^www\\.', '')"
_LOC = "'<sitemap><loc><![CDATA[' || {} || ']]></loc></sitemap>'"
_FILES = f"""
pg AS MATERIALIZED (SELECT page_id, url, {_HOST.format('url')} AS site FROM pages),
si AS MATERIALIZED (SELECT DISTINCT site, 'https://' || site AS o, length(site) AS n FROM pg),
st AS MATERIALIZED (SELECT site, page_id // 8 AS k, string_agg('<url><loc> ' || url || ' </loc></url>', '' ORDER BY '<url><loc> ' || url || ' </loc></url>') AS locs FROM pg GROUP BY ALL),
ix AS (SELECT si.*, (SELECT string_agg({_LOC.format("o || '/s' || k || '.xml'")}, '' ORDER BY k) FROM st WHERE st.site = si.site) AS kids, CASE WHEN n % 5 = 0 THEN (SELECT string_agg({_LOC.format("o || '/x' || i || '.xml'")}, '' ORDER BY i) FROM range(1, {_WIDE + 1}) t(i)) ELSE '' END AS wide FROM si),
fi AS MATERIALIZED (
  SELECT 'https://' || site || '/s' || k || '.xml' AS url, CASE WHEN k % 7 = 6 THEN 500 ELSE 200 END AS status, CASE k % 6 WHEN 5 THEN 'text ' || locs WHEN 4 THEN '<html>' || locs ELSE chr(10) || '<?xml?><urlset>' || locs || '</urlset>' END AS body FROM st
  UNION ALL SELECT o || '/sitemap.xml', 200, '<sitemapindex>' || {_LOC.format("o || '/deep.xml'")} || {_LOC.format("o || '/sitemap.xml'")} || kids || {_LOC.format("o || '/missing.xml'")} || wide || '</sitemapindex>' FROM ix
  UNION ALL SELECT o || '/deep.xml', 200, '<SITEMAPINDEX>' || {_LOC.format("o || '/s0.xml'")} || {_LOC.format("o || '/sitemap.xml'")} || {_LOC.format("o || '/deeper.xml'")} || '</SITEMAPINDEX>' FROM si
  UNION ALL SELECT o || '/deeper.xml', 200, '<sitemapindex>' || {_LOC.format("o || '/deep.xml'")} || {_LOC.format("o || '/x1.xml'")} || {_LOC.format("o || '/y.xml'")} || '</sitemapindex>' FROM si
  UNION ALL SELECT o || '/y.xml', 200, '' FROM si UNION ALL SELECT o || '/x' || i || '.xml', 200, '<urlset></urlset>' FROM si, range(1, {_WIDE + 1}) t(i) WHERE n % 5 = 0),
fp AS MATERIALIZED (SELECT *, octet_length(encode(body)) AS bytes, regexp_matches(body, '(?i)<sitemapindex\\b') AS is_index, list_filter(list_transform(regexp_extract_all(body, '{sitemaps.LOC.replace(chr(39), chr(39) * 2)}', 1), lambda u: trim(u)), lambda u: u <> '') AS urls,
  CASE WHEN status >= 400 THEN 'HTTP ' || status WHEN ltrim(body, ' ' || chr(10)) <> '' AND NOT starts_with(ltrim(body, ' ' || chr(10)), '<') THEN 'not XML' WHEN starts_with(ltrim(body, ' ' || chr(10)), '<') AND NOT regexp_matches(body, '(?i)<(urlset|sitemapindex)\\b') THEN 'missing <urlset> or <sitemapindex> root' END AS error FROM fi),
-- one address a step and site: the queue's first
rd AS (SELECT site, CASE WHEN n % 3 = 0 THEN [o || '/sitemap.xml', o || '/gone.xml', o || '/sitemap_index.xml'] ELSE [o || '/sitemap.xml', o || '/sitemap_index.xml', o || '/sitemap-index.xml'] END AS queue, CASE WHEN n % 3 = 0 THEN [o || '/sitemap.xml', o || '/gone.xml', o || '/sitemap_index.xml'] ELSE CAST([] AS VARCHAR[]) END AS declared FROM si),
wk AS (SELECT 0 AS step, site, queue, declared, CAST([] AS VARCHAR[]) AS seen, CAST([] AS VARCHAR[]) AS got, 0 AS named FROM rd
  UNION ALL SELECT step + 1, site, queue[2:] || fresh, declared, list_append(seen, head), CASE WHEN counts THEN list_append(got, head) ELSE got END, named + len(fresh) FROM (
    SELECT *, CASE WHEN counts AND coalesce(is_index, false) AND named < {sitemaps.MOST_NAMED} THEN list_filter(urls, lambda u: u <> head AND NOT list_contains(seen, u)) ELSE CAST([] AS VARCHAR[]) END AS fresh FROM (
      SELECT wk.*, queue[1] AS head, fp.is_index, fp.urls, NOT list_contains(seen, queue[1]) AND (list_contains(declared, queue[1]) OR (fp.status IS NOT NULL AND fp.status < 400)) AS counts FROM wk LEFT JOIN fp ON fp.url = queue[1] WHERE len(queue) > 0 AND len(got) < {sitemaps.MOST_FILES}))),
fn AS (SELECT site, arg_max(got, step) AS got FROM wk GROUP BY site),
tr AS MATERIALIZED (SELECT site, unnest(range(1, len(got) + 1)) AS n, unnest(got) AS url FROM fn)"""
_SITES = f"sn AS MATERIALIZED (SELECT DISTINCT s AS site FROM (SELECT unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[i:], '.'))) AS s FROM (SELECT string_split({_BARE.format('url')}, '.') AS p FROM pages)) WHERE contains(s, '.'))"
_ON = "({0} = sn.site OR ends_with({0}, '.' || sn.site))"
_REL = "CASE WHEN list_contains(ws, 'nofollow') THEN 'nofollow' WHEN list_contains(ws, 'sponsored') THEN 'sponsored' WHEN list_contains(ws, 'ugc') THEN 'ugc' ELSE 'dofollow' END"
_KEY = r"""CASE WHEN lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) IN ('http', 'https') THEN regexp_replace(regexp_replace(lower(regexp_extract(u, '^([a-zA-Z]+://[^/?]*)', 1)), '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1')
  || CASE WHEN regexp_extract(u, '^[a-zA-Z]+://[^/?]*([^?]*)', 1) IN ('', '/') THEN '/' ELSE regexp_replace(regexp_extract(u, '^[a-zA-Z]+://[^/?]*([^?]*)', 1), '/$', '') END || regexp_extract(u, '^[a-zA-Z]+://[^/?]*[^?]*(\?.+)$', 1) ELSE u END"""
_ORDERS = """SELECT o_custkey % 500 AS site, o_orderpriority AS phrase, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS country, o_orderkey % 2 AS active, CASE WHEN o_orderkey % 3 <> 0 THEN 'l' || (o_orderkey % 7) END AS language,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey END AS draft, o_orderdate AS created_at, o_orderkey FROM orders"""
ORACLES = {
    "sitemap_tree": f"WITH RECURSIVE {_FILES} SELECT tr.site, tr.n, tr.url, CAST(coalesce(status, 0) AS BIGINT) AS status, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes, coalesce(is_index, false) AS is_index, CAST(coalesce(len(urls), 0) AS BIGINT) AS entries, CASE WHEN status IS NULL THEN 'could not be fetched' ELSE error END AS error FROM tr LEFT JOIN fp ON fp.url = tr.url",
    "sitemap_members": f"WITH RECURSIVE {_FILES}, nm AS (SELECT tr.site, tr.url AS sitemap, regexp_replace(unnest(urls), '#.*$', '') AS u FROM tr JOIN fp ON fp.url = tr.url WHERE NOT is_index) SELECT site, {_KEY} AS key, count(DISTINCT sitemap) AS sitemaps FROM nm GROUP BY ALL",
    "rank_hits": f"WITH {_SITES}, k AS (SELECT page_id AS keyword, {_BARE.format('url')} AS site FROM pages), r AS (SELECT page_id - i * i AS keyword, i AS position, url, {_BARE.format('url')} AS h FROM pages, range(1, 9) t(i)), b AS (SELECT k.keyword, k.site, min(position) AS position, arg_min(url, position) AS url FROM k JOIN r ON r.keyword = k.keyword AND (h = k.site OR ends_with(h, '.' || k.site)) GROUP BY ALL) SELECT k.keyword, k.site, CAST(position AS INTEGER) AS position, url FROM k LEFT JOIN b ON b.keyword = k.keyword",
    "backlink_targets": f"""WITH {_SITES}, l AS (SELECT p.page_id, {_BARE.format('p.url')} AS own, pos, {_BARE.format('q.url')} AS h, string_split(lower(coalesce(['noopener', 'UGC nofollow', 'sponsored', 'ugc', NULL, ''][(p.page_id + pos * 5) % 6 + 1], '')), ' ') AS ws, 'a' || pos AS anchor, p.page_id % 9 = 4 AS shut
  FROM (SELECT unnest(range(5)) AS pos, unnest([0, 1, 3, 6, 1]) AS step) s JOIN pages q ON true JOIN pages p ON p.page_id = q.page_id - step),
f AS (SELECT page_id, sn.site, pos, anchor, CASE WHEN shut AND {_REL} = 'dofollow' THEN 'nofollow' ELSE {_REL} END AS rel FROM l JOIN sn ON {_ON.format('h')} WHERE NOT {_ON.format('own')})
SELECT page_id, site, count(*) AS links, arg_min(rel, CASE WHEN rel = 'dofollow' THEN pos ELSE 100 - pos END) AS rel, arg_min(anchor, CASE WHEN rel = 'dofollow' THEN pos ELSE 100 - pos END) AS anchor FROM f GROUP BY ALL""",
    "previous_crawl": "WITH b AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS k, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY ALL) SELECT a.o_orderkey, b.k AS previous, round(a.o_totalprice - b.price, 4) AS change FROM orders a ASOF LEFT JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderdate > b.o_orderdate",
    "price_as_of": "WITH d AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS ts FROM events), b AS (SELECT user_id, ts, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY ALL) SELECT d.user_id, CAST(d.ts AS DATE) AS day, b.event_id, b.event_type FROM d ASOF LEFT JOIN b ON d.user_id = b.user_id AND d.ts >= b.ts",
    "merged_keywords": f"""WITH o AS ({_ORDERS}), old AS (SELECT site, phrase, country, 0 AS nw, arg_max({{'a': active, 'l': language, 'd': draft, 'c': created_at}}, o_orderkey) AS x FROM o WHERE o_orderkey % 4 = 0 AND country IS NOT NULL GROUP BY site, phrase, country),
a AS (SELECT site, phrase, country, 0 AS nw, CAST(NULL AS TIMESTAMP) AS tm, CAST(0 AS BIGINT) AS k, x.a AS active, x.l AS language, x.d AS draft, x.c AS created_at FROM old UNION ALL SELECT site, phrase, country, 1, created_at, o_orderkey, active, language, draft, created_at FROM o WHERE o_orderkey % 4 <> 0),
r AS (SELECT *, row_number() OVER w AS first, row_number() OVER v AS last, last_value(draft IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS filled, first_value(created_at) OVER w AS kept, count(*) OVER (PARTITION BY site, phrase, country) AS used FROM a WHERE country IS NOT NULL WINDOW w AS (PARTITION BY site, phrase, country ORDER BY nw, tm, k), v AS (PARTITION BY site, phrase, country ORDER BY nw DESC, tm DESC, k DESC))
SELECT site, phrase, country, active, language, filled AS draft, kept AS created_at, used FROM r WHERE last = 1 UNION ALL SELECT site, phrase, country, active, language, draft, created_at, 1 FROM a WHERE country IS NULL""",
    "merged_snapshots": f"WITH p AS (SELECT page_id, octet_length(encode(html)) AS raw_bytes, {_KEY} AS url_key FROM (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u FROM pages)) SELECT url_key, page_id, raw_bytes FROM p QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY page_id % 2, page_id) = 1",
    "graph_top": f"""WITH t AS (SELECT o_custkey AS node, row_number() OVER (ORDER BY count(*) DESC, o_custkey) - 1 AS at FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT {graph.PICTURED})
SELECT DISTINCT CAST(s.at AS INTEGER) AS from_at, CAST(d.at AS INTEGER) AS to_at, a.o_custkey AS src, b.o_custkey AS dst FROM orders a JOIN orders b ON b.o_orderkey // 8 = a.o_orderkey JOIN t s ON s.node = a.o_custkey JOIN t d ON d.node = b.o_custkey WHERE a.o_custkey <> b.o_custkey""",
}
